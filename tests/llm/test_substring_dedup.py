"""Repeated passages against counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.llm import catalog, common, substring_dedup

W = substring_dedup.WINDOW


def brute(texts):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + W]) for w in words for i in range(len(w) - W + 1))
    out = []
    for w in words:
        drop = [False] * len(w)
        for i in range(len(w) - W + 1):
            if count[tuple(w[i : i + W])] > 1:
                drop[i : i + W] = [True] * W
        out.append((len(w), sum(drop), hashlib.sha256(b" ".join(x for x, d in zip(w, drop, strict=True) if not d)).hexdigest()))
    return out


def _texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeé", k=4)) for _ in range(60)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = [prose(n) for n in (34, 35, 36, 47, 60, 200)]
    texts = [prose(20) + " " + rng.choice(shared) + " " + prose(rng.randrange(40)) for _ in range(60)]
    texts += [shared[4].rsplit(" ", k)[0] + " " + prose(9) for k in (1, 5, 12, 24, 25, 26)]
    texts += [shared[5]] * 9 + [shared[5].replace(" ", "\x0b\n ")]
    texts += ["a " * 34, "a " * 35, "a " * 36, "b " * 500, "c d " * 60, "e f g " * 12, prose(3000), shared[0] + " x " + shared[1] + "  " + shared[1]]
    texts += ["", None, " \n", " ".join(shared[2].split()), prose(35), "wort " * 30_000 + "ende"]
    return texts


@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_removed_words_are_those_of_repeated_windows(spark, partitions):
    texts = _texts()
    docs = spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(texts)], "doc_id long, text string, start string, _k int").repartition(5)
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = substring_dedup.without_repeats(docs).withColumn("h", F.sha2(F.encode("kept", "UTF-8"), 256)).sort("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.enabled", was[1])
    assert [(r.n_words, r.n_removed, r.h) for r in rows] == brute(texts)


def test_odd_tables(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (1, long), (None, long + " end"), (None, None), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substring_dedup.without_repeats(docs).collect())
    assert got == [(0, 0, 0, ""), (0, 41, 40, "end"), (1, 40, 40, ""), (1, 40, 40, ""), (2, 0, 0, ""), (3, 0, 0, "")]
    assert substring_dedup.without_repeats(docs.where("1 = 0")).collect() == []


def test_least_of_runs_takes_the_leftmost():
    h = np.array([5, 3, 3, 9, 1, 1, 7, 2, 8, 8], np.uint64)
    for width in range(1, 11):
        assert substring_dedup.least_of_runs(h, width).tolist() == [i + int(np.argmin(h[i : i + width])) for i in range(len(h) - width + 1)]


def test_spans_hash_by_content():
    w = common.word_table([b"a b c a b c x", b"b c a"], substring_dedup.KIND, lower=False)
    s = substring_dedup.Spans(w.hash)
    h = s.hashes(np.array([0, 3, 1, 7, 2]), 3, 1)
    assert h[0] == h[1] and h[2] == h[3] and len(set(h.tolist())) == 3


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").sort("doc_id").collect()
    rows = sorted(catalog.QUERIES["op11_substring_dedup"](spark, sf_dir).collect())
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in rows] == brute([d.text for d in docs])
