"""Runs against looking at every period, and the query against plain Python."""

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.llm import catalog, periodic_runs


def brute(words):
    """All maximal stretches of every period that are long enough; of the same stretch the smallest period."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 9), st.integers(0, 2)), max_size=8), max_size=4), st.randoms())
def test_runs_against_every_period(plans, rng):
    texts = []
    for plan in plans:
        words = []
        for period, times, noise in plan:
            unit = [rng.choice([b"a", b"b", b"c"]) for _ in range(period)]
            words += unit * times + [b"x%d" % rng.randrange(3) for _ in range(noise)]
        texts.append(words)
    assert periodic_runs.found_in(texts) == [brute(t) for t in texts]


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_random_texts_of_few_words(letters):
    rng = random.Random(letters)
    for n in [0, 1, 23, 24, 25, 47, 48, 49, *(rng.randrange(400) for _ in range(60))]:
        words = [b"%d" % rng.randrange(letters) for _ in range(n)]
        assert periodic_runs.found_in([words]) == [brute(words)]


def test_texts_whose_power_sums_collide():
    """Thue and Morse's sequence gives unequal blocks equal sums from 1024 words on; results hold all the same."""
    s = [0]
    while len(s) < 2048:
        s += [1 - x for x in s]
    t = [b"%d" % x for x in s]
    for words in (t[:1024] + [b"z"] + t[1024:], (t[:1024] * 3 + t[1024:]), t[:1000] * 4):
        got = periodic_runs.found_in([words])[0]
        array = np.array([int(w) if w != b"z" else 2 for w in words])
        for a, n, q in got:
            assert np.array_equal(array[a : a + n - q], array[a + q : a + n]) and n >= max(24, 3 * q)
            assert a == 0 or array[a - 1] != array[a - 1 + q]
            assert a + n == len(words) or array[a + n] != array[a + n - q]
    assert (0, 4000, 1000) in periodic_runs.found_in([t[:1000] * 4])[0]


def test_overlap_is_the_least_of_all_runs():
    assert periodic_runs.OVERLAP == min(max(24, 3 * q) - q for q in range(1, 500)) == 16


def test_time_of_long_texts():
    begun = time.time()
    assert periodic_runs.found_in([[b"wort"] * 100_000])[0] == [(0, 100_000, 1)]
    rng = random.Random(0)
    lines = [[b"%d" % rng.randrange(9) for _ in range(9)] for _ in range(5)]
    periodic_runs.found_in([[w for _ in range(11_000) for w in rng.choice(lines)]])
    assert time.time() - begun < 60


def plain(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert any(zlib.crc32(str(d.doc_id).encode()) % 10 == 0 for d in docs)
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = catalog.QUERIES["op12_periodic_runs"](spark, sf_dir).select(*columns).collect()
    short = {d.doc_id: d.text for d in docs if len((d.text or "").split()) < 1500}
    assert len(rows) == len(docs) and len(short) > 100
    assert sorted(tuple(r) for r in rows if r.doc_id in short) == sorted(plain(i, t) for i, t in short.items())


def test_odd_tables(spark):
    rows = [(None, "a " * 30, 1), (1, None, 2), (2, "", 2), (2, "", 2), (3, "\x0b \n", 1), (4, "a b\x0c" * 14 + "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in periodic_runs.scan(docs).collect())
    assert got == [(0, [(0, 30, 1)], (0, 30, 1), "a"), (1, [], None, ""), (2, [], None, ""), (2, [], None, ""), (3, [], None, ""), (4, [(0, 28, 2)], (0, 28, 2), "a b c")]
    assert periodic_runs.scan(docs.where("1 = 0")).collect() == []
    for doc_id in (None, 1, 25):
        for text in (None, "", "x y z"):
            one = spark.createDataFrame([(doc_id, text)], "d long, t string").select(periodic_runs.planted(F.col("d"), F.col("t")).alias("t")).first().t
            assert one == text or zlib.crc32(str(doc_id).encode()) % 10 == 0
