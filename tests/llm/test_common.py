"""Hashing primitives against plain Python, and odd tables through every operator."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillwork.llm import bpe, common, exact_dedup, license_scan, media, near_dedup, packing, pii, quality, secret_scan, toxicity

LONG = "wort " * 40_000 + "ende"
TEXTS = ["", None, " ", "\n", "a", "Hello, world. idiot!", "Hello, world. idiot!", "ünïcödé 日本語 😀", "password = 'abcdefghijkl12' +1 (555) 123-4567", LONG, "x" * 70_000]


def test_word_hashes_depend_on_words_only():
    a = common.word_table(["Das ist ein Haus".encode(), b"ein HAUS"])
    assert a.doc.tolist() == [0, 0, 0, 0, 1, 1]
    assert a.hash[2:4].tolist() == a.hash[4:6].tolist() and len(set(a.hash.tolist())) == 4
    h, at = common.grams(a.hash, a.doc, 2)
    assert at.tolist() == [0, 1, 2, 4] and h[2] == h[3]


def test_slices_hold_everything():
    got = [x for _, raw in common.slices(["ab", "", "c" * 50, "d"], 10) for x in raw]
    assert got == [b"ab", b"", b"c" * 50, b"d"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with what operators use."""
    rows = [(i, t, "src", None, i) for i, t in enumerate(TEXTS)] + [(3, "\n", "src", 1, 2), (3, "\n", "src", 1, 2), (None, "a", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, _row int, id int").repartition(3)


W = np.zeros((1 << toxicity.BITS) + 1)
Q = np.zeros((1 << quality.BITS) + 1)
OPERATORS = {
    "packing": lambda d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.json")),
    "toxicity": lambda d: toxicity.scored(d, W, ["doc_id", "score", "_row"]).toDF("doc_id", "a", "b", "score", "offending"),
    "media": lambda d: media.stored(d),
    "license": lambda d: license_scan.scan(d),
    "pii": lambda d: pii.scan(d),
    "exact": lambda d: exact_dedup.memberships(d),
    "survivors": lambda d: exact_dedup.survivors(d),
    "bpe": lambda d: bpe.round_trip(d, public_tokenizers.path("byte_bpe_50k.tiktoken")),
    "quality": lambda d: quality.scored(d, Q, ["doc_id"]),
    "near": lambda d: near_dedup.near_duplicates(d),
    "near_survivors": lambda d: near_dedup.survivors(d),
    "secrets": lambda d: secret_scan.spans(d),
    "redacted": lambda d: secret_scan.redacted(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(odd, name):
    rows = OPERATORS[name](odd).collect()
    if name == "packing":
        assert sum(r.start == 0 for r in rows) == len(TEXTS) + 4
    elif name == "survivors":
        assert len(rows) == len({t or "" for t in TEXTS})
    elif name == "near_survivors":
        assert {r.doc_id for r in rows if r.doc_id is not None} <= set(range(len(TEXTS))) and sum(r.doc_id is None for r in rows) == 2
    else:
        assert len(rows) == len(TEXTS) + 4
    if name in ("survivors", "near_survivors", "redacted"):
        assert set(rows[0].asDict()) == {"doc_id", "text", "score", "_row", "id"}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(odd, name):
    assert OPERATORS[name](odd.where("1 = 0")).collect() == []


def test_exact_dedup_defines_ties(odd):
    rows = exact_dedup.memberships(odd).collect()
    same = [r for r in rows if r.text_sha256 == hashlib.sha256(b"\n").hexdigest()]
    assert len(same) == 3 and {(r.keep_id, r.group_size) for r in same} == {(3, 3)} and sum(r.kept for r in same) == 1
    a = [r for r in rows if r.text_sha256 == hashlib.sha256(b"a").hexdigest()]
    assert sorted((r.doc_id or -1, r.kept) for r in a) == [(-1, False), (4, True)]
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in empty} == {1} and len(empty) == 3


def test_exact_dedup_stitches_runs_over_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 500).cast("string"))).alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rows = exact_dedup.memberships(df).collect()
        kept = {r.doc_id for r in exact_dedup.survivors(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    hot = [r for r in rows if r.doc_id % 3 == 0]
    assert {(r.keep_id, r.group_size) for r in hot} == {(2997, 1000)} and [r.doc_id for r in hot if r.kept] == [2997]
    assert kept == {r.doc_id for r in rows if r.kept} and len(kept) == len({r.text_sha256 for r in rows})
