"""The index of postings against scanning the texts."""

import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quillwork.operators import postings as P
from quillwork.operators import retrieval as Q
from quillwork.plans import search
from quillwork.sources import shared

TEXTS = {1: "Red green red, blue.", 2: "green RED of the sea", 3: None, 4: "", 5: "the of the of the", 6: "Ёлка ёлка redder", 7: "of, the! red" + " x" * 50}


def made(spark, texts, path):
    index = P.Index(spark, path, 8, 3)
    index.replace(spark.createDataFrame(list(texts.items()), "id long, text string"))
    return index


def test_scores_are_those_of_a_scan(spark):
    index = made(spark, TEXTS, shared.folder(spark, "index-test"))
    docs = spark.createDataFrame(list(TEXTS.items()), "id long, text string").fillna("")
    for terms, phrases in ((["red"], []), (["red", "green", "nowhere"], []), (["red"], [("of", "the")]), (["the"], [("of", "the"), ("the", "of")]), (["елка"], [])):
        want = {r.id: round(r.score, 9) for r in Q.lexical(docs, "id", "text", terms, phrases).collect() if r.score > 0}
        assert {r.id: round(r.score, 9) for r in index.scored(terms, phrases).collect()} == want
    assert {r.id: r.tf for r in index.prefixed("red").collect()} == {1: 2, 2: 1, 6: 1, 7: 1}
    assert index.scored(["absent"]).collect() == [] and index.prefixed("q").collect() == []


def test_postings_have_every_place(spark):
    index = made(spark, TEXTS, shared.folder(spark, "index-test"))
    got = {(r.id, r.term): (r.tf, r.length, list(r.places)) for r in index.spark.read.parquet(f"{index.path}/postings").where("term IS NOT NULL").collect()}
    want = {}
    for i, t in TEXTS.items():
        ts = re.findall("[0-9a-zа-я]+", (t or "").lower().replace("ё", "е"))
        for term, n in Counter(ts).items():
            want[i, term] = (n, len(ts), [k for k, x in enumerate(ts) if x == term])
    assert got == want


def test_a_slice_is_replaced_and_others_stay(spark):
    path = shared.folder(spark, "index-test")
    index = made(spark, TEXTS, path)
    slices = {r.id: r.s for r in spark.createDataFrame([(i,) for i in TEXTS], "id long").select("id", index.slice_of(F.col("id")).alias("s")).collect()}
    changed = {i: "new red words" if i == 1 else t for i, t in TEXTS.items() if slices[i] == slices[1]}
    index.replace(spark.createDataFrame(list(changed.items()), "id long, text string"))
    again = made(spark, TEXTS | changed, shared.folder(spark, "index-test"))
    for terms in (["red", "new"], ["green"], ["blue"]):
        key = lambda i: sorted((r.id, round(r.score, 9)) for r in i.scored(terms).collect())  # noqa: B023, E731
        assert key(index) == key(again)
    assert index.with_prefix("blu").collect() == again.with_prefix("blu").collect() == []


def test_only_the_terms_buckets_are_read(spark, sf_dir):
    index = search.document_index(spark, sf_dir)
    assert search.document_index(spark, sf_dir) == index  # it is there: nothing is built
    plan = index.scored(search.TERMS)._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan
    wanted = {zlib.crc32(t.encode()) % P.BUCKETS for t in search.TERMS}
    filters = set(re.findall(r"PartitionFilters: \[bucket#\d+ (?:IN|INSET) ([\d,]+)\]|PartitionFilters: \[[^\]]*bucket#\d+ IN \(([\d,]+)\)", plan))
    assert filters and {int(x) for f in filters for y in f if y for x in y.split(",")} == wanted
    assert "PushedFilters: [In(term" in plan and "places" not in re.findall(r"ReadSchema: (\S+)", plan)[0]
