"""Each stage of the pipeline against a brute-force version, on its own input."""

import hashlib

import corpus_pipeline as C
from quillwork.llm import common, toxicity

from .test_operators import _groups


def test_stages(spark, sf_dir, tmp_path):
    docs, columns = common.table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(C.STAGES):
        columns = columns or docs.columns
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            score = {r.doc_id: r.score for r in toxicity.scored(common.table(spark, sf_dir, "documents"), toxicity.model(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")), ["doc_id"]).collect()}
            assert {r.doc_id for r in rows} == {d for d in before if score[d] < 0.5} and len(rows) > 0.7 * len(before)
            assert all(r == before[r.doc_id] for r in rows)
        elif name == "exact_dedup":
            keep = {}
            for d, r in before.items():
                h = hashlib.sha256((r.text or "").encode()).digest()
                keep[h] = max(keep.get(h, -1), d)
            assert {r.doc_id for r in rows} == set(keep.values()) and all(r == before[r.doc_id] for r in rows)
        elif name == "near_dedup":
            groups = _groups([(d, r.text) for d, r in before.items()])
            assert {r.doc_id for r in rows} == set(groups.values())
        elif name == "secret_scan":
            assert {r.doc_id for r in rows} == set(before)
            changed = [r for r in rows if r.text != before[r.doc_id].text]
            assert all("[SECRET]" in r.text and r.n_chars == len(r.text) for r in changed)
        else:
            assert {r.doc_id for r in rows} == set(before) and sum(r.length for r in rows if r.start == 0) > 0


def test_run_gives_the_last_stage(spark, sf_dir):
    assert set(C.run(spark, sf_dir).columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}


def test_stages_take_odd_tables(spark, sf_dir):
    """Nulls in any column, empty and long texts, repeated rows, clashing names; and no rows."""
    rows = [(1, None, None, None, None, 1.0), (2, "", "en", "s", 0, None), (3, "word " * 30_000, "en", "s", 5, 0.2), (4, "same text here", None, "s", 14, 0.1), (4, "same text here", None, "s", 14, 0.1),
            (None, "token: abcdefghijkl99", "en", None, None, None), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    for df in (docs, docs.where("1 = 0")):
        n = df.count()
        for name, stage in C.STAGES:
            df = common.cut(stage(spark, df, sf_dir))
            if name != "packing":
                assert df.columns == docs.columns
            if name == "exact_dedup":
                assert df.count() == (4 if n else 0)  # null and empty texts are one
        assert (df.count() > 0) == (n > 0)
