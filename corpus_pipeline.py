"""A corpus pipeline: toxic documents go, copies and near copies go, secrets are taken out, what stays is packed.

Each stage takes (spark, docs, sf_dir), decides over all of ``docs``, and returns the columns of documents; the last one
returns the packed pieces. Between stages the table is written and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import common, exact_dedup, near_dedup, packing, secret_scan, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.5; the model learns from the labelled ones among ``docs``. Columns keep their names
    even where they are called as the score is. Null and empty texts aren't toxic; rows that repeat go or stay together; no
    rows give none."""
    weights = toxicity.model(docs, common.table(spark, sf_dir, "labels"))
    own = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    kept = toxicity.scored(own, weights, own.columns, own.columns[docs.columns.index("text")]).where("score < 0.5")
    return kept.select(*own.columns).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null as empty), the row with the largest identifier, null identifiers counting as the smallest; of rows
    that repeat one stays; no rows give none."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the rows with the least identifier. Rows without an identifier stay; texts without words
    are alike only if they are equal; no rows give none."""
    return near_dedup.survivors(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in each secret's place and n_chars counted again (null for a null text). Overlapping secrets
    are one; rows that repeat change alike; no rows give none."""
    clean = secret_scan.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens; a null text is the end id alone, rows that repeat are documents of their own, no
    rows give no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("secret_scan", redact_secrets), ("packing", pack)]
#: SQL has no trained models, signatures or subset sums. Tests hold both deduplications against brute force; the other stages'
#: operators are held against it in their own tests, the stages only by what they keep and change.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
