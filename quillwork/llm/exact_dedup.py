"""Exact deduplication by a content sort.

Texts are ordered by a bounded prefix, then by a hash, the text and the identifier. Sampled splitters (Spark's range exchange)
deal that order out to partitions, each partition sorts externally, and a stream over the sorted rows compares each text
with the one before it in full. The identifier is part of the splitters' key, so a text that a third of all rows share
spreads over many partitions; its runs are put together again from the first and the last run of each partition, a table
of two rows a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Characters of a text that take part in the splitters' key; what follows is ordered by a hash of 64 bits, so that the
#: sample of keys that splitters are drawn from is small. Texts of equal hashes are told apart by the sort and the comparison.
PREFIX = 16
RUN_SCHEMA = "_n bigint, _top bigint, _last boolean, _part int, _run bigint, _edge boolean"


def _sorted(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Rows with _i (identifier), _t (text, null as empty) and _d (digest); equal texts adjacent, by identifier."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, F.col(id_col).cast("long").alias("_i"), t.alias("_t"), F.sha2(F.encode(t, "UTF-8"), 256).alias("_d"))
    key = [F.substring("_t", 1, PREFIX), F.xxhash64("_t"), F.col("_i").asc_nulls_first()]
    return rows.repartitionByRange(*key).sortWithinPartitions(*key[:2], "_t", key[2])


def _runs(columns: list[str], survivors: bool):
    """Streams sorted rows and adds what RUN_SCHEMA names: a run's size, largest identifier, place, and whether it is its
    partition's first or last one. With ``survivors`` only each run's last row comes out, and only it is held."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, run, before, text = TaskContext.get().partitionId(), -1, 0, None
        held: list[pa.RecordBatch] = []

        def closed(rows: list[pa.RecordBatch], number: np.ndarray, before: int, ends: bool) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(rows)
            last = np.flatnonzero(np.diff(number, append=number[-1] + 1))
            size = np.diff(last, prepend=-1)
            size[0] += before
            of = np.repeat(np.arange(len(last)), np.diff(last, prepend=-1))
            is_last = np.zeros(len(number), bool)
            is_last[last] = True
            top = whole.column("_i").take(pa.array(last[of]))
            edge = (number == 0) | (ends & (number == number[-1]))
            columns_ = [*whole.columns, pa.array(size[of]), top, pa.array(is_last), pa.array(np.full(len(number), part, np.int32)), pa.array(number), pa.array(edge)]
            out = pa.table(columns_, names=[*columns, *(x.split()[0] for x in RUN_SCHEMA.split(", "))])
            yield from (out.filter(pa.array(is_last)) if survivors else out).combine_chunks().to_batches()

        def shortened() -> None:
            nonlocal before, held
            before += sum(x.num_rows for x in held) - 1
            held = [held[-1].slice(held[-1].num_rows - 1)]

        for batch in batches:
            if not batch.num_rows:
                continue
            texts = np.array([text, *batch.column(batch.schema.get_field_index("_t")).to_pylist()], dtype=object)
            fresh = texts[1:] != texts[:-1]
            text, slim = texts[-1], batch.select(columns)
            at = np.flatnonzero(fresh)
            if not len(at):
                held.append(slim)
            else:
                number = run + np.cumsum(fresh)
                cut, open_ = int(at[-1]), sum(x.num_rows for x in held)
                if open_ + cut:
                    yield from closed([*held, slim.slice(0, cut)], np.concatenate([np.full(open_, run), number[:cut]]).astype(np.int64), before, False)
                run, held, before = int(number[-1]), [slim.slice(cut)], 0
            if survivors:
                shortened()
        if held:
            n = sum(x.num_rows for x in held)
            yield from closed(held, np.full(n, run, np.int64), before, True)

    return read


def _stitched(edges: DataFrame) -> DataFrame:
    """For each partition's first and last run: the totals of its text over all partitions, and whether it is the last.

    ``edges`` has two rows a partition at most, so a window may look at all of them together.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("_part", "_run")
    fresh = F.coalesce(F.lag("_d").over(order) != F.col("_d"), F.lit(True)).cast("long")
    chained = edges.withColumn("_fresh", fresh).withColumn("_chain", F.sum("_fresh").over(order))
    whole = Window.partitionBy("_chain")
    place = F.struct("_part", "_run")
    return chained.select("_part", "_run", F.sum("_n").over(whole).alias("_all"), F.max("_top").over(whole).alias("_all_top"),
                          (F.max(place).over(whole) == place).alias("_final"))


def memberships(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the row with the largest identifier stays. Null identifiers are the
    smallest, so such a row stays only where its group has no other (``keep_id`` is then null). Where rows repeat with the
    same identifier and text, ``kept`` is true for one of them. Other columns aren't looked at; no rows give no rows.
    """
    common.tune(docs.sparkSession)
    rows = _sorted(docs, id_col, text_col, [])
    found = common.cut(rows.mapInArrow(_runs(["_i", "_d"], False), f"_i bigint, _d string, {RUN_SCHEMA}"))
    edges = found.where("_edge AND _last").select("_part", "_run", "_d", "_n", "_top")
    return found.join(F.broadcast(_stitched(edges)), ["_part", "_run"], "left").select(
        F.col("_i").alias("doc_id"), F.coalesce("_all_top", "_top").alias("keep_id"), F.coalesce("_all", "_n").alias("group_size"),
        (F.col("_last") & F.coalesce("_final", F.lit(True))).alias("kept"), F.col("_d").alias("text_sha256"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns and as they are; which, says ``memberships``."""
    common.tune(docs.sparkSession)
    inner = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*inner)
    own = {c: i for c, i in zip(docs.columns, inner, strict=True)}
    rows = _sorted(named, own[id_col], own[text_col], inner)
    kinds = ", ".join(f"{i} {t}" for i, t in named.dtypes)
    found = common.cut(rows.mapInArrow(_runs([*inner, "_i", "_d"], True), f"{kinds}, _i bigint, _d string, {RUN_SCHEMA}"))
    gone = _stitched(found.where("_edge").select("_part", "_run", "_d", "_n", "_top")).where("NOT _final")
    return found.join(F.broadcast(gone), ["_part", "_run"], "left_anti").select(*(F.col(i).alias(c) for c, i in own.items()))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their group of equal texts, as ``memberships`` says of nulls, ties and repeated rows; an empty table
    gives no rows."""
    return memberships(common.table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
