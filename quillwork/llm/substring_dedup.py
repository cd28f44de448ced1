"""Repeated passages by seed and extend.

Seeds. Each window of WINDOW words has an anchor: of its runs of SEED words the one with the least hash, the leftmost of
equal ones. Equal windows have equal anchors at equal places, so places of a repeat meet at their anchor; neighbouring
windows mostly share theirs. The windows that share one anchor are its *block*.

Extension. Places of an anchor are brought together by a sort on (anchor, block), not by pairs. An anchor that stands nowhere
else ends there. Places whose whole blocks are equal match as far as their windows go, in both directions, so all words
of the block are in repeats. A place whose block stands alone, but whose anchor doesn't, is at the edge of a repeat: the
anchor is extended both ways over each window of the block, one place for each different block, and the extensions meet
in a second sort on (anchor, window). What matches is the whole of the maximal repeats over WINDOW words, since each of their
windows has its anchor. A passage that a third of all rows share is that many rows of a sort, cut between partitions
anywhere; nothing grows with the square of its places.

Equality is that of two 64-bit hashes (of the anchor, and of the block or window around it), made of the words' hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words of a window, and of the runs that anchors are chosen from.
WINDOW, SEED = 35, 12
#: Bytes of words: all but the space and 9 to 13.
KIND = np.ones(256, bool)
KIND[[32, *range(9, 14)]] = False
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Spans:
    """Hashes of any runs of words, from sums of the words' hashes times powers of an odd number."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        powers = np.full(n + 1, _BASE, np.uint64)
        powers[0] = 1
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * np.cumprod(powers[:n]), dtype=np.uint64)])
        powers[1:] = _INVERSE
        self.inverse = np.cumprod(powers)

    def hashes(self, start: np.ndarray, size: np.ndarray | int, kind: int) -> np.ndarray:
        h = (self.sums[start + size] - self.sums[start]) * self.inverse[start]
        return common.mix(h + np.asarray(size).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(kind))


def least_of_runs(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the index of the least, the leftmost of equal ones."""
    best, span = np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        a, b = best[: max(len(best) - step, 0)], best[step:]
        best, span = np.where(h[b] < h[a], b, a), span + step
    return best


def anchored(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of a slice of texts, the blocks: text, first word (within the text), number of windows, hash of the anchor, hash of the
    block; and for windows: ``Spans`` and each text's first word."""
    w = common.word_table(raw, KIND, lower=False)
    spans = Spans(w.hash)
    base = np.searchsorted(w.doc, np.arange(len(raw)))
    n = len(w.doc) - WINDOW + 1
    if n <= 0:
        return (*(np.zeros(0, np.int64),) * 3, *(np.zeros(0, np.uint64),) * 2, spans, base)
    seed = spans.hashes(np.arange(len(w.doc) - SEED + 1), SEED, 1)
    at = np.flatnonzero(w.doc[:n] == w.doc[WINDOW - 1 :])
    anchor = least_of_runs(seed, WINDOW - SEED + 1)[at]
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    windows = np.diff(np.append(first, len(at)))
    start = at[first]
    text = w.doc[start]
    return text, start - base[text], windows, seed[anchor[first]], spans.hashes(start, windows + WINDOW - 1, 2), spans, base


_ROWS = "start int, windows int, anchor bigint, inner bigint"


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_i", "_k", *(x.split()[0] for x in _ROWS.split(", "))]
    for batch in batches:
        for at, raw in common.slices(common.strings(batch.column(2))):
            text, start, windows, anchor, block, *_ = anchored(raw)
            rows = pa.array(text + at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), _signed(anchor), _signed(block)], names=names)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the blocks that ``edges`` (first word, number of windows, alone) names, as rows of one window each."""
    names = ["_i", "_k", *(x.split()[0] for x in _ROWS.split(", ")), "alone"]
    for batch in batches:
        edges = batch.column(3).to_pylist()
        for at, raw in common.slices(common.strings(batch.column(2))):
            text, start, windows, anchor, _, spans, base = anchored(raw)
            named = [{x["start"]: x["alone"] for x in edges[at + i]} for i in range(len(raw))]
            alone = np.array([named[t].get(s, -1) for t, s in zip(text.tolist(), start.tolist(), strict=True)], np.int8)
            use = np.flatnonzero(alone >= 0)
            of = np.repeat(use, windows[use])
            place = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(windows[use]) - windows[use], windows[use])
            rows = pa.array(text[of] + at)
            h = spans.hashes(base[text[of]] + place, WINDOW, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place.astype(np.int32)), pa.array(np.ones(len(of), np.int32)), _signed(anchor[of]), _signed(h), pa.array(alone[of] == 1)], names=names)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows: before and after (how many of anchor and inner are as in the neighbouring row; null beyond the
    partition), part. Rows whose anchor no neighbour has are left out, except at the partition's borders."""
    from pyspark import TaskContext

    part, held, before = TaskContext.get().partitionId(), None, None

    def same(a: np.ndarray, i: np.ndarray) -> np.ndarray:
        return ((a[1:] == a[:-1]) * (1 + (i[1:] == i[:-1]))).astype(np.int8)

    def told(rows: pa.RecordBatch, before: int | None, last: bool) -> pa.RecordBatch:
        """All rows but the last one, or with it."""
        link = same(rows.column("anchor").to_numpy(), rows.column("inner").to_numpy())
        n = rows.num_rows if last else rows.num_rows - 1
        b = pa.array(np.concatenate([[before or 0], link])[:n], pa.int8(), mask=np.arange(n) == (0 if before is None else n))
        a = pa.array(np.concatenate([link, [0]])[:n], pa.int8(), mask=np.arange(n) == rows.num_rows - 1)
        out = pa.RecordBatch.from_arrays([*rows.slice(0, n).columns, b, a, pa.array(np.full(n, part, np.int32))], names=[*rows.schema.names, "before", "after", "part"])
        keep = np.concatenate([[before is None or before > 0], link > 0])[:n] | np.concatenate([link > 0, [True]])[:n]
        return out.filter(pa.array(keep))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        yield told(rows, before, False)
        if rows.num_rows > 1:
            tail = rows.slice(rows.num_rows - 2)
            before = int(same(tail.column("anchor").to_numpy(), tail.column("inner").to_numpy())[0])
        held = rows.slice(rows.num_rows - 1)
    if held is not None:
        yield told(held, before, True)


def met(rows: DataFrame) -> DataFrame:
    """Rows whose anchor another row has too, with before and after: 1 where the neighbour in the order of (anchor, inner) has
    the anchor only, 2 where it has inner too.

    A sampled range order in which the identifier and the place take part, so that equal rows may lie in several partitions;
    what partitions can't see are their neighbours' border rows, two a partition, which are put together afterwards.
    """
    key = ["anchor", "inner", "_k", "start"]
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    found = common.cut(rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_compared, f"{kinds}, before tinyint, after tinyint, part int"))
    border = found.where("before IS NULL OR after IS NULL").select("part", "anchor", "inner", F.col("before").isNull().alias("_first"), F.col("after").isNull().alias("_last"))
    order = Window.partitionBy(F.lit(0)).orderBy("part", F.col("_first").desc())
    level = lambda step: F.when(step("anchor").over(order) == F.col("anchor"), 1 + (step("inner").over(order) == F.col("inner")).cast("int")).otherwise(0)
    border = border.select("part", "_first", "_last", level(F.lag).alias("_before"), level(F.lead).alias("_after"))
    first = F.broadcast(border.where("_first").select(F.col("part").alias("_p"), "_before"))
    last = F.broadcast(border.where("_last").select(F.col("part").alias("_q"), "_after"))
    whole = found.join(first, (F.col("part") == F.col("_p")) & F.col("before").isNull(), "left").join(last, (F.col("part") == F.col("_q")) & F.col("after").isNull(), "left")
    return whole.select(*rows.columns, F.coalesce("before", "_before").alias("before"), F.coalesce("after", "_after").alias("after")).where("before > 0 OR after > 0")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` that has words in repeated windows: _i (identifier), _k (hash of identifier and text), spans
    (first word and the word after the last, not merged)."""
    common.tune(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    kind = dict(rows.dtypes)["_i"]
    seeds = met(rows.mapInArrow(_seeds, f"_i {kind}, _k bigint, {_ROWS}"))
    whole = seeds.where("before = 2 OR after = 2").select("_i", "_k", "start", (F.col("start") + F.col("windows") + WINDOW - 1).alias("end"))
    edges = seeds.where("before = 1 OR after = 1").select("_i", "_k", F.struct("start", (F.greatest("before", "after") < 2).cast("tinyint").alias("alone")).alias("edge"))
    edges = edges.groupBy("_i", "_k").agg(F.collect_list("edge").alias("edges"))
    windows = _with(rows, edges, "inner").mapInArrow(_windows, f"_i {kind}, _k bigint, {_ROWS}, alone boolean")
    single = met(windows).where("alone AND (before = 2 OR after = 2)").select("_i", "_k", "start", (F.col("start") + WINDOW).alias("end"))
    return whole.unionByName(single).groupBy("_i", "_k").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_i"), F.xxhash64(F.col(id_col), F.sha2(F.encode(text, "UTF-8"), 256)).alias("_k"), text.alias("_t"))


def _with(rows: DataFrame, more: DataFrame, how: str) -> DataFrame:
    more = more.withColumnsRenamed({"_i": "_j", "_k": "_l"})
    return rows.join(more, (F.col("_k") == F.col("_l")) & F.col("_i").eqNullSafe(F.col("_j")), how).drop("_j", "_l")


def covered(spans: list[dict] | None, n: int) -> np.ndarray:
    """Which of ``n`` words some span has."""
    change = np.zeros(n + 1, np.int64)
    if spans:
        np.add.at(change, [x["start"] for x in spans], 1)
        np.add.at(change, [x["end"] for x in spans], -1)
    return np.cumsum(change)[:n] > 0


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: identifier, n_words, n_removed, kept (the kept words, joined by one space).

    Each word goes that a window covers whose words also start anywhere else, the same text or a repeated row included. Null
    and empty texts have no words, texts of fewer than WINDOW words lose none; very long texts are read whole; other columns
    aren't looked at; no rows give no rows. Which row is which is known by identifier and text, so rows that repeat, or have
    no identifier, each get their row.
    """
    rows = _keyed(docs, id_col, text_col)
    kind = dict(rows.dtypes)["_i"]

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, spans in zip(common.strings(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                drop = covered(spans, len(words))
                n.append(len(words))
                gone.append(int(drop.sum()))
                kept.append(b" ".join(compress(words, (~drop).tolist()) if spans else words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["_i", "n_words", "n_removed", "kept"])

    joined = _with(rows, repeats(docs, id_col, text_col), "left").select("_i", "_k", "_t", "spans")
    return joined.mapInArrow(cleaned, f"_i {kind}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("_i", id_col)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words that repeated windows of 35 words cover; ``without_repeats`` says what becomes of nulls,
    empty and long texts and repeated rows."""
    clean = without_repeats(common.table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS ws FROM documents),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 33), lambda i: {'i': i, 'h': sha256(array_to_string(ws[i:i + 34], ' '))})) AS x FROM w),
again AS (SELECT x.h AS h FROM win GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(x.i, x.i + 35)) AS p FROM win WHERE x.h IN (SELECT h FROM again)) GROUP BY doc_id),
kept AS (SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed, ws, gone FROM w LEFT JOIN hit USING (doc_id)),
said AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w) q
         ANTI JOIN (SELECT doc_id, unnest(gone) AS pos FROM hit) g USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, n_words, n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM kept LEFT JOIN said USING (doc_id)
"""
