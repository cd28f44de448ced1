"""Stretches of a text that repeat themselves with a period: maximal runs, found by masking and by Main and Lorentz.

Masking. A run of period q and length n matches itself moved by q over n - q words, which is OVERLAP words at least for any
run that counts. So each of its words lies in a run of OVERLAP words (a k-gram) that the text has twice; all other words can't
be in a run, and split the text into segments. Ordinary prose has none that are long enough.

Main and Lorentz. Surviving segments are halved again and again, and a run is found at the first middle that it reaches: a
period is the distance from the middle m to a place x, and the run goes as far as the words from m and from x agree, in both
directions. Since these agreements are OVERLAP words together, one of the two is half of that, so the places x are those with
the same OVERLAP // 2 words after, or before, them as the middle has. All middles of a level are worked out together in
numpy, for all segments of a slice of texts; agreements come from hashes by halving steps, and each run found is compared
word by word (and measured word by word if hashes went wrong). The time is about words times the levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .substring_dedup import Spans

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 24, 3
#: Words over which any such run matches itself when moved by its period.
OVERLAP = min(max(LEAST, TIMES * q) - q for q in range(1, LEAST + 1))
HALF = OVERLAP // 2


def surviving(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Words that lie in a run of OVERLAP words which their text has more than once."""
    out, n = np.zeros(len(ids), bool), len(ids) - OVERLAP + 1
    if n <= 0:
        return out
    at = np.flatnonzero(text[:n] == text[OVERLAP - 1 :])
    h = common.mix(Spans(_spread(ids)).hashes(at, OVERLAP, 1) + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    equal = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + OVERLAP, -1)
    return np.cumsum(change)[:-1] > 0


def _spread(ids: np.ndarray) -> np.ndarray:
    return common.mix(ids.astype(np.uint64) + np.uint64(0xA0761D6478BD642F))


def maximal(ids: np.ndarray) -> np.ndarray:
    """Rows of (start, end, period) of all maximal runs, by start and period."""
    n = len(ids)
    spans = Spans(_spread(ids))
    after = _spread(np.arange(n) + (1 << 40))  # hashes of the HALF words from a place on; where there are fewer, equal to none
    whole = max(n - HALF + 1, 0)
    after[:whole] = spans.hashes(np.arange(whole), HALF, 2)
    before = _spread(np.arange(n) + (1 << 41))
    before[HALF:] = after[: max(n - HALF, 0)]
    found, size = [], 2 * OVERLAP
    while size < 2 * n:
        x = np.arange(n)
        low = x - x % size
        mid = low + size // 2
        at = np.flatnonzero((mid < n) & (mid != x) & (TIMES * np.abs(mid - x) <= size))
        m = mid[at]
        at = at[(after[at] == after[m]) | (before[at] == before[m])]
        m = mid[at]
        a, b, lo, hi = np.minimum(at, m), np.maximum(at, m), low[at], np.minimum(low[at] + size, n)
        start, end = a - _agreement(spans, a, b, a - lo, size, -1), b + _agreement(spans, a, b, hi - b, size, 1)
        period = b - a
        ok = _counts(start, end, period, lo, hi, n)
        for i in np.flatnonzero(ok):
            s, e, q = start[i], end[i], period[i]
            if not np.array_equal(ids[s : e - q], ids[s + q : e]):
                s, e = _measured(ids, a[i], b[i], lo[i], hi[i])
                ok[i], start[i], end[i] = _counts(s, e, q, lo[i], hi[i], n), s, e
        found.append(np.stack([start[ok], end[ok], period[ok]], axis=1))
        size *= 2
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    least = np.ones(len(rows), bool)  # of the same stretch the smallest period
    least[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[least]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _counts(start, end, period, lo, hi, n):
    """Long enough, and not cut off by the borders of its part (a wider part has those)."""
    return (end - start >= np.maximum(LEAST, TIMES * period)) & ((start > lo) | (lo == 0)) & ((end < hi) | (hi == n))


def _agreement(spans: Spans, a: np.ndarray, b: np.ndarray, most: np.ndarray, size: int, way: int) -> np.ndarray:
    """Words that are the same from ``a`` and from ``b`` on (way 1) or before them (-1), up to ``most``."""
    n, step = np.zeros(len(a), np.int64), size
    while step:
        at = np.flatnonzero(n + step <= most)
        i, j = (a[at] + n[at], b[at] + n[at]) if way > 0 else (a[at] - n[at] - step, b[at] - n[at] - step)
        n[at] += step * (spans.hashes(i, step, 3) == spans.hashes(j, step, 3))
        step //= 2
    return n


def _measured(ids: np.ndarray, a: int, b: int, lo: int, hi: int) -> tuple[int, int]:
    """``start`` and ``end`` as words say it, not hashes."""
    unlike = np.flatnonzero(ids[a : hi - (b - a)] != ids[b:hi])
    back = np.flatnonzero(ids[lo:a][::-1] != ids[lo + b - a : b][::-1])
    return a - (back[0] if len(back) else a - lo), b + (unlike[0] if len(unlike) else hi - b)


def found_in(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs, by start and period; texts are lists of words."""
    known: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    keep = surviving(ids, text)
    # A segment ends with its text, too.
    start, end = common.runs(np.insert(keep, np.cumsum(sizes)[:-1], False))
    start, end = (x - np.searchsorted(np.cumsum(sizes)[:-1] + np.arange(len(sizes) - 1), x, side="left") for x in (start, end))
    wide = np.flatnonzero(end - start >= LEAST)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(wide):
        return out
    start, end = start[wide], end[wide]
    parts, place = [], []
    for i, (s, e) in enumerate(zip(start, end, strict=True)):
        parts += [ids[s:e], np.array([-1 - i])]
        place += [np.arange(s, e), np.array([-1])]
    where, base = np.concatenate(place), np.cumsum(sizes) - sizes
    for s, e, q in maximal(np.concatenate(parts)).tolist():
        t = text[where[s]]
        out[t].append((int(where[s] - base[t]), e - s, q))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length by period, exactly; of equal ones the first, then the one of the smallest period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, but of each run only the first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    return b" ".join(compress(words, (np.cumsum(change)[:-1] == 0).tolist()))


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: identifier, runs (start, length, period; in words), strongest (null without runs), collapsed.

    Words are what stands between spaces and the characters 9 to 13. Null and empty texts have no words and no runs; long texts
    are looked at whole; rows that repeat get a row each, other columns aren't looked at, no rows give no rows. Rows stay where
    they are, no shuffle.
    """
    common.tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ["start", "length", "period"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in common.slices(common.strings(batch.column(1))):
                texts = [x.split() for x in raw]
                runs = found_in(texts)
                best = [strongest(r) for r in runs]
                kept = [collapsed(t, r).decode("utf-8", "surrogatepass") for t, r in zip(texts, runs, strict=True)]
                columns = [batch.column(0).slice(at, len(raw)), pa.array([[dict(zip(names, x, strict=True)) for x in r] for r in runs], pa.list_(run)),
                           pa.array([dict(zip(names, x, strict=True)) if x else None for x in best], run), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["_i", "runs", "strongest", "collapsed"])

    return rows.mapInArrow(told, f"_i {dict(rows.dtypes)['_i']}, runs array<{RUN}>, strongest {RUN}, collapsed string").withColumnRenamed("_i", id_col)


def planted(doc_id: Column, text: Column) -> Column:
    """A tenth of the texts, chosen by the identifier's crc32, periodic from a word on (also by it); the others as they are."""
    words = F.regexp_extract_all(text, F.lit(r"[^ \t-\r]+"), F.lit(0))
    h = F.crc32(doc_id.cast("string"))
    g, n = F.floor(h / 10), F.size(words)
    first = (g % F.nullif(n, F.lit(0))).cast("int")
    period = (1 + F.floor((n - first) / (3 + g % 8))).cast("int")
    unit = F.flatten(F.array_repeat(F.slice(words, first + 1, period), F.ceil((n - first) / period).cast("int")))
    of = F.concat(F.slice(words, F.lit(1), first), F.slice(unit, F.lit(1), n - first))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(of, " ")).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of them made periodic by their identifier (rows without one stay as they are); ``scan``
    says what becomes of nulls, empty and long texts and repeated rows."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("strongest")
    return scan(docs).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), F.sha2(F.encode(F.array_join(F.transform("runs", line), ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))
