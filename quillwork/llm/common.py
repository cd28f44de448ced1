"""What the operators of this subpackage share: reading, materialising, batching and hashing of words.

A *word table* describes all words of a slice of texts as numpy arrays; hashes of all words are made together.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch that Python workers get; texts are long, so fewer than Spark's own default.
ROWS_PER_BATCH = 500
#: Bytes of text that numpy looks at together; a longer text is looked at alone.
SLICE_BYTES = 1 << 19


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches, by rows and (where this Spark knows it) by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


#: Bytes of a table (Spark's own estimate) up to which it is dealt out to all cores before it is read by an operator.
SMALL = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One of at most SMALL bytes, whose files can't be split over the cores, is dealt out to them; a larger one,
    which has more than one split, is never shuffled here."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a session on one machine (tests) gets a folder
    of its own; a cluster, whose machines share no such folder, gets an error.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that the cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillwork-"))
    return df.checkpoint(eager=True)


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def slices(texts: list[str], limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 of the texts) for consecutive texts of about ``limit`` bytes together."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Spans of more bytes than these are hashed by a digest of their bytes, one by one; shorter ones eight bytes a round.
CHUNKED = 64
_ENDS = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def _chunks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``: of eight bytes a round, each mixed into all bits before the next comes.

    A hash only says that spans may be equal. Where results hang on it alone (shingles), texts are told apart by thousands
    of hashes; where one hash decides (BPE), ``same_spans`` looks at the bytes.
    """
    size = end - start
    chunk = _chunks(data)
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live = np.arange(len(size)) if not len(size) or size.max() <= CHUNKED else np.flatnonzero(size <= CHUNKED)
    for at in range(0, CHUNKED, 8):
        if at:
            live = live[size[live] > at]
        if not len(live):
            break
        part = chunk[start[live] + at] & _ENDS[np.minimum(size[live] - at, 8)]
        h[live] = mix((h[live] + part) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA0761D6478BD642F))
    for i in np.flatnonzero(size > CHUNKED):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether each ``data[start:end]`` has the bytes of ``other[at:to]``."""
    size = end - start
    same = size == to - at
    a, b = _chunks(data), _chunks(other)
    live, done = np.flatnonzero(same & (size <= CHUNKED)), 0
    while len(live):
        ends = _ENDS[np.minimum(size[live] - done, 8)]
        ok = (a[start[live] + done] & ends) == (b[at[live] + done] & ends)
        same[live[~ok]] = False
        done += 8
        live = live[ok & (size[live] > done)]
    for i in np.flatnonzero(same & (size > CHUNKED)):
        same[i] = np.array_equal(data[start[i] : end[i]], other[at[i] : to[i]])
    return same


@dataclass
class Words:
    data: np.ndarray  # the texts' bytes, a line feed after each
    first: np.ndarray  # where each text starts in data
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # index of a word's text within the slice
    hash: np.ndarray


def is_word(*more: bytes) -> np.ndarray:
    """By byte: digits, letters of ASCII and all of other characters, and what ``more`` names."""
    k = np.zeros(256, dtype=bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        k[a:b] = True
    for x in more:
        k[list(x)] = True
    return k


WORD = is_word()
#: A-Z to a-z, all other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a line feed after each text, and where each text starts."""
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    sizes = np.fromiter((len(x) + 1 for x in raw), dtype=np.int64, count=len(raw))
    return data, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def word_table(raw: list[bytes], kind: np.ndarray = WORD, lower: bool = True) -> Words:
    """The words (runs of bytes of ``kind``, which leaves the line feed out) of a slice of texts."""
    data, first = joined(raw)
    if lower:
        data = LOWER[data]
    start, end = runs(kind[data])
    doc = np.searchsorted(first, start, side="right") - 1
    return Words(data, first, start, end, doc, span_hashes(data, start, end))


def grams(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words that lie in one text, and the index of their first words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[j : n + j]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(h[at]), at
