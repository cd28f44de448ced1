"""Packing of tokenised documents into sequences by minimum bin slack.

A document's ids, with an end id, fill whole sequences first; its remainder waits in a pool that a task keeps. For the
longest remainder, a bitset dynamic program over the pool's multiset of lengths finds the lengths that come closest to
filling the sequence, walks back to how many of each it took, and repeats that pattern as often as the pool allows. Only
when a partition has ended are documents cut further: to close the last slacks, and to deal the tail out to sequences whose
lengths are powers of two and so need no padding.

A partition's result depends on its rows alone, so a task that runs again gives the same sequences; nothing is shuffled.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

CAPACITY, END = 1024, 0
#: Remainders that a task holds, at most, before it packs what fits exactly.
POOL = 4096
SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def closest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length (of ``counts``: length to number there is) come closest to ``capacity``, not above it.

    Bit s of ``reach`` says that some of the lengths so far sum to s. Longer lengths come first, and the program ends when
    the capacity is reached; the bitsets before each length are kept to walk back.
    """
    mask, reach = (1 << (capacity + 1)) - 1, 1
    steps: list[tuple[int, int]] = []
    for length in sorted((x for x in counts if counts[x] > 0 and x <= capacity), reverse=True):
        steps.append((length, reach))
        left, unit = min(counts[length], capacity // length), 1
        while left and not reach >> capacity & 1:
            take = min(unit, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            unit *= 2
        if reach >> capacity & 1:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, before in reversed(steps):
        n = 0
        while not before >> at & 1:
            at -= length
            n += 1
        if n:
            used[length] = n
    return used


@dataclass
class Piece:
    doc: object
    start: int
    ids: np.ndarray
    doc_tokens: int


@dataclass
class Packer:
    """Packs the documents of one task; ``add`` and ``finish`` yield sequences, which are lists of pieces."""

    capacity: int = CAPACITY
    pool: dict[int, list[Piece]] = field(default_factory=lambda: defaultdict(list))
    held: int = 0

    def add(self, doc: object, ids: np.ndarray) -> Iterator[list[Piece]]:
        n, c = len(ids), self.capacity
        for start in range(0, n - n % c, c):
            yield [Piece(doc, start, ids[start : start + c], n)]
        if n % c:
            self._hold(Piece(doc, n - n % c, ids[n - n % c :].copy(), n))
        if self.held >= POOL:
            yield from self._exact()
            if self.held >= POOL // 2:  # too many lengths that nothing completes
                yield from self._all(POOL // 2)

    def finish(self) -> Iterator[list[Piece]]:
        yield from self._exact()
        yield from self._all(0)

    def _hold(self, piece: Piece) -> None:
        self.pool[len(piece.ids)].append(piece)
        self.held += 1

    def _take(self, length: int) -> Piece:
        self.held -= 1
        piece = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        return piece

    def _pattern(self, anchor: int) -> dict[int, int]:
        counts = {k: len(v) for k, v in self.pool.items()}
        counts[anchor] -= 1
        used = closest(counts, self.capacity - anchor)
        used[anchor] = used.get(anchor, 0) + 1
        return used

    def _exact(self) -> Iterator[list[Piece]]:
        """Sequences that are full without a cut, for each length from the longest on."""
        for anchor in sorted(self.pool, reverse=True):
            while anchor in self.pool:
                used = self._pattern(anchor)
                if sum(k * n for k, n in used.items()) < self.capacity:
                    break
                for _ in range(min(len(self.pool[k]) // n for k, n in used.items())):
                    yield [self._take(k) for k, n in used.items() for _ in range(n)]

    def _all(self, keep: int) -> Iterator[list[Piece]]:
        """Sequences until ``keep`` pieces are held; what the closest pattern leaves free, a cut piece fills."""
        while self.held > keep:
            if sum(k * len(v) for k, v in self.pool.items()) < self.capacity:
                yield from self._tail()
                return
            used = self._pattern(max(self.pool))
            sequence = [self._take(k) for k, n in used.items() for _ in range(n)]
            slack = self.capacity - sum(len(p.ids) for p in sequence)
            while slack:
                sequence.append(self._cut(slack))
                slack -= len(sequence[-1].ids)
            yield sequence

    def _cut(self, size: int) -> Piece:
        """The first ids of the longest piece, at most ``size``; the rest is held on."""
        piece = self._take(max(self.pool))
        if len(piece.ids) > size:
            self._hold(Piece(piece.doc, piece.start + size, piece.ids[size:], piece.doc_tokens))
            piece.ids = piece.ids[:size]
        return piece

    def _tail(self) -> Iterator[list[Piece]]:
        """What is left, less than a sequence, in sequences of powers of two."""
        left = sum(k * len(v) for k, v in self.pool.items())
        while left:
            free, sequence = 1 << (left.bit_length() - 1), []
            left -= free
            while free:
                sequence.append(self._cut(free))
                free -= len(sequence[-1].ids)
            yield sequence


@functools.lru_cache(2)
def merges(path: str) -> bpe.Bpe:
    return bpe.Bpe.of_merges(path)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", want_ids: bool = False) -> DataFrame:
    """One row per piece: identifier, what SCHEMA names, and with ``want_ids`` the piece's ids.

    Null texts count as empty: a document of the end id alone. Repeated rows are documents of their own. Texts of any length
    are encoded whole, in parts of bounded size. Other columns aren't looked at; no rows give no pieces.
    ``path`` names a tokenizer file that the executors can open; its ids are what the tokenizer gives without special tokens.
    """
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer = merges(path), Packer()
        number, part = 0, TaskContext.get().partitionId() << 36

        def rows(sequences: Iterator[list[Piece]], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal number
            out: list[tuple] = []
            for sequence in sequences:
                offset = 0
                for p in sequence:
                    ids = p.ids.astype("<u4")
                    out.append((p.doc, p.start, len(ids), zlib.crc32(ids.data), p.doc_tokens, part + number, offset, ids if want_ids else None))
                    offset += len(ids)
                number += 1
                if len(out) >= 2000:
                    yield batch_of(out, kind)
                    out = []
            if out:
                yield batch_of(out, kind)

        def batch_of(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            names = ["id", *(x.split()[0] for x in SCHEMA.split(", "))]
            if want_ids:
                arrays, names = [*arrays, pa.array(columns[7], pa.list_(pa.int64()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def documents(batch: pa.RecordBatch) -> Iterator[list[Piece]]:
            names, texts = batch.column(0).to_pylist(), common.strings(batch.column(1))
            end, waiting, last = np.array([END], np.uint32), [], None
            for index, held in bpe.batched(texts):
                ids, at = encoder.encode(held)
                ids = ids.astype(np.uint32)
                for k, i in enumerate(index):
                    if last is not None and i != last:
                        yield from packer.add(names[last], np.concatenate([*waiting, end]))
                        waiting = []
                    waiting.append(ids[at[k] : at[k + 1]])
                    last = i
            if last is not None:
                yield from packer.add(names[last], np.concatenate([*waiting, end]))

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            yield from rows(documents(batch), kind)
        if kind is not None:
            yield from rows(packer.finish(), kind)

    rows_ = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return rows_.mapInArrow(run, f"id {rows_.dtypes[0][1]}, {SCHEMA}" + ", ids array<bigint>" * want_ids).withColumnRenamed("id", id_col)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in pieces of sequences of at most 1024 tokens. Null texts count as empty: a piece of the end id alone. Ties of
    patterns go to the longer lengths; repeated rows are documents of their own; an empty table gives no pieces."""
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
