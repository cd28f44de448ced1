"""Byte-level BPE encoding and decoding in numpy.

A slice of texts is split as the tokenizer's pattern splits it, from arrays of character classes. Its distinct pieces go
into matrices by length; in each round every row merges its leftmost pair of least rank, found by a hashed lookup of
pairs, and closes the gap. Rows that have nothing left to merge leave the matrix.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes that numpy looks at together, and the longest stretch of a text that isn't cut where two words meet.
SLICE = 1 << 20
#: Widths of the matrices; longer pieces get matrices of their own powers of two.
WIDTHS = (4, 8, 12, 16, 24, 32, 64)
#: Bytes of a piece from which on it is encoded alone.
LONG = 256
# The characters that \s stands for.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = range(4)
NONE = np.int64(1 << 40)


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    of = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1)
    out[SPACES] = SPACE
    return out


def pieces(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts' bytes; where each piece starts (and, last, the end); how many pieces come before each text, and in all.

    Matches are those of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``: a run of one class
    takes the space before it, a run of white space leaves its last character to what follows, and a lone apostrophe takes
    the letters of a contraction.
    """
    whole = "".join(texts)
    data = whole.encode("utf-8", "surrogatepass")
    c = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(c)
    bound = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bound[1:])
    if not n:
        return data, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    kind = classes()[c]
    head = np.zeros(n + 1, bool)  # where a text starts
    head[bound] = True
    fresh = head[:n].copy()
    fresh[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    start = fresh.copy()
    # A space goes with what follows it in its text.
    taken = np.flatnonzero(fresh[1:] & ~head[1:n] & ~space[1:] & (c[:-1] == 32)) + 1
    start[taken] = False
    # The last of several white spaces before something else is a piece, or begins one.
    ends = np.flatnonzero(fresh[1:] & ~head[1:n] & space[:-1])
    start[ends] = True
    quote = np.flatnonzero(start & (c == 39))
    if len(quote):
        pad = np.concatenate([c, np.zeros(2, np.uint32)])
        edge = np.concatenate([head, np.ones(2, bool)])
        a, b = pad[quote + 1], pad[quote + 2]
        one = ~edge[quote + 1] & np.isin(a, [ord(x) for x in "stmd"])
        two = ~edge[quote + 1] & ~edge[quote + 2] & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        start[quote[one | two] + 1] = False
        for where, size in ((quote[one], 2), (quote[two], 3)):
            after = where + size
            after = after[after < n]
            # What follows is the letters' rest, or a run that starts by itself (a taken space has its mark already).
            rest = after[(kind[after] == LETTER) & ~head[after]]
            start[rest] = True
    at = np.flatnonzero(start)
    size = (1 + (c >= 0x80).astype(np.int8) + (c >= 0x800) + (c >= 0x10000)).astype(np.int8)
    byte = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=byte[1:])
    return data, byte[np.append(at, n)], np.searchsorted(at, bound)


def ragged(flat: np.ndarray, offset: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenation of ``flat[offset[w]:offset[w + 1]]`` for each w, and where each ends."""
    size = offset[which + 1] - offset[which]
    end = np.cumsum(size)
    if not len(end):
        return flat[:0], end
    index = np.repeat(offset[which] - (end - size), size)
    index += np.arange(end[-1])
    return flat[index], end


def _table(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(items), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)


class Bpe:
    """A vocabulary: ``pairs`` maps (left id, right id) to (rank, merged id); ``whole`` makes vocabulary pieces one id."""

    def __init__(self, vocabulary: dict[int, bytes], pairs: Iterator[tuple[int, int, int, int]], whole: bool):
        top = max(vocabulary) + 1
        items = [vocabulary.get(i, b"") for i in range(top)]
        self.bytes, self.offset = _table(items)
        self.decimal, self.decimal_at = _table([b"%d " % i for i in range(top)])
        self.byte = np.zeros(256, np.int64)
        for i, x in vocabulary.items():
            if len(x) == 1:
                self.byte[x[0]] = i
        p = np.array(list(pairs), dtype=np.int64).reshape(-1, 4)
        self._place(p[:, 0] << 20 | p[:, 1], p[:, 2] << 20 | p[:, 3])
        self.added: dict[str, int] = {}
        self.whole = None
        if whole:
            ids = np.array([i for i, x in enumerate(items) if x], np.int64)
            h = common.span_hashes(self.bytes, self.offset[ids], self.offset[ids + 1])
            order = np.argsort(h)
            self.whole = h[order], ids[order]

    @classmethod
    def of_ranks(cls, path: str) -> Bpe:
        """From a rank file: any two neighbours whose bytes together have a rank may merge."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = ((ranks[x[:i]], ranks[x[i:]], r, r) for x, r in ranks.items() for i in range(1, len(x)) if x[:i] in ranks and x[i:] in ranks)
        return cls({r: x for x, r in ranks.items()}, pairs, True)

    @classmethod
    def of_merges(cls, path: str) -> Bpe:
        """From a tokenizer file: the merges that it lists, in their order, and its added tokens, which plain text may have."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, added = file["model"], file.get("added_tokens") or []
        for x in added:
            if any(x.get(k) for k in ("single_word", "lstrip", "rstrip")) or len(x["content"]) < 2 or any(c.isspace() for c in x["content"]):
                raise ValueError(f"added token {x} isn't matched as plain text")
        shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 0xA0, 0xAD)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ids = model["vocab"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        pairs = ((ids[a], ids[b], r, ids[a + b]) for r, (a, b) in enumerate(merges))
        vocabulary = {i: bytes(byte[c] for c in x) for x, i in ids.items() if all(c in byte for c in x)}
        out = cls(vocabulary | {x["id"]: x["content"].encode() for x in added}, pairs, False)
        out.added = {x["content"]: x["id"] for x in added}
        return out

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table of at most a quarter full: numpy fills, and later reads, one probe of all keys a round."""
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            self.keys[slot[left[free]]] = keys[left[free]]
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 20 | id of each pair's merge, or NONE."""
        keys = a << 20 | b
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def _matrix(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (padded) and their numbers of pieces of at most ``width`` bytes."""
        n = len(start)
        col = np.arange(width)
        live = col < size[:, None]
        ids = np.where(live, self.byte[data[np.minimum(start[:, None] + col, len(data) - 1)]], -1)
        count, out = size.copy(), ids.copy()
        rank = np.full((n, width), NONE)
        both = live[:, 1:]
        rank[:, :-1][both] = self.merged(ids[:, :-1][both], ids[:, 1:][both])
        row = np.arange(n)
        while len(row):
            j = rank.argmin(axis=1)
            k = np.arange(len(row))
            best = rank[k, j]
            go = best < NONE
            if not go.all():
                stay = ~go
                out[row[stay], : ids.shape[1]] = ids[stay]
                out[row[stay], ids.shape[1] :] = -1
                ids, rank, row, j, best = ids[go], rank[go], row[go], j[go], best[go]
                if not len(row):
                    break
                k = np.arange(len(row))
            ids[k, j] = best & ((1 << 20) - 1)
            count[row] -= 1
            # Close the gap after column j, in ids and (for the pairs that begin there) in ranks.
            after = np.arange(ids.shape[1] - 1) > j[:, None]
            for m in (ids, rank):
                np.copyto(m[:, :-1], m[:, 1:].copy(), where=after)
            ids[:, -1] = -1
            rank[:, -1] = NONE
            for side in (j - 1, j):
                ok = np.flatnonzero((side >= 0) & (side < ids.shape[1] - 1))
                s = side[ok]
                a, b = ids[ok, s], ids[ok, s + 1]
                rank[ok, s] = np.where(b >= 0, self.merged(a, np.maximum(b, 0)), NONE)
        return out, count

    def _long(self, raw: np.ndarray) -> np.ndarray:
        """Ids of one piece of any length: each round merges the least pair at all its places, from the left, and closes the
        gaps. A place after which one place a round would have a lesser pair ends the round, so that the ids are the same."""
        ids = self.byte[raw]
        rank = self.merged(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) < NONE:
            at = np.flatnonzero(rank == best)
            first = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # of neighbours that overlap, every other one, from the left
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
            made = best & ((1 << 20) - 1)
            before = np.where(np.diff(at, prepend=-2) == 2, made, ids[at - 1])
            here = np.full(len(at), made)
            lesser = (at > 0) & (self.merged(before, here) <= best)
            inner = at + 2 < len(ids)
            lesser[inner] |= self.merged(here[inner], ids[at[inner] + 2]) <= best
            if lesser.any():
                at = at[: lesser.argmax() + 1]
            ids[at] = made
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            rank = np.append(rank, NONE)[keep][:-1] if keep[-1] else rank[keep[:-1]][:-1]
            ids = ids[keep]
            side = np.unique(np.concatenate([place[at] - 1, place[at]]))
            side = side[(side >= 0) & (side < len(rank))]
            rank[side] = self.merged(ids[side], ids[side + 1])
        return ids

    def distinct(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, concatenated, and the offsets."""
        size = end - start
        n = len(start)
        count = np.zeros(n, np.int64)
        single = np.full(n, -1, np.int64)
        if self.whole is not None:
            h, ids = self.whole
            at = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
            hit = np.flatnonzero(h[at] == hashes)
            of = ids[at[hit]]
            ok = common.same_spans(data, start[hit], end[hit], self.bytes, self.offset[of], self.offset[of + 1])
            single[hit[ok]] = of[ok]
        count[single >= 0] = 1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        todo = np.flatnonzero(single < 0)
        lower, widths = 0, [*WIDTHS]
        for i in todo[size[todo] > LONG]:
            ids = self._long(data[start[i] : end[i]])
            count[i] = len(ids)
            done.append((np.array([i]), ids[None, :]))
        todo = todo[size[todo] <= LONG]
        while widths[-1] < (size[todo].max() if len(todo) else 0):
            widths.append(2 * widths[-1])
        for width in widths:
            rows = todo[(size[todo] > lower) & (size[todo] <= width)]
            lower = width
            step = max(1, (1 << 21) // width)
            for part in (rows[i : i + step] for i in range(0, len(rows), step)):
                ids, c = self._matrix(data, start[part], size[part], width)
                count[part] = c
                done.append((part, ids))
        offset = np.concatenate([[0], np.cumsum(count)])
        flat = np.zeros(offset[-1], np.int64)
        one = np.flatnonzero(single >= 0)
        flat[offset[one]] = single[one]
        for part, ids in done:
            keep = ids >= 0
            within = np.nonzero(keep)[1]
            flat[np.repeat(offset[part], keep.sum(axis=1)) + within] = ids[keep]
        return flat, offset

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and where each text's begin (and, last, their number); an added token is one id."""
        if not any(x in t for x in self.added for t in texts):
            return self._ordinary(texts)
        split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        between: list[str] = []
        after: list[int] = []  # how many stretches between tokens end before each added token
        special: list[int] = []
        first = []  # stretches and added tokens before each text
        for text in texts:
            first.append((len(between), len(special)))
            for i, x in enumerate(split(text)):
                if i % 2:
                    after.append(len(between))
                    special.append(self.added[x])
                else:
                    between.append(x)
        ids, at = self._ordinary(between)
        first.append((len(between), len(special)))
        stretches, tokens = np.array(first).T
        return np.insert(ids, at[after], special), at[stretches] + tokens

    def _ordinary(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw, at, before = pieces(texts)
        if len(at) < 2:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(raw, np.uint8)
        start, end = at[:-1], at[1:]
        hashes = common.span_hashes(data, start, end)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        # A piece whose bytes aren't those of the first one with its hash is a row of its own.
        odd = np.flatnonzero(~common.same_spans(data, start, end, data, start[first[which]], end[first[which]]))
        which[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate([first, odd])
        flat, offset = self.distinct(data, start[first], end[first], hashes[first])
        ids, end = ragged(flat, offset, which)
        return ids, np.concatenate([[0], end])[before]


_SEAM = re.compile(r"(?<=\S) (?=\S)")


def parts(text: str, size: int = SLICE) -> list[str]:
    """A long text cut before single spaces between words, where every tokenizer piece ends; else the text as it is."""
    out, at = [], 0
    while len(text) - at > size:
        m = _SEAM.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def batched(texts: list[str], size: int = SLICE) -> Iterator[tuple[list[int], list[str]]]:
    """Texts, or parts of long ones, in slices of about ``size`` characters: indices of the texts, and strings."""
    index: list[int] = []
    held: list[str] = []
    total = 0
    for i, text in enumerate(texts):
        for part in parts(text, size):
            if held and total + len(part) > size:
                yield index, held
                index, held, total = [], [], 0
            index.append(i)
            held.append(part)
            total += len(part)
    if held:
        yield index, held


@functools.lru_cache(2)
def ranks(path: str) -> Bpe:
    return Bpe.of_ranks(path)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", want_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: identifier, n_tokens, ids_sha256, decoded_sha256, and with ``want_ids`` the ids.

    Null texts count as empty, which have no tokens and the digests of nothing. Texts of any length are read whole, in parts
    of bounded size. Rows are encoded alone, repeated ones alike; other columns aren't looked at; no rows give no rows.
    ``path`` names a rank file that the executors can open.
    """
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ranks(path)
        for batch in batches:
            texts = common.strings(batch.column(1))
            n = len(texts)
            count, digest = np.zeros(n, np.int64), [(hashlib.sha256(), hashlib.sha256()) for _ in range(n)]
            all_ids: list[list[np.ndarray]] = [[] for _ in range(n)]
            for index, held in batched(texts):
                ids, at = bpe.encode(held)
                said, said_at = ragged(bpe.decimal, bpe.decimal_at, ids)
                back, back_at = ragged(bpe.bytes, bpe.offset, ids)
                said_at, back_at = (np.concatenate([[0], x])[at] for x in (said_at, back_at))
                said_, back_ = memoryview(said.tobytes()), memoryview(back.tobytes())
                for k, i in enumerate(index):
                    a, b = digest[i]
                    text = said_[said_at[k] : said_at[k + 1]]
                    a.update(text[:-1] if not count[i] else b" " + bytes(text[:-1]) if len(text) else b"")
                    b.update(back_[back_at[k] : back_at[k + 1]])
                    count[i] += at[k + 1] - at[k]
                    if want_ids:
                        all_ids[i].append(ids[at[k] : at[k + 1]])
            columns = [batch.column(0), pa.array(count), pa.array([a.hexdigest() for a, _ in digest]), pa.array([b.hexdigest() for _, b in digest])]
            if want_ids:
                columns.append(pa.array([np.concatenate(x) if x else [] for x in all_ids], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = f"id {rows.dtypes[0][1]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * want_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded. Null texts count as empty: no tokens, digests of nothing; repeated rows are alike; an
    empty table gives no rows."""
    import public_tokenizers

    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
