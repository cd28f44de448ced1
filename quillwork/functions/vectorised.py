"""Text functions that columns can't express, as pandas functions on Arrow batches."""

from __future__ import annotations

import collections
import difflib
import functools
import heapq
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

_TOKEN = re.compile(X.TOKEN)


def _normal(s: str) -> str:
    folded = unicodedata.normalize("NFKC", s).casefold()
    return " ".join(re.sub(r"[-‐-―−]", " ", folded).split())


def normalized(x: Column) -> Column:
    """Compatibility forms and case folded away, dashes as spaces, white space squeezed; null stays null."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(_normal, na_action="ignore")

    return f(x)


#: Fixed value: texts whose tokens are Python objects at one time.
TEXTS = 64


def _parts(*columns: pa.Array) -> Iterator[list[tuple]]:
    """Rows of an Arrow batch, a few at a time."""
    for i in range(0, len(columns[0]), TEXTS):
        yield list(zip(*(c.slice(i, TEXTS).to_pylist() for c in columns), strict=True))


def _listed(rows: list[list[tuple]], names: list[str], kinds: list[pa.DataType]) -> pa.Array:
    """Lists of tuples as an Arrow array of lists of structs."""
    flat = list(zip(*itertools.chain.from_iterable(rows), strict=True)) or [()] * len(names)
    ends = pa.array(np.cumsum([0, *map(len, rows)]).astype("int32"))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(flat, kinds, strict=True)], names))


def token_positions(x: Column) -> Column:
    """Lexical tokens with where they start and end, in characters; null as an empty text."""
    names, kinds = ["token", "start", "end"], [pa.string(), pa.int32(), pa.int32()]
    found = lambda t: [(m[0].lower().replace("ё", "е"), m.start(), m.end()) for m in _TOKEN.finditer(t or "")]

    @F.arrow_udf("array<struct<token:string,start:int,end:int>>")
    def f(s: pa.Array) -> pa.Array:
        return pa.concat_arrays([_listed([found(t) for (t,) in part], names, kinds) for part in _parts(s)] or [_listed([], names, kinds)])

    return f(x)


def frequent_terms(x: Column, asked: Column, least: int, most: int) -> Column:
    """The ``most`` most frequent tokens of ``least`` characters and more that ``asked`` doesn't have, with their numbers, the
    alphabetically first of equals; null as an empty text."""
    names, kinds = ["term", "n"], [pa.string(), pa.int64()]
    found = lambda t: (m[0].lower().replace("ё", "е") for m in _TOKEN.finditer(t or ""))

    def best(text: str | None, question: str | None) -> list[tuple]:
        counts = collections.Counter(t for t in found(text) if len(t) >= least)
        for t in found(question):
            counts.pop(t, None)
        return heapq.nsmallest(most, counts.items(), key=lambda x: (-x[1], x[0]))

    @F.arrow_udf("array<struct<term:string,n:bigint>>")
    def f(s: pa.Array, q: pa.Array) -> pa.Array:
        return pa.concat_arrays([_listed([best(*r) for r in part], names, kinds) for part in _parts(s, q)] or [_listed([], names, kinds)])

    return f(x, asked)


def term_places(tokens: Column) -> Column:
    """The distinct tokens of an array of them as structs (term, tf, places): how often they are there, and where (from 0)."""

    @F.arrow_udf("array<struct<term:string,tf:int,places:array<int>>>")
    def f(ts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(ts), 0).to_numpy(zero_copy_only=False).astype("int64")
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(ends - sizes, sizes)
        words = ts.flatten().dictionary_encode()
        key = row * max(1, len(words.dictionary)) + words.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")  # places stay in order
        heads = np.flatnonzero(np.diff(key[order], prepend=-1))
        bounds = np.append(heads, len(key)).astype("int32")
        at = order[heads]
        places = pa.ListArray.from_arrays(pa.array(bounds), pa.array(place[order].astype("int32")))
        found = pa.StructArray.from_arrays([words.dictionary.take(pa.array(words.indices.to_numpy(zero_copy_only=False)[at])), pa.array(np.diff(bounds)), places], ["term", "tf", "places"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(len(sizes) + 1)).astype("int32")), found)

    return f(tokens)


def soft_overlap(a: Column, b: Column, least: float = 0.8) -> Column:
    """How many of the first array's words have a partner in the second, best pairs first, each word once; partners are alike
    by ``least`` of their characters."""

    @F.pandas_udf("int")
    def f(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([len(_partners(list(x if x is not None else []), list(y if y is not None else []), least)) for x, y in zip(left, right, strict=True)])

    return f(a, b)


@functools.lru_cache(1 << 16)
def _letters(s: str) -> collections.Counter:
    return collections.Counter(s)


@functools.lru_cache(1 << 16)
def _set(s: str) -> int:
    """The characters of a word as bits, some of which share one."""
    return functools.reduce(lambda m, c: m | 1 << (ord(c) & 63), s, 0)


def _may_meet(a: list[str], b: list[str], least: float, need: float) -> bool:
    """False only if fewer than ``need`` words of ``a`` have one in ``b`` that is alike by ``least``: each character that the other
    word lacks is one that can't match."""
    same = set(b)
    rest = [(len(x), _set(x)) for x in a if x not in same]
    n = len(a) - len(rest)
    others = [(len(y), _set(y)) for y in b]
    for i, (k, x) in enumerate(rest):
        if n >= need or n + len(rest) - i < need:
            break
        for m, y in others:
            both = least * (k + m) / 2
            if k >= both and m >= both and k - (x & ~y).bit_count() >= both and m - (y & ~x).bit_count() >= both:
                n += 1
                break
    return n >= need


@functools.lru_cache(1 << 12)
def _where(s: str) -> dict[str, int]:
    """The places of each character, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(s):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _in_order(a: str, b: str) -> int:
    """The most characters that both have in the same order; matching blocks have no more. One addition for a character of ``b``
    (Hyyrö, Bit-parallel LCS-length computation revisited)."""
    at, full = _where(a), (1 << len(a)) - 1
    left = full
    for c in b:
        if m := at.get(c):
            u = left & m
            left = (left + u | left - u) & full
    return len(a) - left.bit_count()


@functools.lru_cache(1 << 16)
def _alike(x: str, y: str, least: float) -> float:
    """How alike two words are; 0 under ``least``. Headings of a file share their words, so few pairs of words are new."""
    if x == y:
        return 1.0
    # Common letters bound the matching ones.
    if (_letters(x) & _letters(y)).total() < least * (len(x) + len(y)) / 2:
        return 0.0
    r = difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
    return r if r >= least else 0.0


def partner(x: str, y: str, least: float = 0.8) -> float:
    """How alike two words are that may be partners, else 0."""
    return _alike(x, y, least) if min(len(x), len(y)) >= least * (len(x) + len(y)) / 2 else 0.0


def _partners(a: list[str], b: list[str], least: float) -> list[float]:
    """How alike the words of ``a`` and their partners in ``b`` are: the most alike two first, each word once."""
    same = {w for w in set(a) & set(b) if a.count(w) == b.count(w) == 1}
    scored = [(-1.0, a.index(w), b.index(w)) for w in same]
    for i, x in enumerate(a):
        for j, y in enumerate(b) if x not in same else ():
            if y not in same and (r := partner(x, y, least)):
                scored.append((-r, i, j))
    used_a, used_b, out = set(), set(), []
    for r, i, j in sorted(scored):
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            out.append(-r)
    return out


# What a heading may begin with, and the marks that don't count when headings are compared.
HEADING_MARKER = r"^\s*(?:#+\s*)?(?:(?:(?:вопрос|задача|задание)\s*(?:№|#)?\s*\d+(?:\.\d+)*\s*(?:[.):—–-]\s*|\s+))|(?:\d+(?:\.\d+)*\s*[.)]\s*))"
HEADING_MARKS = r"[,;:.!?«»\"'()\[\]{}/\\—–\-]+"


_MARKER, _MARKS = re.compile(HEADING_MARKER, re.IGNORECASE), re.compile(HEADING_MARKS)


def folded(s: str) -> str:
    return unicodedata.normalize("NFKC", s).casefold().replace("ё", "е")


def _heading(s: str) -> str:
    return " ".join(_MARKS.sub(" ", _MARKER.sub("", folded(s))).split())


def heading_form(x: Column) -> Column:
    """A heading as it is compared: no number before it, no punctuation, case folded; null as an empty one."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _heading(t or ""))

    return f(x)


#: Fixed value: pairs of headings whose words meet in one array.
PAIRS = 256


@functools.lru_cache(1 << 12)
def _buckets(s: str) -> np.ndarray:
    """How many of a text's characters fall into each of 64 buckets: what two texts share there bounds what they share."""
    return np.bincount(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") & 63, minlength=64)


def _words_bound(s: pa.Array, t: pa.Array) -> np.ndarray:
    """The largest share of words that two arrays of words, row by row, can have in common, as ``_may_meet`` tells of words."""
    left, right = pc.list_value_length(s).to_numpy(zero_copy_only=False), pc.list_value_length(t).to_numpy(zero_copy_only=False)
    words = pa.concat_arrays([s.flatten(), t.flatten()]).dictionary_encode()
    named = words.dictionary.to_pylist()
    code, size, bits = words.indices.to_numpy(zero_copy_only=False), np.array([*map(len, named)], "int64"), np.array([*map(_set, named)], "uint64")
    row = np.repeat(np.arange(len(left)), left)
    times = right[row].astype("int64")
    i = np.repeat(np.arange(len(row)), times)
    j = len(row) + (np.cumsum(right) - right)[row][i] + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
    k, m, x, y = size[code[i]], size[code[j]], bits[code[i]], bits[code[j]]
    both = 0.4 * (k + m) - 1e-9
    may = (k >= both) & (m >= both) & (k - np.bitwise_count(x & ~y) >= both) & (m - np.bitwise_count(y & ~x) >= both)
    met = np.zeros(len(row), bool)
    met[i[may]] = True
    most = np.minimum(np.bincount(row[met], minlength=len(left)), right)
    return most / np.maximum(left + right - most, 1)


def heading_score(form: Column, terms: Column, other_form: Column, other_terms: Column, least: Column | None = None) -> Column:
    """Half for the words in common (those alike by 0.8 of their characters count as much as they are alike), half for the
    characters in common. Scores under ``least`` may be given as 0."""

    @F.arrow_udf("double")
    def f(a: pa.Array, s: pa.Array, b: pa.Array, t: pa.Array, bar: pa.Array) -> pa.Array:
        out: list[float] = []
        for i in range(0, len(a), PAIRS):
            part = [c.slice(i, PAIRS) for c in (a, s, b, t, bar)]
            x, y, low = part[0].to_pylist(), part[2].to_pylist(), part[4].to_numpy(zero_copy_only=False)
            words = _words_bound(part[1], part[3])
            both = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)])
            chars = 2 * np.minimum(np.stack([*map(_buckets, x)]), np.stack([*map(_buckets, y)])).sum(1) / np.maximum(both, 1)
            scores = np.zeros(len(x))
            for j in np.flatnonzero((low == 0) | (both == 0) | (words + chars >= 2 * (low - 1e-9))):
                if low[j] == 0 or not both[j] or words[j] + 2 * _in_order(x[j], y[j]) / both[j] >= 2 * (low[j] - 1e-9):
                    scores[j] = score_headings(x[j], part[1][j].as_py(), y[j], part[3][j].as_py(), float(low[j]))
            out.extend(scores.tolist())
        return pa.array(out, pa.float64())

    return f(form, terms, other_form, other_terms, F.lit(0.0) if least is None else least)


def ratio(a: Column, b: Column) -> Column:
    """Share of characters in matching blocks."""

    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, s, t).ratio() for s, t in zip(x, y, strict=True)])

    return f(a, b)


def score_headings(a: str, s: list[str], b: str, t: list[str], least: float = 0.0) -> float:
    """Half the share of words in common, half the share of characters in common; no words or characters at all: 0 of them.
    A score whose bound is under ``least`` is 0."""
    both = len(a) + len(b)
    if least and both:
        # Characters in the same order bound the matching ones; then so many words must have a partner.
        chars = 2 * _in_order(a, b) / both
        share = 2 * (least - 1e-9) - chars
        if share > 0:
            need = share * (len(s) + len(t)) / (1 + share) - 1e-9
            if need > min(len(s), len(t)) or not _may_meet(s, t, 0.8, need):
                return 0.0
    shared = sum(_partners(s, t, 0.8))
    words = shared / (len(s) + len(t) - shared) if s or t else 0.0
    if least and both and (words + chars) / 2 < least - 1e-9:
        return 0.0
    return (words + difflib.SequenceMatcher(None, a, b).ratio()) / 2


def with_synonyms(x: Column, synonyms: dict[str, str]) -> Column:
    """Whole words replaced, whatever their case; the text around them stays."""
    for word, other in synonyms.items():
        x = F.regexp_replace(x, rf"(?iu)(?<![\p{{L}}\p{{N}}]){re.escape(word)}(?![\p{{L}}\p{{N}}])", other.replace("\\", "\\\\").replace("$", "\\$"))
    return x


def highlights(x: Column, terms: list[str], prefix: str | None = None) -> Column:
    """Where a text's tokens are among ``terms`` or begin with ``prefix``: tokens in order as structs (token, start, end, form), in
    code points of the text as it is, ``form`` as it is written there; null as an empty text."""
    found = F.filter(token_positions(x), lambda t: t["token"].isin(*terms) | (t["token"].startswith(prefix) if prefix else F.lit(False)))
    return F.transform(found, lambda t: F.struct(t["token"].alias("token"), t["start"].alias("start"), t["end"].alias("end"), x.substr((t["start"] + 1).cast("int"), (t["end"] - t["start"]).cast("int")).alias("form")))


def surface_forms(spans: Column) -> Column:
    """The first written form of each highlighted token, in order."""
    return F.aggregate(spans, F.array().cast("array<struct<token:string,form:string>>"),
                       lambda out, s: F.when(F.exists(out, lambda o: o["token"] == s["token"]), out).otherwise(F.concat(out, F.array(F.struct(s["token"].alias("token"), s["form"].alias("form"))))),
                       lambda out: F.transform(out, lambda o: o["form"]))
