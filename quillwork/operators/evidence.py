"""Quotations as evidence: found where they say they are from, as they are, after normalisation, or nearly; else elsewhere."""

from __future__ import annotations

import collections
import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources import shared
from ..sources import tables as T

# The share of a quotation's words that make it nearly found; how many runs of words choose one of them; formulas' commands and their symbols; Latin letters
# and the Cyrillic ones that look alike.
NEARLY = 0.75
LEVELS = (0, 1, 2, 3, 6, 12, 24)
# Characters of texts whose words are found at one time; bits of the table of runs that are looked for, of
# which each run sets two, and how many of them are a row.
CHARACTERS = 1_000_000
BITS, ROW = 1 << 27, 1 << 15
COMMANDS = {
    "in": "∈", "notin": "∉", "subset": "⊂", "subseteq": "⊆", "times": "×", "cdot": "·", "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "neq": "≠", "to": "→", "rightarrow": "→", "leftarrow": "←",
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "Sigma": "Σ", "sigma": "σ", "sum": "∑", "lambda": "λ", "epsilon": "ε", "infty": "∞", "cup": "∪", "cap": "∩",
}
LOOKALIKES = str.maketrans("ABCEHKMOPTXYaceopxy", "АВСЕНКМОРТХУасеорху")
_WORD = re.compile(r"\w+")
_COMMAND, _BRACKETS, _DOTS, _DASHES = re.compile(r"\\([a-zA-Z]+)"), re.compile(r"\\[()\[\]]"), re.compile(r"\.\.+"), re.compile("[-—]{2,}")


def plains(texts: list[str]) -> list[str]:
    """Texts as they are compared: compatibility forms, formulas' commands as symbols, no marks of mathematics or emphasis, dots and
    dashes in a row as a space, look-alike letters as one, case folded, white space squeezed. They are changed as one string, in
    which a character that none of the rules knows stands between them."""
    s = "\0".join(texts)
    if s.count("\0") >= len(texts) > 1:
        return [plain(t) for t in texts]
    s = unicodedata.normalize("NFKC", s)
    if "\\" in s:
        s = _BRACKETS.sub("", _COMMAND.sub(lambda m: COMMANDS.get(m[1], m[1]), s))
    for mark in "${}*_`":
        s = s.replace(mark, "")
    s = _DOTS.sub(" ", s).replace("…", " ")
    if any(x + y in s for x in "-—" for y in "-—"):
        s = _DASHES.sub(" ", s)
    for letter, other in LOOKALIKES.items():
        s = s.replace(chr(letter), chr(other))
    s = s.casefold()
    return [" ".join(t.split()) for t in (s.split("\0") if len(texts) > 1 else [s] * len(texts))]


def plain(text: str) -> str:
    return plains([text])[0]


def _known(texts: list[str | None]) -> list[str | None]:
    """``plains`` where nulls stay nulls."""
    out = iter(plains([t for t in texts if t is not None]))
    return [None if t is None else next(out) for t in texts]


def comparable(x: Column) -> Column:
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return pd.Series(_known([t if isinstance(t, str) else None for t in s]), dtype="object")

    return f(x)


def window(text: str, quote: str) -> tuple[float, int, int]:
    """The share of the quotation's words that a stretch of as many words of the text has at best, and where the first such
    stretch begins and ends in the text as it is; found while the stretch moves on word by word."""
    asked = collections.Counter(_WORD.findall(plain(quote)))
    size, places = asked.total(), [(plain(m[0]), m.start(), m.end()) for m in _WORD.finditer(text)]
    held: collections.Counter = collections.Counter()
    both, best = 0, (0, 0, 0)
    for i, (word, _, end) in enumerate(places):
        held[word] += 1
        both += held[word] <= asked[word]
        if i >= size:
            gone = places[i - size][0]
            both -= held[gone] <= asked[gone]
            held[gone] -= 1
        if both > best[0]:
            best = (both, places[max(0, i - size + 1)][1], end)
    return (best[0] / size if size else 0.0), best[1], best[2]


def best_window(text: Column, quote: Column) -> Column:
    @F.pandas_udf("share double, start int, end int")
    def f(t: pd.Series, q: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([window(a or "", b or "") for a, b in zip(t, q, strict=True)], columns=["share", "start", "end"])

    return f(text, quote)


def found_here(text: Column, quote: Column, exact: Column) -> Column:
    """How a unit has a quotation (normalized, approximate or null) and the quotation as it is compared; nulls where it is there
    as it stands."""

    def one(asked: str | None, within: str | None) -> str | None:
        if asked and within and asked in within:
            return "normalized"
        wanted = collections.Counter(_WORD.findall(asked or ""))
        return "approximate" if wanted and (wanted & collections.Counter(_WORD.findall(within or ""))).total() / wanted.total() >= NEARLY else None

    @F.arrow_udf("struct<how:string,asked:string>")
    def f(t: pa.Array, q: pa.Array, x: pa.Array) -> pa.Array:
        left = pc.invert(x)
        within, asked = (_known(pc.if_else(left, c, pa.scalar(None, c.type)).to_pylist()) for c in (t, q))
        return pa.StructArray.from_arrays([pa.array([*map(one, asked, within)], pa.string()), pa.array(asked, pa.string())], ["how", "asked"])

    return f(text, quote, exact)


def picked(hashes: list[int], level: int) -> list[int]:
    """The places of the least hash (the first of equals) of each ``level`` neighbours."""
    out: list[int] = []
    for i in range(len(hashes) - level + 1):
        if out and out[-1] >= i:
            last = i + level - 1
            if hashes[last] < hashes[out[-1]]:
                out.append(last)
        else:
            out.append(min(range(i, i + level), key=hashes.__getitem__))
    return out


@functools.cache
def _letters() -> np.ndarray:
    """Of each code point, whether it is a word's."""
    return np.array([chr(i).isalnum() or chr(i) == "_" for i in range(0x110000)])


@functools.cache
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, "uint64"))


def marks(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number of each word of texts, equal for equal words, and the text (from 0) that it is in."""
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    inside = _letters()[codes]
    edges = np.flatnonzero(np.diff(inside, prepend=False))  # words begin and end; the last text ends with what is in no word
    begin, size = edges[::2], edges[1::2] - edges[::2]
    if not len(begin):
        return np.zeros(0, "uint64"), np.zeros(0, "int64")
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    powers = _powers(1 << int(size.max()).bit_length())
    out = np.add.reduceat(codes[inside].astype("uint64") * powers[place], first)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return out, np.searchsorted(ends, begin, "right")


def hashed(numbers: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` neighbouring numbers."""
    n = max(0, len(numbers) - size + 1)
    out = np.zeros(n, "uint64")
    for i in range(size):
        out ^= numbers[i : i + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view("int64")


def runs(found: list[str], level: int) -> list[int]:
    """Hashes of the word runs that stand for a text: of each ``level`` neighbouring runs of 2 * ``level`` words (0: of each word)
    the one of least hash. Whatever has the same 3 * ``level`` - 1 words in a row has one of them in common."""
    size, near = (2 * level, level) if level else (1, 1)
    hashes = hashed(marks([" ".join(found)])[0], size).tolist()
    return [hashes[i] for i in picked(hashes, near)]


def chosen(texts: list[str]) -> list[dict | None]:
    """Of each quotation, the first of its inner words' ``runs`` and its level, None if it has no inner word."""
    words, row = marks(texts)
    begin = np.searchsorted(row, np.arange(len(texts))) + 1
    inner = np.searchsorted(row, np.arange(len(texts)), "right") - 1 - begin
    out: list[dict | None] = [None] * len(texts)
    for i, level in enumerate(LEVELS):
        fits = (inner >= max(1, 3 * level - 1)) & (inner < (3 * LEVELS[i + 1] - 1 if i + 1 < len(LEVELS) else np.inf))
        those = np.flatnonzero(fits)
        if len(those):
            hashes = hashed(words, 2 * level or 1)
            least = np.min([hashes[begin[those] + j] for j in range(level or 1)], axis=0)
            for j, h in zip(those.tolist(), least.tolist(), strict=True):
                out[j] = {"level": level, "hash": h}
    return out


def _run(x: Column) -> Column:
    @F.arrow_udf("struct<level:int,hash:bigint>")
    def f(s: pa.Array) -> pa.Array:
        return pa.array(chosen([t or "" for t in s.to_pylist()]), pa.struct([("level", pa.int32()), ("hash", pa.int64())]))

    return f(x)


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hashes & (BITS - 1), (hashes >> 27) & (BITS - 1)


def holding(units: DataFrame, runs_: DataFrame) -> DataFrame:
    """ref, plain, level, hash: units (ref, text) that have one of the runs (level, hash) of words, as they are compared; and a few
    others, since whether a run is looked for is read from a table of BITS bits, which is all of the runs that tasks hold.

    A unit's runs are as many as its words: few are looked for, so they aren't made into rows to find that out.
    """
    spark = units.sparkSession
    levels = sorted(r[0] for r in runs_.select("level").distinct().collect())  # a few numbers
    places = runs_.select(F.explode(F.array(F.col("hash").bitwiseAND(BITS - 1), F.shiftright("hash", 27).bitwiseAND(BITS - 1))).alias("at"))
    table = np.zeros(BITS // 8, "uint8")
    bits = places.groupBy(F.floor(F.col("at") / ROW).alias("row")).agg(F.bitmap_construct_agg(F.col("at") % ROW).alias("bits"))
    for r in bits.collect():
        table[r.row * ROW // 8 : (r.row + 1) * ROW // 8] = np.frombuffer(bytes(r.bits), "uint8")
    shared_table = spark.sparkContext.broadcast(table)
    kind = StructType.fromDDL(f"ref {dict(units.dtypes)['ref']}, plain string, level int, hash bigint")
    arrow = to_arrow_schema(kind)

    def of(refs: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        asked, shown = shared_table.value, plains(texts.to_pylist())
        words, row = marks(shown)
        out = []
        for level in levels:
            size = 2 * level or 1
            hashes = hashed(words, size)
            a, b = _places(hashes)
            hit = np.flatnonzero((asked[a >> 3] >> (a & 7).astype("uint8")) & (asked[b >> 3] >> (b & 7).astype("uint8")) & 1)
            hit = hit[row[hit] == row[hit + size - 1]]
            pairs = np.unique(np.stack([row[hit], hashes[hit]]), axis=1)
            out.append((pairs[0], np.full(len(pairs[0]), level, "int32"), pairs[1]))
        at, level, hash_ = (np.concatenate(c) for c in zip(*out, strict=True))
        at = pa.array(at)
        return pa.RecordBatch.from_arrays([refs.take(at).cast(arrow.field("ref").type), pa.array(shown, pa.string()).take(at), pa.array(level), pa.array(hash_, pa.int64())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False)) // CHARACTERS
            bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for i, j in itertools.pairwise(bounds):
                if j > i:
                    yield of(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i))

    known = units.where("text IS NOT NULL").select("ref", "text")
    return known.mapInArrow(run, kind) if levels else spark.createDataFrame([], kind)


def repaired(evidence: DataFrame, units: DataFrame) -> DataFrame:
    """id, found (the unit's ref), how, start, end of evidence (id, ref, quote) among units (ref, text):

    * exact: the unit has the quotation as it stands (an empty one stands for the whole unit);
    * normalized: it has it when both are compared as ``plain`` makes them; the whole unit is the place;
    * approximate: it has NEARLY of its words, each as often as it stands there; the best stretch is the place;
    * ref_corrected: another unit (the first by ref) has it when both are compared so; that whole unit is the place;
    * lost: none; nulls. A null quotation, or one of which nothing is left to compare, is lost; so is a null text.

    Evidence meets its own unit by ref. Only what isn't found there is looked for elsewhere, by a run of its inner words (a
    single word, however rare, is in a share of all units); quotations of fewer than three words have none that is sure to be
    whole, and are held against all units where these are read.
    """
    u = units.select("ref", "text")
    evidence = shared.cut(evidence.select("id", "ref", "quote"))
    own = evidence.join(u, "ref", "left")
    exact = F.coalesce(F.col("text").contains(F.col("quote")), F.lit(False))
    own = own.withColumn("exact", exact).withColumn("x", found_here(F.col("text"), F.col("quote"), F.col("exact")))
    whole = F.struct(F.lit(0).alias("start"), F.length("text").alias("end"))
    start = F.instr("text", F.col("quote")) - 1
    here = F.when(F.col("exact") & (F.length("quote") > 0), F.struct(start.alias("start"), (start + F.length("quote")).alias("end"))).otherwise(whole)
    how = F.when(F.col("exact"), "exact").otherwise(F.col("x.how"))
    nearly = [F.when(F.col("x.how") == "approximate", F.col(c)).alias(c) for c in ("text", "quote")]
    own = shared.cut(own.select("id", "ref", how.alias("how"), F.col("x.asked").alias("asked"), here.alias("at"), *nearly))
    sure = own.where("how IN ('exact', 'normalized')").select("id", F.col("ref").alias("found"), "how", "at")
    nearly = own.where("how = 'approximate'").withColumn("w", best_window(F.col("text"), F.col("quote"))).select("id", F.col("ref").alias("found"), "how", F.struct("w.start", "w.end").alias("at"))
    # Equal quotations are looked for once, with the first two units that have them: the first that isn't their own counts.
    left = own.where("how IS NULL AND asked <> ''").select("id", "ref", "asked")
    asked = shared.cut(left.select("asked").distinct().withColumn("run", _run(F.col("asked"))))
    wanted = asked.where("run IS NOT NULL").select("run.level", "run.hash", "asked")
    long = holding(u, wanted.select("level", "hash")).join(wanted, ["level", "hash"]).where(F.col("plain").contains(F.col("asked"))).select("ref", "asked")
    short = u.withColumn("plain", comparable(F.col("text"))).join(T.bounded(asked.where("run IS NULL").select("asked")), F.col("plain").contains(F.col("asked"))).select("ref", "asked")
    nth = F.dense_rank().over(Window.partitionBy("asked").orderBy("ref"))
    met = long.unionByName(short).withColumn("_n", nth).where("_n <= 2")
    found = left.join(met.select(F.col("ref").alias("other"), "asked").distinct(), "asked").where(F.col("other") != F.col("ref")).groupBy("id").agg(F.min("other").alias("found"))
    other = found.join(units.select(F.col("ref").alias("found"), whole.alias("at")), "found").select("id", "found", F.lit("ref_corrected").alias("how"), "at")
    got = sure.unionByName(nearly).unionByName(other)
    return evidence.select("id").join(got, "id", "left").select("id", "found", F.coalesce("how", F.lit("lost")).alias("how"), F.col("at.start").alias("start"), F.col("at.end").alias("end"))
