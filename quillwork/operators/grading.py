"""Deterministic checks of answers, citations and quotations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def single(answer: Column, key: Column) -> Column:
    return (answer == key).cast("double")


def multiple(answer: Column, key: Column) -> Column:
    """Right choices less wrong ones, of the key's number; not under 0."""
    right, wrong = F.size(F.array_intersect(answer, key)), F.size(F.array_except(answer, key))
    return F.greatest(F.lit(0.0), (right - wrong) / F.size(key))


def ordering(answer: Column, key: Column) -> Column:
    """Share of places that are right."""
    right = F.aggregate(F.zip_with(answer, key, lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int")), F.lit(0), lambda s, x: s + x)
    return right / F.size(key)


def matching(answer: Column, key: Column) -> Column:
    """Share of pairs that are right; an answer without one (null) has none there."""
    return ordering(answer, key)


def blank(given: Column, accepted: Column) -> Column:
    """Whether a blank has an accepted text (case and white space aside), or the number that an accepted text is, if it is one
    as a whole."""
    form = lambda x: X.fold(X.squeezed(x))
    whole = lambda x: F.when(F.regexp_replace(x, r"[\s\u00A0]", "").rlike(r"^[-+−–]?\d+(?:[.,]\d+)?$"), X.number(F.regexp_replace(x, r"[\s\u00A0]", "")))
    g = X.number(given)
    same = F.exists(accepted, lambda a: F.coalesce(form(a) == form(given), F.lit(False)) | F.coalesce(F.abs(whole(a) - g) <= 1e-9 * F.greatest(F.abs(whole(a)), F.abs(g)), F.lit(False)))
    return F.coalesce(same, F.lit(False))


def blanks(given: Column, accepted: Column) -> Column:
    """Share of blanks that are right; both arrays are of the same size."""
    right = F.zip_with(given, accepted, lambda g, a: blank(F.coalesce(g, F.lit("")), a).cast("int"))
    return F.aggregate(right, F.lit(0), lambda s, x: s + x) / F.size(accepted)


def numeric(answer: Column, key: Column, absolute: float, relative: float) -> Column:
    a = X.number(answer)
    return F.coalesce(F.abs(a - key) <= F.greatest(F.lit(absolute), F.abs(key) * relative), F.lit(False)).cast("double")


def term_coverage(answer: Column, terms: Column) -> Column:
    """Share of ``terms`` that the answer has."""
    return F.size(F.array_intersect(F.array_distinct(terms), X.tokens(answer))) / F.nullif(F.size(F.array_distinct(terms)), F.lit(0))


def outcome(coverage: Column, full: float = 0.8, some: float = 0.25) -> Column:
    return F.when(coverage >= full, "passed").when(coverage >= some, "partial").otherwise("failed")


def cited(x: Column) -> Column:
    """Source numbers in [S1] and [S1, S2], in order, once each."""
    groups = F.regexp_extract_all(x, F.lit(r"\[(S\d+(?:\s*,\s*S\d+)*)\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.regexp_extract_all(g, F.lit(r"S(\d+)"), F.lit(1)), lambda n: n.cast("int")))))


def tiled(spans: DataFrame, key: str, length: str) -> DataFrame:
    """Keys whose spans (start, end) tile their text exactly: no gap, no overlap, from 0 to ``length``."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("start", "end")
    s = spans.withColumn("_p", F.coalesce(F.lag("end").over(w), F.lit(0)))
    return s.groupBy(key).agg((F.bool_and(F.col("_p") == F.col("start")) & (F.max("end") == F.max(length))).alias("tiled"))
