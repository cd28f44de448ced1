"""Interval and event-time operators. Times are whole seconds; ends are exclusive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def _before(key: Sequence[str], order: Sequence[str], value: str = "end") -> Column:
    """The largest ``value`` of the rows before in the key's order."""
    return F.max(value).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def union_seconds(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The length of the union of each key's intervals."""
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(_before(key, ["start", "id"]), F.col("start"))))
    return df.withColumn("_new", new).groupBy(*key).agg(F.sum("_new").alias("seconds"), F.count(F.lit(1)).alias("intervals"))


def clipped(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each interval without what the key's earlier ones cover; those that nothing is left of are dropped."""
    start = F.greatest(F.col("start"), F.coalesce(_before(key, ["start", "id"]), F.col("start")))
    return df.withColumn("from", start).where("from < end")


def by_study_day(df: DataFrame, boundary: int = 0) -> DataFrame:
    """Intervals cut where study days begin (``boundary`` seconds after midnight): a row for each day, with its number."""
    first, last = F.floor((F.col("start") - boundary) / DAY), F.floor((F.greatest(F.col("end") - 1, F.col("start")) - boundary) / DAY)
    days = df.withColumn("day", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    begin = F.col("day") * DAY + boundary
    return days.withColumn("from", F.greatest("start", begin)).withColumn("to", F.least("end", begin + DAY))


def episodes(df: DataFrame, key: Sequence[str], gap: int) -> DataFrame:
    """Runs of a key's intervals with at most ``gap`` seconds between one's start and all earlier ones' end.

    Seconds of overlaps count once. A run is known by its number in the key.
    """
    before = _before(key, ["start", "id"])
    order = Window.partitionBy(*key).orderBy("start", "id")
    fresh = (F.coalesce(F.col("start") - before > gap, F.lit(True))).cast("int")
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))))
    runs = df.withColumn("_new", new).withColumn("_fresh", fresh).withColumn("episode", F.sum("_fresh").over(order))
    return runs.groupBy(*key, "episode").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("_new").alias("seconds"), F.count(F.lit(1)).alias("parts"))


def coalesced(df: DataFrame, stream: str, same: Sequence[str], gap: int) -> DataFrame:
    """Neighbours in a stream's order with equal ``same`` and a gap of at most ``gap`` become one; any other row between parts
    them."""
    order = Window.partitionBy(stream).orderBy("start", "id")
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.lag(c).over(order).eqNullSafe(F.col(c))
    fresh = (F.lag("id").over(order).isNull() | differs | (F.col("start") - F.lag("end").over(order) > gap)).cast("int")
    runs = df.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(order))
    return runs.groupBy(stream, "run", *same).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("parts"))


def absorbed(df: DataFrame, key: str, minor: Column, tolerance: int) -> DataFrame:
    """Drops ``minor`` events that have a major one of the key within ``tolerance`` seconds: two windows, no range join."""
    major = F.when(~minor, F.col("moment"))
    order = Window.partitionBy(key).orderBy("moment", "id")
    last = F.last(major, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    following = F.first(major, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    near = F.coalesce(F.col("moment") - last <= tolerance, F.lit(False)) | F.coalesce(following - F.col("moment") <= tolerance, F.lit(False))
    return df.withColumn("_near", near).where(~(minor & F.col("_near"))).drop("_near")


def streaks(days: DataFrame, key: str) -> DataFrame:
    """Runs of consecutive day numbers of a key: first day and length."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("day"))
    return days.select(key, "day").distinct().withColumn("_island", F.col("day") - n).groupBy(key, "_island").agg(F.min("day").alias("first_day"), F.count(F.lit(1)).alias("length")).drop("_island")


def pace(daily: DataFrame, key: str, days: int = 7) -> DataFrame:
    """Mean seconds of the ``days`` days up to each active day; days without activity count as 0 (a range frame)."""
    frame = Window.partitionBy(key).orderBy("day").rangeBetween(-(days - 1), 0)
    return daily.withColumn("pace", F.sum("seconds").over(frame) / days).withColumn("active", F.count(F.lit(1)).over(frame))


def first_opened(df: DataFrame, key: str, item: str) -> DataFrame:
    """How many items a key has opened for the first time by each day."""
    first = df.groupBy(key, item).agg(F.min("day").alias("day")).groupBy(key, "day").agg(F.count(F.lit(1)).alias("n"))
    return first.withColumn("opened", F.sum("n").over(Window.partitionBy(key).orderBy("day"))).drop("n")


def speech(df: DataFrame, key: str, pause: int) -> DataFrame:
    """Words a minute, pauses of ``pause`` seconds or more, and the share of silence, of timed words."""
    gap = F.greatest(F.lit(0), F.lead("start").over(Window.partitionBy(key).orderBy("start", "id")) - F.col("end"))
    g = df.withColumn("_gap", gap).groupBy(key).agg(
        F.count(F.lit(1)).alias("words"), (F.max("end") - F.min("start")).alias("span"), F.count_if(F.col("_gap") >= pause).alias("pauses"), F.coalesce(F.sum("_gap"), F.lit(0)).alias("silence"))
    span = F.nullif(F.col("span"), F.lit(0))
    return g.select(key, "words", "pauses", F.round(F.col("words") * 60 / span, 6).alias("wpm"), F.round(F.col("silence") / span, 6).alias("silence_share"))
