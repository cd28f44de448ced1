"""Numbered lists in lines of text: items with the lines that continue them, and the choice of the list that is meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared

# Fixed value: what begins a numbered item ("3." or "3)" but not "3.1", or "3 ").
ITEM = r"^\s*(?:(\d{1,4})[.)](?!\d)\s*|(\d{1,4})\s+)(\S.*?)\s*$"


def in_series(rows: DataFrame) -> DataFrame:
    """Rows (key, pos, n, ...; n is null where a line has no number) with the number of their ``series``, 0 before the first."""
    order = Window.partitionBy("key").orderBy("pos")
    rows = rows.withColumn("_before", F.last("n", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.col("n").isNotNull() & ~F.coalesce(F.col("n") == F.col("_before") + 1, F.lit(False))
    return rows.withColumn("series", F.count_if(fresh).over(order)).drop("_before")


def items(lines: DataFrame) -> DataFrame:
    """key, series, number, text, pos, until: the items of (key, pos, line), each with the lines up to the next one; a series ends
    where a number doesn't follow the one before. ``until`` is the place of an item's last line; blank lines don't count."""
    order = Window.partitionBy("key").orderBy("pos")
    line = F.trim("line")
    part = lambda i: F.regexp_extract(line, ITEM, i)
    number = F.coalesce(F.nullif(part(1), F.lit("")), F.nullif(part(2), F.lit(""))).cast("int")
    rows = lines.where(F.length(line) > 0).select("key", "pos", number.alias("n"), F.when(number.isNotNull(), F.trim(part(3))).otherwise(line).alias("said"))
    rows = in_series(rows.withColumn("_item", F.count("n").over(order)).where("_item > 0"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), " ")
    return rows.groupBy("key", "series", "_item").agg(F.max("n").alias("number"), told.alias("text"), F.min("pos").alias("pos"), F.max("pos").alias("until")).drop("_item")


def _chosen(all_: Column, most: Column, expected: Column) -> Column:
    """Of an array of series (s, first, last, n, ...), of which the longest has ``most`` items, a struct of how, ambiguous, chain and dropped.

    Without a number that is expected, the longest series if there is one longest. With one, the series that has as many
    items; else the chain of series that go on from the first one with ever larger numbers, if it has more than one part or as
    many items; else the longest.
    """
    none = F.filter(all_, lambda x: F.lit(False))
    longest = F.filter(all_, lambda x: x["n"] == most)
    exact = F.filter(all_, lambda x: x["n"] == expected)
    # Series are in order; a part of the chain begins above all parts before it.
    start = F.struct(F.lit(-1).alias("top"), none.alias("chain"))
    step = lambda c, x: F.when(x["first"] > c["top"], F.struct(x["last"].alias("top"), F.concat(c["chain"], F.array(x)).alias("chain"))).otherwise(c)
    chain = F.aggregate(all_, start, step)["chain"]
    total = F.aggregate(chain, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    stitched = (F.size(chain) > 1) | (total == expected)
    one = lambda how, few: F.when(F.size(few) == 1, F.struct(F.lit(how).alias("how"), F.lit(False).alias("ambiguous"), few.alias("chain"), none.alias("dropped"))).otherwise(F.struct(F.lit(how).alias("how"), F.lit(True).alias("ambiguous"), none.alias("chain"), none.alias("dropped")))
    joined = F.struct(F.lit("stitched").alias("how"), F.lit(False).alias("ambiguous"), chain.alias("chain"), F.filter(all_, lambda x: ~F.array_contains(F.transform(chain, lambda y: y["s"]), x["s"])).alias("dropped"))
    return F.when(expected.isNull(), one("longest", longest)).when(F.size(exact) > 0, one("exact", exact)).when(stitched, joined).otherwise(one("longest", longest))


def choice(runs: DataFrame, expected: DataFrame | None) -> DataFrame:
    """key, expected, how, ambiguous, chain and dropped of series (key, series, first, last, n, ...); ``expected`` as in
    ``selected``."""
    item = F.struct(F.col("series").alias("s"), *(c for c in runs.columns if c not in ("key", "series")))
    of = runs.groupBy("key").agg(F.array_sort(F.collect_list(item)).alias("all"), F.max("n").alias("most"))
    of = of.withColumn("expected", F.lit(None).cast("int")) if expected is None else of.join(expected, "key", "left")
    return of.select("key", "expected", _chosen(F.col("all"), F.col("most"), F.col("expected")).alias("x")).select("key", "expected", "x.*")


def selected(lines: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The list that is meant in each key's ``lines`` (key, pos, line), and its items (key, number, text, pos).

    ``expected`` has (key, expected), the number of items if it is known. Of each key that has numbered lines: how (longest,
    exact, stitched), ambiguous (several lists would do; then nothing is chosen), items, parts, dropped (items of series that
    the chain left out), gap (lines between parts), before and after (lines outside), first and last (numbers), source_end (the
    place of the last line). Keys without numbered lines have no row.
    """
    every = shared.cut(items(lines))
    runs = every.groupBy("key", "series").agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"), F.max("until").alias("until"))
    of = choice(runs, expected)
    spans = of.select("key", F.posexplode("chain").alias("i", "c")).select("key", "c.s", F.col("c.pos").alias("from"), F.col("c.until").alias("to"))
    outer = of.where(F.size("chain") > 0).select("key", F.element_at("chain", 1)["pos"].alias("_a"), F.element_at("chain", -1)["until"].alias("_z"))
    said = lines.where(F.length(F.trim("line")) > 0).select("key", "pos").join(outer, "key")
    inside = F.exists("_spans", lambda s: (F.col("pos") >= s["pos"]) & (F.col("pos") <= s["until"]))
    held = said.join(of.select("key", F.col("chain").alias("_spans")), "key")
    counts = held.groupBy("key").agg(F.count_if(F.col("pos") < F.col("_a")).alias("before"), F.count_if(F.col("pos") > F.col("_z")).alias("after"), F.count_if((F.col("pos") > F.col("_a")) & (F.col("pos") < F.col("_z")) & ~inside).alias("gap"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    chosen = of.join(counts, "key", "left").select(
        "key", "expected", "how", "ambiguous", total(F.col("chain")).alias("items"), F.size("chain").alias("parts"), total(F.col("dropped")).alias("dropped"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("gap", "before", "after")), F.try_element_at("chain", F.lit(1))["first"].alias("first"), F.try_element_at("chain", F.lit(-1))["last"].alias("last"), F.try_element_at("chain", F.lit(-1))["until"].alias("source_end"))
    own = every.join(spans.select("key", F.col("s").alias("series")), ["key", "series"]).select("key", "number", "text", "pos")
    return chosen, own
