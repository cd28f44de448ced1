"""Reports over facts and links: latest rows, pages with totals, pivots with fixed domains, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables as T


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``. An aggregate of a struct would do for few columns; this keeps all."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int, totals: dict[str, Column]) -> DataFrame:
    """A page of ``df`` with aggregates over all of it in each row. Only the page's rows are sorted out (top k)."""
    whole = df.agg(*(c.alias(k) for k, c in totals.items())).withColumn("_one", F.lit(1))
    rows = df.orderBy(*order).offset(offset).limit(limit).withColumn("_one", F.lit(1))
    return rows.join(F.broadcast(whole), "_one").drop("_one")  # one row


def usage(df: DataFrame, key: str) -> DataFrame:
    """Runs by key; money and successes only of succeeded ones."""
    won = F.col("status") == "succeeded"
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(won).alias("succeeded"), F.coalesce(F.sum(F.when(won, F.col("cost"))), F.lit(0).cast("decimal(28,2)")).alias("cost"),
        F.count_if(F.col("status") == "running").alias("running"))


def budgeted(df: DataFrame, limit: int) -> DataFrame:
    """Each run with what its day had spent before it (succeeded and running ones count) and whether it fits the limit."""
    order = Window.partitionBy("day").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    counts = F.when(F.col("status") != "failed", F.col("cost")).otherwise(F.lit(0).cast("decimal(18,2)"))
    before = F.coalesce(F.sum(counts).over(order), F.lit(0).cast("decimal(28,2)"))
    return df.withColumn("before", before).withColumn("fits", F.col("before") + F.col("cost") <= limit)


def histogram(df: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """Counts of each whole value of a fixed domain; values that don't occur have 0."""
    spark = df.sparkSession
    domain = spark.range(low, high + 1).select(F.col("id").cast("int").alias(value))
    found = df.where(F.col(value).between(low, high)).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return domain.join(F.broadcast(found), value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))


def optional_filters(df: DataFrame, **given: object) -> DataFrame:
    """Equality with each value that isn't None."""
    for name, value in given.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def divided(links: DataFrame, left: str, right: str, all_right: DataFrame) -> DataFrame:
    """Those of ``left`` that are linked with every row of ``all_right`` (relational division, by counts). Few rows of ``all_right``
    go to where the links are read: links dealt out by ``right`` would be as few parts."""
    need = all_right.select(right).distinct()
    have = links.join(T.bounded(need), right, "left_semi").groupBy(left).agg(F.countDistinct(right).alias("have"))
    return have.join(F.broadcast(need.agg(F.count(F.lit(1)).alias("need"))), F.col("have") == F.col("need")).select(left)


def pivoted(df: DataFrame, row: str, column: str, values: Sequence[str], other: str | None = None, **more: Column) -> DataFrame:
    """Counts by ``row`` with one column for each of ``values`` (nulls under ``other``), zeros included; and ``more``."""
    c = F.coalesce(F.col(column), F.lit(other)) if other else F.col(column)
    return df.groupBy(row).agg(*(F.count_if(c == v).alias(v) for v in values), F.count(F.lit(1)).alias("total"), *(a.alias(n) for n, a in more.items()))
