"""Spaced repetition, status and forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the memory model: the first easiness, its floor, the passing quality, the first two intervals.
EASINESS, FLOOR, PASS, FIRST, SECOND = 2.5, 1.3, 3, 1, 6


def replay(graded: DataFrame, key: list[str]) -> DataFrame:
    """State of the memory model by key after all its grades (columns day, id, quality), in order.

    Of a day's grades only the first counts. A pass moves the interval to 1, 6, then the last interval times the easiness
    from before the grade, rounded up; a failure resets repetitions and the interval to 1. A fold over each key's sorted
    array stays in the JVM; a key has as many grades as a learner has given it.
    """
    first = Window.partitionBy(*key, "day").orderBy("id")
    days = graded.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    rows = days.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("day", "id", "quality"))).alias("g"))
    start = F.struct(F.lit(0).cast("bigint").alias("reps"), F.lit(0).cast("bigint").alias("interval"), F.lit(EASINESS).alias("ease"), F.lit(0).cast("bigint").alias("due"))

    def step(s: Column, x: Column) -> Column:
        q = x["quality"].cast("double")
        ease = F.greatest(F.lit(FLOOR), s["ease"] + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))
        passed = x["quality"] >= PASS
        interval = F.when(~passed, FIRST).when(s["reps"] == 0, FIRST).when(s["reps"] == 1, SECOND).otherwise(F.ceil(s["interval"] * s["ease"])).cast("bigint")
        return F.struct(F.when(passed, s["reps"] + 1).otherwise(0).cast("bigint").alias("reps"), interval.alias("interval"), ease.alias("ease"), (x["day"] + interval).cast("bigint").alias("due"))

    return rows.withColumn("s", F.aggregate("g", start, step)).select(*key, F.size("g").alias("grades"), "s.reps", "s.interval", F.round("s.ease", 6).alias("ease"), "s.due")


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The 95 % interval of a share; null without trials."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = successes / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def status(attempts: DataFrame, key: list[str]) -> DataFrame:
    """unseen, understood, practiced or mastered, by what was opened, tried and passed (twice and last: mastered)."""
    a = attempts.groupBy(*key).agg(
        F.count_if(F.col("outcome") == "passed").alias("passed"), F.count_if(F.col("outcome").isNotNull()).alias("tried"), F.count(F.lit(1)).alias("opened"),
        F.max_by("outcome", F.when(F.col("outcome").isNotNull(), F.struct("moment", "id"))).alias("last"))
    return a.withColumn("status", F.when((F.col("passed") >= 2) & (F.col("last") == "passed"), "mastered").when(F.col("tried") > 0, "practiced").when(F.col("opened") > 1, "understood").otherwise("unseen"))
