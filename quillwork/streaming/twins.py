"""Streaming twins of batch operators, over study intervals and attempts.

Each takes a streaming DataFrame and gives one. ``drained`` runs it over what there is now and reads the outcome: updates
carry the number of their batch, and of a key's updates the last one counts, so a batch that runs again changes nothing.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import memory as M
from ..operators import relational as R
from ..sources import shared


def source(spark: SparkSession, folder: str, name: str, files: int | None = None) -> DataFrame:
    """A stream of a table's Parquet: a folder of files, or one file (streams are of folders, so that one is picked out)."""
    table = spark.read.parquet(f"{folder}/{name}")
    reader = spark.readStream.schema(table.schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    alone = all(f.rstrip("/").endswith(f"/{name}") for f in table.inputFiles())
    return reader.option("pathGlobFilter", name).parquet(folder) if alone else reader.parquet(f"{folder}/{name}")


def drained(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs until all that is there has been read, with checkpoints in the shared folder; gives each key's last row."""
    spark = stream.sparkSession
    at = shared.folder(spark, "stream")
    out = f"{at}/out"

    def keep(batch: DataFrame, number: int) -> None:
        # A batch has a folder of its own, so writing it again replaces it.
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(out).drop("batch")
    return R.latest(rows, keys, [F.desc("_batch")]).drop("_batch")


def once(stream: DataFrame, id_col: str, time_col: str, delay: str) -> DataFrame:
    """Events once by identifier, as long as repetitions come within ``delay``."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def gated(stream: DataFrame, begins: DataFrame, key: str, time_col: str, now: str, tolerance: int = 60) -> DataFrame:
    """Events not more than ``tolerance`` seconds after ``now`` and not before their key's day start (a static table)."""
    limit = F.lit(now).cast("timestamp") + F.make_dt_interval(secs=F.lit(tolerance))
    return stream.join(begins, key, "left").where((F.col(time_col) <= limit) & (F.col("begin").isNull() | (F.col(time_col) >= F.col("begin")))).drop("begin")


def day_totals(stream: DataFrame, time_col: str, keys: list[str], boundary: str, delay: str) -> DataFrame:
    """Rows and seconds by study day (it begins ``boundary`` after midnight) and keys."""
    day = F.window(time_col, "1 day", startTime=boundary)
    g = stream.withWatermark(time_col, delay).groupBy(day.alias("w"), *keys).agg(F.count(F.lit(1)).alias("parts"), F.sum("seconds").alias("seconds"))
    return g.select(F.col("w.start").alias("day_start"), *keys, "parts", "seconds")


def sessions(stream: DataFrame, time_col: str, key: str, gap: str, delay: str) -> DataFrame:
    """Sessions of a key's events with less than ``gap`` between one event and the next."""
    g = stream.withWatermark(time_col, delay).groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("parts"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "parts")


def memory(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The memory model of each key after every batch; the state is the model's numbers, of all keys that share the first column
    together (a learner's): a call for each key would cost far more than its grades.

    ``stream`` has the keys, day, id and quality. Grades that come after a later day's are applied as they come.
    """
    kinds = dict(stream.dtypes)
    first, *rest = keys
    told = ", ".join(f"{k} {kinds[k]}" for k in keys)
    whole = [kinds[k] in ("tinyint", "smallint", "int", "bigint") for k in rest]  # pandas makes floats of them where some are null
    names = [*rest, "reps", "interval", "ease", "due", "last", "grades"]
    held = ", ".join([*(f"{k} array<{kinds[k]}>" for k in rest), "reps array<bigint>, interval array<bigint>, ease array<double>, due array<bigint>, last array<bigint>, grades array<int>"])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [list(c) for c in state.get] if state.exists else [[] for _ in names]
        known = {tuple(r[: len(rest)]): r[len(rest) :] for r in zip(*columns, strict=True)}
        grades_of = collections.defaultdict(list)
        for p in parts:
            for day, i, quality, *k in zip(*(p[c].tolist() for c in ("day", "id", "quality", *rest)), strict=True):
                grades_of[tuple(None if x is None or x != x else int(x) if w else x for x, w in zip(k, whole, strict=True))].append((day, i, quality))
        for k, found in grades_of.items():
            reps, interval, ease, due, last, grades = known.get(k, (0, 0, M.EASINESS, 0, None, 0))
            for day, _, quality in sorted(found):
                if last is not None and day == last:
                    continue
                before, last, grades = ease, day, grades + 1
                ease = max(M.FLOOR, ease + 0.1 - (5 - quality) * (0.08 + (5 - quality) * 0.02))
                if quality < M.PASS:
                    reps, interval = 0, M.FIRST
                else:
                    interval = M.FIRST if reps == 0 else M.SECOND if reps == 1 else int(-(-interval * before // 1))
                    reps += 1
                due = int(day) + interval
            known[k] = (reps, interval, ease, due, last, grades)
        state.update(tuple(list(c) for c in zip(*((*k, *v) for k, v in known.items()), strict=True)))
        rows = [(key[0], *k, v[5], v[0], v[1], round(v[2], 6), v[3]) for k, v in known.items() if k in grades_of]
        yield pd.DataFrame(rows, columns=[*keys, "grades", "reps", "interval", "ease", "due"], dtype=object)

    return stream.groupBy(first).applyInPandasWithState(step, f"{told}, grades int, reps bigint, interval bigint, ease double, due bigint", held, "update", GroupStateTimeout.NoTimeout)
