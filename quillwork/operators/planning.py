"""Calendars, queues and the distribution of work over days."""

from __future__ import annotations

import collections
import datetime as dt
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import groups


def spine(df: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each day from ``first`` to ``last``."""
    return df.withColumn("on_date", F.explode(F.sequence(first, last)))


def capacity(days: DataFrame, daily: int, weekend: int, rest_every: int) -> DataFrame:
    """Minutes of each day: weekends and rest days (every ``rest_every``-th of the month) have their own."""
    weekday = F.weekday("on_date")
    return days.withColumn("minutes", F.when(F.dayofmonth("on_date") % rest_every == 0, 0).when(weekday >= 5, weekend).otherwise(daily))


def queue(items: DataFrame, key: str, order: list, cap: int, unit: str) -> DataFrame:
    """Each key's first ``cap`` items, one for a unit at most."""
    once = items.withColumn("_u", F.row_number().over(Window.partitionBy(key, unit).orderBy(*order))).where("_u = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= cap).drop("_u")


def distributed(items: DataFrame, days: DataFrame, key: str) -> DataFrame:
    """Items (key, id, ord, need) onto their key's days (key, on_day, minutes): in order, each on the first day, not before
    the last item's, that still has room for it; days' room isn't exceeded, but a day that nothing is on takes any item.
    What no day takes has a null day.

    The cursor is sequential, so each key is a group of its own; a key's plan is what one person can plan.
    """

    def place(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values(["ord", "id"]), right.sort_values("on_day")
        free, day, used = right.minutes.tolist(), 0, 0
        got: list[int | None] = []
        for need in left.need.tolist():
            while day < len(free) and not (used + need <= free[day] or used == 0 and free[day] > 0):
                day, used = day + 1, 0
            got.append(int(right.on_day.iloc[day]) if day < len(free) else None)
            used += need
        return pd.DataFrame({key: [k[0]] * len(left), "id": left.id.tolist(), "on_day": pd.array(got, dtype="Int64")})

    kind = dict(items.dtypes)
    return items.groupBy(key).cogroup(days.groupBy(key)).applyInPandas(place, f"{key} {kind[key]}, id {kind['id']}, on_day bigint")


def recovered(items: DataFrame, days: DataFrame, key: str, today: int, mode: str, most_new: int = 3) -> DataFrame:
    """(key, id, on_day) of plans after what was missed is dealt with: ``mode`` is dismiss (missed items go), catch_up (each to
    the earliest day that takes it) or spread (to the day with most room, the earliest of equals).

    ``items`` has (key, id, ord, on_day, need, done, pinned), ``days`` (key, on_day, minutes). Missed are items before ``today``
    that are neither done nor pinned. A day takes an item if it isn't before today, had nothing on it, has room for it, and
    has got fewer than ``most_new`` of them; what no day takes stays where it was. A key's plan is one person's.
    """
    if mode not in ("dismiss", "catch_up", "spread"):
        raise ValueError(f"no way of recovery is called {mode}")

    def place(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        missed = (left.on_day < today) & ~left.done & ~left.pinned
        if mode == "dismiss":
            left = left[~missed]
        taken = set(left.on_day)
        room = {d: m for d, m in zip(right.on_day, right.minutes, strict=True) if d >= today and d not in taken}
        got = dict.fromkeys(room, 0)
        moved = {}
        for i, need in left[missed.reindex(left.index)].sort_values(["ord", "id"])[["id", "need"]].itertuples(index=False):
            free = [d for d in room if room[d] >= need and got[d] < most_new]
            if free:
                day = min(free) if mode == "catch_up" else min(free, key=lambda d: (-room[d], d))
                moved[i] = day
                room[day] -= need
                got[day] += 1
        return pd.DataFrame({key: [k[0]] * len(left), "id": left.id.tolist(), "on_day": [moved.get(i, d) for i, d in zip(left.id, left.on_day, strict=True)]})

    kind = dict(items.dtypes)
    return items.groupBy(key).cogroup(days.groupBy(key)).applyInPandas(place, f"{key} {kind[key]}, id {kind['id']}, on_day bigint")


def batches(rows: DataFrame, key: str | list[str], order: str, size: str, budget: int) -> DataFrame:
    """Next-fit batches: rows in order, a new batch where the next row would exceed the budget (a row may exceed it alone). Where a
    batch ends depends on all before it, so a task goes through a key's sorted rows, and holds two numbers."""
    keys = [key] if isinstance(key, str) else key

    def number(found: Iterator[tuple]) -> Iterator[tuple]:
        used = batch = 0
        for *own, n in found:
            if used and n is not None and used + n > budget:
                used, batch = 0, batch + 1
            used = None if used is None or n is None else used + n  # as SQL's sums: after an unknown size nothing is over
            yield *own, batch

    listed = rows.select(*keys, order, F.col(size).cast("bigint").alias("n"))
    told = ", ".join(f"`{c}` {t}" for c, t in listed.dtypes[:-1])
    return groups.over(listed, keys, [order, "n"], number, f"{told}, batch bigint", whole=False)


def _utc(day: Column, minutes: Column, zone: Column) -> Column:
    """The moment (UTC, without zone) at which it is ``minutes`` after midnight on a local day, on a day of any length."""
    local = day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return F.convert_timezone(zone, F.lit("UTC"), local)


def budget_minutes(day: Column) -> Column:
    """What a configuration allows for a day: nothing on days of rest, after the deadline and, unless it is enabled, on the day of
    the exam; else what the date, the weekday or the rule says; a share of it on the day before the deadline."""
    c = F.col
    own = c("date_minutes")[day]
    usual = F.coalesce(c("weekday_minutes")[F.weekday(day)], c("daily_minutes"), F.lit(0))
    off = F.array_contains("rest_dates", day) | (day > c("deadline")) | ((day == c("deadline")) & ~c("exam_day_enabled"))
    last = day == F.date_sub("deadline", 1)
    return F.when(F.coalesce(off, F.lit(False)), 0).otherwise(F.coalesce(own, F.when(F.coalesce(last, F.lit(False)), F.floor(usual * c("final_day_ratio"))).otherwise(usual))).cast("bigint")


def free_minutes(days: DataFrame) -> DataFrame:
    """``days`` with free (minutes without sleep and what is busy) and capacity (the budget, where that is less).

    A row is a configuration and a study day (``on_date``): zone, boundary, sleep (struct from, to), busy (array of structs
    weekday, on_date, from, to; null for any), deadline, exam_time (nulls: none), exam_reserve, exam_day_enabled, daily_minutes,
    weekday_minutes, date_minutes, rest_dates, final_day_ratio, used_seconds, now (UTC, null: all of the day). Times are minutes
    after midnight in the zone; what ends before it begins ends on the next day. A study day is as long as the clock makes it.
    It ends where the reserve before an exam begins. Windows of the days before and after reach into it; what overlaps counts
    once. All is in the row: nothing is shuffled.
    """
    c, day = F.col, F.col("on_date")
    left = F.greatest(_utc(day, c("boundary"), c("zone")), c("now"))
    midnight = _utc(c("deadline"), F.lit(0), c("zone"))
    reserve = _utc(c("deadline"), c("exam_time"), c("zone")) - F.make_dt_interval(F.lit(0), F.lit(0), c("exam_reserve"))
    no_day = c("exam_time").isNull() | ~c("exam_day_enabled")
    right = F.least(_utc(F.date_add(day, 1), c("boundary"), c("zone")), reserve, F.when(no_day, midnight))
    rows = days.withColumn("_left", left).withColumn("_right", right)

    def on(offset: int) -> Column:
        civil = F.date_add(day, offset)
        fits = lambda w: F.when(w["on_date"].isNotNull(), w["on_date"] == civil).otherwise(w["weekday"].isNull() | (w["weekday"] == F.weekday(civil)))
        times = lambda w: F.struct(w["from"].alias("from"), w["to"].alias("to"))
        every = F.concat(F.array(times(c("sleep"))), F.transform(F.filter("busy", fits), times))
        to = lambda w: F.when(w["to"] <= w["from"], w["to"] + 1440).otherwise(w["to"])
        end = lambda w: _utc(F.date_add(civil, F.floor(to(w) / 1440).cast("int")), to(w) % 1440, c("zone"))
        return F.transform(every, lambda w: F.struct(F.greatest(c("_left"), _utc(civil, w["from"], c("zone"))).alias("a"), F.least(c("_right"), end(w)).alias("z")))

    blocked = F.array_sort(F.filter(F.concat(*(on(i) for i in (-1, 0, 1))), lambda w: w["z"] > w["a"]))
    length = lambda a, z: F.timestamp_diff("SECOND", a, z)
    start = F.struct(c("_left").alias("to"), F.lit(0).cast("bigint").alias("sum"))
    step = lambda s, w: F.struct(F.greatest(s["to"], w["z"]).alias("to"), (s["sum"] + F.greatest(F.lit(0), length(F.greatest(s["to"], w["a"]), w["z"]))).alias("sum"))
    taken = F.aggregate(blocked, start, step)["sum"]
    free = F.when(c("_right") > c("_left"), F.greatest(F.lit(0), length(c("_left"), c("_right")) - taken)).otherwise(0)
    rest = F.greatest(F.lit(0), budget_minutes(day) * 60 - F.coalesce("used_seconds", F.lit(0)))
    rows = rows.withColumn("_free", free)
    return rows.withColumn("free", F.floor(c("_free") / 60).cast("bigint")).withColumn("capacity", F.floor(F.least("_free", rest) / 60).cast("bigint")).drop("_left", "_right", "_free")


def runs_within(rows: DataFrame, key: str, order: str, block: str, size: str, most: int) -> DataFrame:
    """``key``, ``order``, run, part: neighbouring rows of the same block are a run; a run is cut where the next row would make a
    part exceed ``most`` (a row may exceed it alone)."""
    w = Window.partitionBy(key).orderBy(order)
    fresh = F.when(F.col(block).eqNullSafe(F.lag(block).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = rows.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(w))
    return batches(runs, [key, "run"], order, size, most).withColumnRenamed("batch", "part")


#: Tokens for a word or mark, and where a text may be cut.
TOKENS_A_PIECE = 1.35
_PIECES, _ENDS = re.compile(r"\w+|[^\w\s]"), re.compile(r"\n\s*\n|(?<=[.!?])\s+")


def estimated_tokens(text: str) -> int:
    return max(1, math.ceil(len(_PIECES.findall(text)) * TOKENS_A_PIECE))


def pieces_of(text: str, budget: int) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of a text's pieces of at most ``budget`` tokens: as many whole sentences as fit. A sentence that is
    too large is cut into equal widths, as many as its tokens ask for (forced)."""
    if estimated_tokens(text) <= budget:
        return [(0, len(text), False)]
    stops = [0, *(m.end() for m in _ENDS.finditer(text)), len(text)]
    out: list[tuple[int, int, bool]] = []
    open_ = False  # whether the last piece takes more sentences
    for start, end in ((a, b) for a, b in zip(stops, stops[1:], strict=False) if a < b):
        size = estimated_tokens(text[start:end])
        if size > budget:
            width = math.ceil((end - start) / math.ceil(size / budget))
            out += [(a, min(end, a + width), True) for a in range(start, end, width)]
            open_ = False
        elif open_ and estimated_tokens(text[out[-1][0] : end]) <= budget:
            out[-1] = (out[-1][0], end, False)
        else:
            out.append((start, end, False))
            open_ = True
    return out


def packets(units: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """``key``, ``order``, packet, start, end, tokens, forced: the pieces of units in order, in packets of at most ``budget``
    tokens; two pieces of the same unit are never in one packet. Null texts are empty ones, of one token."""

    @F.pandas_udf("array<struct<start:int,end:int,tokens:int,forced:boolean>>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start": a, "end": b, "tokens": estimated_tokens((t or "")[a:b]), "forced": f} for a, b, f in pieces_of(t or "", budget)])

    kind = dict(units.dtypes)[order]
    rows = units.select(key, F.col(order).alias("o"), F.posexplode(cut(F.col(text))).alias("i", "p"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", "i", F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.col("p.tokens").alias("tokens"), F.col("p.forced").alias("forced")))).alias("g"))
    # A packet's last piece says all that the next one needs to know.
    begin = F.struct(F.lit(0).alias("used"), F.lit(0).alias("packet"), F.lit(None).cast(kind).alias("last"), F.array().cast("array<int>").alias("out"))
    full = lambda s, x: (s["used"] > 0) & ((s["used"] + x["tokens"] > budget) | F.coalesce(s["last"] == x["o"], F.lit(False)))
    step = lambda s, x: F.struct(F.when(full(s, x), x["tokens"]).otherwise(s["used"] + x["tokens"]).alias("used"), (s["packet"] + full(s, x).cast("int")).alias("packet"), x["o"].alias("last"), F.concat(s["out"], F.array(s["packet"] + full(s, x).cast("int"))).alias("out"))
    numbered = listed.withColumn("_n", F.aggregate("g", begin, step)["out"])
    return numbered.select(key, F.inline(F.arrays_zip("g", F.col("_n").alias("packet")))).select(key, F.col("g.o").alias(order), "packet", "g.start", "g.end", "g.tokens", "g.forced")


#: Fixed value: days that a plan of lessons may reach ahead.
MAX_DAYS = 730


def lesson_plan(lessons: DataFrame, plan: DataFrame, key: str, today: dt.date, daily: int, days_a_week: int, deadline: dt.date | None = None, most_days: int | None = MAX_DAYS) -> DataFrame:
    """``key``, id, on_date: the plan with what it lacks put on the days from ``today`` on, in order and whole: a day takes a lesson
    if nothing is on it, or if both fit ``daily`` minutes. Weekends are what is beyond ``days_a_week``.

    ``lessons`` has (key, id, ord, minutes, eligible, completed), ``plan`` (key, id, on_date, minutes), which stays. What comes
    after the ``deadline``, or ``most_days`` (None: no bound), isn't planned. The days fill one after the other, so a key's plan
    is one task's.
    """
    kinds = dict(lessons.dtypes)

    def fill(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        have, load = set(right.id), collections.Counter()
        for day, minutes in zip(right.on_date, right.minutes, strict=True):
            load[day] += minutes
        rows = left[left.eligible & ~left.completed & ~left.id.isin(have)].sort_values(["ord", "id"])
        todo, out, offset = collections.deque(zip(rows.id, rows.minutes, strict=True)), list(zip(right.id, right.on_date, strict=True)), 0
        while todo and days_a_week > 0 and (most_days is None or offset < most_days):
            day = today + dt.timedelta(offset)
            if deadline and day > deadline:
                break
            if day.weekday() < days_a_week:
                while todo and (not load[day] or load[day] + todo[0][1] <= daily):
                    lesson, minutes = todo.popleft()
                    out.append((lesson, day))
                    load[day] += minutes
                    if load[day] >= daily:
                        break
            offset += 1
        return pd.DataFrame([(k[0], *x) for x in out], columns=[key, "id", "on_date"])

    return lessons.groupBy(key).cogroup(plan.groupBy(key)).applyInPandas(fill, f"{key} {kinds[key]}, id {kinds['id']}, on_date date")


def finish_forecast(lessons: DataFrame, plan: DataFrame, key: str, today: dt.date, daily: int, days_a_week: int) -> DataFrame:
    """``key``, remaining (eligible lessons that aren't completed) and finish (the last day of these; null without any), if the
    plan goes on as it is, beyond any deadline and however long it takes. What the plan has for days before ``today`` and isn't done counts as to do."""
    open_ = lessons.where("eligible AND NOT completed").select(key, "id")
    ahead = lesson_plan(lessons, plan.where(F.col("on_date") >= F.lit(today)), key, today, daily, days_a_week, most_days=None)
    last = ahead.join(open_, [key, "id"], "left_semi").groupBy(key).agg(F.max("on_date").alias("finish"))
    return lessons.select(key).distinct().join(open_.groupBy(key).agg(F.count(F.lit(1)).alias("remaining")), key, "left").join(last, key, "left").select(key, F.coalesce("remaining", F.lit(0)).alias("remaining"), "finish")
