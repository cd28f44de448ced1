"""Event-time queries: study days, interval algebra, episodes, streaks, pace, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import timeline as L
from ..sources import tables as T
from .registry import query

_PREV = "max(\"end\") OVER (PARTITION BY {k} ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _days(boundary: int) -> str:
    return f"""days AS (SELECT *, greatest(start, day * 86400 + {boundary}) AS f, least("end", day * 86400 + {boundary} + 86400) AS t FROM (
  SELECT *, unnest(range(CAST(floor((start - {boundary}) / 86400.0) AS BIGINT), CAST(floor((greatest("end" - 1, start) - {boundary}) / 86400.0) AS BIGINT) + 1)) AS day FROM intervals))"""


@query(f"WITH {T.INTERVALS}, {_days(14400)} SELECT day, kind, CAST(sum(t - f) AS BIGINT) AS seconds, count(*) AS parts FROM days GROUP BY day, kind")
def study_day_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study days begin at four."""
    d = L.by_study_day(T.intervals(spark, sf_dir), 4 * 3600)
    return d.groupBy("day", "kind").agg(F.sum(F.col("to") - F.col("from")).alias("seconds"), F.count(F.lit(1)).alias("parts"))


@query("""SELECT CAST(CAST((ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin') - INTERVAL 4 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1""")
def study_day_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study day of events in a time zone: local time less the day's boundary."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Berlin"), F.col("ts"))
    day = (local - F.make_dt_interval(F.lit(0), F.lit(4))).cast("date").cast("string")
    return T.read(spark, sf_dir, "events").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {T.INTERVALS}, p AS (SELECT *, {_PREV.format(k='session')} AS b FROM intervals)
  SELECT session, CAST(sum(greatest(0, "end" - greatest(start, coalesce(b, start)))) AS BIGINT) AS seconds, count(*) AS intervals FROM p GROUP BY session""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.union_seconds(T.intervals(spark, sf_dir), ["session"])


@query(f"""WITH {T.INTERVALS}, p AS (SELECT *, {_PREV.format(k='session')} AS b FROM intervals), c AS (SELECT *, greatest(start, coalesce(b, start)) AS f FROM p)
  SELECT session, kind, CAST(sum("end" - f) AS BIGINT) AS seconds, count(*) AS kept FROM c WHERE f < "end" GROUP BY session, kind""")
def interval_clip_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = L.clipped(T.intervals(spark, sf_dir), ["session"])
    return c.groupBy("session", "kind").agg(F.sum(F.col("end") - F.col("from")).alias("seconds"), F.count(F.lit(1)).alias("kept"))


@query(f"WITH {T.INTERVALS}, {_days(0)} SELECT id, day, f AS \"from\", t AS \"to\" FROM days")
def day_split_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All intervals, cut at midnight."""
    return L.by_study_day(T.intervals(spark, sf_dir)).select("id", "day", "from", "to")


@query(f"""WITH {T.INTERVALS}, p AS (SELECT *, {_PREV.format(k='session')} AS b FROM intervals),
  e AS (SELECT *, sum(CASE WHEN b IS NULL OR start - b > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY start, id) AS episode FROM p)
  SELECT session, CAST(episode AS BIGINT) AS episode, min(start) AS start, max("end") AS "end", CAST(sum(greatest(0, "end" - greatest(start, coalesce(b, start)))) AS BIGINT) AS seconds, count(*) AS parts
  FROM e GROUP BY session, episode""")
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.episodes(T.intervals(spark, sf_dir), ["session"], 7200)


@query(f"""WITH {T.INTERVALS}, p AS (SELECT *, lag(id) OVER w AS pid, lag(kind) OVER w AS pk, lag("end") OVER w AS pe FROM intervals WINDOW w AS (PARTITION BY session ORDER BY start, id)),
  r AS (SELECT *, sum(CASE WHEN pid IS NULL OR pk <> kind OR start - pe > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY start, id) AS run FROM p)
  SELECT session, CAST(run AS BIGINT) AS run, kind, min(start) AS start, max("end") AS "end", count(*) AS parts FROM r GROUP BY session, run, kind""")
def adjacent_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.coalesced(T.intervals(spark, sf_dir), "session", ["kind"], 3600)


@query(f"""WITH {T.ATTEMPTS}, w AS (SELECT *, last_value(CASE WHEN kind <> 'view' THEN moment END IGNORE NULLS) OVER (PARTITION BY session ORDER BY moment, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
    first_value(CASE WHEN kind <> 'view' THEN moment END IGNORE NULLS) OVER (PARTITION BY session ORDER BY moment, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f FROM attempts)
  SELECT id, session, kind, moment FROM w WHERE NOT (kind = 'view' AND (coalesce(moment - b <= 3600, false) OR coalesce(f - moment <= 3600, false)))""")
def view_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views within an hour of work are part of it."""
    return L.absorbed(T.attempts(spark, sf_dir), "session", F.col("kind") == "view", 3600).select("id", "session", "kind", "moment")


@query(f"""WITH {T.INTERVALS}, {T.ATTEMPTS} SELECT i.id, i.session, i.start FROM intervals i WHERE i.kind = 'click' AND NOT EXISTS (SELECT 1 FROM attempts a
  WHERE a.session = i.session AND a.kind = 'purchase' AND a.moment >= i.start AND a.moment <= i."end" + 7200)""")
def answer_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer intervals without an attempt inside them or up to two hours after: the next attempt from the start on decides."""
    i = T.intervals(spark, sf_dir).where("kind IN ('click', 'purchase')")
    order = Window.partitionBy("session").orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    following = F.min(F.when(F.col("kind") == "purchase", F.col("start"))).over(order)
    return i.withColumn("n", following).where("kind = 'click' AND (n IS NULL OR n > end + 7200)").select("id", "session", "start")


@query(f"""WITH {T.ATTEMPTS}, f AS (SELECT * FROM attempts WHERE day BETWEEN 19725 AND 19740 AND coalesce(outcome, 'pending') = 'pending' AND kind = 'view')
  SELECT id, session, node, day, (SELECT count(*) FROM f) AS total FROM f ORDER BY moment DESC, id DESC LIMIT 20 OFFSET 40""")
def history_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of what is pending of one kind in a window of days, with the number of all."""
    df = T.attempts(spark, sf_dir).where(F.col("day").between(19725, 19740) & (F.coalesce("outcome", F.lit("pending")) == "pending") & (F.col("kind") == "view"))
    return R.page(df.select("id", "session", "node", "day", "moment"), [F.desc("moment"), F.desc("id")], 40, 20, {"total": F.count(F.lit(1))}).drop("moment")


@query(f"""WITH {T.ATTEMPTS}, d AS (SELECT DISTINCT session, day FROM attempts), i AS (SELECT *, day - row_number() OVER (PARTITION BY session ORDER BY day) AS g FROM d)
  SELECT session, min(day) AS first_day, count(*) AS length FROM i GROUP BY session, g""")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.streaks(T.attempts(spark, sf_dir), "session")


@query(f"""WITH {T.ATTEMPTS}, d AS (SELECT session, day, CAST(sum(seconds) AS BIGINT) AS seconds FROM attempts GROUP BY 1, 2)
  SELECT session, day, seconds, round(sum(seconds) OVER w / 7.0, 6) AS pace, count(*) OVER w AS active FROM d WINDOW w AS (PARTITION BY session ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def pace_seven_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = T.attempts(spark, sf_dir).groupBy("session", "day").agg(F.sum("seconds").alias("seconds"))
    return L.pace(daily, "session").withColumn("pace", F.round("pace", 6))


@query(f"""WITH {T.ATTEMPTS}, p AS (SELECT session, sum(seconds) / 30.0 AS pace FROM attempts GROUP BY 1),
  q AS (SELECT sum(p_size * 60) AS need FROM part)
  SELECT session, CAST(ceil((SELECT need FROM q) / pace) AS BIGINT) AS days_left FROM p WHERE pace > 0""")
def pace_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that all plan items take at each session's pace."""
    pace = T.attempts(spark, sf_dir).groupBy("session").agg((F.sum("seconds") / 30.0).alias("pace")).where("pace > 0")
    need = T.read(spark, sf_dir, "part").agg(F.sum(F.col("p_size") * 60).alias("need")).withColumn("one", F.lit(1))
    return pace.withColumn("one", F.lit(1)).join(F.broadcast(need), "one").select("session", F.ceil(F.col("need") / F.col("pace")).alias("days_left"))


@query(f"""WITH {T.ATTEMPTS}, f AS (SELECT session, node, min(day) AS day FROM attempts GROUP BY 1, 2), n AS (SELECT session, day, count(*) AS n FROM f GROUP BY 1, 2)
  SELECT session, day, CAST(sum(n) OVER (PARTITION BY session ORDER BY day) AS BIGINT) AS opened FROM n""")
def first_opened_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.first_opened(T.attempts(spark, sf_dir), "session", "node")


@query(f"""WITH {T.INTERVALS}, g AS (SELECT *, greatest(0, lead(start) OVER (PARTITION BY session ORDER BY start, id) - "end") AS gap FROM intervals),
  a AS (SELECT session, count(*) AS words, count(*) FILTER (gap >= 3600) AS pauses, max("end") - min(start) AS span, coalesce(sum(gap), 0) AS silence FROM g GROUP BY session)
  SELECT session, words, pauses, round(words * 60.0 / nullif(span, 0), 6) AS wpm, round(CAST(silence AS DOUBLE) / nullif(span, 0), 6) AS silence_share FROM a""")
def speech_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.speech(T.intervals(spark, sf_dir), "session", 3600)


@query("SELECT event_type AS kind, round(median(value), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle (pairs are averaged) and the nearest-rank 95th percentile."""
    disc = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)")
    return T.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.round(F.median("value"), 6).alias("p50"), F.round(disc, 6).alias("p95"), F.count(F.lit(1)).alias("n"))


_OUT = "coalesce(outcome, 'pending')"


@query(f"""WITH {T.ATTEMPTS} SELECT CAST(session % 5 AS INT) AS mode, count(*) FILTER ({_OUT} = 'passed') AS passed, count(*) FILTER ({_OUT} = 'partial') AS "partial",
  count(*) FILTER ({_OUT} = 'failed') AS failed, count(*) FILTER ({_OUT} = 'pending') AS pending, count(*) AS total FROM attempts GROUP BY 1""")
def outcome_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = T.attempts(spark, sf_dir).withColumn("mode", (F.col("session") % 5).cast("int"))
    return R.pivoted(df, "mode", "outcome", ["passed", "partial", "failed", "pending"], other="pending")


@query(f"""WITH {T.ATTEMPTS} SELECT CAST(d AS INT) AS confidence, count(id) AS n FROM range(1, 6) r(d) LEFT JOIN attempts ON confidence = d AND outcome = 'failed' GROUP BY d""")
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of failed attempts over its domain; 5 never occurs and has 0."""
    return R.histogram(T.attempts(spark, sf_dir).where("outcome = 'failed'"), "confidence", 1, 5)


@query(f"""WITH {T.ATTEMPTS}, u AS (SELECT session, node, count(*) AS n, count(*) FILTER (outcome = 'failed') AS low FROM attempts GROUP BY 1, 2)
  SELECT session, node, n, low FROM u QUALIFY row_number() OVER (PARTITION BY session ORDER BY low / CAST(n AS DOUBLE) DESC, n DESC, node) = 1""")
def hardest_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node with the largest share of failures in each session; of equals the one with more attempts."""
    u = T.attempts(spark, sf_dir).groupBy("session", "node").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "failed").alias("low"))
    best = u.groupBy("session").agg(F.max_by(F.struct("node", "n", "low"), F.struct(F.col("low") / F.col("n"), "n", -F.col("node"))).alias("b"))
    return best.select("session", "b.node", "b.n", "b.low")


@query(f"""WITH {T.ATTEMPTS}, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY moment DESC, id DESC) AS rn FROM attempts)
  SELECT node, round(avg(confidence), 6) AS mean3, max(confidence) FILTER (rn = 1) AS last FROM r WHERE rn <= 3 GROUP BY node""")
def last_three_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("node").orderBy(F.desc("moment"), F.desc("id"))
    r = T.attempts(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    return r.groupBy("node").agg(F.round(F.avg("confidence"), 6).alias("mean3"), F.max(F.when(F.col("rn") == 1, F.col("confidence"))).alias("last"))


@query(f"""WITH {T.ATTEMPTS}, m AS (SELECT session, node, median(seconds) AS med FROM attempts GROUP BY 1, 2 HAVING count(*) >= 3)
  SELECT session, round(sum(med), 6) AS seconds, count(*) AS nodes FROM m GROUP BY session""")
def median_min_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of nodes with three attempts or more, summed over a session."""
    m = T.attempts(spark, sf_dir).groupBy("session", "node").agg(F.median("seconds").alias("med"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    return m.groupBy("session").agg(F.round(F.sum("med"), 6).alias("seconds"), F.count(F.lit(1)).alias("nodes"))


@query(f"""WITH {T.ATTEMPTS} SELECT session, node, count(*) AS days FROM (SELECT DISTINCT session, node, day FROM attempts WHERE outcome IN ('failed', 'partial')) GROUP BY 1, 2 HAVING count(*) >= 2""")
def recurring_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that a session missed on two days or more."""
    d = T.attempts(spark, sf_dir).where(F.col("outcome").isin("failed", "partial")).select("session", "node", "day").distinct()
    return d.groupBy("session", "node").agg(F.count(F.lit(1)).alias("days")).where("days >= 2")


@query(f"""WITH {T.ATTEMPTS} SELECT session, min(moment) AS opened, min(moment) FILTER (outcome IS NOT NULL) AS tried, min(moment) FILTER (outcome = 'passed') AS passed, arg_min(node, moment * 1000000 + id) FILTER (outcome = 'passed') AS first_node
  FROM attempts GROUP BY session""")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each session first opened, tried and passed something, and what it passed."""
    won, moment = F.col("outcome") == "passed", F.col("moment")
    return T.attempts(spark, sf_dir).groupBy("session").agg(
        F.min("moment").alias("opened"), F.min(F.when(F.col("outcome").isNotNull(), moment)).alias("tried"), F.min(F.when(won, moment)).alias("passed"),
        F.min_by(F.when(won, F.col("node")), F.when(won, moment * 1_000_000 + F.col("id"))).alias("first_node"))


@query(f"""WITH {T.ATTEMPTS}, r AS (SELECT node, max(moment) AS recovered FROM attempts WHERE outcome = 'passed' GROUP BY 1)
  SELECT node, kind, count(*) AS n, max(moment) AS newest FROM attempts LEFT JOIN r USING (node) WHERE (recovered IS NULL OR moment > recovered) AND kind IN ('error', 'view') GROUP BY 1, 2
  HAVING bool_or(kind = 'error') OR count(*) >= 2""")
def active_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What went wrong at a node since its last recovery: any failure, or repeated exhaustion."""
    a = T.attempts(spark, sf_dir)
    since = a.where("outcome = 'passed'").groupBy("node").agg(F.max("moment").alias("recovered"))
    left = a.join(since, "node", "left").where("(recovered IS NULL OR moment > recovered) AND kind IN ('error', 'view')")
    return left.groupBy("node", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("moment").alias("newest")).where("kind = 'error' OR n >= 2")


@query(f"""WITH {T.ATTEMPTS}, s AS (SELECT session, id, moment, seconds, lag(seconds) OVER (PARTITION BY session ORDER BY moment, id) AS b, lag(moment) OVER (PARTITION BY session ORDER BY moment, id) AS pa FROM attempts)
  SELECT session, count(*) AS samples, count(*) FILTER (moment - pa <= 3600) AS fresh, CASE WHEN bool_and(b IS NOT NULL OR pa IS NULL) THEN CAST(sum(abs(seconds - coalesce(b, seconds))) AS BIGINT) END AS moved FROM s GROUP BY session""")
def resource_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters' changes between samples, how many samples followed a fresh one, and totals that a gap makes null."""
    w = Window.partitionBy("session").orderBy("moment", "id")
    s = T.attempts(spark, sf_dir).withColumn("b", F.lag("seconds").over(w)).withColumn("pa", F.lag("moment").over(w))
    whole = F.bool_and(F.col("b").isNotNull() | F.col("pa").isNull())
    return s.groupBy("session").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("moment") - F.col("pa") <= 3600).alias("fresh"), F.when(whole, F.sum(F.abs(F.col("seconds") - F.coalesce("b", "seconds")))).alias("moved"))
