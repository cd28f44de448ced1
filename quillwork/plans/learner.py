"""Learner queries: memory, status, forecast, trees, calendars and plans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import memory as M
from ..operators import planning as P
from ..operators import trees
from ..sources import tables as T
from .registry import query

_QUALITY = "CASE outcome WHEN 'passed' THEN 5 WHEN 'partial' THEN 3 ELSE 1 END"


@query(f"""WITH RECURSIVE {T.ATTEMPTS}, g AS (SELECT session, node, day, id, {_QUALITY} AS q FROM attempts WHERE outcome IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session, node, day ORDER BY id) = 1),
  n AS (SELECT *, row_number() OVER (PARTITION BY session, node ORDER BY day, id) AS rn FROM g),
  s AS (SELECT session, node, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS reps, CAST(0 AS BIGINT) AS interval_, CAST(2.5 AS DOUBLE) AS ease, CAST(0 AS BIGINT) AS due FROM n WHERE rn = 1
    UNION ALL SELECT s.session, s.node, n.rn, CASE WHEN q >= 3 THEN reps + 1 ELSE 0 END,
      CAST(CASE WHEN q < 3 THEN 1 WHEN reps = 0 THEN 1 WHEN reps = 1 THEN 6 ELSE ceil(interval_ * ease) END AS BIGINT),
      greatest(CAST(1.3 AS DOUBLE), ease + CAST(0.1 AS DOUBLE) - (5 - q) * (CAST(0.08 AS DOUBLE) + (5 - q) * CAST(0.02 AS DOUBLE))),
      n.day + CAST(CASE WHEN q < 3 THEN 1 WHEN reps = 0 THEN 1 WHEN reps = 1 THEN 6 ELSE ceil(interval_ * ease) END AS BIGINT)
    FROM s JOIN n ON n.session = s.session AND n.node = s.node AND n.rn = s.rn + 1)
  SELECT session, node, CAST(rn AS INT) AS grades, reps, interval_ AS "interval", round(ease, 6) AS ease, due FROM s WHERE rn > 0 QUALIFY rn = max(rn) OVER (PARTITION BY session, node)""")
def sm2_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = F.when(F.col("outcome") == "passed", 5).when(F.col("outcome") == "partial", 3).otherwise(1)
    graded = T.attempts(spark, sf_dir).where("outcome IS NOT NULL").select("session", "node", "day", "id", quality.alias("quality"))
    return M.replay(graded, ["session", "node"])


@query(f"""WITH {T.ATTEMPTS}, a AS (SELECT session, node, count(*) FILTER (outcome = 'passed') AS passed, count(outcome) AS tried, count(*) AS opened,
    arg_max(outcome, moment * 1000000 + id) FILTER (outcome IS NOT NULL) AS last FROM attempts GROUP BY 1, 2)
  SELECT session, node, CASE WHEN passed >= 2 AND last = 'passed' THEN 'mastered' WHEN tried > 0 THEN 'practiced' WHEN opened > 1 THEN 'understood' ELSE 'unseen' END AS status FROM a""")
def topic_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.status(T.attempts(spark, sf_dir), ["session", "node"]).select("session", "node", "status")


_W = "1.96"


@query(f"""WITH {T.ATTEMPTS}, b AS (SELECT CAST(least(seconds // 50, 2) AS INT) AS bin, count(*) AS n, count(*) FILTER (outcome = 'passed') AS k FROM attempts WHERE outcome IS NOT NULL GROUP BY 1),
  p AS (SELECT *, k / CAST(n AS DOUBLE) AS p, CAST(1.96 AS DOUBLE) AS z FROM b)
  SELECT bin, n, k, round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 6) AS low,
    round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 6) AS high FROM p""")
def wilson_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = T.attempts(spark, sf_dir).where("outcome IS NOT NULL").groupBy(F.least(F.floor(F.col("seconds") / 50), F.lit(2)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "passed").alias("k"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return b.select("bin", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH {T.ATTEMPTS}, r AS (SELECT session, node, day, outcome, day - lag(day) OVER (PARTITION BY session, node ORDER BY day, id) AS gap, row_number() OVER (PARTITION BY session, node ORDER BY day DESC, id DESC) AS rn
    FROM attempts WHERE outcome IS NOT NULL AND day > 19700),
  l AS (SELECT session, CASE WHEN gap <= 3 THEN 0 WHEN gap <= 9 THEN 1 ELSE 2 END AS bin, outcome FROM r WHERE rn = 1 AND gap IS NOT NULL)
  SELECT bin, count(*) AS topics, count(*) FILTER (outcome = 'passed') AS kept, CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (outcome = 'passed') / CAST(count(*) AS DOUBLE), 6) END AS rate FROM l GROUP BY bin""")
def memory_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each topic's latest graded attempt in the window, the share that was kept, by bins of the gap before it; bins with
    under five topics have none."""
    w = Window.partitionBy("session", "node")
    a = T.attempts(spark, sf_dir).where("outcome IS NOT NULL AND day > 19700")
    r = a.withColumn("gap", F.col("day") - F.lag("day").over(w.orderBy("day", "id"))).withColumn("rn", F.row_number().over(w.orderBy(F.desc("day"), F.desc("id")))).where("rn = 1 AND gap IS NOT NULL")
    kept, n = F.count_if(F.col("outcome") == "passed"), F.count(F.lit(1))
    return r.groupBy(F.when(F.col("gap") <= 3, 0).when(F.col("gap") <= 9, 1).otherwise(2).alias("bin")).agg(n.alias("topics"), kept.alias("kept"), F.when(n >= 5, F.round(kept / n, 6)).alias("rate"))


@query(f"""WITH {T.ATTEMPTS}, l AS (SELECT session, node, max(day) AS day FROM attempts WHERE outcome IS NOT NULL GROUP BY 1, 2), p AS (SELECT DISTINCT session, node FROM attempts WHERE outcome IS NULL AND day >= 19750)
  SELECT l.session, l.node, l.day + 7 AS due FROM l LEFT JOIN p USING (session, node) WHERE p.node IS NULL AND l.day + 7 <= 19750""")
def due_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose review is due by a day and that aren't planned already."""
    a = T.attempts(spark, sf_dir)
    last = a.where("outcome IS NOT NULL").groupBy("session", "node").agg((F.max("day") + 7).alias("due")).where("due <= 19750")
    return last.join(a.where("outcome IS NULL AND day >= 19750").select("session", "node"), ["session", "node"], "left_anti").select("session", "node", "due")


_WALK = f"""{T.TREE}, walk AS (SELECT id, 0 AS depth, title AS path, [lpad(CAST(ord AS VARCHAR), 12, '0') || id] AS o, [id] AS anc, target FROM tree WHERE parent_id IS NULL
  UNION ALL SELECT t.id, w.depth + 1, w.path || ' / ' || t.title, list_append(w.o, lpad(CAST(t.ord AS VARCHAR), 12, '0') || t.id), list_append(w.anc, t.id), coalesce(t.target, w.target) FROM tree t JOIN walk w ON t.parent_id = w.id)"""


@query(f"WITH RECURSIVE {_WALK} SELECT id, depth, path, row_number() OVER (PARTITION BY anc[1] ORDER BY o) AS number FROM walk")
def tree_preorder_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = trees.walk(T.tree(spark, sf_dir)).withColumn("root", F.element_at("ancestors", 1))
    return trees.preorder(w, "root").select("id", "depth", "path", "number")


@query(f"WITH RECURSIVE {_WALK} SELECT id, target FROM walk")
def tree_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.walk(T.tree(spark, sf_dir), inherit="target").select("id", "target")


@query(f"""WITH RECURSIVE {_WALK}, a AS (SELECT unnest(anc) AS ancestor, id FROM walk), c AS (SELECT DISTINCT 'c' || o_custkey AS id FROM orders WHERE o_orderstatus = 'F')
  SELECT ancestor AS node, count(DISTINCT c.id) AS covered, count(DISTINCT a.id) AS size FROM a LEFT JOIN c USING (id) GROUP BY 1""")
def tree_closure_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered leaves and all nodes of every subtree."""
    done = T.read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("c"), "o_custkey").alias("id")).distinct().withColumn("c", F.lit(1))
    a = trees.closure(trees.walk(T.tree(spark, sf_dir))).join(done, "id", "left")
    return a.groupBy(F.col("ancestor").alias("node")).agg(F.count("c").alias("covered"), F.count(F.lit(1)).alias("size"))


@query(f"""WITH RECURSIVE {T.TREE}, bad AS (SELECT id, CASE WHEN id = 'n3' THEN 'x9' WHEN id = 'n4' THEN 'c1' ELSE parent_id END AS parent_id FROM tree UNION ALL SELECT 'c1', 'n4' WHERE false),
  f AS (SELECT id, CASE WHEN id = 'c1' THEN 'n4' ELSE parent_id END AS parent_id FROM bad), walk AS (SELECT id FROM f WHERE parent_id IS NULL UNION ALL SELECT f.id FROM f JOIN walk w ON f.parent_id = w.id)
  SELECT id, CASE WHEN parent_id NOT IN (SELECT id FROM f) THEN 'missing_parent' ELSE 'unreachable' END AS problem FROM f WHERE id NOT IN (SELECT id FROM walk)""")
def tree_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree with a missing parent and a cycle put in: what no walk reaches."""
    parent = F.when(F.col("id") == "n3", "x9").when(F.col("id") == "n4", "c1").when(F.col("id") == "c1", "n4").otherwise(F.col("parent_id"))
    return trees.problems(T.tree(spark, sf_dir).withColumn("parent_id", parent))


@query(f"""WITH RECURSIVE {_WALK} SELECT list_filter(anc, lambda x: x[1] = 'n')[-1] AS unit, count(*) AS topics, max(depth) AS deepest FROM walk WHERE depth >= 1 GROUP BY 1""")
def tree_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by their nearest unit above."""
    w = trees.walk(T.tree(spark, sf_dir)).where("depth >= 1")
    unit = F.element_at(F.filter("ancestors", lambda x: x.startswith("n")), -1)
    return w.groupBy(unit.alias("unit")).agg(F.count(F.lit(1)).alias("topics"), F.max("depth").alias("deepest"))


_CAPACITY = "CASE WHEN day(d) % 10 = 0 THEN 0 WHEN isodow(d) >= 6 THEN 60 ELSE 120 END"


@query(f"""WITH {T.ATTEMPTS}, d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS d),
  l AS (SELECT CAST(day AS INT) AS day, count(*) AS items, CAST(sum(seconds) // 6000 AS BIGINT) AS planned FROM attempts GROUP BY 1)
  SELECT CAST(d AS VARCHAR) AS on_date, {_CAPACITY} AS minutes, coalesce(planned, 0) AS planned, coalesce(items, 0) AS items, coalesce(planned, 0) > {_CAPACITY} AS overload
  FROM d LEFT JOIN l ON l.day = d - DATE '1970-01-01'""")
def day_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacity, plan and overload of each day of a month."""
    month = spark.range(1).select(F.to_date(F.lit("2024-01-01")).alias("a"), F.to_date(F.lit("2024-01-30")).alias("b"))
    days = P.capacity(P.spine(month, "a", "b"), 120, 60, 10).withColumn("day", F.datediff("on_date", F.to_date(F.lit("1970-01-01"))))
    load = T.attempts(spark, sf_dir).groupBy("day").agg(F.count(F.lit(1)).alias("items"), F.floor(F.sum("seconds") / 6000).alias("planned"))
    both = days.join(load, "day", "left").withColumn("planned", F.coalesce("planned", F.lit(0))).withColumn("items", F.coalesce("items", F.lit(0)))
    return both.select(F.col("on_date").cast("string").alias("on_date"), "minutes", "planned", "items", (F.col("planned") > F.col("minutes")).alias("overload"))


@query(f"""WITH {T.ATTEMPTS}, u AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY session, node ORDER BY moment, id) = 1)
  SELECT session, node, id, row_number() OVER (PARTITION BY session ORDER BY moment, id) AS place FROM u QUALIFY place <= 5""")
def daily_queue_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five items for each session, one for a node."""
    return P.queue(T.attempts(spark, sf_dir), "session", ["moment", "id"], 5, "node").select("session", "node", "id", F.col("place").cast("bigint").alias("place"))


@query("""WITH s AS (SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n, p_brand FROM part)
  SELECT p_brand AS project, p_partkey AS id, CASE WHEN rn * 10 <= n * 6 THEN 'learn' WHEN rn * 10 <= n * 9 THEN 'repeat' ELSE 'final' END AS phase FROM s""")
def default_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases by share of a project's items: 60 % learn, 30 % repeat, the rest final."""
    w = Window.partitionBy("p_brand")
    s = T.read(spark, sf_dir, "part").withColumn("rn", F.row_number().over(w.orderBy("p_partkey"))).withColumn("n", F.count(F.lit(1)).over(w))
    phase = F.when(F.col("rn") * 10 <= F.col("n") * 6, "learn").when(F.col("rn") * 10 <= F.col("n") * 9, "repeat").otherwise("final")
    return s.select(F.col("p_brand").alias("project"), F.col("p_partkey").alias("id"), phase.alias("phase"))


@query()
def plan_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's items onto its next sixty days."""
    items = T.read(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_size").cast("bigint").alias("need"))
    days = items.select("project").distinct().withColumn("on_day", F.explode(F.sequence(F.lit(0), F.lit(59)))).withColumn("minutes", F.when(F.col("on_day") % 7 >= 5, 30).otherwise(90))
    return P.distributed(items, days, "project")


@query()
def plan_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans after a missed week, in the two ways that move items; half of what is planned is done."""
    items = T.read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("project"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), (F.col("p_partkey") % 10).alias("on_day"), F.col("p_size").cast("bigint").alias("need"),
        (F.col("p_size") % 2 == 0).alias("done"), (F.col("p_partkey") % 13 == 0).alias("pinned"))
    days = items.select("project").distinct().withColumn("on_day", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(59).cast("bigint")))).withColumn("minutes", F.when(F.col("on_day") % 7 >= 5, 30).otherwise(90))
    ways = [P.recovered(items, days, "project", 7, mode).withColumn("mode", F.lit(mode)) for mode in ("catch_up", "spread")]
    return ways[0].unionByName(ways[1])


@query("""WITH RECURSIVE o AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part),
  f AS (SELECT p_brand, p_partkey, rn, CAST(p_size AS BIGINT) AS used, CAST(0 AS BIGINT) AS batch FROM o WHERE rn = 1
    UNION ALL SELECT o.p_brand, o.p_partkey, o.rn, CASE WHEN used + p_size > 100 THEN p_size ELSE used + p_size END, CASE WHEN used + p_size > 100 THEN batch + 1 ELSE batch END FROM f JOIN o ON o.p_brand = f.p_brand AND o.rn = f.rn + 1)
  SELECT p_brand AS project, p_partkey AS id, batch FROM f""")
def next_fit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = T.read(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), F.col("p_partkey").alias("id"), "p_size")
    return P.batches(items, "project", "id", "p_size", 100)


@query("""WITH RECURSIVE l AS (SELECT p_brand AS k, p_partkey AS id, p_size AS m FROM part WHERE p_size % 7 > 0 AND p_size % 5 > 0),
  pl AS (SELECT p_brand AS k, p_partkey AS id, DATE '2024-05-01' + CAST(p_partkey % 20 - 5 AS INT) AS d, p_size AS m FROM part WHERE p_partkey % 6 = 0 AND p_partkey % 20 >= 5), ld AS (SELECT k, d, sum(m) AS load FROM pl GROUP BY 1, 2),
  td AS (SELECT l.*, row_number() OVER (PARTITION BY l.k ORDER BY l.id) AS rn FROM l WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.k = l.k AND pl.id = l.id)),
  s AS (SELECT k, CAST(1 AS BIGINT) AS rn, DATE '2024-05-01' AS d, CAST(coalesce((SELECT load FROM ld WHERE ld.k = b.k AND ld.d = DATE '2024-05-01'), 0) AS BIGINT) AS load, CAST(NULL AS BIGINT) AS id, CAST(NULL AS DATE) AS put FROM (SELECT DISTINCT k FROM td) b
    UNION ALL SELECT k, CASE WHEN ok THEN rn + 1 ELSE rn END, CASE WHEN ok AND load + m < 60 THEN d ELSE d + 1 END, CASE WHEN ok AND load + m < 60 THEN load + m ELSE CAST(coalesce(after, 0) AS BIGINT) END, CASE WHEN ok THEN tid END, CASE WHEN ok THEN d END
      FROM (SELECT s.k, s.rn, s.d, s.load, td.m, td.id AS tid, isodow(s.d) <= 5 AND (s.load = 0 OR s.load + td.m <= 60) AS ok, ld.load AS after FROM s JOIN td ON td.k = s.k AND td.rn = s.rn LEFT JOIN ld ON ld.k = s.k AND ld.d = s.d + 1)),
  a AS (SELECT k, id, put AS d FROM s WHERE put IS NOT NULL UNION ALL SELECT k, id, d FROM pl WHERE EXISTS (SELECT 1 FROM l WHERE l.k = pl.k AND l.id = pl.id))
  SELECT b.k AS project, (SELECT count(*) FROM l WHERE l.k = b.k) AS remaining, CAST((SELECT max(d) FROM a WHERE a.k = b.k) AS VARCHAR) AS finish FROM (SELECT DISTINCT p_brand AS k FROM part) b""")
def finish_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each project's lessons will be done, with an hour a day and five days a week."""
    p = T.read(spark, sf_dir, "part").withColumn("project", F.col("p_brand"))
    lessons = p.select("project", F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_size").alias("minutes"), (F.col("p_size") % 7 > 0).alias("eligible"), (F.col("p_size") % 5 == 0).alias("completed"))
    plan = p.where("p_partkey % 6 = 0").select("project", F.col("p_partkey").alias("id"), F.date_add(F.to_date(F.lit("2024-05-01")), (F.col("p_partkey") % 20 - 5).cast("int")).alias("on_date"), F.col("p_size").alias("minutes"))
    return P.finish_forecast(lessons, plan, "project", dt.date(2024, 5, 1), 60, 5).withColumn("finish", F.col("finish").cast("string"))
