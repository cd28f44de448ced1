"""Operational reports: usage, budgets, libraries, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources import tables as T
from .registry import query


@query(f"""WITH {T.LEDGER} SELECT role, count(*) AS runs, count(*) FILTER (status = 'succeeded') AS succeeded,
  CAST(coalesce(sum(cost) FILTER (status = 'succeeded'), 0) AS DOUBLE) AS cost, count(*) FILTER (status = 'running') AS running FROM ledger GROUP BY role""")
def usage_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.usage(T.ledger(spark, sf_dir), "role").withColumn("cost", F.col("cost").cast("double"))


@query(f"""WITH {T.LEDGER} SELECT run_id, role, CAST(cost AS DOUBLE) AS cost, (SELECT count(*) FROM ledger WHERE status = 'succeeded') AS total_runs,
  (SELECT CAST(coalesce(sum(cost), 0) AS DOUBLE) FROM ledger WHERE status = 'succeeded') AS total_cost
  FROM ledger WHERE status = 'succeeded' ORDER BY day DESC, run_id DESC LIMIT 10 OFFSET 20""")
def usage_page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = R.optional_filters(T.ledger(spark, sf_dir), status="succeeded", role=None)
    totals = {"total_runs": F.count(F.lit(1)), "total_cost": F.coalesce(F.sum("cost"), F.lit(0).cast("decimal(28,2)"))}
    return R.page(df.select("run_id", "role", "cost", "day"), [F.desc("day"), F.desc("run_id")], 20, 10, totals).select("run_id", "role", F.col("cost").cast("double").alias("cost"), "total_runs", F.col("total_cost").cast("double").alias("total_cost"))


@query(f"""WITH {T.LEDGER}, b AS (SELECT *, coalesce(sum(CASE WHEN status <> 'failed' THEN cost ELSE 0 END) OVER (PARTITION BY day ORDER BY run_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ledger)
  SELECT CAST(day AS VARCHAR) AS day, count(*) AS runs, count(*) FILTER (before + cost > 1000000) AS refused, CAST(max(before + cost) AS DOUBLE) AS top FROM b GROUP BY day""")
def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = R.budgeted(T.ledger(spark, sf_dir), 1_000_000)
    return df.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("fits")).alias("refused"), F.max(F.col("before") + F.col("cost")).cast("double").alias("top"))


@query("""WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
  SELECT lang, count(*) FILTER (quality = 1) AS text, count(*) FILTER (quality = 0 AND toxic = 1) AS ocr, count(*) FILTER (quality = 0 AND toxic = 0) AS ocr_low,
  count(*) FILTER (quality IS NULL) AS unread, count(*) AS total, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents LEFT JOIN l USING (doc_id) GROUP BY lang""")
def library_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low quality that somebody has reviewed counts as recognised text."""
    labels = T.read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    kind = F.when(F.col("quality") == 1, "text").when((F.col("quality") == 0) & (F.col("toxic") == 1), "ocr").when(F.col("quality") == 0, "ocr_low").otherwise("unread")
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(labels, "doc_id", "left").withColumn("kind", kind)
    return R.pivoted(docs, "lang", "kind", ["text", "ocr", "ocr_low", "unread"], chars=F.sum("n_chars"))


@query("""SELECT l_partkey AS topic, count(DISTINCT o) AS sources FROM (
  SELECT l_partkey, l_orderkey AS o FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R'
  UNION SELECT l_partkey, o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F') GROUP BY l_partkey""")
def topic_usage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = T.read(spark, sf_dir, "lineitem")
    links = line.select(F.col("l_partkey").alias("topic"), F.col("l_orderkey").alias("o"), "l_returnflag")
    done = T.read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("o"))
    parts = [links.where(F.col("l_returnflag") == f).select("topic", "o") for f in "AR"] + [links.join(done, "o").select("topic", "o")]
    return parts[0].union(parts[1]).union(parts[2]).distinct().groupBy("topic").agg(F.count("o").alias("sources"))


@query("""SELECT c_custkey AS project, coalesce(n, 0) AS orders, coalesce(lines, 0) AS lines, CAST(greatest(last_order, last_ship) AS VARCHAR) AS latest FROM customer
  LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(max(o_orderdate) AS DATE) AS last_order FROM orders GROUP BY 1) a ON c_custkey = a.o_custkey
  LEFT JOIN (SELECT o_custkey, count(*) AS lines, CAST(max(l_shipdate) AS DATE) AS last_ship FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) b ON c_custkey = b.o_custkey""")
def project_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two kinds of children, and the latest activity of either."""
    orders = T.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), "o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    line = T.read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("s"))
    by_order = line.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.max("s").alias("s"))
    both = orders.join(by_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    stats = both.groupBy("project").agg(F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.greatest(F.max("d"), F.max("s")).cast("string").alias("latest"))
    customers = T.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"))
    return customers.join(stats, "project", "left").select("project", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("orders", "lines")), "latest")


@query("""SELECT l_partkey AS topic, count(*) AS links, count(*) FILTER (l_linestatus = 'F') AS confirmed, count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_suppkey END) AS materials,
  CASE max(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) WHEN 0 THEN 'N' WHEN 1 THEN 'A' ELSE 'R' END AS worst FROM lineitem GROUP BY l_partkey""")
def binding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by topic: how many, confirmed ones and their sources, and the worst quality (N best, then A, R)."""
    sure = F.col("l_linestatus") == "F"
    rank = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("topic")).agg(
        F.count(F.lit(1)).alias("links"), F.count_if(sure).alias("confirmed"), F.countDistinct(F.when(sure, F.col("l_suppkey"))).alias("materials"), F.max_by("l_returnflag", rank).alias("worst"))


@query("SELECT o_custkey AS project, o_orderkey AS run_id, o_orderpriority AS role FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = T.ledger(spark, sf_dir).select("project", "run_id", "role", "day")
    return R.latest(df, ["project"], [F.desc("day"), F.desc("run_id")]).drop("day")


@query("""SELECT kind, id, CAST(day AS VARCHAR) AS day FROM (SELECT 'order' AS kind, o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders
  UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber, CAST(l_shipdate AS DATE) FROM lineitem) GROUP BY kind, id, day ORDER BY day DESC, kind, id DESC LIMIT 5""")
def recent_merge_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of two sources: each gives its own newest, then five of both."""
    a = T.read(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"))
    b = T.read(spark, sf_dir, "lineitem").select(F.lit("line"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_shipdate").cast("date")).distinct()
    return a.union(b).orderBy(F.desc("day"), "kind", F.desc("id")).limit(5).withColumn("day", F.col("day").cast("string"))


@query("SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def library_minus_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = T.read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")).join(used, "id", "left_anti")


@query("SELECT c_custkey AS project, c_name AS title FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_totalprice > 400000)")
def exists_current_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = T.read(spark, sf_dir, "orders").where("o_orderstatus = 'O' AND o_totalprice > 400000").select(F.col("o_custkey").alias("project"))
    return T.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), F.col("c_name").alias("title")).join(current, "project", "left_semi")


@query("""SELECT DISTINCT l_orderkey AS node FROM lineitem WHERE l_suppkey < 10 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey >= 10)""")
def orphaned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that would lose every source if the sources under 10 went."""
    links = T.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), "l_suppkey")
    return links.groupBy("node").agg(F.max("l_suppkey").alias("top")).where("top < 10").select("node")


@query("""WITH need AS (SELECT DISTINCT l_linenumber AS n FROM lineitem WHERE l_linenumber <= 3)
  SELECT l_orderkey AS item FROM lineitem JOIN need ON n = l_linenumber GROUP BY 1 HAVING count(DISTINCT l_linenumber) = (SELECT count(*) FROM need)""")
def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with all of the first three parts."""
    links = T.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("n"))
    return R.divided(links, "item", "n", links.where("n <= 3"))


@query("""SELECT o_orderpriority AS lane, count(*) FILTER (o_orderstatus = 'O') AS queued, count(*) FILTER (o_orderstatus = 'P') AS running, count(*) FILTER (o_orderstatus = 'F') AS completed,
  CAST(CAST(min(o_orderdate) FILTER (o_orderstatus = 'O') AS DATE) AS VARCHAR) AS oldest, count(*) FILTER (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01') AS expired FROM orders GROUP BY 1""")
def job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes of a queue: states, the oldest that waits, and running ones whose lease is over."""
    s = F.col("o_orderstatus")
    day = F.col("o_orderdate").cast("date")
    return T.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("lane")).agg(
        *(F.count_if(s == k).alias(n) for k, n in (("O", "queued"), ("P", "running"), ("F", "completed"))),
        F.min(F.when(s == "O", day)).cast("string").alias("oldest"), F.count_if((s == "P") & (day < F.to_date(F.lit("1996-01-01")))).alias("expired"))


@query("""WITH j AS (SELECT o_orderpriority AS lane, count(*) FILTER (o_orderstatus = 'O') AS queued, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) AS n FROM orders GROUP BY 1)
  SELECT lane, CASE WHEN failed * 3 > n THEN 'error' WHEN queued * 3 > n THEN 'warning' ELSE 'ok' END AS state FROM j""")
def system_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state for each lane, by thresholds over its counts."""
    j = T.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("lane")).agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("queued"), F.count_if(F.col("o_orderstatus") == "P").alias("failed"), F.count(F.lit(1)).alias("n"))
    return j.select("lane", F.when(F.col("failed") * 3 > F.col("n"), "error").when(F.col("queued") * 3 > F.col("n"), "warning").otherwise("ok").alias("state"))


@query("""WITH v2 AS (SELECT p_partkey AS id, p_size + CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END AS size FROM part WHERE p_brand <> 'Brand#7'
    UNION ALL SELECT -1 - p_partkey, p_size FROM part WHERE p_brand = 'Brand#9')
  SELECT coalesce(a.p_partkey, b.id) AS id, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.p_size <> b.size THEN 'changed' ELSE 'same' END AS change
  FROM part a FULL JOIN v2 b ON a.p_partkey = b.id""")
def draft_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second version of a plan changes, removes and adds."""
    part = T.read(spark, sf_dir, "part")
    old = part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    kept = part.where("p_brand <> 'Brand#7'").select(F.col("p_partkey").alias("id"), (F.col("p_size") + F.when(F.col("p_type") == "SMALL", 1).otherwise(0)).alias("size2"))
    new = kept.union(part.where("p_brand = 'Brand#9'").select(-1 - F.col("p_partkey"), "p_size"))
    both = old.join(new, "id", "full")
    change = F.when(F.col("size").isNull(), "added").when(F.col("size2").isNull(), "removed").when(F.col("size") != F.col("size2"), "changed").otherwise("same")
    return both.select("id", change.alias("change"))


@query("""WITH o AS (SELECT o_custkey AS project, o_orderkey AS id, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS e FROM orders),
  p AS (SELECT *, max(e) OVER (PARTITION BY project ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o)
  SELECT project, count(*) AS phases, count(*) FILTER (before >= s) AS overlaps FROM p GROUP BY project""")
def plan_overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of projects that begin before an earlier one has ended."""
    from pyspark.sql import Window

    day = F.col("o_orderdate").cast("date")
    o = T.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"), day.alias("s"), F.date_add(day, (F.col("o_orderkey") % 40).cast("int")).alias("e"))
    w = Window.partitionBy("project").orderBy("s", "id").rowsBetween(Window.unboundedPreceding, -1)
    return o.withColumn("before", F.max("e").over(w)).groupBy("project").agg(F.count(F.lit(1)).alias("phases"), F.count_if(F.col("before") >= F.col("s")).alias("overlaps"))


@query("""SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS linked, count(*) FILTER (quality = 0) AS outside, count(*) FILTER (toxic = 1) AS review,
  count(*) FILTER (quality IS NULL) AS unfinished, count(*) AS total,
  round(count(*) FILTER (quality = 1 AND toxic = 0) / nullif(CAST(count(*) FILTER (quality = 1 AND toxic = 0) + count(*) FILTER (quality = 0) AS DOUBLE), 0), 6) AS ratio
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id) GROUP BY source""")
def coverage_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of blocks by source, and the linked share of what is decided (null where nothing is)."""
    labels = T.read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    linked, outside = F.count_if((F.col("q") == 1) & (F.col("t") == 0)), F.count_if(F.col("q") == 0)
    out = docs.groupBy("source").agg(linked.alias("linked"), outside.alias("outside"), F.count_if(F.col("t") == 1).alias("review"), F.count_if(F.col("q").isNull()).alias("unfinished"), F.count(F.lit(1)).alias("total"))
    base = F.nullif(F.col("linked") + F.col("outside"), F.lit(0))
    return out.withColumn("ratio", F.round(F.col("linked") / base, 6))


@query("""SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS asked, max(turn) + 1 AS next_turn FROM conversations GROUP BY conv_id""")
def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("asked"), (F.max("turn") + 1).alias("next_turn"))


@query("""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) <= 4)""")
def chat_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four messages of each conversation, in order."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    last = T.read(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(w.orderBy(F.desc("turn"), "role", "text"))).where("n <= 4")
    return last.select("conv_id", "turn", "role", F.row_number().over(w.orderBy("turn")).alias("place"))
