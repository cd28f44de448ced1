"""Readers of the fixture tables, and the entities of a study corpus that they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where its scan has fewer partitions than there are (one small file); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has ``most`` rows at most (counted no further than that), else as it is: Spark then
    joins it by its keys."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def money(column: str) -> Column:
    """Money as a decimal: sums don't depend on their order."""
    return F.col(column).cast("decimal(18,2)")


def micros(column: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column)


def seconds(column: str) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of models with their cost: id, project, role, status (succeeded, running, failed), cost, day."""
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("role"), status.alias("status"),
        money("o_totalprice").alias("cost"), F.col("o_orderdate").cast("date").alias("day"))


LEDGER = """ledger AS (SELECT o_orderkey AS run_id, o_custkey AS project, o_orderpriority AS role,
  CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  CAST(o_totalprice AS DECIMAL(18,2)) AS cost, CAST(o_orderdate AS DATE) AS day FROM orders)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study intervals: id, session, node, kind, start and end in whole seconds."""
    moment = seconds("ts")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session"), F.get_json_object("props", "$.k").cast("int").alias("node"),
        F.col("event_type").alias("kind"), moment.alias("start"), (moment + F.greatest(F.lit(0), F.floor("value"))).cast("bigint").alias("end"))


INTERVALS = """intervals AS (SELECT event_id AS id, user_id AS session, CAST(json_extract_string(props, '$.k') AS INT) AS node,
  event_type AS kind, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS start,
  CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) + greatest(0, CAST(floor(value) AS BIGINT)) AS "end" FROM events)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts at nodes: id, session, node, outcome (null: pending), confidence 1 to 4, seconds, moment (seconds), day number."""
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "passed").when(kind == "click", "partial").when(kind == "error", "failed")
    moment = seconds("ts")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session"), F.get_json_object("props", "$.k").cast("int").alias("node"), outcome.alias("outcome"),
        kind.alias("kind"), (F.floor("value").cast("bigint") % 4 + 1).cast("int").alias("confidence"), F.floor("value").cast("bigint").alias("seconds"), moment.alias("moment"), F.floor(moment / 86400).cast("int").alias("day"))


ATTEMPTS = """attempts AS (SELECT event_id AS id, user_id AS session, CAST(json_extract_string(props, '$.k') AS INT) AS node,
  CASE event_type WHEN 'purchase' THEN 'passed' WHEN 'click' THEN 'partial' WHEN 'error' THEN 'failed' END AS outcome,
  event_type AS kind, CAST(CAST(floor(value) AS BIGINT) % 4 + 1 AS INT) AS confidence, CAST(floor(value) AS BIGINT) AS seconds,
  CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS moment, CAST(floor(epoch_us(ts) / 86400000000) AS INT) AS day FROM events)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic tree: id, parent_id, ord, title, level_name (leaves have one, some branches too)."""
    region, nation, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    none = F.lit(None).cast("string")
    parts = [
        region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), none.alias("parent_id"), F.col("r_regionkey").cast("bigint").alias("ord"), F.col("r_name").alias("title"), F.lit("basic").alias("target")),
        nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey").cast("bigint"), "n_name", F.when(F.col("n_nationkey") % 3 == 0, "deep")),
        customer.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.col("c_custkey").cast("bigint"), "c_name", F.when(F.col("c_mktsegment") == "BUILDING", "expert")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


TREE = """tree AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id, CAST(r_regionkey AS BIGINT) AS ord, r_name AS title, 'basic' AS target FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CAST(n_nationkey AS BIGINT), n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'deep' END FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CAST(c_custkey AS BIGINT), c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'expert' END FROM customer)"""


def lines(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Fragments: the lines of documents that aren't blank: doc_id, pos (from 0, blank ones counted), line. Where documents are
    ``dealt`` out by doc_id before lines are made of them, windows and groups by document shuffle no lines, and tasks, whose work
    is more than their texts weigh, aren't put together by size."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id") if dealt else spread(docs)
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")


LINES = """lines AS (SELECT * FROM (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM documents) WHERE trim(line) <> '')"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of pages with their boxes, in shares of the page: page, id (from 0), x0, y0, x1, y1, and the upper edge's run and
    rise (dx, dy). A page is an order, its elements are the order's items; a third of the pages have one column, a third two,
    a third a line across two columns; two fifths are tilted by 1.5 or -2 degrees, a fifth by 9."""
    k = F.col("page")
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) - 1
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), i.alias("id"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    across, column, row = (k % 3 == 2) & (F.col("id") == 0), F.when(k % 3 == 0, 0).otherwise(F.col("id") % 2), F.when(k % 3 == 0, F.col("id")).otherwise(F.floor((F.col("id") + 1) / 2))
    x0 = F.when(across, 80).otherwise(80 + column * 460 + F.col("s") % 5)
    x1 = F.when(across, 920).otherwise(F.col("_x0") + F.when(k % 3 == 0, 300 + F.col("p") % 500).otherwise(300 + F.col("p") % 80))
    y0 = 120 + row * 90 + column * 25 + F.col("p") % 7
    slope = F.element_at(F.array(*map(F.lit, (0.0, 0.0, 0.026, -0.035, 0.158))), (k % 5 + 1).cast("int"))
    flat = items.withColumn("_x0", x0).withColumn("_x1", x1).withColumn("_y0", y0).withColumn("_m", slope)
    lift = (F.col("_x0") - 500) * F.col("_m")
    up = flat.withColumn("_u", F.round(F.col("_y0") + lift).cast("bigint")).withColumn("_h", 22 + F.col("p") % 13)
    return up.select("page", "id", (F.col("_x0") / 1000).alias("x0"), (F.col("_u") / 1000).alias("y0"), (F.col("_x1") / 1000).alias("x1"), ((F.col("_u") + F.col("_h")) / 1000).alias("y1"),
                     ((F.col("_x1") - F.col("_x0")) / 1000).alias("dx"), ((F.col("_x1") - F.col("_x0")) / 1000 * F.col("_m")).alias("dy"))


ELEMENTS = """items AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS id, l_partkey AS p, l_suppkey AS s FROM lineitem),
  col AS (SELECT *, page % 3 = 2 AND id = 0 AS across, CASE WHEN page % 3 = 0 THEN 0 ELSE id % 2 END AS c, CASE WHEN page % 3 = 0 THEN id ELSE (id + 1) // 2 END AS r, [0.0, 0.0, 0.026, -0.035, 0.158][page % 5 + 1]::DOUBLE AS m FROM items),
  wide AS (SELECT *, CASE WHEN across THEN 80 ELSE 80 + c * 460 + s % 5 END AS ix, 120 + r * 90 + c * 25 + p % 7 AS iy FROM col),
  flat AS (SELECT *, CASE WHEN across THEN 920 ELSE ix + CASE WHEN page % 3 = 0 THEN 300 + p % 500 ELSE 300 + p % 80 END END AS jx, CAST(round(iy + (ix - 500) * m) AS BIGINT) AS u FROM wide),
  elements AS (SELECT page, id, ix / 1000.0::DOUBLE AS x0, u / 1000.0::DOUBLE AS y0, jx / 1000.0::DOUBLE AS x1, (u + 22 + p % 13) / 1000.0::DOUBLE AS y1, (jx - ix) / 1000.0::DOUBLE AS dx, (jx - ix) / 1000.0::DOUBLE * m AS dy FROM flat)"""


def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of materials' pages, margins above all: material, page, id, kind, text, image (hash), x0, y0, x1, y1. A material
    is a customer, its pages are the customer's orders. Pages have a title in two pieces (odd) or a chapter (even), which is
    misread or missing now and then, a number outside by parity, an ornament, a heading and a line of their own."""
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    k, m, p = F.col("o_orderkey"), F.col("material"), F.col("page")
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("material"), page.alias("page"), "o_orderkey", "o_orderpriority", "o_totalprice")
    odd = p % 2 == 1
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    none, n = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    number = F.when(k % 7 == 0, p + 1).otherwise(p).cast("string")
    hashed = (m * 7919) % 1000003 * 4096 + F.element_at(F.array(*map(F.lit, (0, 1, 5, 255, 4095))), (k % 5 + 1).cast("int"))
    box = lambda x, y, w, h: [(v / 1000).alias(c) for c, v in (("x0", x), ("y0", y), ("x1", x + w), ("y1", y + h))]
    piece = lambda i, kind, text, image, b: F.struct(F.lit(i).alias("id"), F.lit(kind).alias("kind"), text.alias("text"), image.alias("image"), *b)
    pieces = [
        F.when(k % 6 > 0, piece(0, "paragraph", F.when(odd, F.concat(F.lit("Course reader "), F.when(k % 4 == 0, F.lit("n0.")).otherwise("no."))).otherwise(F.concat(F.lit("Chapter of part "), (m % 7).cast("string"))), n, box(200 + k % 9, 40 + k % 5, F.lit(180), F.lit(16)))),
        F.when((k % 6 > 0) & odd, piece(1, "paragraph", m.cast("string"), n, box(410 + k % 9, 42 + k % 5, F.lit(40), F.lit(16)))),
        piece(2, "paragraph", F.when(m % 2 == 0, F.concat(F.lit("Page "), number)).otherwise(F.concat(F.lit("– "), number, F.lit(" –"))), n, box(F.when(odd, 880).otherwise(90) + k % 4, F.lit(950), F.lit(30), F.lit(14))),
        F.when(m % 4 == 0, piece(3, "image", none, hashed, box(450 + k % 3, F.lit(900), F.lit(60), F.lit(40)))),
        piece(4, "heading", F.lit("Exercises"), n, box(F.lit(100), F.lit(100), F.lit(300), F.lit(20))),
        piece(5, "paragraph", F.concat(F.col("o_orderpriority"), F.lit(" "), price), n, box(300 + k % 400, F.lit(70), F.lit(200), F.lit(14))),
        piece(6, "paragraph", F.lit("The text of the page."), n, box(F.lit(100), F.lit(400), F.lit(700), F.lit(60))),
    ]
    return orders.select("material", "page", F.explode(F.array(*pieces)).alias("e")).where("e IS NOT NULL").select("material", "page", "e.*")


def answer_files(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A file of answers for each customer's exam: fragments, questions, resolved, manual and edited, as ``answers.linked`` reads
    them. A question is an order; its header is written in one of seven ways (as it is, numbered, misspelt, over two
    paragraphs, in capitals, by its number alone, not at all) and its answer has a fragment for each of the order's items."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("of brand"), F.regexp_replace("p_brand", "\\D", "")).alias("name"))
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))).alias("i"))
    title = F.concat(F.initcap(F.col("name")), F.lit(", supply and "), F.element_at(F.array(*map(F.lit, ("demand", "storage", "pricing", "transport", "quality"))), (F.col("k") % 5 + 1).cast("int")))
    order = F.row_number().over(Window.partitionBy("key").orderBy("k"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("key"))
    first = items.where("i = 1").join(part, "l_partkey").select(F.col("l_orderkey").alias("k"), "name")
    asked = shared.cut(orders.join(first, "k").withColumn("ord", order).withColumn("title", title))
    way, n, t = F.col("k") % 7, F.col("ord").cast("string"), F.col("title")
    cut = F.instr("title", ",").cast("int")
    piece = lambda j, kind, text: F.struct(F.lit(j).alias("j"), F.lit(kind).alias("kind"), text.alias("text"))
    head = (
        F.when(way == 0, F.array(piece(0, "heading", t))).when(way == 1, F.array(piece(0, "heading", F.concat(n, F.lit(". "), t))))
        .when(way == 2, F.array(piece(0, "paragraph", F.translate(t, "oS", "0s"))))
        .when(way == 3, F.array(piece(0, "paragraph", t.substr(F.lit(1), cut)), piece(1, "paragraph", t.substr(cut + 1, F.lit(100)))))
        .when(way == 4, F.array(piece(0, "heading", F.upper(t)))).when(way == 5, F.array(piece(0, "heading", F.concat(n, F.lit(") About something else entirely"))))))
    heads = asked.where("k % 7 < 6").select("key", "ord", F.explode(head).alias("h")).select("key", (F.col("ord") * 100 + F.col("h.j")).alias("pos"), "h.kind", "h.text")
    body = shared.cut(items.join(asked.select(F.col("k").alias("l_orderkey"), "key", "ord"), "l_orderkey"))
    said = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.col("i").cast("string"), F.lit(") a step of the proof"))).otherwise(F.concat(F.lit("The answer says "), F.col("l_partkey").cast("string"), F.lit(" and goes on for a while.")))
    fragments = heads.unionByName(body.select("key", (F.col("ord") * 100 + 10 + F.col("i")).alias("pos"), F.lit("paragraph").alias("kind"), said.alias("text")))
    questions = asked.select("key", "ord", "title", F.col("ord").alias("root"), F.lit(None).cast("int").alias("child"))
    return {
        "fragments": fragments, "questions": questions,
        "resolved": asked.where("k % 7 = 5 AND k % 2 = 0").select("key", F.lit("about something else entirely").alias("form"), "ord").groupBy("key", "form").agg(F.min("ord").alias("ord")),
        "manual": body.where("l_partkey % 11 = 0").select("key", (F.col("ord") * 100 + 10 + F.col("i")).alias("pos"), "ord"),
        "edited": asked.where("k % 13 = 0").select("key", "ord"),
    }
