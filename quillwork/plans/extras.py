"""Smaller queries: groups of hits, modal values, roll-ups, currency, orders, timings, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..operators import structure as S
from ..sources import tables as T
from .registry import query

def _n():
    return F.count(F.lit(1))



@query("""WITH o AS (SELECT l_orderkey AS doc, l_linenumber - CAST(l_quantity AS BIGINT) % 3 AS off, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT doc, max(n) AS top, sum(n) AS total FROM o GROUP BY doc)
  SELECT doc, CAST(total AS BIGINT) AS pages, round(top / CAST(total AS DOUBLE), 6) AS share, top / CAST(total AS DOUBLE) >= 0.6 AS numbered FROM m""")
def modal_page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent difference between a page's place and its printed number, and whether its share makes a numbering."""
    o = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") - F.col("l_quantity").cast("bigint") % 3).alias("off")).agg(_n().alias("n"))
    share = F.max("n") / F.sum("n")
    return o.groupBy("doc").agg(F.sum("n").alias("pages"), F.round(share, 6).alias("share"), (share >= 0.6).alias("numbered"))


@query("SELECT sha256(text) AS digest, count(DISTINCT source) AS places, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def repeated_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that repeat, by digest, and over how many sources."""
    d = T.read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "source")
    return d.groupBy("digest").agg(F.countDistinct("source").alias("places"), _n().alias("n")).where("n > 1")


@query("""SELECT source, count(*) AS hits, arg_min(doc_id, -n_chars * 1000000000 + doc_id) AS best, array_to_string(list_sort(list_distinct(list(lang))), ',') AS signals FROM documents WHERE contains(text, 'estion') GROUP BY source""")
def hit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by source: how many, the best one, and what they have."""
    h = T.read(spark, sf_dir, "documents").where(F.contains("text", F.lit("estion")))
    return h.groupBy("source").agg(_n().alias("hits"), F.min_by("doc_id", F.struct((-F.col("n_chars")).alias("n"), "doc_id")).alias("best"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("signals"))


@query(f"""WITH {T.LINES}, d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(line)) ORDER BY pos) AS n FROM lines), k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place FROM d WHERE n = 1)
  SELECT d.doc_id, count(*) AS lines, count(*) FILTER (d.n > 1) AS repeated, max(place) + 1 AS kept FROM d LEFT JOIN k ON d.doc_id = k.doc_id AND d.pos = k.pos GROUP BY d.doc_id""")
def duplicate_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat in a document: the first one of each stays, and the rest are numbered anew."""
    w = Window.partitionBy("doc_id", F.lower(F.trim("line"))).orderBy("pos")
    d = T.lines(spark, sf_dir).withColumn("n", F.row_number().over(w))
    return d.groupBy("doc_id").agg(_n().alias("lines"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("n") == 1).alias("kept"))


@query(f"""WITH {T.ATTEMPTS}, d AS (SELECT session, day, CAST(sum(seconds) AS BIGINT) AS used FROM attempts GROUP BY 1, 2)
  SELECT session, count(*) AS days, count(*) FILTER (day % 7 = 0) AS rest, CAST(sum(CASE WHEN day % 7 = 0 THEN 0 ELSE 100 END) AS BIGINT) AS base, CAST(sum(used) AS BIGINT) AS used, CAST(sum(greatest(0, CASE WHEN day % 7 = 0 THEN 0 ELSE 100 END - used)) AS BIGINT) AS remaining FROM d GROUP BY session""")
def budget_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base, used and remaining seconds of sessions; every seventh day is a rest day with no budget."""
    d = T.attempts(spark, sf_dir).groupBy("session", "day").agg(F.sum("seconds").alias("used")).withColumn("b", F.when(F.col("day") % 7 == 0, 0).otherwise(100))
    return d.groupBy("session").agg(_n().alias("days"), F.count_if(F.col("b") == 0).alias("rest"), F.sum("b").cast("bigint").alias("base"), F.sum("used").alias("used"), F.sum(F.greatest(F.lit(0), F.col("b") - F.col("used"))).cast("bigint").alias("remaining"))


@query("""WITH r AS (SELECT o_orderkey AS run, o_custkey AS project, o_orderpriority AS seen FROM orders), p AS (SELECT o_custkey AS project, arg_max(o_orderpriority, o_orderkey) AS now, bool_or(o_orderstatus = 'O') AS active FROM orders GROUP BY 1)
  SELECT run, CASE WHEN NOT active THEN 'archived' WHEN seen <> now THEN 'outdated' ELSE 'current' END AS state FROM r JOIN p USING (project)""")
def snapshot_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what a run saw is still so."""
    o = T.read(spark, sf_dir, "orders")
    now = o.groupBy(F.col("o_custkey").alias("project")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("now"), F.bool_or(F.col("o_orderstatus") == "O").alias("active"))
    r = o.select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("seen")).join(now, "project")
    return r.select("run", F.when(~F.col("active"), "archived").when(F.col("seen") != F.col("now"), "outdated").otherwise("current").alias("state"))


@query(f"""WITH {T.LINES}, r AS (SELECT doc_id, quality AS a, quality + toxic + 2 AS b FROM labels) SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN r ON l.doc_id = r.doc_id AND l.pos BETWEEN r.a AND r.b""")
def composite_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of many (document, range of lines) conditions, as a join with the conditions."""
    r = T.read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("a"), (F.col("quality") + F.col("toxic") + 2).alias("b"))
    return T.lines(spark, sf_dir).join(r, "doc_id").where(F.col("pos").between(F.col("a"), F.col("b"))).select("doc_id", "pos").distinct()


@query("SELECT p_partkey AS id FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring brand#1')")
def folded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "part").where(F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), F.lit("ring brand#1"))).select(F.col("p_partkey").alias("id"))


@query("""WITH t AS (SELECT o_custkey AS id, list_distinct(list(o_orderpriority)) AS tags FROM orders GROUP BY 1) SELECT id FROM t WHERE NOT list_has_any(tags, ['1-URGENT', '2-HIGH'])""")
def disjoint_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects none of whose runs has one of some roles."""
    t = T.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("tags"))
    return t.where(~F.arrays_overlap("tags", F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))).select("id")


@query("""WITH b AS (SELECT l_partkey AS topic, l_orderkey AS frag, l_linestatus = 'F' AS readable, l_quantity AS q FROM lineitem) SELECT topic, count(*) AS links, count(*) FILTER (NOT readable) AS gaps,
  coalesce(max(frag * 1000 + CAST(q AS BIGINT)) FILTER (readable), -1) AS best FROM b GROUP BY topic""")
def topics_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with their links, the unreadable ones, and the best evidence (-1: none)."""
    ok = F.col("l_linestatus") == "F"
    rank = F.col("l_orderkey") * 1000 + F.col("l_quantity").cast("bigint")
    return T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("topic")).agg(_n().alias("links"), F.count_if(~ok).alias("gaps"), F.coalesce(F.max(F.when(ok, rank)), F.lit(-1)).alias("best"))


@query(f"""WITH {T.TREE}, m AS (SELECT id, parent_id, CASE WHEN target = 'expert' THEN -1 ELSE ord END AS o FROM tree) SELECT id, CAST(row_number() OVER (PARTITION BY coalesce(parent_id, '') ORDER BY o, id) - 1 AS BIGINT) AS place FROM m""")
def sibling_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings numbered from 0 after some were moved to the front."""
    m = T.tree(spark, sf_dir).withColumn("o", F.when(F.col("target") == "expert", -1).otherwise(F.col("ord")))
    w = Window.partitionBy(F.coalesce("parent_id", F.lit(""))).orderBy("o", "id")
    return m.select("id", (F.row_number().over(w) - 1).cast("bigint").alias("place"))


@query("SELECT doc_id, len(list_filter(string_split(regexp_replace(regexp_replace(text, '\\n{2,}', chr(1), 'g'), '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS sentences FROM documents")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("bigint").alias("sentences"))


@query("""WITH h AS (SELECT event_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('event:' || user_id || ':' || event_type || ':' || event_id)) AS h FROM events)
  SELECT event_id, left(h, 8) || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', CAST('0x' || h[17] AS INT) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS key FROM h""")
def deterministic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that the same event always gets: UUIDs of version 5."""
    return T.read(spark, sf_dir, "events").select("event_id", X.uuid5(F.concat_ws(":", F.lit("event"), "user_id", "event_type", "event_id")).alias("key"))


@query("""WITH t AS (SELECT conv_id, turn, 'Use ' || split_part(text, ' ', 1) || ' with Wi-Fi, io_' || lower(split_part(text, ' ', 2)) || ' and SHA-' || turn || ', A-B, v' || conv_id % 7 || ' ∀ x → ' || conv_id AS q FROM conversations),
  n AS (SELECT conv_id, turn, q, list_filter(flatten(list_transform(regexp_extract_all(q, '[0-9A-Za-z]+(?:[-_][0-9A-Za-z]+)*'), lambda w: CASE WHEN len(list_filter(string_split(w, '-'), lambda p: length(p) < 2)) = 0 THEN [w] ELSE string_split(w, '-') END)),
    lambda w: NOT regexp_full_match(w, '[0-9]+') AND (length(w) >= 3 OR regexp_matches(w, '[0-9]')) AND (regexp_matches(w, '[0-9A-Z]') OR contains(w, '_'))) AS ws FROM t)
  SELECT conv_id, turn, array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: list_position(list_transform(ws, lambda w: lower(w)), lower(ws[i])) = i), lambda i: ws[i]), ',') AS terms,
    trim(regexp_replace(replace(replace(q, '∀', ' forall '), '→', ' to '), '\\s+', ' ', 'g')) AS spelt FROM n""")
def specific_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What questions name, and the questions with their symbols spelt; questions are made around messages' first words."""
    word = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    q = F.concat(F.lit("Use "), word(1), F.lit(" with Wi-Fi, io_"), F.lower(word(2)), F.lit(" and SHA-"), F.col("turn").cast("string"), F.lit(", A-B, v"), (F.col("conv_id") % 7).cast("string"), F.lit(" ∀ x → "), F.col("conv_id").cast("string"))
    t = T.read(spark, sf_dir, "conversations").select("conv_id", "turn", q.alias("q"))
    return t.select("conv_id", "turn", F.array_join(X.specific_terms(F.col("q")), ",").alias("terms"), X.squeezed(X.symbols_spelt(F.col("q"))).alias("spelt"))


@query("""WITH n AS (SELECT p_partkey AS id, p_name AS title FROM part), s AS (SELECT p_partkey AS section, p_partkey AS node FROM part WHERE p_size % 5 = 0), g AS (SELECT lower(title) AS t, list(id ORDER BY id) AS ids FROM n GROUP BY 1)
  SELECT section, len(ids) AS nodes, ids[1] AS first, CAST(list_sum(ids) AS BIGINT) AS total FROM s JOIN n ON n.id = s.node JOIN g ON g.t = lower(n.title)""")
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that hang on a node hang on all nodes of the same title, whatever its case."""
    p = T.read(spark, sf_dir, "part")
    n = p.select(F.col("p_partkey").alias("id"), "p_name")
    s = p.where("p_size % 5 = 0").select(F.col("p_partkey").alias("section"), F.col("p_partkey").alias("id"))
    return S.title_totals(s, n, "section", "id", "p_name", {"nodes": F.count(F.lit(1)), "first": F.min("id"), "total": F.sum("id")})


@query()
def near_duplicate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a conversation, each followed by what somebody asks again (in capitals, or with a word more), that ask the same
    as an earlier one of it."""
    c = T.read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).where(F.length("text") > 20)
    again = F.when(F.col("turn") % 3 == 0, F.upper("text")).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" really"))).otherwise(F.reverse("text"))
    rows = c.select("conv_id", (2 * F.col("turn")).alias("turn"), "text").unionByName(c.select("conv_id", (2 * F.col("turn") + 1).alias("turn"), again.alias("text")))
    return S.same_questions(rows, "conv_id", "turn", "text")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 6 = 0 THEN 'content' WHEN least(p_size * 8, p_retailprice) < 16 THEN 'decorative' WHEN p_partkey % 4 = 0 AND p_partkey % 3 = 0 THEN CASE WHEN least(p_size * 8, p_retailprice) < 64 OR p_size < 2 THEN 'service' ELSE 'unknown' END
  WHEN p_partkey % 4 = 0 THEN 'unknown' WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE 'content' END AS role FROM part""")
def image_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of images by size, repetition, place and caption; images are made of parts."""
    side = F.least(F.col("p_size") * 8, F.col("p_retailprice"))
    k = F.col("p_partkey")
    return T.read(spark, sf_dir, "part").select(k.alias("id"), S.image_role(side, F.col("p_size") / 100, k % 4 == 0, k % 3 == 0, F.col("p_size") % 6 == 0, k % 7 == 0).alias("role"))


@query("""SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderpriority, o_orderkey) AS place FROM orders""")
def enum_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a project by an order of states that isn't the alphabet's."""
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(rank, "o_orderpriority", "o_orderkey")).cast("bigint").alias("place"))


@query("""WITH c AS (SELECT conv_id, turn, role, text, length(text) AS n, sum(length(text)) OVER w AS upto, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
  SELECT conv_id, turn, round((upto - n) * 600.0::DOUBLE / nullif(total, 0), 6) AS time_from, round(upto * 600.0::DOUBLE / nullif(total, 0), 6) AS time_to FROM c""")
def proportional_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of paragraphs in ten minutes, in proportion to their lengths."""
    w = Window.partitionBy("conv_id")
    c = T.read(spark, sf_dir, "conversations").withColumn("n", F.length("text")).withColumn("upto", F.sum("n").over(w.orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.nullif(F.sum("n").over(w), F.lit(0)))
    return c.select("conv_id", "turn", F.round((F.col("upto") - F.col("n")) * 600.0 / F.col("total"), 6).alias("time_from"), F.round(F.col("upto") * 600.0 / F.col("total"), 6).alias("time_to"))


@query("""WITH s AS (SELECT l_orderkey AS doc, 1 AS pri, 'embedded' AS src, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1 UNION ALL SELECT l_orderkey, 2, 'printed', count(*) FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1 UNION ALL SELECT o_orderkey, 3, 'recognised', 0 FROM orders)
  SELECT doc, src, n FROM s QUALIFY row_number() OVER (PARTITION BY doc ORDER BY pri) = 1""")
def outline_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of three sources of each document's outline."""
    line = T.read(spark, sf_dir, "lineitem")
    part = lambda flag, p, name: line.where(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias("doc")).agg(F.lit(p).alias("pri"), F.lit(name).alias("src"), _n().alias("n"))
    last = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(3).alias("pri"), F.lit("recognised").alias("src"), F.lit(0).cast("bigint").alias("n"))
    every = part("A", 1, "embedded").unionByName(part("N", 2, "printed")).unionByName(last)
    return R.latest(every, ["doc"], [F.col("pri")]).drop("pri")


@query("""SELECT conv_id, sha256(string_agg('## ' || turn || ' ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text)) AS markdown_sha FROM conversations GROUP BY conv_id""")
def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown, in order (as digests)."""
    part = F.struct("turn", "role", "text")
    shown = F.transform(F.array_sort(F.collect_list(part)), lambda x: F.concat(F.lit("## "), x["turn"], F.lit(" "), x["role"], F.lit("\n"), x["text"]))
    return T.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(shown, "\n\n"), 256).alias("markdown_sha"))


@query("""SELECT p_partkey AS id, CAST(ceil(p_size * CASE p_type WHEN 'SMALL' THEN 0.5 WHEN 'ECONOMY' THEN 1.0 ELSE 1.5 END) AS BIGINT) AS minutes, CAST(CAST(p_retailprice AS DECIMAL(18,4)) * p_size / 1000 AS DECIMAL(18,4))::DOUBLE AS cost FROM part""")
def effort_and_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes by a coefficient of the kind of work, and a price times an amount in decimals."""
    k = F.when(F.col("p_type") == "SMALL", 0.5).when(F.col("p_type") == "ECONOMY", 1.0).otherwise(1.5)
    cost = (F.col("p_retailprice").cast("decimal(18,4)") * F.col("p_size") / F.lit(1000)).cast("decimal(18,4)").cast("double")
    return T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.ceil(F.col("p_size") * k).alias("minutes"), cost.alias("cost"))


@query("""WITH c AS (SELECT l_partkey AS topic, l_suppkey AS cand, l_discount AS score, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE 0.25 END AS w FROM lineitem),
  p AS (SELECT topic, cand, max(score) AS own, sum(score * w) - max(score * w) AS more FROM c GROUP BY 1, 2) SELECT topic, cand, round(own + 0.5 * more, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY topic ORDER BY round(own + 0.5 * more, 6) DESC, cand) <= 5""")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of each topic: their best score, and half of what other mentions add by their role."""
    w = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.5).otherwise(0.25)
    p = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("topic"), F.col("l_suppkey").alias("cand")).agg(F.max("l_discount").alias("own"), (F.sum(F.col("l_discount") * w) - F.max(F.col("l_discount") * w)).alias("more"))
    s = p.select("topic", "cand", F.round(F.col("own") + 0.5 * F.col("more"), 6).alias("score"))
    return s.withColumn("n", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "cand"))).where("n <= 5").drop("n")


@query("""WITH h AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS pos, length(lang) * 100000 - doc_id AS s FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s DESC, doc_id) AS head FROM h WHERE pos <= 5) SELECT h.doc_id, h.source, coalesce(r.head, h.pos) AS place FROM h LEFT JOIN r ON h.doc_id = r.doc_id AND h.source = r.source AND h.pos = r.pos""")
def rerank_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of each ranking by another score; the tail stays in its order."""
    w = Window.partitionBy("source")
    h = T.read(spark, sf_dir, "documents").select("doc_id", "source", F.row_number().over(w.orderBy(F.desc("n_chars"), "doc_id")).alias("pos"), (F.length("lang") * 100_000 - F.col("doc_id")).alias("s"))
    head = F.row_number().over(w.orderBy((F.col("pos") > 5).cast("int"), F.when(F.col("pos") <= 5, -F.col("s")), F.when(F.col("pos") > 5, F.col("pos")), "doc_id"))
    return h.select("doc_id", "source", head.cast("bigint").alias("place"))


@query("""SELECT event_type AS kind, count(*) AS n, count(*) FILTER (coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) >= 50) AS described, count(*) FILTER (json_extract_string(props, '$.zz') IS NULL) AS without FROM events GROUP BY 1""")
def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates on JSON paths with defaults."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    return T.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(_n().alias("n"), F.count_if(k >= 50).alias("described"), F.count_if(F.get_json_object("props", "$.zz").isNull()).alias("without"))


@query(f"""WITH {T.LINES}, s AS (SELECT *, lead(length(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS next, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM lines) SELECT doc_id, pos, rn = 1 AS opens FROM s WHERE rn = 1 OR length(line) < 60 AND next > 200""")
def skeleton_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a document's skeleton keeps: its first, and short ones before long bodies."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    s = T.lines(spark, sf_dir).withColumn("next", F.lead(F.length("line")).over(w)).withColumn("rn", F.row_number().over(w))
    return s.where((F.col("rn") == 1) | (F.length("line") < 60) & (F.col("next") > 200)).select("doc_id", "pos", (F.col("rn") == 1).alias("opens"))
