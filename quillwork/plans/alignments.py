"""Queries over outlines, ranges, anchors, passages, receipts and visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import alignment as A
from ..operators import answers as W
from ..sources import tables as T
from .registry import query

_ITEMS = "items AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord, CAST(l_quantity AS BIGINT) % 3 + 1 AS level, l_linenumber AS page FROM lineitem)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return T.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.row_number().over(w).cast("bigint").alias("ord"), (F.col("l_quantity").cast("bigint") % 3 + 1).alias("level"), F.col("l_linenumber").alias("page"))


@query(f"""WITH {_ITEMS} SELECT doc, ord, coalesce((SELECT max(b.ord) FROM items b WHERE b.doc = a.doc AND b.ord < a.ord AND b.level < a.level), -1) AS parent,
  greatest(page, coalesce((SELECT arg_min(c.page, c.ord) - 1 FROM items c WHERE c.doc = a.doc AND c.ord > a.ord AND c.level <= a.level), 7)) AS page_to FROM items a""")
def outline_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents and page ranges out of levels."""
    o = A.outline(_items(spark, sf_dir).withColumn("last", F.lit(7)), "doc", "ord", "level", "page", "last", 3)
    return o.select("doc", "ord", F.coalesce("parent", F.lit(-1)).alias("parent"), "page_to")


@query(f"""WITH {_ITEMS}, p AS (SELECT doc, ord, level, unnest(range(page, page + level)) AS place FROM items) SELECT doc, place, arg_max(level, ord) AS level FROM p GROUP BY doc, place""")
def range_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges expanded; a later range refines an earlier one."""
    r = _items(spark, sf_dir).withColumn("to", (F.col("page") + F.col("level") - 1).cast("int"))
    return A.expanded(r, "doc", "page", "to", "ord", "level").select("doc", F.col("place").cast("int").alias("place"), "level")


@query(f"""WITH {T.LINES}, r AS (SELECT doc_id, pos FROM lines WHERE length(line) % 17 <> 0 UNION ALL SELECT doc_id, pos FROM lines WHERE length(line) % 23 = 0 UNION ALL SELECT doc_id, pos + 100000 FROM lines WHERE length(line) % 29 = 0),
  g AS (SELECT doc_id, pos, count(*) AS n FROM r GROUP BY 1, 2)
  SELECT coalesce(l.doc_id, g.doc_id) AS doc_id, count(*) FILTER (n IS NULL) AS lost, count(*) FILTER (l.pos IS NULL) AS invented, count(*) FILTER (n > 1) AS twice FROM lines l FULL JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY 1""")
def full_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewritten list of lines that loses, repeats and invents some."""
    s, n = T.lines(spark, sf_dir), F.length("line")
    r = s.where(n % 17 != 0).select("doc_id", "pos").unionAll(s.where(n % 23 == 0).select("doc_id", "pos")).unionAll(s.where(n % 29 == 0).select("doc_id", (F.col("pos") + 100_000).alias("pos")))
    return A.covered_exactly(s, r, "doc_id", "pos")


_FORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


@query(f"""WITH {T.LINES}, n AS (SELECT *, {_FORM.format('line')} AS f FROM lines), a AS (SELECT doc_id, pos, {_FORM.format("CASE length(line) % 3 WHEN 0 THEN replace(line, ' ', '  ') WHEN 1 THEN left(line, 45) || '~' ELSE '~' || line END")} AS f FROM lines), s AS (SELECT doc_id, f, min(pos) AS sp FROM n GROUP BY 1, 2)
  SELECT a.doc_id, a.pos, coalesce(sp, n.pos, -1) AS found, CASE WHEN sp IS NOT NULL THEN 'text' WHEN n.pos IS NOT NULL THEN 'place' ELSE 'lost' END AS how
  FROM a LEFT JOIN s ON s.doc_id = a.doc_id AND s.f = a.f LEFT JOIN n ON n.doc_id = a.doc_id AND n.pos = a.pos AND left(n.f, 40) = left(a.f, 40)""")
def anchor_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as anchors, some with wider spaces, some changed after 45 characters and some at the beginning; -1 where one is lost."""
    rows, n = T.lines(spark, sf_dir), F.length("line")
    line = F.when(n % 3 == 0, F.replace("line", F.lit(" "), F.lit("  "))).when(n % 3 == 1, F.concat(F.substring("line", 1, 45), F.lit("~"))).otherwise(F.concat(F.lit("~"), "line"))
    return A.anchored(rows.withColumn("line", line), rows, "doc_id", "pos", "line").withColumn("found", F.coalesce("found", F.lit(-1)))


@query("""WITH o AS (SELECT p_partkey AS id, p_name AS text, p_type = 'SMALL' AS manual, p_brand = 'Brand#3' AS deleted FROM part WHERE p_size < 40), n AS (SELECT p_partkey AS id, CASE WHEN p_type = 'ECONOMY' THEN p_name || '!' ELSE p_name END AS text FROM part WHERE p_size > 5)
  SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.text IS NULL THEN 'keep' WHEN o.text IS NULL THEN 'create' WHEN deleted THEN 'restore' WHEN manual THEN 'preserve' WHEN o.text = n.text THEN 'unchanged' ELSE 'update' END AS action FROM o FULL JOIN n ON o.id = n.id""")
def imported_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    old = p.where("p_size < 40").select("id", F.col("p_name").alias("text"), (F.col("p_type") == "SMALL").alias("manual"), (F.col("p_brand") == "Brand#3").alias("deleted"))
    new = p.where("p_size > 5").select("id", F.when(F.col("p_type") == "ECONOMY", F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("text"))
    return A.merged_answers(old, new, "id")


@query()
def monotone_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best increasing chain of each conversation's candidate pairs (turn, length class)."""
    c = T.read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("left"), (F.length("text") % 10).alias("right"), (F.length("text") % 7).cast("double").alias("score")).dropDuplicates(["conv_id", "left", "right"])
    return A.monotone(c, "conv_id", "left", "right", "score", 10.0)


@query(f"""WITH {T.LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM lines), h AS (SELECT *, rn - lag(rn) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS g FROM n WHERE contains(line, 'tion')),
  r AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM h) SELECT doc_id, CAST(p AS BIGINT) AS passage, min(pos) AS first, max(pos) AS last, count(*) AS wanted FROM r GROUP BY doc_id, p""")
def passage_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.lines(spark, sf_dir).withColumn("w", F.col("line").contains("tion"))
    return A.passages(rows, "doc_id", "pos", "w")


@query("""WITH r AS (SELECT o_custkey AS project, unnest([o_totalprice, o_totalprice / 2]) AS cost, unnest(['actual', CASE WHEN o_orderstatus = 'P' THEN 'uncertain' ELSE 'estimate' END]) AS kind FROM orders)
  SELECT project, count(*) AS receipts, count(*) FILTER (kind = 'uncertain') AS uncertain, round(sum(cost) FILTER (kind = 'actual'), 2) AS actual FROM r GROUP BY project""")
def budget_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts nested in JSON, exploded and summed."""
    one = lambda c, k: F.struct(c.alias("cost"), k.alias("kind"))
    nested = F.to_json(F.array(one(F.col("o_totalprice"), F.lit("actual")), one(F.col("o_totalprice") / 2, F.when(F.col("o_orderstatus") == "P", "uncertain").otherwise("estimate"))))
    rows = T.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.inline(F.from_json(nested, "array<struct<cost:double,kind:string>>")))
    return rows.groupBy("project").agg(F.count(F.lit(1)).alias("receipts"), F.count_if(F.col("kind") == "uncertain").alias("uncertain"), F.round(F.sum(F.when(F.col("kind") == "actual", F.col("cost").cast("decimal(18,2)"))).cast("double"), 2).alias("actual"))


@query(f"""WITH {T.ATTEMPTS} SELECT session, count(*) AS attempts, count(*) FILTER (outcome IS NOT NULL AND moment + 86400 <= 1705276800) AS graded_by_then, count(*) FILTER (outcome IS NOT NULL AND moment + 86400 > 1705276800) AS hidden FROM attempts WHERE moment <= 1705276800 GROUP BY session""")
def visible_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts up to a moment, with the grades (a day later) that were known by then and those that weren't."""
    a, at = T.attempts(spark, sf_dir), 1_705_276_800
    known = F.col("moment") + 86_400 <= at
    return a.where(F.col("moment") <= at).groupBy("session").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("outcome").isNotNull() & known).alias("graded_by_then"), F.count_if(F.col("outcome").isNotNull() & ~known).alias("hidden"))


#: Passages as they are quoted: every third as it is, others in capitals or with other marks between words.
_QUOTES = """q AS (SELECT item_id AS quote_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN upper(text) ELSE replace(text, ' ', ' -- ') END AS quote FROM benchmark)"""


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.when(F.col("item_id") % 3 == 0, F.col("text")).when(F.col("item_id") % 3 == 1, F.upper("text")).otherwise(F.replace("text", F.lit(" "), F.lit(" -- ")))
    return T.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), form.alias("quote"))


@query(f"""WITH {_QUOTES}, p AS (SELECT *, '(?:^|[^0-9a-zа-я])(' || array_to_string(regexp_extract_all(replace(lower(quote), 'ё', 'е'), '[0-9a-zа-я]+'), '[^0-9a-zа-я]+') || ')(?:$|[^0-9a-zа-я])' AS pattern FROM q),
  d AS (SELECT doc_id, text, replace(lower(text), 'ё', 'е') AS t FROM documents),
  m AS (SELECT quote_id, doc_id, instr(text, quote) AS e, length(quote) AS n, regexp_extract(t, pattern, 1) AS found, t FROM p JOIN d ON contains(text, quote) OR regexp_matches(t, pattern))
  SELECT quote_id, doc_id, CAST(CASE WHEN e > 0 THEN e ELSE instr(t, found) END AS BIGINT) - 1 AS start, CAST(CASE WHEN e > 0 THEN e + n ELSE instr(t, found) + length(found) END AS BIGINT) - 1 AS "end", CASE WHEN e > 0 THEN 'exact' ELSE 'tokens' END AS how FROM m""")
def quote_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents have whole quotations, in characters: as they are, else token after token."""
    docs = T.spread(T.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return A.located(A.quoted(docs, _quotes(spark, sf_dir), "doc_id", "text"), "text").select("quote_id", "doc_id", "start", "end", "how")


@query("""SELECT doc_id, greatest(5, CAST(round_even(n_chars / 1200.0::DOUBLE / 5, 0) AS INT) * 5) AS minutes, CAST(greatest(1, ceil(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) * 1.35::DOUBLE)) AS BIGINT) AS model_tokens,
  CASE WHEN n_chars % 86400 >= 3600 THEN (n_chars % 86400) // 3600 || ':' || lpad(CAST((n_chars % 3600) // 60 AS VARCHAR), 2, '0') ELSE CAST((n_chars % 3600) // 60 AS VARCHAR) END || ':' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0') AS clock FROM documents""")
def scalar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading time, a model's token estimate, and a duration's form."""
    n = F.col("n_chars")
    return T.read(spark, sf_dir, "documents").select("doc_id", X.reading_minutes(n).alias("minutes"), X.model_tokens(X.token_count(F.col("text"))).alias("model_tokens"), X.duration(n % 86400).alias("clock"))


@query("""WITH a AS (SELECT conv_id, list(DISTINCT CASE turn % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'partial' ELSE 'failed' END) AS o FROM conversations GROUP BY conv_id)
  SELECT conv_id, CASE WHEN len(o) = 1 THEN o[1] ELSE 'partial' END AS outcome FROM a""")
def outcome_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer's outcome out of its parts': theirs if they agree, else partial."""
    part = F.when(F.col("turn") % 3 == 0, "passed").when(F.col("turn") % 3 == 1, "partial").otherwise("failed")
    a = T.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set(part).alias("o"))
    return a.select("conv_id", F.when(F.size("o") == 1, F.element_at("o", 1)).otherwise("partial").alias("outcome"))


@query(f"""WITH {T.LINES}, h AS (SELECT *, regexp_matches(line, '^[A-ZÀ-Þ][^.!?]{{0,58}}$') AS head FROM lines), s AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM h)
  SELECT doc_id, CAST(n AS BIGINT) AS answer, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), '')) AS body_sha, count(*) FILTER (NOT head) AS lines FROM s GROUP BY doc_id, n""")
def reference_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers between heading lines, their bodies put together in order (as digests)."""
    from pyspark.sql import Window

    h = T.lines(spark, sf_dir).withColumn("head", F.col("line").rlike("^[A-ZÀ-Þ][^.!?]{0,58}$"))
    s = h.withColumn("answer", F.sum(F.col("head").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos")))
    parts = F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))), lambda x: x["line"])
    return s.groupBy("doc_id", "answer").agg(F.sha2(F.array_join(parts, "\n"), 256).alias("body_sha"), F.count_if(~F.col("head")).alias("lines"))


@query("""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[0-9a-zA-Zа-яА-ЯёЁ]+')) AS terms FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[0-9a-zA-Zа-яА-ЯёЁ]+')) AS ts FROM documents),
  h AS (SELECT item_id, doc_id, len(list_intersect(terms, ts)) AS n, len(terms) AS k FROM t, d) SELECT item_id, count(*) FILTER (n = k) AS all_terms, count(*) FILTER (n * 4 >= k * 3) AS most_terms, max(n) AS best FROM h GROUP BY item_id""")
def lexical_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have all, or three quarters, of each question's terms (questions are a stated set).

    Documents give only terms that some question has.
    """
    q = T.read(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(X.tokens(F.col("text"))).alias("terms"))
    asked = q.select("item_id", F.size("terms").alias("k"), F.explode("terms").alias("term"))
    docs = T.read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    n = docs.join(T.bounded(asked), "term").groupBy("item_id", "doc_id", "k").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("item_id").agg(F.count_if(F.col("n") == F.col("k")).alias("all_terms"), F.count_if(F.col("n") * 4 >= F.col("k") * 3).alias("most_terms"), F.max("n").alias("best"))
    zero = F.lit(0).cast("bigint")
    return q.select("item_id").join(g, "item_id", "left").select("item_id", *(F.coalesce(c, zero).alias(c) for c in ("all_terms", "most_terms", "best")))


@query("""SELECT source, count(*) AS fragments, count(DISTINCT lang) AS langs, bool_or(contains(text, '@')) AS has_mail, max(n_chars) AS longest FROM documents GROUP BY source""")
def revision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("fragments"), F.countDistinct("lang").alias("langs"), F.bool_or(F.contains("text", F.lit("@"))).alias("has_mail"), F.max("n_chars").alias("longest"))


@query(f"""WITH {T.ATTEMPTS}, c AS (SELECT session, node, count(*) AS shown, avg(confidence) AS conf FROM attempts WHERE outcome IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY conf, shown DESC, node) AS place FROM c)
  SELECT session, node, shown, round(conf, 6) AS confidence, place FROM r WHERE place <= 10""")
def card_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten least sure cards of each session."""
    from pyspark.sql import Window

    c = T.attempts(spark, sf_dir).where("outcome IS NOT NULL").groupBy("session", "node").agg(F.count(F.lit(1)).alias("shown"), F.avg("confidence").alias("conf"))
    place = F.row_number().over(Window.partitionBy("session").orderBy("conf", F.desc("shown"), "node")).cast("bigint")
    return c.withColumn("place", place).where("place <= 10").select("session", "node", "shown", F.round("conf", 6).alias("confidence"), "place")


@query("""WITH a AS (SELECT o_orderkey AS id, o_custkey AS fragment, o_orderpriority AS print, CAST(floor(o_totalprice) AS BIGINT) % 5 AS rev, o_orderstatus AS status FROM orders), d AS (SELECT fragment, print, rev FROM a WHERE status = 'F' AND rev = 1)
  SELECT id FROM a WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.fragment = a.fragment AND (d.print = a.print OR d.rev <> a.rev))""")
def rejected_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links without an earlier rejection that holds: the same fragment, with the same fingerprint or from another revision."""
    a = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("fragment"), F.col("o_orderpriority").alias("print"), (F.floor("o_totalprice") % 5).alias("rev"), F.col("o_orderstatus").alias("status"))
    d = a.where("status = 'F' AND rev = 1").select(F.col("fragment").alias("f"), F.col("print").alias("p"), F.col("rev").alias("r")).distinct()
    return a.join(d, (a.fragment == d.f) & ((a.print == d.p) | (a.rev != d.r)), "left_anti").select("id")




@query()
def answer_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question of each exam gets out of its file of answers: its section, bindings and answer, or a suggestion."""
    t = T.answer_files(spark, sf_dir)
    got = W.linked(t["fragments"], t["questions"], t["resolved"], t["manual"], t["edited"])
    bound = got.bindings.groupBy("key", "ord").agg(F.count_if(F.col("origin") == "auto").alias("auto"), F.count_if(F.col("origin") == "manual").alias("manual"))
    sections = got.sections.select("key", "ord", "method", (F.col("end") - F.col("anchor")).cast("bigint").alias("fragments"))
    suggested = got.suggestions.select("key", "ord", F.round("score", 6).alias("suggested"))
    rows = t["questions"].select("key", "ord").join(sections, ["key", "ord"], "left").join(bound, ["key", "ord"], "left").join(got.answers, ["key", "ord"], "left").join(suggested, ["key", "ord"], "left")
    return rows.select("key", "ord", "method", "fragments", F.coalesce("auto", F.lit(0)).alias("auto"), F.coalesce("manual", F.lit(0)).alias("manual"), "action", F.sha2("text", 256).alias("answer"), "suggested")
