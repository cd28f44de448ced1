"""Queries over materials: numbered lists, imports, highlights, free time, packets, ranges of topics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectorised as V
from ..operators import evidence as E
from ..operators import exams as Q
from ..operators import planning as P
from ..operators import ranges as G
from ..operators import series as N
from ..operators import trees as R
from ..sources import shared
from ..sources import tables as T
from .registry import query

_LISTS = """lists AS (SELECT l_orderkey // 64 AS key, row_number() OVER (PARTITION BY l_orderkey // 64 ORDER BY l_orderkey, l_linenumber, l_partkey) AS pos,
    CASE WHEN l_partkey % 5 = 0 THEN 'goes on ' || l_returnflag WHEN l_partkey % 17 = 0 THEN '' ELSE
      (row_number() OVER (PARTITION BY l_orderkey // 64 ORDER BY l_orderkey, l_linenumber, l_partkey) % 23 + CASE WHEN l_partkey % 29 = 0 THEN 40 ELSE 0 END) || CASE l_partkey % 3 WHEN 0 THEN '. ' WHEN 1 THEN ') ' ELSE ' ' END || 'item ' || l_shipmode END AS line
  FROM (SELECT *, l_linestatus || l_returnflag AS l_shipmode FROM lineitem)),
  expected AS (SELECT DISTINCT key, CASE key % 4 WHEN 0 THEN NULL WHEN 1 THEN 5 WHEN 2 THEN 7 ELSE 60 END AS expected FROM lists)"""


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of 64 orders' items as one text: numbers that start again, jump, or are missing, and lines between; and how many
    items are expected."""
    rows = T.read(spark, sf_dir, "lineitem").withColumn("key", F.floor(F.col("l_orderkey") / 64))
    pos = F.row_number().over(Window.partitionBy("key").orderBy("l_orderkey", "l_linenumber", "l_partkey"))
    p = F.col("l_partkey")
    number = (F.col("pos") % 23 + F.when(p % 29 == 0, 40).otherwise(0)).cast("string")
    mark = F.when(p % 3 == 0, ". ").when(p % 3 == 1, ") ").otherwise(" ")
    line = F.when(p % 5 == 0, F.concat(F.lit("goes on "), "l_returnflag")).when(p % 17 == 0, "").otherwise(F.concat(number, mark, F.lit("item "), "l_linestatus", "l_returnflag"))
    lines = rows.withColumn("pos", pos).select("key", "pos", line.alias("line"))
    k = F.col("key") % 4
    return lines, lines.select("key").distinct().withColumn("expected", F.when(k == 1, 5).when(k == 2, 7).when(k == 3, 60))


_SERIES = f"""WITH RECURSIVE {_LISTS}, l AS (SELECT key, pos, trim(line) AS line FROM lists WHERE trim(line) <> ''),
  m AS (SELECT *, TRY_CAST(coalesce(nullif(regexp_extract(line, '^(\\d{{1,4}})[.)]\\s*[^\\d\\s]', 1), ''), nullif(regexp_extract(line, '^(\\d{{1,4}})\\s+\\S', 1), '')) AS INT) AS n FROM l),
  c AS (SELECT *, count(n) OVER (PARTITION BY key ORDER BY pos) AS item FROM m), d AS (SELECT * FROM c WHERE item > 0),
  f AS (SELECT *, last_value(n IGNORE NULLS) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d),
  s AS (SELECT *, sum(CASE WHEN n IS NOT NULL AND n IS DISTINCT FROM b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY pos) AS series FROM f),
  r AS (SELECT key, series, min(n) AS first, max(n) AS last, count(n) AS n, min(pos) AS pos, max(pos) AS until FROM s GROUP BY 1, 2),
  ch AS (SELECT key, series, last AS top, true AS taken FROM r WHERE series = 1
    UNION ALL SELECT r.key, r.series, CASE WHEN r.first > top THEN r.last ELSE top END, r.first > top FROM ch JOIN r ON r.key = ch.key AND r.series = ch.series + 1),
  j AS (SELECT r.*, taken, expected, max(n) OVER w AS longest, count(*) FILTER (r.n = expected) OVER w AS exact, sum(n) FILTER (taken) OVER w AS chained, count(*) FILTER (taken) OVER w AS links FROM r JOIN ch USING (key, series) LEFT JOIN expected USING (key) WINDOW w AS (PARTITION BY key)),
  h AS (SELECT *, CASE WHEN expected IS NULL THEN 'longest' WHEN exact > 0 THEN 'exact' WHEN links > 1 OR chained = expected THEN 'stitched' ELSE 'longest' END AS how FROM j),
  v AS (SELECT *, CASE how WHEN 'longest' THEN n = longest WHEN 'exact' THEN n = expected ELSE taken END AS fits FROM h),
  x AS (SELECT *, count(*) FILTER (fits) OVER (PARTITION BY key) > 1 AND how <> 'stitched' AS ambiguous FROM v),
  o AS (SELECT *, fits AND NOT ambiguous AS own FROM x),
  a AS (SELECT key, any_value(expected) AS expected, any_value(how) AS how, any_value(ambiguous) AS ambiguous, coalesce(sum(n) FILTER (own), 0) AS items, count(*) FILTER (own) AS parts, coalesce(sum(n) FILTER (NOT own AND how = 'stitched'), 0) AS dropped,
    min(first) FILTER (own) AS first, arg_max(last, pos) FILTER (own) AS last, min(pos) FILTER (own) AS az, max(until) FILTER (own) AS source_end FROM o GROUP BY key),
  g AS (SELECT a.key, count(*) FILTER (l.pos < az) AS before, count(*) FILTER (l.pos > source_end) AS after, count(*) FILTER (l.pos > az AND l.pos < source_end AND NOT EXISTS (SELECT 1 FROM o WHERE o.key = a.key AND own AND l.pos BETWEEN o.pos AND o.until)) AS gap FROM a JOIN l USING (key) GROUP BY a.key)
  SELECT a.key, a.expected, how, ambiguous, CAST(items AS BIGINT) AS items, parts, CAST(dropped AS BIGINT) AS dropped, gap, before, after, first, last, source_end FROM a JOIN g USING (key)"""


@query(_SERIES)
def numbered_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered list that is meant in each text: the longest, the one of the expected length, or one stitched together."""
    chosen, _ = N.selected(*_lists(spark, sf_dir))
    return chosen


_EDGES = "edges AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS dst FROM lineitem WHERE l_quantity < 4)"


@query(f"""WITH RECURSIVE {_EDGES}, e AS (SELECT DISTINCT src, dst FROM edges JOIN part ON dst = p_partkey WHERE p_size % 5 > 0), ok AS (SELECT p_partkey AS id FROM part WHERE p_size % 5 > 0),
  r AS (SELECT id, 0 AS depth FROM ok WHERE id % 97 = 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = id WHERE depth < 40) SELECT id, min(depth) AS depth FROM r GROUP BY id""")
def import_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a few source files import, directly or by others, with the fewest steps. Files are parts (a fifth can't be read), and
    one imports another where a supplier delivered it next; there are cycles."""
    after = F.lead("l_partkey").over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey"))
    edges = T.read(spark, sf_dir, "lineitem").where("l_quantity < 4").select(F.col("l_partkey").alias("src"), after.alias("dst")).where("dst IS NOT NULL").distinct()
    files = T.read(spark, sf_dir, "part").where("p_size % 5 > 0").select(F.col("p_partkey").alias("id"))
    return R.reachable(edges, files.where("id % 97 = 0"), files)


@query(f"""WITH {T.LINES}, p AS (SELECT doc_id, pos, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM (SELECT doc_id, pos, regexp_extract_all(line, '[0-9a-zA-Zа-яА-ЯёЁ]+|[^0-9a-zA-Zа-яА-ЯёЁ]+') AS pieces FROM lines)),
  s AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, pos ORDER BY i) AS upto, translate(lower(piece), 'ё', 'е') AS token FROM p),
  h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos, token ORDER BY i) AS nth FROM s WHERE token IN ('estion', 'ndtion', 'tionen') OR starts_with(token, 'entio'))
  SELECT doc_id, pos, string_agg(CAST(upto - length(piece) AS BIGINT) || '-' || CAST(upto AS BIGINT), ',' ORDER BY i) AS spans, string_agg(piece, ',' ORDER BY i) FILTER (nth = 1) AS forms FROM h GROUP BY doc_id, pos""")
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where lines have a search's terms, or words with its last prefix, and how these are written there."""
    found = T.lines(spark, sf_dir).select("doc_id", "pos", V.highlights(F.col("line"), ["estion", "ndtion", "tionen"], "entio").alias("h")).where(F.size("h") > 0)
    spans = F.array_join(F.transform("h", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return found.select("doc_id", "pos", spans.alias("spans"), F.array_join(V.surface_forms(F.col("h")), ",").alias("forms"))


_PLAIN = "trim(regexp_replace(lower(translate(regexp_replace(regexp_replace({}, '[$]|[{{}}*_`]', '', 'g'), '\\.{{2,}}|…|[-—]{{2,}}', ' ', 'g'), 'ABCEHKMOPTXYaceopxy', 'АВСЕНКМОРТХУасеорху')), '\\s+', ' ', 'g'))"


@query(f"""WITH {T.LINES}, u AS (SELECT doc_id * 1000 + pos AS ref, line AS text, doc_id, pos FROM lines WHERE pos < 1000), n AS (SELECT *, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w, coalesce(lead(ref) OVER (PARTITION BY doc_id ORDER BY pos), ref) AS after FROM u),
  e AS (SELECT ref AS id, CASE (doc_id + pos) % 6 WHEN 4 THEN after ELSE ref END AS ref, CASE (doc_id + pos) % 6 WHEN 1 THEN upper(array_to_string(w[2:12], '  ')) WHEN 2 THEN array_to_string(list_transform(w[2:12], lambda x, i: CASE WHEN i % 5 = 0 THEN 'zzz' ELSE x END), ' ')
    WHEN 3 THEN array_to_string(list_transform(w[2:12], lambda x, i: CASE WHEN i % 2 = 0 THEN 'zzz' ELSE x END), ' ') WHEN 5 THEN replace(array_to_string(w[2:12], ' '), 'e', 'е') ELSE array_to_string(w[2:12], ' ') END AS quote FROM n WHERE len(w) >= 14 AND pos % 3 = 0),
  p AS (SELECT ref, text, {_PLAIN.format('text')} AS p FROM u), q AS (SELECT *, {_PLAIN.format('quote')} AS a FROM e),
  o AS (SELECT q.*, text, p, regexp_extract_all(a, '[\\p{{L}}\\p{{N}}_]+') AS qw, regexp_extract_all(p, '[\\p{{L}}\\p{{N}}_]+') AS uw FROM q JOIN p USING (ref)),
  s AS (SELECT *, list_sum(list_transform(list_distinct(qw), lambda x: least(len(list_filter(qw, lambda y: y = x)), len(list_filter(uw, lambda y: y = x))))) / CAST(len(qw) AS DOUBLE) AS share FROM o),
  h AS (SELECT *, CASE WHEN contains(text, quote) THEN 'exact' WHEN contains(p, a) THEN 'normalized' WHEN share >= 0.75 THEN 'approximate' END AS how FROM s),
  c AS (SELECT h.id, min(p.ref) AS other FROM h JOIN p ON h.how IS NULL AND p.ref <> h.ref AND contains(p.p, h.a) GROUP BY h.id)
  SELECT id, CASE WHEN how IS NOT NULL THEN ref ELSE other END AS found, coalesce(how, CASE WHEN other IS NOT NULL THEN 'ref_corrected' ELSE 'lost' END) AS how FROM h LEFT JOIN c USING (id)""")
def evidence_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations of lines, as they are and changed in five ways, found again: exact, normalized, approximate or elsewhere."""
    of = lambda dealt: T.lines(spark, sf_dir, dealt).where("pos < 1000").select((F.col("doc_id") * 1000 + F.col("pos")).alias("ref"), F.col("line").alias("text"), "doc_id", "pos")
    after = F.coalesce(F.lead("ref").over(Window.partitionBy("doc_id").orderBy("pos")), F.col("ref"))
    n = of(True).withColumn("after", after).where("pos % 3 = 0").withColumn("w", F.split(F.trim("text", F.lit(" \t\n\x0b\f\r")), r"\s+", 15)).where("size(w) >= 14")
    eleven, way = F.slice("w", 2, 11), (F.col("doc_id") + F.col("pos")) % 6
    every = lambda k: F.array_join(F.transform(eleven, lambda x, i: F.when((i + 1) % k == 0, "zzz").otherwise(x)), " ")
    quote = F.when(way == 1, F.upper(F.array_join(eleven, "  "))).when(way == 2, every(5)).when(way == 3, every(2)).when(way == 5, F.translate(F.array_join(eleven, " "), "e", "е")).otherwise(F.array_join(eleven, " "))
    evidence = n.select(F.col("ref").alias("id"), F.when(way == 4, F.col("after")).otherwise(F.col("ref")).alias("ref"), quote.alias("quote"))
    return E.repaired(evidence, of(False).select("ref", "text")).select("id", "found", "how")


_PAGED = f"""{T.LINES}, fr AS (SELECT doc_id AS key, pos // 5 AS page, row_number() OVER (PARTITION BY doc_id, pos // 5 ORDER BY pos) - 1 AS place, pos, line AS text, length(line) % 3 = 0 AS heading, CASE WHEN length(line) % 4 < 3 THEN length(line) % 4 + 1 END AS level, length(line) % 9 > 0 AS content FROM lines),
  tops AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS ord, lead(text) OVER (PARTITION BY key ORDER BY pos) AS next_title, lead(page) OVER (PARTITION BY key ORDER BY pos) AS next_page FROM fr WHERE heading AND pos % 2 = 0),
  topics AS (SELECT key, ord, upper(text) AS title, page AS page_from, greatest(page, coalesce(next_page - 1 + pos % 3 // 2, page + 2)) AS page_to, next_title, next_page, CASE WHEN key % 3 = 0 THEN 3 END AS page_count FROM tops),
  hd AS (SELECT * FROM (SELECT *, coalesce(max(CASE WHEN content THEN place END) OVER (PARTITION BY key, page ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) AS back, trim(regexp_replace(replace(lower(text), 'ё', 'е'), '\\s+', ' ', 'g')) AS form FROM fr) WHERE heading AND content),
  own AS (SELECT t.*, h.back, h.level FROM topics t LEFT JOIN (SELECT t.key, t.ord, min({{'p': h.place, 'b': h.back, 'l': h.level}}) AS x FROM topics t JOIN hd h ON h.key = t.key AND h.page = t.page_from AND h.form = trim(regexp_replace(replace(lower(t.title), 'ё', 'е'), '\\s+', ' ', 'g')) GROUP BY 1, 2) o ON o.key = t.key AND o.ord = t.ord, LATERAL (SELECT o.x.b AS back, o.x.l AS level) h),
  st AS (SELECT *, coalesce(back, 0) AS place_from, coalesce(next_page = page_from, false) AS same, CASE WHEN next_page = page_from OR (next_page = page_to + 1 AND (page_count IS NULL OR next_page <= page_count)) THEN next_page END AS cut FROM own),
  ct AS (SELECT s.key, s.ord, coalesce(min({{'i': h.place, 'b': h.back}}) FILTER (h.form = trim(regexp_replace(replace(lower(s.next_title), 'ё', 'е'), '\\s+', ' ', 'g'))), min({{'i': h.place, 'b': h.back}}) FILTER (s.level IS NULL OR h.level IS NULL OR h.level <= s.level)) AS x
    FROM st s JOIN hd h ON h.key = s.key AND h.page = s.cut AND h.place >= CASE WHEN s.same THEN s.place_from + 1 ELSE 0 END GROUP BY 1, 2),
  pg AS (SELECT key, page, bool_or(content) AS content, count(*) AS size FROM fr GROUP BY 1, 2),
  rg AS (SELECT s.*, CASE WHEN cut IS NULL THEN [page_to + 1, 0] WHEN same THEN CASE WHEN x IS NOT NULL THEN [cut, x.b] ELSE [page_to + 1, 0] END WHEN pg.content IS NULL THEN [cut + 1, 0] WHEN NOT pg.content THEN [page_to + 1, 0] WHEN x IS NOT NULL THEN [cut, x.b] ELSE [cut + 1, 0] END AS e
    FROM st s LEFT JOIN ct USING (key, ord) LEFT JOIN pg ON pg.key = s.key AND pg.page = s.cut)"""


def _paged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages of five lines, a third of them headings (by their length), and topics: every other heading, with a last page that is right, or one too far."""
    line = F.col("line")
    page = F.floor(F.col("pos") / 5).cast("int")
    place = (F.row_number().over(Window.partitionBy("doc_id", page).orderBy("pos")) - 1).alias("place")
    level = F.when(F.length(line) % 4 < 3, F.length(line) % 4 + 1)
    fr = T.lines(spark, sf_dir).select(F.col("doc_id").alias("key"), page.alias("page"), place, "pos", line.alias("text"), (F.length(line) % 3 == 0).alias("heading"), level.alias("level"), (F.length(line) % 9 > 0).alias("content"))
    w = Window.partitionBy("key").orderBy("pos")
    tops = fr.where("heading AND pos % 2 = 0").withColumn("ord", F.row_number().over(w)).withColumn("next_title", F.lead("text").over(w)).withColumn("next_page", F.lead("page").over(w))
    last = F.greatest(F.col("page"), F.coalesce(F.col("next_page") - 1 + F.floor(F.col("pos") % 3 / 2), F.col("page") + 2)).cast("int")
    topics = tops.select("key", "ord", F.upper("text").alias("title"), F.col("page").alias("page_from"), last.alias("page_to"), "next_title", "next_page", F.when(F.col("key") % 3 == 0, 3).alias("page_count"))
    return fr, topics


@query(f"WITH {_PAGED} SELECT key, ord, page_from, place_from, e[1] AS page_end, e[2] AS place_end FROM rg")
def refined_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics' ranges with their borders at headings."""
    fr, topics = _paged(spark, sf_dir)
    return G.refined(topics, fr).select("key", "ord", F.col("start.page").alias("page_from"), F.col("start.place").alias("place_from"), F.col("end.page").alias("page_end"), F.col("end.place").alias("place_end"))


@query(f"""WITH {_PAGED}, kids AS (SELECT fr.key, rg.ord, fr.pos AS part, fr.text AS title, fr.page + CASE WHEN fr.pos % 7 = 0 THEN 1 ELSE 0 END AS page, rg.page_from * 1000 + rg.place_from AS s, rg.e[1] * 1000 + rg.e[2] AS e FROM fr JOIN rg ON fr.key = rg.key AND fr.heading AND fr.pos % 2 = 1 AND fr.page >= rg.page_from AND fr.page <= rg.page_to),
  po AS (SELECT k.*, greatest(k.page * 1000 + coalesce((SELECT min({{'i': h.place, 'b': h.back}}).b FROM hd h WHERE h.key = k.key AND h.page = k.page AND h.form = trim(regexp_replace(replace(lower(k.title), 'ё', 'е'), '\\s+', ' ', 'g')) AND h.place >= CASE WHEN k.page = k.s // 1000 THEN k.s % 1000 + 1 ELSE 0 END), 0), s) AS a FROM kids k WHERE k.page >= k.s // 1000),
  cu AS (SELECT key, ord, part, e, max(a) OVER (PARTITION BY key, ord ORDER BY page, part) AS f, row_number() OVER (PARTITION BY key, ord ORDER BY page, part) AS n FROM po WHERE a < e),
  bo AS (SELECT key, ord, NULL AS part, e[1] * 1000 + e[2] AS e, page_from * 1000 + place_from AS f, 0 AS n FROM rg UNION ALL SELECT key, ord, part, e, f, n FROM cu),
  se AS (SELECT *, coalesce(lead(f) OVER (PARTITION BY key, ord ORDER BY n), e) AS z FROM bo),
  sg AS (SELECT se.*, CASE WHEN f % 1000 > 0 AND f % 1000 >= coalesce(size, 0) THEN (f // 1000 + 1) * 1000 ELSE f END AS b, CASE WHEN z % 1000 = 0 THEN z // 1000 - 1 ELSE z // 1000 END AS y FROM se LEFT JOIN pg ON pg.key = se.key AND pg.page = se.f // 1000)
  SELECT key, ord, coalesce(part, -1) AS part, CASE WHEN ok THEN b // 1000 END AS page_from, CASE WHEN ok THEN b % 1000 END AS place_from, CASE WHEN ok THEN y END AS page_to, CASE WHEN ok THEN z % 1000 END AS place_to FROM (SELECT *, f < z AND y >= b // 1000 AND b < z AS ok FROM sg) WHERE part IS NOT NULL OR ok""")
def child_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics' ranges cut at the headings of their parts; -1 is what stands before the first part."""
    fr, topics = _paged(spark, sf_dir)
    r = G.refined(topics, fr)
    kids = fr.where("heading AND pos % 2 = 1").select("key", F.col("pos").alias("part"), F.col("text").alias("title"), "page")
    within = kids.join(r.select("key", "ord", F.col("page_from").alias("_a"), F.col("page_to").alias("_z")), "key").where("page BETWEEN _a AND _z")
    parts = within.select("key", "ord", "part", "title", (F.col("page") + F.when(F.col("part") % 7 == 0, 1).otherwise(0)).alias("page_from"))
    return G.split_by_parts(r, parts, fr).withColumn("part", F.coalesce("part", F.lit(-1)))


_DAYS = ["2024-03-09", "2024-03-10", "2024-03-11", "2024-03-30", "2024-03-31", "2024-04-01", "2024-11-02", "2024-11-03", "2024-11-04"]
_CONFIGS = f"""cf AS (SELECT c_custkey AS k, ['Europe/Berlin', 'America/New_York', 'Asia/Kolkata'][c_custkey % 3 + 1] AS zone, (c_custkey % 5) * 60 AS boundary, 1380 + c_custkey % 40 - (c_custkey % 2) * 1300 AS sf, 400 + c_custkey % 100 AS st,
    CASE WHEN c_custkey % 4 > 0 THEN DATE '2024-03-31' + CAST(c_custkey % 3 AS INT) END AS deadline, CASE WHEN c_custkey % 8 > 1 THEN 60 + c_custkey % 900 END AS exam_time, 30 + c_custkey % 200 AS reserve, c_custkey % 6 > 2 AS exam_day, 120 + c_custkey % 600 AS daily FROM customer),
  wk AS (SELECT k, unnest([{{'wd': k % 7, 'od': CAST(NULL AS DATE), 'f': 600, 't': 600 + k % 300}}, {{'wd': CAST(NULL AS BIGINT), 'od': CAST(NULL AS DATE), 'f': 700 + k % 60, 't': 800}}, {{'wd': CAST(NULL AS BIGINT), 'od': DATE '2024-03-30', 'f': 1300, 't': 100 + k % 90}}]) AS w FROM cf),
  dy AS (SELECT CAST(unnest({_DAYS!r}) AS DATE) AS d), cd AS (SELECT * FROM cf, dy)"""
_AT = "((({0} + to_minutes(CAST({1} AS INT))) AT TIME ZONE zone) AT TIME ZONE 'UTC')"


@query(f"""WITH {_CONFIGS}, b AS (SELECT *, {_AT.format('CAST(d AS TIMESTAMP)', 'boundary')} AS l, least({_AT.format('CAST(d + 1 AS TIMESTAMP)', 'boundary')}, coalesce({_AT.format('CAST(deadline AS TIMESTAMP)', 'exam_time')} - to_minutes(CAST(reserve AS INT)), TIMESTAMP '9999-01-01'),
    CASE WHEN deadline IS NOT NULL AND (exam_time IS NULL OR NOT exam_day) THEN {_AT.format('CAST(deadline AS TIMESTAMP)', '0')} ELSE TIMESTAMP '9999-01-01' END) AS r FROM cd),
  ws AS (SELECT k, CAST(NULL AS BIGINT) AS wd, CAST(NULL AS DATE) AS od, sf AS f, st AS t FROM cf UNION ALL SELECT k, w.wd, w.od, w.f, w.t FROM wk),
  cv AS (SELECT b.k, b.d, zone, l, r, f, t, CAST(b.d + o AS DATE) AS civil FROM b JOIN ws USING (k), (SELECT unnest([-1, 0, 1]) AS o) WHERE CASE WHEN od IS NOT NULL THEN od = b.d + o ELSE wd IS NULL OR wd = isodow(b.d + o) - 1 END),
  sp AS (SELECT k, d, greatest(l, {_AT.format('CAST(civil AS TIMESTAMP)', 'f')}) AS a, least(r, {_AT.format('CAST(civil + CASE WHEN t <= f THEN 1 ELSE 0 END AS TIMESTAMP)', 't')}) AS z FROM cv),
  un AS (SELECT k, d, a, z, max(z) OVER (PARTITION BY k, d ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sp WHERE z > a),
  tk AS (SELECT k, d, sum(greatest(0, epoch(z) - epoch(greatest(a, coalesce(before, a))))) AS taken FROM un GROUP BY k, d),
  fr AS (SELECT b.*, CASE WHEN r > l THEN greatest(0, epoch(r) - epoch(l) - coalesce(taken, 0)) ELSE 0 END AS free, CASE WHEN d = DATE '2024-03-11' AND k % 3 = 0 OR coalesce(d > deadline, false) OR coalesce(d = deadline AND NOT exam_day, false) THEN 0 WHEN d = DATE '2024-04-01' AND k % 5 = 0 THEN 45
    ELSE CASE WHEN coalesce(d = deadline - 1, false) THEN CAST(floor(CASE WHEN isodow(d) = 7 THEN 90 ELSE daily END * 0.5) AS BIGINT) ELSE CASE WHEN isodow(d) = 7 THEN 90 ELSE daily END END END AS budget FROM b LEFT JOIN tk USING (k, d))
  SELECT k, CAST(d AS VARCHAR) AS on_date, CAST(floor(free / 60) AS BIGINT) AS free, CAST(floor(least(free, greatest(0, budget * 60 - (k % 4) * 900)) / 60) AS BIGINT) AS capacity FROM fr""")
def free_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is free of study days, and what of it is planned for, on days around changes of the clock in three zones."""
    k = F.col("c_custkey")
    none, no_day = F.lit(None).cast("int"), F.lit(None).cast("date")
    window = lambda weekday, on_date, a, z: F.struct(weekday.alias("weekday"), on_date.alias("on_date"), a.cast("int").alias("from"), z.cast("int").alias("to"))
    zone = F.element_at(F.array(*map(F.lit, ("Europe/Berlin", "America/New_York", "Asia/Kolkata"))), (k % 3 + 1).cast("int"))
    configs = T.spread(T.read(spark, sf_dir, "customer").select("c_custkey")).select(  # a customer makes nine days of many windows
        k.alias("k"), zone.alias("zone"), (k % 5 * 60).cast("int").alias("boundary"), F.struct((1380 + k % 40 - k % 2 * 1300).cast("int").alias("from"), (400 + k % 100).cast("int").alias("to")).alias("sleep"),
        F.array(window((k % 7).cast("int"), no_day, F.lit(600), 600 + k % 300), window(none, no_day, 700 + k % 60, F.lit(800)), window(none, F.to_date(F.lit("2024-03-30")), F.lit(1300), 100 + k % 90)).alias("busy"),
        F.when(k % 4 > 0, F.date_add(F.to_date(F.lit("2024-03-31")), (k % 3).cast("int"))).alias("deadline"), F.when(k % 8 > 1, (60 + k % 900).cast("int")).alias("exam_time"), (30 + k % 200).cast("int").alias("exam_reserve"), (k % 6 > 2).alias("exam_day_enabled"),
        (120 + k % 600).cast("int").alias("daily_minutes"), F.create_map(F.lit(6), F.lit(90)).alias("weekday_minutes"), F.when(k % 5 == 0, F.create_map(F.to_date(F.lit("2024-04-01")), F.lit(45))).otherwise(F.create_map().cast("map<date,int>")).alias("date_minutes"),
        F.when(k % 3 == 0, F.array(F.to_date(F.lit("2024-03-11")))).otherwise(F.array().cast("array<date>")).alias("rest_dates"), F.lit(0.5).alias("final_day_ratio"), (k % 4 * 900).alias("used_seconds"), F.lit(None).cast("timestamp_ntz").alias("now"))
    days = configs.withColumn("on_date", F.explode(F.array(*(F.to_date(F.lit(d)) for d in _DAYS))))
    return P.free_minutes(days).select("k", F.col("on_date").cast("string").alias("on_date"), "free", "capacity")


@query(f"""WITH RECURSIVE {T.LINES}, s AS (SELECT doc_id, pos, len(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS n, pos // 6 AS block, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM lines WHERE length(line) % 5 > 0),
  f AS (SELECT doc_id, pos, rn, block, CAST(n AS BIGINT) AS used, CAST(1 AS BIGINT) AS run, CAST(0 AS BIGINT) AS part FROM s WHERE rn = 1
    UNION ALL SELECT s.doc_id, s.pos, s.rn, s.block, CASE WHEN s.block <> f.block OR (used > 0 AND used + n > 120) THEN n ELSE used + n END, CASE WHEN s.block <> f.block THEN run + 1 ELSE run END, CASE WHEN s.block <> f.block THEN 0 WHEN used > 0 AND used + n > 120 THEN part + 1 ELSE part END FROM f JOIN s ON s.doc_id = f.doc_id AND s.rn = f.rn + 1)
  SELECT doc_id, pos, run, part FROM f""")
def candidate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring lines of a block, in parts of at most 120 tokens; every fifth line belongs to somebody else."""
    rows = T.lines(spark, sf_dir).where("length(line) % 5 > 0").select("doc_id", "pos", F.floor(F.col("pos") / 6).alias("block"), X.token_count(F.col("line")).alias("n"))
    return P.runs_within(rows, "doc_id", "pos", "block", "n", 120)


@query()
def packet_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source as units of packets of at most 400 tokens, cut at sentences or, where these are too long, anywhere."""
    docs = T.spread(T.read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", (F.floor(F.col("doc_id") / 100)).cast("string")).alias("section"), "doc_id", "text"))
    return P.packets(docs, "section", "doc_id", "text", 400)


def _exam_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of exam lists (kind 0: numbered with parts, 1: marked, 2: tickets) for every ten customers' orders: key, kind, text."""
    item = F.struct("l_linenumber", F.col("l_partkey").alias("p"))
    items = T.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    orders = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.floor(F.col("o_custkey") / 10).alias("key"), F.lower("o_orderpriority").alias("priority"))
    # Orders are numbered within their text, and their lines are made in their row.
    n = F.row_number().over(Window.partitionBy("key").orderBy("l_orderkey")).cast("string")
    rows = items.join(orders, "l_orderkey").withColumn("n", n)

    def line(kind: int) -> Callable[[Column, Column], Column]:
        def said(x: Column, at: Column) -> Column:
            p, first, i = x["p"], at == 0, (at + 1).cast("string")
            about = F.concat(F.when(p % 9 == 0, F.lit("Задача: ")).otherwise(""), F.lit("Topic "), (p % 400).cast("string"), F.lit(" of "), F.col("priority"))
            if kind == 0:
                return F.when(first, F.concat("n", F.lit(". "), about)).when(p % 4 == 0, F.concat("n", F.lit("."), at.cast("string"), F.lit(" part "), p.cast("string"))).when(p % 4 == 1, F.lit("and what goes on.")).when(p % 4 == 2, F.lit("17")).otherwise(F.concat("n", F.lit("."), i, F.lit(") late part")))
            if kind == 1:
                return F.when(first, F.when(p % 5 == 0, F.lit("Задачи:")).otherwise(F.concat(F.lit("— "), about))).when(p % 3 == 0, F.concat(F.lit("* "), about)).otherwise(F.lit("goes on"))
            return F.when(first, F.concat(F.lit("Билет № "), "n", F.when(p % 2 == 0, F.lit(". Algebra")).otherwise(""))).when((at == 1) & (F.col("key") % 2 == 0), F.concat(F.lit("1) "), about)).otherwise(F.concat(i, F.lit(". "), about))

        return said

    of = [F.array_join(F.transform("items", line(kind)), "\n") for kind in range(3)]
    said = F.when(F.col("key") % 3 == 0, of[0]).when(F.col("key") % 3 == 1, of[1]).otherwise(of[2])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", said.alias("said")))), lambda x: x["said"]), "\n")
    return rows.groupBy("key").agg(text.alias("text")).select("key", (F.col("key") % 3).alias("kind"), "text")


@query()
def exam_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exam lists and programs of tickets: how many questions, tasks and parts each text has, what is wrong with it, and its tree
    as a digest."""
    texts = shared.cut(_exam_texts(spark, sf_dir))  # every list and report reads them
    found = [Q.exam_list(texts.where("kind < 2")), Q.tickets(texts.where("kind = 2"))]
    nodes, reports = found[0][0].unionByName(found[1][0]), found[0][1].unionByName(found[1][1])
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "parent", "type", "kind", "title", "position"))), lambda x: F.concat_ws("|", x["node"], F.coalesce(x["parent"], F.lit(-1)), x["type"], x["kind"], x["title"], x["position"])), "\n")
    return reports.join(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("nodes"), F.sha2(told, 256).alias("tree")), "key", "left")
