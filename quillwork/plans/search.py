"""Search queries: lexical, vector, hybrid, context, metrics; texts' tokens, hashes and noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..functions import vectorised as V
from ..operators import postings as P
from ..operators import retrieval as Q
from ..operators import structure as S
from ..sources import tables as T
from .registry import query

#: The queries that the reports ask.
TERMS = ["estion", "ndtion", "tionen"]
PHRASE = ("of", "the")
_T = "[0-9a-zA-Zа-яА-ЯёЁ]+"
_TOK = f"tok AS (SELECT doc_id AS id, regexp_extract_all(translate(lower(text), 'ё', 'е'), '{_T}') AS ts FROM documents)"


def _bm25(terms: list[str], phrases: list[tuple[str, str]] = (), tok: str = _TOK) -> str:
    keys = [*terms, *(" ".join(p) for p in phrases)]
    one = lambda k: f"len(list_filter(ts, lambda t: t = '{k}'))" if " " not in k else f"len(list_filter(list_zip(ts[:-2], ts[2:]), lambda z: z[1] = '{k.split()[0]}' AND z[2] = '{k.split()[1]}'))"
    tf = ", ".join(f"{one(k)} AS f{i}" for i, k in enumerate(keys))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(keys)))
    part = lambda i: f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))"
    return f"""{tok}, tf AS (SELECT id, len(ts) AS length, {tf} FROM tok), st AS (SELECT count(*) AS n, avg(length) AS mean, {df} FROM tf),
  lex AS (SELECT id, {' + '.join(part(i) for i in range(len(keys)))} AS score FROM tf, st WHERE {' OR '.join(f'f{i} > 0' for i in range(len(keys)))})"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.spread(T.read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def document_index(spark: SparkSession, sf_dir: str) -> P.Index:
    """The postings of documents, built where they aren't there yet."""
    docs = T.read(spark, sf_dir, "documents")
    return P.kept(spark, docs, T.spread(docs.select(F.col("doc_id").alias("id"), "text")), "documents")


#: Lines of a page.
PAGE = 40


def _line_index(spark: SparkSession, sf_dir: str) -> P.Index:
    """The postings of lines, whose identifiers are document, block, page and line."""
    heading = (F.length("line") < 60) & ~F.col("line").rlike("[.!?,]$")
    lines = S.blocks(T.lines(spark, sf_dir), "doc_id", "pos", heading)
    id_ = F.struct("doc_id", "block", F.floor(F.col("pos") / PAGE).cast("int").alias("page"), "pos").alias("id")
    return P.kept(spark, T.read(spark, sf_dir, "documents"), lines.select(id_, F.col("line").alias("text")), "lines")


@query(f"WITH {_bm25(TERMS)} SELECT id AS doc_id, round(score, 6) AS score FROM lex ORDER BY round(lex.score, 9) DESC, id LIMIT 10")
def lex_bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents, from the buckets of the question's terms."""
    hits = document_index(spark, sf_dir).scored(TERMS)
    return hits.orderBy(F.desc(F.round("score", 9)), "id").limit(10).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_bm25(['tion'], [PHRASE])} SELECT id AS doc_id, round(score, 6) AS score FROM lex ORDER BY round(lex.score, 9) DESC, id LIMIT 10")
def lex_bigram_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term and a phrase as one more branch."""
    hits = document_index(spark, sf_dir).scored(["tion"], [PHRASE])
    return hits.orderBy(F.desc(F.round("score", 9)), "id").limit(10).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


_LINE_TOK = f"""{T.LINES}, blocks AS (SELECT *, CAST(sum(CASE WHEN length(line) < 60 AND NOT regexp_matches(line, '[.!?,]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS block FROM lines),
  tok AS (SELECT {{'d': doc_id, 'b': block, 'p': pos}} AS id, regexp_extract_all(translate(lower(line), 'ё', 'е'), '{_T}') AS ts FROM blocks)"""


@query(f"""WITH {_bm25(TERMS, tok=_LINE_TOK)}, r AS (SELECT id.d AS doc_id, id.b AS block, id.p AS pos, round(score, 9) AS s FROM lex)
  SELECT doc_id, block, count(*) AS hits, round(max(s), 6) AS score, arg_min(pos, struct_pack(a := -s, b := pos)) AS best_line FROM r GROUP BY 1, 2 ORDER BY max(s) DESC, doc_id, block LIMIT 10""")
def lex_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best blocks by their best line, with that line's place and how many of their lines have a term."""
    s = _line_index(spark, sf_dir).scored(TERMS).select("id.*", F.round("score", 9).alias("s"))
    g = s.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("hits"), F.max("s").alias("s"), F.min_by("pos", F.struct(-F.col("s"), "pos")).alias("best_line"))
    return g.orderBy(F.desc("s"), "doc_id", "block").limit(10).select("doc_id", "block", "hits", F.round("s", 6).alias("score"), "best_line")


@query(f"""WITH {_bm25(TERMS, tok=_LINE_TOK)}, r AS (SELECT id.d AS doc_id, id.b AS block, id.p // {PAGE} AS page, id.p AS pos, round(score, 9) AS s FROM lex), g AS (SELECT doc_id, block, max(s) AS top FROM r GROUP BY 1, 2 ORDER BY top DESC, doc_id, block LIMIT 10)
  SELECT doc_id, block, CAST(page AS INT) AS page, count(*) AS hits, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY s DESC, pos) AS lines, arg_min(pos, struct_pack(a := -s, b := pos)) AS best_line, round(max(s), 6) AS score FROM r JOIN g USING (doc_id, block) GROUP BY 1, 2, 3""")
def lex_hit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best blocks by page: the lines with a term, best first, and the best one of each page."""
    s = _line_index(spark, sf_dir).scored(TERMS).select("id.*", F.round("score", 9).alias("s"))
    return Q.hit_pages(s, ["doc_id", "block"], "page", "pos", "s", 10).select("doc_id", "block", "page", "hits", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"), F.element_at("lines", 1).alias("best_line"), F.round("score", 6).alias("score"))


@query(f"WITH {_TOK} SELECT id AS doc_id, len(list_filter(ts, lambda t: starts_with(t, 'entio'))) AS matches FROM tok WHERE len(list_filter(ts, lambda t: starts_with(t, 'entio'))) > 0")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with terms that begin with a prefix: the vocabulary names the terms, their buckets have the documents."""
    return document_index(spark, sf_dir).prefixed("entio").select(F.col("id").alias("doc_id"), F.col("tf").alias("matches"))


@query(f"""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{_T}')) AS ts FROM benchmark), t AS (SELECT item_id, unnest(ts) AS term FROM q),
  {_TOK}, v AS (SELECT DISTINCT unnest(ts) AS term FROM tok) SELECT item_id, count(*) AS terms, count(*) FILTER (v.term IS NULL) AS missing FROM t LEFT JOIN v USING (term) GROUP BY item_id""")
def missing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each question's terms no document has."""
    q = T.read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    known = _docs(spark, sf_dir).select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")).join(T.bounded(q.select("term").distinct()), "term", "left_semi").distinct().withColumn("known", F.lit(True))
    return q.join(known, "term", "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("terms"), F.count_if(F.col("known").isNull()).alias("missing"))


_VEC = "SELECT embedding AS q FROM embeddings WHERE vec_id = 0"
_KNN = f"knn AS (SELECT vec_id AS id, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(q AS DOUBLE[]) FROM ({_VEC}))) AS distance FROM embeddings WHERE vec_id <> 0)"


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "embeddings")
    first = e.where("vec_id = 0").select("embedding").head()  # the question's vector: one row
    return Q.nearest(e.where("vec_id <> 0"), list(first["embedding"]) if first else [], "vec_id", "embedding")


@query(f"WITH {_KNN} SELECT id AS vec_id, round(distance, 6) AS distance FROM knn ORDER BY knn.distance, id LIMIT 10")
def vector_knn_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir).orderBy("distance", "id").limit(10).select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query("SELECT label, count(*) AS n, count(*) FILTER (len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) AS valid FROM embeddings GROUP BY label")
def vector_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(A.valid_vector(F.col("embedding"), 64)).alias("valid"))


_RRF = f"""WITH {_bm25(TERMS)}, {_KNN}, a AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM lex ORDER BY rank LIMIT 50), b AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS rank FROM knn ORDER BY rank LIMIT 50),
  f AS (SELECT id, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score, concat_ws(',', CASE WHEN a.rank IS NOT NULL THEN 'lexical' END, CASE WHEN b.rank IS NOT NULL THEN 'semantic' END) AS signals,
    CASE WHEN a.rank IS NOT NULL THEN a.rank ELSE 1000 + b.rank END AS first FROM a FULL JOIN b USING (id))"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = Q.top(document_index(spark, sf_dir).scored(TERMS), [F.desc(F.round("score", 9)), F.col("id")], 50)
    sem = Q.top(_knn(spark, sf_dir), [F.col("distance"), F.col("id")], 50)
    return Q.fused({"lexical": lex, "semantic": sem})


@query(f"{_RRF} SELECT id, round(score, 9) AS score, signals FROM f ORDER BY f.score DESC, first LIMIT 20")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and vectors share identifiers here; ties keep the first ranking's order."""
    return _fused(spark, sf_dir).orderBy(F.desc("score"), "first").limit(20).select("id", F.round("score", 9).alias("score"), F.array_join("signals", ",").alias("signals"))


@query(f"""{_RRF}, w AS (SELECT f.*, distance FROM f LEFT JOIN knn USING (id)) SELECT id, round(score, 9) AS score, coalesce(1 - distance >= 0.2, false) OR signals = 'lexical,semantic' AS strong FROM w ORDER BY w.score DESC, first LIMIT 20""")
def hybrid_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which hits pass the relevance gate: near enough, or found by both signals."""
    w = _fused(spark, sf_dir).join(_knn(spark, sf_dir), "id", "left")
    strong = F.coalesce(1 - F.col("distance") >= 0.2, F.lit(False)) | (F.size("signals") == 2)
    return w.orderBy(F.desc("score"), "first").limit(20).select("id", F.round("score", 9).alias("score"), strong.alias("strong"))


@query(f"""WITH {_TOK}, r AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY c DESC, id) AS rank FROM (SELECT q, id, len(list_filter(ts, lambda t: t = q)) AS c FROM tok, (SELECT unnest(['estion', 'ndtion', 'tionen']) AS q)) WHERE c > 0 QUALIFY rank <= 30)
  SELECT id, round(list_sum(list_sort(list(1.0::DOUBLE / (60 + rank)))), 9) AS score, count(*) AS queries FROM r GROUP BY id ORDER BY list_sum(list_sort(list(1.0::DOUBLE / (60 + rank)))) DESC, id LIMIT 20""")
def fuse_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of several questions fused."""
    ts = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), X.tokens(F.col("text")).alias("ts"))

    def ranking(q: str) -> DataFrame:
        c = ts.select("id", F.size(F.filter("ts", lambda t: t == q)).alias("c")).where("c > 0")
        return Q.top(c, [F.desc("c"), F.col("id")], 30)

    f = Q.fused({q: ranking(q) for q in TERMS})
    return f.orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 9).alias("score"), F.size("signals").cast("bigint").alias("queries"))


_SQUEEZED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"""WITH h AS (SELECT doc_id, source, sha256({_SQUEEZED}) AS h FROM documents),
  g AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS rn, list_sort(list_distinct(list(source) OVER (PARTITION BY h))) AS names FROM h)
  SELECT doc_id, array_to_string(list_filter(names, lambda x: x <> source), ',') AS also_in FROM g WHERE rn = 1""")
def hit_dedup_also_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _docs(spark, sf_dir).select("doc_id", "source", X.content_hash(F.col("text")).alias("h"))
    return Q.deduplicated(hits, "h", "source", ["doc_id"]).select("doc_id", F.array_join("also_in", ",").alias("also_in"))


@query(f"SELECT count(*) AS documents, count(DISTINCT {_SQUEEZED}) AS distinct_texts, count(*) - count(DISTINCT {_SQUEEZED}) AS copies FROM documents")
def content_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _docs(spark, sf_dir).select(X.content_hash(F.col("text")).alias("h"))
    n, d = F.count(F.lit(1)), F.countDistinct("h")
    return h.agg(n.alias("documents"), d.alias("distinct_texts"), (n - d).alias("copies"))


@query(f"""WITH {T.LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord FROM lines), h AS (SELECT doc_id, ord, 1.0::DOUBLE AS score FROM n WHERE contains(line, 'estion')),
  a AS (SELECT doc_id, ord + d AS ord, max(score) AS score FROM h, (SELECT unnest([-1, 0, 1]) AS d) GROUP BY 1, 2)
  SELECT n.doc_id, n.pos, CASE WHEN h.ord IS NOT NULL THEN a.score ELSE round(a.score * 0.9, 6) END AS score FROM n JOIN a USING (doc_id, ord) LEFT JOIN h ON h.doc_id = n.doc_id AND h.ord = n.ord""")
def context_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a term, and the lines before and after them in their documents."""
    n = T.lines(spark, sf_dir).withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    hits = n.where(F.col("line").contains("estion")).select("doc_id", "ord", F.lit(1.0).alias("score"))
    return Q.neighbours(n.drop("score"), hits, "doc_id", "ord", 1).select("doc_id", "pos", F.round("score", 6).alias("score"))


_SIZES = f"{T.LINES}, s AS (SELECT doc_id, pos, len(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS n FROM lines)"


@query(f"""WITH RECURSIVE {_SIZES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM s),
  g AS (SELECT doc_id, pos, rn, CAST(n AS BIGINT) AS used, true AS taken FROM o WHERE rn = 1
    UNION ALL SELECT o.doc_id, o.pos, o.rn, CASE WHEN used = 0 OR used + n <= 60 THEN used + n ELSE used END, used = 0 OR used + n <= 60 FROM g JOIN o ON o.doc_id = g.doc_id AND o.rn = g.rn + 1)
  SELECT doc_id, pos FROM g WHERE taken""")
def context_budget_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that a budget of 60 tokens takes."""
    rows = T.lines(spark, sf_dir).withColumn("n", X.token_count(F.col("line")))
    return Q.within_budget(rows, "doc_id", "pos", "n", 60)


@query(f"""WITH {_SIZES}, c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM s) SELECT doc_id, pos, CAST(least(n, 100 - (upto - n)) AS BIGINT) AS taken FROM c WHERE upto - n < 100""")
def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from the first on until 100 tokens are taken; the last one is cut."""
    rows = T.lines(spark, sf_dir).withColumn("n", X.token_count(F.col("line")))
    c = rows.withColumn("before", F.sum("n").over(Window.partitionBy("doc_id").orderBy("pos")) - F.col("n")).where("before < 100")
    return c.select("doc_id", "pos", F.least(F.col("n"), 100 - F.col("before")).cast("bigint").alias("taken"))


@query("""WITH f AS (SELECT item_id AS query, trim(split_part(text, chr(10), 1)) AS k FROM benchmark), rel AS (SELECT query, doc_id AS id FROM f JOIN documents ON contains(text, k)),
  r AS (SELECT query, doc_id AS id, row_number() OVER (PARTITION BY query ORDER BY doc_id) AS rank FROM f JOIN documents ON contains(text, left(k, 20)) QUALIFY rank <= 10),
  h AS (SELECT rel.query, rel.id, r.rank FROM rel LEFT JOIN r ON r.query = rel.query AND r.id = rel.id)
  SELECT query, count(*) AS targets, round(count(rank) / CAST(count(*) AS DOUBLE), 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS mrr,
    round(coalesce(sum(1 / log2(rank + 1.0::DOUBLE)), 0) / list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))), 6) AS ndcg FROM h GROUP BY query""")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions are benchmark passages (their first lines); relevant are the documents that have them; the ranking looks for
    their first twenty characters.

    The questions are few (a stated set); a document is held against those of which it has the longest inner word.
    """
    q = T.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.trim(F.split_part("text", F.lit("\n"), F.lit(1))).alias("k"))
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    both = Q.containing(docs, q.withColumn("k20", F.substring("k", 1, 20)), "id", "text", "query", "k20").select("query", "id", F.contains("text", F.col("k")).alias("whole"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("id")))
    m = Q.metrics(ranked.select("query", "id", "rank"), both.where("whole").select("query", "id"))
    return m.select("query", "targets", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")))


@query("SELECT lang, CAST(sum(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'))) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def token_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("lang").agg(F.sum(X.token_count(F.col("text"))).alias("tokens"))


@query(f"WITH {T.LINES} SELECT sha256(lower(trim(line))) AS line_sha, count(DISTINCT doc_id) AS docs FROM lines WHERE length(trim(line)) <= 120 GROUP BY lower(trim(line)) HAVING count(DISTINCT doc_id) >= 4")
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines that four documents or more have; the line is grouped by its digest."""
    rows = T.lines(spark, sf_dir).where(F.length(F.trim("line")) <= 120).select("doc_id", F.sha2(F.lower(F.trim("line")), 256).alias("line_sha")).distinct()
    return rows.groupBy("line_sha").agg(F.count(F.lit(1)).alias("docs")).where("docs >= 4")


@query("""WITH q AS (SELECT doc_id, nullif(length(regexp_replace(text, '\\s', '', 'g')), 0) AS n, length(regexp_replace(text, '[^\\p{L}\\p{N}.,;:!?()"''-]', '', 'g')) AS good, length(regexp_replace(text, '[^\\x{FFFD}ÃÂ\\x{0080}-\\x{009F}]', '', 'g')) AS bad FROM documents)
  SELECT doc_id, round(good / CAST(n AS DOUBLE), 6) AS plausible, round(bad / CAST(n AS DOUBLE), 6) AS broken, CASE WHEN coalesce(n, 0) < 20 THEN 'blank' WHEN bad / CAST(n AS DOUBLE) > 0.02 THEN 'broken' WHEN good / CAST(n AS DOUBLE) < 0.9 THEN 'partial' ELSE 'text' END AS route FROM q""")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of plausible and broken characters, and the route that a text layer takes by them."""
    good, bad = X.quality(F.col("text"))
    n = X.matched(F.col("text"), r"\S+")
    q = _docs(spark, sf_dir).select("doc_id", good.alias("g"), bad.alias("b"), n.alias("n"))
    route = F.when(F.coalesce("n", F.lit(0)) < 20, "blank").when(F.col("b") > 0.02, "broken").when(F.col("g") < 0.9, "partial").otherwise("text")
    return q.select("doc_id", F.round("g", 6).alias("plausible"), F.round("b", 6).alias("broken"), route.alias("route"))


@query(f"""WITH {T.LINES} SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(line, '^\\s*[-–—]?\\s*(?:\\d{{1,4}}|[ivxlcdmIVXLCDM]{{1,8}})\\s*[-–—]?\\s*$') OR regexp_matches(line, '(?:\\.\\s?){{3,}}\\s*\\d{{1,4}}\\s*$') OR length(trim(line)) < 3) AS noise FROM lines GROUP BY doc_id""")
def line_noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    noise = line.rlike(X.PAGE_NUMBER) | line.rlike(X.CONTENTS_LINE) | (F.length(F.trim(line)) < 3)
    return T.lines(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(noise).alias("noise"))


@query("""SELECT page_id, regexp_matches(lower(url), '^https?://[^/?#:@]+(:\\d+)?([/?#]|$)') AND NOT regexp_matches(lower(regexp_extract(url, '^https?://([^/?#:@]+)', 1)), '^(127\\.|10\\.|192\\.168\\.|169\\.254\\.|172\\.(1[6-9]|2\\d|3[01])\\.|0\\.|localhost$)|\\.local$') AND contains(regexp_extract(url, '^https?://([^/?#:@]+)', 1), '.') AS public,
  regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^(www|m)\\.', '') || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1), '/+$', '') AS normalized FROM pages""")
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's address is public, and its form for comparison."""
    return T.read(spark, sf_dir, "pages").select("page_id", X.public_url(F.col("url")).alias("public"), X.normalized_url(F.col("url")).alias("normalized"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2")
def search_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows out of JSON."""
    rows = T.read(spark, sf_dir, "events").select(F.from_json("props", "k int").alias("p"), "event_type", "value").where("p.k IS NOT NULL")
    return rows.groupBy("p.k", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


@query(f"""WITH {_TOK}, asked AS (SELECT doc_id AS id, regexp_extract_all(replace(lower(split_part(text, '.', 1)), 'ё', 'е'), '[0-9a-zA-Zа-яА-ЯёЁ]+') AS q FROM documents), w AS (SELECT id, unnest(ts) AS term FROM tok), c AS (SELECT id, term, count(*) AS n FROM w JOIN asked USING (id) WHERE length(term) > 3 AND NOT list_contains(q, term) GROUP BY 1, 2)
  SELECT id AS doc_id, term, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, term) AS place FROM c QUALIFY place <= 12""")
def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve most frequent longer terms of each document, without those of its question (its first sentence). A document
    is one row, so its terms are counted where it is read."""
    docs = _docs(spark, sf_dir).select("doc_id", V.frequent_terms(F.col("text"), F.split_part("text", F.lit("."), F.lit(1)), 4, 12).alias("terms"))
    return docs.select("doc_id", F.posexplode("terms").alias("p", "t")).select("doc_id", "t.term", "t.n", (F.col("p") + 1).cast("bigint").alias("place"))


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) SELECT doc_id, source, rn FROM r WHERE rn <= 3""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of each source; ordering by rn first deals them out in turn."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return _docs(spark, sf_dir).select("doc_id", "source", F.row_number().over(w).cast("bigint").alias("rn")).where("rn <= 3")
