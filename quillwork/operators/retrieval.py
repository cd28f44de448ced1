"""Lexical and vector search, fusion, gates, context and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..sources import tables as T

#: BM25's constants (the usual ones), fusion's, and how far a result page reaches.
K1, B, RRF = 1.2, 0.75, 60


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, tf, length): counts within a document are made before anything is shuffled."""
    t = docs.select(F.col(id_col).alias("id"), X.tokens(F.col(text_col)).alias("ts"))
    counted = t.select("id", F.size("ts").alias("length"), F.explode("ts").alias("token"))
    return counted.groupBy("id", "length", "token").agg(F.count(F.lit(1)).alias("tf"))


def lexical(docs: DataFrame, id_col: str, text_col: str, terms: list[str], phrases: list[tuple[str, str]] = ()) -> DataFrame:
    """(id, score) of all documents by the terms and phrases (pairs of neighbouring words) that they have, by BM25; 0: none.

    A query has a few terms, so each document's counts are columns of its own row, found where its text is read, by replacing
    fixed strings; only the statistics (one row) are aggregated over all documents. Nothing is exploded. What
    has no term is filtered out after the top is taken: a filter before it would be pushed down to where Catalyst computes
    the counts again for it. A phrase's words must differ.
    """
    keys = [*terms, *(" ".join(p) for p in phrases)]
    counts = [X.spaced_length(F.col("s")).alias("length"), *(X.spaced_count(F.col("s"), k).alias(f"f{i}") for i, k in enumerate(keys))]
    tf = docs.select(F.col(id_col).alias("id"), X.spaced(F.col(text_col)).alias("s")).select("id", *counts)
    stats = tf.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(keys)))).withColumn("one", F.lit(1))
    hit = tf.withColumn("one", F.lit(1)).join(F.broadcast(stats), "one")

    def part(i: int) -> Column:
        f, d = F.col(f"f{i}"), F.col(f"d{i}")
        idf = F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))

    score = part(0)
    for i in range(1, len(keys)):
        score = score + part(i)
    return hit.select("id", score.alias("score"))


def nearest(vectors: DataFrame, query: list[float], id_col: str, vector_col: str) -> DataFrame:
    """(id, distance) by cosine distance to one vector, which is a literal in every task."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(F.col(id_col).alias("id"), A.cosine_distance(F.col(vector_col), q).alias("distance"))


def containing(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, query_col: str, string_col: str) -> DataFrame:
    """``docs`` with the rows of ``asked`` whose string they contain. A token inside a string, between other characters, is a
    token of each text that has the string, so texts meet strings by the longest such token of these; strings without one are
    held against all texts where these are read. Texts' identifiers and ``asked``'s are unique."""
    inner = F.filter(X.tokens(F.regexp_replace(F.lower(string_col), rf"^{X.TOKEN}|{X.TOKEN}$", "")), lambda t: F.length(t) > 1)
    words = F.transform(inner, lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))
    keyed = asked.withColumn("_word", F.array_max(words)["t"])
    met = docs.withColumn("_word", F.explode(F.array_distinct(X.tokens(F.col(text_col))))).join(T.bounded(keyed.where("_word IS NOT NULL")), "_word")
    rest = docs.join(T.bounded(keyed.where("_word IS NULL")), F.contains(text_col, string_col))
    return met.where(F.contains(text_col, string_col)).unionByName(rest).drop("_word")


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows in order, with their rank: Spark keeps k rows a task, and only those are numbered."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def fused(rankings: dict[str, DataFrame], k: int = RRF, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of (id, rank) tables of bounded size: id, score, signals (in the rankings' order)."""
    out = None
    for i, (name, df) in enumerate(rankings.items()):
        w = (weights or {}).get(name, 1.0)
        rows = df.select("id", (F.lit(w) / (k + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("i"), F.lit(name).alias("name")).alias("signal"), "rank")
        out = rows if out is None else out.unionByName(rows)
    g = out.groupBy("id").agg(F.aggregate(F.array_sort(F.collect_list("part")), F.lit(0.0), lambda s, x: s + x).alias("score"), F.array_sort(F.collect_list("signal")).alias("s"), F.min(F.struct("signal.i", "rank")).alias("first"))
    return g.select("id", "score", F.transform("s", lambda x: x["name"]).alias("signals"), "first")


def deduplicated(hits: DataFrame, hash_col: str, name_col: str, order: list[str]) -> DataFrame:
    """The first hit of each content by ``order``, with the names of the others in ``also_in``.

    An aggregate, not a window: of a content that very many hits share, each task sends one row.
    """
    rest = [c for c in hits.columns if c not in (*order, hash_col)]
    g = hits.groupBy(hash_col).agg(F.min(F.struct(*order, *rest)).alias("_f"), F.array_sort(F.collect_set(name_col)).alias("_names"))
    return g.select(hash_col, "_f.*", "_names").withColumn("also_in", F.array_remove("_names", F.col(name_col))).drop("_names")


def neighbours(rows: DataFrame, hits: DataFrame, key: str, pos: str, reach: int) -> DataFrame:
    """Rows within ``reach`` places of a hit of the same key, with the share of the hit's score that is theirs."""
    around = hits.withColumn(pos, F.explode(F.sequence(F.col(pos) - reach, F.col(pos) + reach))).select(key, pos, "score", (F.col(pos)).alias("_p"))
    own = hits.select(key, pos, F.lit(True).alias("hit"))
    best = around.groupBy(key, pos).agg(F.max("score").alias("score"))
    return rows.join(best, [key, pos]).join(own, [key, pos], "left").withColumn("score", F.when(F.col("hit"), F.col("score")).otherwise(F.col("score") * 0.9))


def within_budget(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Greedy: rows in order that still fit the budget, with the first in any case; one that doesn't fit is skipped."""
    kind = dict(rows.dtypes)[order]
    fits = lambda s, x: (s["used"] == 0) | (s["used"] + x["n"] <= budget)
    step = lambda s, x: F.struct(F.when(fits(s, x), s["used"] + x["n"]).otherwise(s["used"]).alias("used"), F.when(fits(s, x), F.concat(s["out"], F.array(x["o"]))).otherwise(s["out"]).alias("out"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("bigint").alias("n")))).alias("g"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<{kind}>").alias("out"))
    return listed.select(key, F.explode(F.aggregate("g", start, step)["out"]).alias(order))


def metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """recall, reciprocal rank and nDCG at ``k`` of each query; ``ranked`` has (query, id, rank), ``relevant`` (query, id)."""
    rel = relevant.distinct()
    hit = rel.join(ranked.where(F.col("rank") <= k).groupBy("query", "id").agg(F.min("rank").alias("rank")), ["query", "id"], "left")
    g = hit.groupBy("query").agg(F.count(F.lit(1)).alias("targets"), F.count("rank").alias("found"), F.min("rank").alias("first"),
                                 F.aggregate(F.array_sort(F.collect_list("rank")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("targets"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    return g.select("query", "targets", (F.col("found") / F.col("targets")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("dcg") / ideal).alias("ndcg"))


def hit_pages(hits: DataFrame, block: list[str], page: str, place: str, score: str, most: int) -> DataFrame:
    """``block`` columns, ``page``, hits, lines (``place`` of the hits, best first), score (the page's best): the ``most`` best
    blocks (by their best hit, then by name), in pages. A report's length is its limit."""
    best = hits.groupBy(*block).agg(F.max(score).alias("_top")).orderBy(F.desc("_top"), *block).limit(most).select(*block)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(place).alias("p"))))
    pages = hits.join(F.broadcast(best), block, "left_semi").groupBy(*block, page).agg(ranked.alias("_r"), F.max(score).alias("score"))
    return pages.select(*block, page, F.size("_r").cast("bigint").alias("hits"), F.transform("_r", lambda x: x["p"]).alias("lines"), "score")
