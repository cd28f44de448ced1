"""Queries of functions that no other query reaches: text forms, token places, overlaps, bits, addresses, pruned exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..functions import vectorised as V
from ..sources import sinks
from ..sources import tables as T
from .registry import query

_W = "[0-9a-zа-я]+"


@query("""SELECT conv_id, turn, role, trim(regexp_replace(replace(replace(lower(text), 'ß', 'ss'), '-', ' '), '\\s+', ' ', 'g')) AS form FROM conversations""")
def comparable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as they are compared: compatibility forms, no case, no dashes, single spaces."""
    return T.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", V.normalized(F.col("text")).alias("form"))


@query(f"""WITH c AS (SELECT conv_id, turn, role, text, regexp_extract_all(replace(lower(text), 'ё', 'е'), '{_W}') AS ts FROM conversations)
  SELECT conv_id, turn, role, len(ts) AS tokens, CASE WHEN len(ts) > 0 THEN length(regexp_extract(lower(text), '^[^0-9a-zа-яё]*')) END AS first, CASE WHEN len(ts) > 0 THEN length(regexp_replace(lower(text), '[^0-9a-zа-яё]*$', '')) END AS last FROM c""")
def token_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens messages have, where the first begins and the last ends."""
    c = T.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", V.token_positions(F.col("text")).alias("ts"))
    return c.select("conv_id", "turn", "role", F.size("ts").cast("bigint").alias("tokens"), F.try_element_at("ts", F.lit(1))["start"].cast("bigint").alias("first"), F.try_element_at("ts", F.lit(-1))["end"].cast("bigint").alias("last"))


@query(f"""WITH c AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2), t AS (SELECT conv_id, turn, regexp_extract_all(replace(lower(text), 'ё', 'е'), '{_W}') AS a FROM c), p AS (SELECT *, lag(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
  SELECT conv_id, turn, CAST(coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) AS BIGINT) AS shared, len(list_distinct(a)) AS words FROM p WHERE b IS NOT NULL""")
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a message has in common with the one before it, each as often as both have it."""
    c = T.read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    t = c.select("conv_id", "turn", X.tokens(F.col("text")).alias("a")).withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    return t.select("conv_id", "turn", A.multiset_overlap(F.col("a"), F.col("b")).cast("bigint").alias("shared"), F.size(F.array_distinct("a")).cast("bigint").alias("words"))


@query("""SELECT o_orderkey AS id, bit_count(xor(o_orderkey * 2654435761, o_custkey * 40503)) AS distance, bit_count(xor(o_orderkey * 2654435761, o_custkey * 40503)) <= 8 AS alike FROM orders""")
def hash_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differing bits of 64-bit image hashes (made of numbers), and whether they are few."""
    d = A.hamming(F.col("o_orderkey").cast("bigint") * 2654435761, F.col("o_custkey").cast("bigint") * 40503)
    return T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), d.alias("distance"), (d <= 8).alias("alike"))


@query("""WITH v AS (SELECT page_id, left(sha1(CAST(page_id AS VARCHAR)), 11 - CAST(page_id % 5 = 4 AS INT)) AS v FROM pages)
  SELECT page_id, CASE WHEN page_id % 5 < 4 THEN v END AS video FROM v""")
def video_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers out of videos' addresses of four forms; one form in five is none."""
    k = F.col("page_id") % 5
    v = F.substring(F.sha1(F.col("page_id").cast("string").cast("binary")), 1, 11)
    url = F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?t=3&v="), v, F.lit("&x=1"))).when(k == 1, F.concat(F.lit("https://youtu.be/"), v)).when(k == 2, F.concat(F.lit("https://www.youtube.com/embed/"), v, F.lit("?a=b"))).when(k == 3, F.concat(F.lit("https://m.youtube.com/shorts/"), v)).otherwise(F.concat(F.lit("https://youtu.be/"), F.substring(v, 1, 10)))
    return T.read(spark, sf_dir, "pages").select("page_id", X.video_id(url).alias("video"))


@query("""SELECT l_orderkey, count(*) AS items FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) GROUP BY 1""")
def export_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export of one nation's customers keeps of items: other roots' rows and their dependents go."""
    customers = T.read(spark, sf_dir, "customer").where("c_nationkey = 3").select("c_custkey")
    orders = sinks.pruned(T.read(spark, sf_dir, "orders"), "o_custkey", customers)
    return sinks.pruned(T.read(spark, sf_dir, "lineitem"), "l_orderkey", orders.select("o_orderkey")).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"))
