"""Queries that run streams to the end of what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import shared, sinks
from ..sources import tables as T
from ..streaming import twins as S
from .learner import sm2_replay  # noqa: F401  its SQL is the stream's too
from .registry import SQL, query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.source(spark, sf_dir, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT CAST(floor((epoch_us(ts) / 1000000 - 14400) / 86400) AS BIGINT) AS day, event_type AS kind, count(*) AS parts, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS seconds FROM events GROUP BY 1, 2""")
def stream_day_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("ts", F.col("event_type").alias("kind"), F.floor("value").alias("seconds"))
    out = S.drained(S.day_totals(e, "ts", ["kind"], "4 hours", "30 days"), ["day_start", "kind"])
    local = F.unix_timestamp("day_start")
    return out.select(F.floor((local - 4 * 3600) / 86400).alias("day"), "kind", "parts", "seconds")


@query("""WITH p AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), s AS (SELECT *, sum(CASE WHEN b IS NULL OR epoch_us(ts) - epoch_us(b) > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM p)
  SELECT user_id, CAST(floor(epoch_us(min(ts)) / 1000000) AS BIGINT) AS start, count(*) AS parts FROM s GROUP BY user_id, n""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.drained(S.sessions(_events(spark, sf_dir), "ts", "user_id", "2 hours", "1 day"), ["user_id", "start"], "complete")
    return out.select("user_id", F.unix_timestamp("start").alias("start"), "parts")


@query("SELECT event_id, event_type AS kind FROM events")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, out of a stream that has each twice."""
    e = _events(spark, sf_dir)
    twice = e.unionAll(_events(spark, sf_dir))
    return S.drained(S.once(twice, "event_id", "ts", "30 days"), ["event_id"], "append").select("event_id", F.col("event_type").alias("kind"))


@query("""WITH b AS (SELECT user_id, min(ts) + INTERVAL 2 DAY AS begin FROM events WHERE user_id % 3 > 0 GROUP BY 1) SELECT event_id FROM events LEFT JOIN b USING (user_id)
  WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 3 DAY + INTERVAL 60 SECOND AND (begin IS NULL OR ts >= begin)""")
def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are neither more than a minute after a given time nor before their reader's day began."""
    static = T.read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    begins = static.where("user_id % 3 > 0").groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 2 DAYS")).alias("begin"))
    now = static.agg((F.max("ts") - F.expr("INTERVAL 3 DAYS")).cast("string").alias("now")).head()["now"]
    return S.drained(S.gated(_events(spark, sf_dir), begins, "user_id", "ts", now), ["event_id"], "append").select("event_id")


@query("SELECT * FROM (SELECT user_id, event_id AS last_id, event_type AS kind FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)")
def stream_last_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last mark of each reader: an aggregate that every batch updates."""
    e = _events(spark, sf_dir).groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("m"))
    return S.drained(e.select("user_id", F.col("m.event_id").alias("last_id"), F.col("m.event_type").alias("kind")), ["user_id"])


@query(SQL["sm2_replay"])
def stream_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory model as a stream; its rows are those of sm2_replay."""
    kind = F.col("event_type")
    q = F.when(kind == "purchase", 5).when(kind == "click", 3).when(kind == "error", 1)
    raw = S.source(spark, sf_dir, "events.parquet")
    e = raw.select(F.col("user_id").alias("session"), F.get_json_object("props", "$.k").cast("int").alias("node"), F.floor(T.seconds("ts") / 86400).cast("bigint").alias("day"), F.col("event_id").alias("id"), q.alias("quality"))
    return S.drained(S.memory(e.where("quality IS NOT NULL"), ["session", "node"]), ["session", "node"])


@query("""SELECT lang, count(*) AS n, CAST(sum(CASE WHEN lang = 'fr' THEN length(upper(text)) ELSE length(text) END) AS BIGINT) AS chars FROM documents GROUP BY lang""")
def incremental_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index by language is written, one language is written anew, and the others stay as they were."""
    path = shared.folder(spark, "index")
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    sinks.replace_partitions(docs, path, "lang")
    sinks.replace_partitions(docs.where("lang = 'fr'").withColumn("text", X.capitals(F.col("text"))), path, "lang")
    return spark.read.parquet(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT conv_id + 1000 AS conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id""")
def export_import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations out to JSON lines (their texts as bytes) and in again, under new keys."""
    path = shared.folder(spark, "lines")
    c = T.read(spark, sf_dir, "conversations").withColumn("text", F.encode("text", "UTF-8"))
    sinks.export_lines(c, path)
    back = sinks.import_lines(spark, path, c.schema)
    mapping = c.select(F.col("conv_id").alias("old"), (F.col("conv_id") + 1000).alias("new")).distinct()
    return sinks.remapped(back, "conv_id", mapping).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length(F.decode("text", "UTF-8"))).alias("chars"))
