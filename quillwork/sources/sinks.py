"""Writers: indexes by partition, JSON lines with typed escapes, and their readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes ``df`` so that only the partitions it has rows for are replaced; each is written by few tasks."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def export_lines(df: DataFrame, path: str) -> None:
    """JSON lines; binary columns as {"$bytes": base64}."""
    out = [F.struct(F.base64(c).alias("$bytes")).alias(c) if isinstance(df.schema[c].dataType, T.BinaryType) else F.col(c) for c in df.columns]
    df.select(*out).write.mode("overwrite").json(path)


def import_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``export_lines`` wrote, by the schema that it had."""
    escaped = T.StructType([T.StructField("$bytes", T.StringType())])
    told = T.StructType([T.StructField(f.name, escaped if isinstance(f.dataType, T.BinaryType) else f.dataType) for f in schema])
    df = spark.read.schema(told).json(path)
    return df.select(*(F.unbase64(F.col(f"`{f.name}`.`$bytes`")).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name) for f in schema))


def remapped(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Foreign keys rewritten by ``mapping`` (old, new); those that aren't in it become null."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return df.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.col("_new")).drop("_old", "_new")


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 of a row as JSON with its columns in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def pruned(rows: DataFrame, root: str, keep: DataFrame) -> DataFrame:
    """Rows that belong to one of the kept roots."""
    return rows.join(keep.select(F.col(keep.columns[0]).alias(root)).distinct(), root, "left_semi")
