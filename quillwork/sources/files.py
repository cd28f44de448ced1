"""Files as rows: their bytes, sizes and digests; texts as wholes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, suffixes: str = "*", most: int | None = None) -> DataFrame:
    """(path, size, sha256, content) of files with the suffixes (a glob), of at most ``most`` bytes; once for each content."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", suffixes).option("recursiveFileLookup", "true").load(path)
    df = df.where(F.col("length") <= most) if most else df
    rows = df.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")
    # Only digests and paths are grouped; contents are joined back to the paths that stay.
    first = rows.groupBy("sha256").agg(F.min("path").alias("path")).select("path")
    return rows.join(first, "path", "left_semi").select("path", "size", "sha256", "content")


def unknown(found: DataFrame, known: DataFrame) -> DataFrame:
    """Those whose content isn't known yet (``known`` has sha256)."""
    return found.join(known.select("sha256"), "sha256", "left_anti")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files as text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
