"""An inverted index kept as a table: which texts have a term, how often and where.

Postings lie in folders by slice (of the texts, by their identifier's hash) and bucket (of the terms, by theirs), sorted by
term. A question reads the folders of its own terms' buckets and, within the files, the row groups that may have the terms;
texts aren't read. A slice is what is replaced when its texts change. Beside them are sizes (by slice, texts and tokens) and a
sorted vocabulary (by slice).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectorised as V
from ..sources import shared
from .retrieval import B, K1

#: Folders of terms, and of texts. A bucket of a slice is a file for each share of its texts at most (a power of two of shares),
#: so a cluster with very large tables wants more of all three.
BUCKETS, SLICES, SHARES = 32, 4, 8


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    slices: int = SLICES

    def slice_of(self, id_: Column) -> Column:
        return (F.crc32(F.to_json(F.struct(id_.alias("id")))) % self.slices).cast("int")

    def _rows(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings, and sizes by slice, of (id, text). A text is one row, so its postings are made where it is read: what is
        shuffled are postings, once, on their way to their files."""
        t = texts.select(self.slice_of(F.col("id")).alias("slice"), "id", X.tokens(F.coalesce("text", F.lit(""))).alias("ts"))
        sizes = t.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ts")).alias("total"))
        found = t.select("slice", "id", F.size("ts").alias("length"), F.inline(V.term_places(F.col("ts"))))
        return found.withColumn("bucket", (F.crc32("term") % self.buckets).cast("int")), sizes

    def replace(self, texts: DataFrame) -> None:
        """Writes the slices of (id, text) anew; ``texts`` has all texts of the slices that it touches, and other slices stay.
        Identifiers are unique; null texts have no terms, but count as texts. Sizes are written last: where they are, the
        rest of their slice is."""
        postings, sizes = self._rows(texts)
        sizes = self.spark.createDataFrame(sizes.collect(), sizes.schema)  # a row for each slice
        # A row without a term in every bucket, so that buckets which have no terms any more are replaced as well.
        every = sizes.select("slice", F.explode(F.sequence(F.lit(0), F.lit(self.buckets - 1))).alias("bucket"))
        rows = postings.unionByName(every, allowMissingColumns=True)
        write = lambda df, name, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{name}")
        write(rows.repartition("slice", "bucket", F.crc32(F.to_json(F.struct("id"))).bitwiseAND(SHARES - 1)).sortWithinPartitions("slice", "bucket", "term"), "postings", "slice", "bucket")
        written = self.spark.read.parquet(f"{self.path}/postings").join(F.broadcast(sizes.select("slice")), "slice", "left_semi")
        vocabulary = written.groupBy("slice", "term").agg(F.count(F.lit(1)).alias("texts"))
        write(vocabulary.repartitionByRange("slice", "term").sortWithinPartitions("slice", "term"), "vocabulary", "slice")
        write(sizes.coalesce(1), "sizes", "slice")

    def postings(self, terms: list[str]) -> DataFrame:
        """id, term, tf, length, places of the terms' postings."""
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        return self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).select("id", "term", "tf", "length", "places")

    def with_prefix(self, prefix: str) -> DataFrame:
        """term, bucket: the terms that begin with ``prefix``; the vocabulary is sorted, so row groups without any are skipped."""
        rows = self.spark.read.parquet(f"{self.path}/vocabulary").where(F.col("term").startswith(prefix))
        return rows.select("term", (F.crc32("term") % self.buckets).cast("int").alias("bucket")).distinct()

    def prefixed(self, prefix: str) -> DataFrame:
        """id, tf: texts with terms that begin with ``prefix``; of the postings, only the buckets of such terms are read."""
        rows = self.spark.read.parquet(f"{self.path}/postings").select("bucket", "term", "id", "tf")
        return rows.join(self.with_prefix(prefix), ["bucket", "term"], "left_semi").groupBy("id").agg(F.sum("tf").alias("tf"))

    def scored(self, terms: list[str], phrases: list[tuple[str, str]] = ()) -> DataFrame:
        """id, score: BM25 of all texts that have a term or a phrase (two words next to each other)."""
        asked = list(dict.fromkeys([*terms, *(w for p in phrases for w in p)]))
        rows = self.postings(asked)
        paired = list(dict.fromkeys(w for p in phrases for w in p))
        tf = rows.groupBy("id", "length").agg(*(F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"t{i}") for i, t in enumerate(terms)), *(F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"p{i}") for i, w in enumerate(paired)))
        at = lambda w: F.col(f"p{paired.index(w)}")
        together = lambda a, b: F.size(F.array_intersect(F.transform(at(a), lambda x: x + 1), at(b)))
        counts = [F.coalesce(f"t{i}", F.lit(0)).alias(f"f{i}") for i in range(len(terms))]
        counts += [F.greatest(F.coalesce(together(a, b), F.lit(0)), F.lit(0)).alias(f"f{len(terms) + i}") for i, (a, b) in enumerate(phrases)]
        n = len(counts)
        tf = tf.select("id", "length", *counts)
        of = tf.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(n))).withColumn("one", F.lit(1))
        sizes = self.spark.read.parquet(f"{self.path}/sizes").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean")).withColumn("one", F.lit(1))
        # Two tables of one row each.
        hit = tf.withColumn("one", F.lit(1)).join(F.broadcast(of.join(F.broadcast(sizes), "one")), "one")

        def part(i: int) -> Column:
            f, d = F.col(f"f{i}"), F.col(f"d{i}")
            return F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))

        score = part(0)
        for i in range(1, n):
            score = score + part(i)
        return hit.select("id", score.alias("score")).where("score > 0")


def kept(spark: SparkSession, source: DataFrame, texts: DataFrame, name: str) -> Index:
    """The index of ``texts`` (id, text), which are made from the files of ``source``: the one in the shared folder if these files
    are as they were (paths, sizes and times), else a new one."""
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()[0]
    index = Index(spark, f"{shared.root(spark)}/quillwork/index-{name}-{state}-{BUCKETS}-{SLICES}")
    try:
        spark.read.parquet(f"{index.path}/sizes")
    except AnalysisException:
        index.replace(texts)
    return index
