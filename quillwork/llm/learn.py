"""Training of the two hashed linear models, in numpy, on a bounded sample of labelled texts inside one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled texts that a classifier is fitted on, at most; chosen by a hash of their identifiers, so always the same.
SAMPLE = 6000


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, sample: int = SAMPLE, even: bool = True) -> DataFrame:
    """Text and label (0 or 1) of at most ``sample`` rows that aren't held out: as many of either label as there are up to half
    of it, or (not ``even``) in the proportion that the labels have.

    The bound is drawn from the small table of labels before any text is joined, so only the sample's texts move. A
    document whose labels contradict each other counts as labelled by the larger one. Of several texts with one identifier
    the one of the least digest is taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64("doc_id", F.lit(7))
    if even:
        each = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(sample // 2) for y in (0, 1)]
        chosen = F.broadcast(each[0].unionByName(each[1]))  # SAMPLE rows of two numbers
    else:
        chosen = F.broadcast(known.orderBy(order, "doc_id").limit(sample))
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    return texts.groupBy("doc_id", "y").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))


def fitted(sample: DataFrame, fit: Callable[[list[str], np.ndarray], np.ndarray]) -> np.ndarray:
    """The weights that ``fit`` makes of the sample's texts and labels, which are gathered in one task (SAMPLE rows).

    The texts are taken in the order of their identifiers, so that a retried task gives the same weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, y) for b in batches for t, y in zip(common.strings(b.column(0)), b.column(1).to_pylist(), strict=True)]
        w = fit([t for t, _ in rows], np.array([y for _, y in rows], dtype=np.float64))
        yield pa.RecordBatch.from_pydict({"w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    one = sample.repartition(1).sortWithinPartitions("doc_id").select("text", "y").mapInArrow(run, "w binary")
    found = one.collect()
    return np.frombuffer(found[0]["w"], dtype=np.float32).copy() if found else fit([], np.zeros(0)).astype(np.float32)
