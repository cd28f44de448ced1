"""Programs over the rows of one key, where windows and aggregates don't reach."""

from __future__ import annotations

import itertools
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Fixed value: rows that leave a task together.
ROWS = 10_000


def over(df: DataFrame, keys: list[str], order: list[str | Column], program: Callable[[Any], Iterable[tuple]], schema: str, whole: bool = True) -> DataFrame:
    """What ``program`` gives for the rows (named tuples) of each of ``keys``, in ``order``; its tuples follow ``schema``.

    Spark deals rows out by key and sorts them; a task goes through its sorted rows and holds those of one key at a time. That
    costs a small key nothing but its rows, where a data frame for each key costs some milliseconds. A program that reads its rows
    once, in order, takes them as they come (not ``whole``): then no key's rows are held.
    """
    names = df.columns
    if not all(n.isidentifier() and not n.startswith("_") for n in names):
        raise ValueError(f"columns can't be names of a tuple: {names}")
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    at = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = namedtuple("row", names)
        rows = (row(*x) for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = (x for _, g in itertools.groupby(rows, lambda r: tuple(r[i] for i in at)) for x in program(list(g) if whole else g))
        while part := list(itertools.islice(out, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)

    # Programs cost more than their rows weigh, so tasks aren't put together by size.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)
