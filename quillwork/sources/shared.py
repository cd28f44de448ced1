"""Tables in the folder that all of a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a session on one machine (tests) gets one of its own; a cluster,
    whose machines share no such folder, gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that the cluster shares")
        found = tempfile.mkdtemp(prefix="quillwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession, what: str) -> str:
    """A new path under the session's checkpoint folder."""
    return f"{root(spark)}/quillwork/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, so that loops don't grow plans and a lost executor costs little."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(root(df.sparkSession))
    return df.checkpoint(eager=True)
