"""Trees as adjacency lists (id, parent_id, ord, ...), walked level by level.

A level is one join with the nodes below the last one, so a walk has as many joins as the tree is deep, whatever that is. Each
level is kept in the shared folder, so no level is computed twice. ``problems`` says which nodes a walk can't reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared


def walk(nodes: DataFrame, inherit: str | None = None) -> DataFrame:
    """Each reachable node with depth (from 0), path (titles joined by " / "), order (sorts as a preorder), ancestors (ids
    from the root), and ``inherit`` from the nearest ancestor that has it. A row that would be its own ancestor (identifiers
    that repeat) ends its branch."""
    place = lambda: F.array(F.struct(F.col("ord"), F.col("id")))
    carried = [F.col(inherit).alias("_carried")] if inherit else []
    level = nodes.where("parent_id IS NULL").select("id", F.lit(0).alias("depth"), F.col("title").alias("path"), place().alias("order"), F.array("id").alias("ancestors"), *carried)
    level = out = shared.cut(level)
    d = 0
    while True:
        d += 1
        up = level.toDF(*(f"_{c}" for c in level.columns))
        own = [F.coalesce(F.col(inherit), F.col("__carried")).alias("_carried")] if inherit else []
        below = nodes.join(up, (F.col("parent_id") == F.col("_id")) & ~F.array_contains("_ancestors", F.col("id"))).select(
            "id", F.lit(d).alias("depth"), F.concat_ws(" / ", "_path", "title").alias("path"), F.concat("_order", place()).alias("order"), F.concat("_ancestors", F.array("id")).alias("ancestors"), *own)
        level = shared.cut(below)
        if level.isEmpty():
            break
        out = out.union(level)
    return out.withColumnRenamed("_carried", inherit) if inherit else out


def preorder(walked: DataFrame, key: str) -> DataFrame:
    """Numbers a walk's nodes in preorder within ``key`` (as a rule the root, so that trees are numbered apart)."""
    from pyspark.sql import Window

    return walked.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("order")))


def closure(walked: DataFrame) -> DataFrame:
    """(ancestor, id) of every node and each of its ancestors, itself included."""
    return walked.select(F.explode("ancestors").alias("ancestor"), "id")


def problems(nodes: DataFrame) -> DataFrame:
    """Nodes that no walk from a root reaches: their parent is missing, or they are on or below a cycle or such a node."""
    lost = nodes.join(walk(nodes).select("id"), "id", "left_anti")
    known = nodes.select(F.col("id").alias("parent_id")).withColumn("_known", F.lit(True))
    return lost.join(known, "parent_id", "left").select("id", F.when(F.col("_known").isNull(), "missing_parent").otherwise("unreachable").alias("problem"))


def reachable(edges: DataFrame, roots: DataFrame, files: DataFrame) -> DataFrame:
    """id, depth: what can be reached from ``roots`` (id) along ``edges`` (src, dst) between ``files`` (id), with the fewest steps.

    The graph may have cycles and several ways to a place; each round joins only what the last one found, and what is known
    already is taken away, so there are as many rounds as the longest shortest way. What isn't among the files is left out.
    """
    known = files.select("id").distinct()
    front = shared.cut(roots.select("id").distinct().join(known, "id", "left_semi").withColumn("depth", F.lit(0)))
    out, depth = front, 0
    while not front.isEmpty():
        depth += 1
        ahead = edges.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = shared.cut(ahead.join(known, "id", "left_semi").join(out, "id", "left_anti").withColumn("depth", F.lit(depth)))
        out = out.unionByName(front)
    return out
