"""Queries over the geometry of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..sources import tables as T
from .registry import query


def _cuts(levels: int) -> str:
    """The same cuts as running maxima in SQL: a path of part numbers for each element, one number a level."""
    out = """tilts AS (SELECT page, median(degrees(atan2(dy, dx))) FILTER (abs(degrees(atan2(dy, dx))) <= 8) AS t FROM elements GROUP BY page),
  turned AS (SELECT *, CASE WHEN abs(coalesce(t, 0)) >= 0.15 THEN cos(radians(-t)) ELSE 1.0::DOUBLE END AS c, CASE WHEN abs(coalesce(t, 0)) >= 0.15 THEN sin(radians(-t)) ELSE 0.0::DOUBLE END AS s FROM elements JOIN tilts USING (page)),
  cornered AS (SELECT page, id, 0.5 + (x0 - 0.5) * c - (y0 - 0.5) * s AS px, 0.5 + (x0 - 0.5) * s + (y0 - 0.5) * c AS py, 0.5 + (x1 - 0.5) * c - (y1 - 0.5) * s AS qx, 0.5 + (x1 - 0.5) * s + (y1 - 0.5) * c AS qy FROM turned),
  l0 AS (SELECT page, id, greatest(0.004, 0.6::DOUBLE * median(nullif(abs(qy - py), 0)) OVER (PARTITION BY page)) AS gap, least(px, qx) AS x0, least(py, qy) AS y0, greatest(px, qx) AS x1, greatest(py, qy) AS y1, page::VARCHAR AS path FROM cornered)"""
    for i in range(levels):
        out += f""",
  a{i} AS (SELECT *, CASE WHEN y0 - max(y1) OVER (PARTITION BY path ORDER BY y0, y1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > gap THEN 1 ELSE 0 END AS fy,
    CASE WHEN x0 - max(x1) OVER (PARTITION BY path ORDER BY x0, x1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0.03 THEN 1 ELSE 0 END AS fx FROM l{i}),
  b{i} AS (SELECT *, sum(fy) OVER (PARTITION BY path) AS ny, sum(fy) OVER (PARTITION BY path ORDER BY y0, y1, id) AS gy, sum(fx) OVER (PARTITION BY path ORDER BY x0, x1, id) AS gx FROM a{i}),
  l{i + 1} AS (SELECT page, id, gap, x0, y0, x1, y1, path || '.' || lpad(CAST(CASE WHEN ny > 0 THEN gy ELSE gx END AS VARCHAR), 4, '0') AS path FROM b{i})"""
    return out


@query(f"WITH {T.ELEMENTS}, {_cuts(6)} SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY path, y0, x0) - 1 AS place FROM l6")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each element of a page comes when it is read."""
    return G.reading_order(T.elements(spark, sf_dir), ["page"], "id", ["x0", "y0", "x1", "y1"], ("dx", "dy"))


@query()
def running_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the margins of each material's pages repeat: headers and footers by place and fuzzy text or image, and page numbers."""
    r = G.running_margins(T.margins(spark, sf_dir))
    return r.select("material", "kind", "element", "text", F.size("pages").cast("bigint").alias("n_pages"), F.array_min("pages").alias("first_page"), F.array_max("pages").alias("last_page"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query("""WITH o AS (SELECT o_custkey AS material, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey AS k FROM orders),
  i AS (SELECT material, page, k, CASE WHEN k % 11 > 0 THEN CASE WHEN k % 3 = 0 THEN material * 10 ELSE k END END AS digest, k % 10 * 0.09::DOUBLE AS y0, CASE k % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 0.3 WHEN 2 THEN 0.9 ELSE 0.5 END::DOUBLE AS w, CASE k % 4 WHEN 0 THEN 0.05 WHEN 1 THEN 0.2 WHEN 2 THEN 0.8 ELSE 0.1 END::DOUBLE AS h, k % 90 + 1 AS px, k % 8 = 0 AS caption FROM o),
  s AS (SELECT *, w * h AS area, count(*) OVER (PARTITION BY material, digest) >= 2 AND digest IS NOT NULL AS repeated, (y0 + (y0 + h)) / 2 <= 0.12 OR (y0 + (y0 + h)) / 2 >= 0.88 AS margin FROM i),
  r AS (SELECT *, CASE WHEN caption THEN 'content' WHEN px < 16 THEN 'decorative' WHEN repeated AND margin AND (px < 64 OR area < 0.02) THEN 'service' WHEN repeated OR area >= 0.7 THEN 'unknown' ELSE 'content' END AS role FROM s)
  SELECT material, page, repeated, margin, area >= 0.7 AS page_sized, CASE WHEN digest IS NULL AND role = 'content' THEN 'unknown' ELSE role END AS role FROM r""")
def image_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of materials' pages with what is computed about them (repetition, margin, size) and their roles."""
    k = F.col("k")
    o = T.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("material"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"), F.col("o_orderkey").alias("k"))
    of = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % 4 + 1).cast("int"))
    y0 = k % 10 * F.lit(0.09)
    images = o.select("material", "page", F.lit(0).alias("id"), F.when(k % 11 > 0, F.when(k % 3 == 0, F.col("material") * 10).otherwise(k)).alias("digest"), F.lit(0.0).alias("x0"), y0.alias("y0"), of(0.1, 0.3, 0.9, 0.5).alias("x1"), (y0 + of(0.05, 0.2, 0.8, 0.1)).alias("y1"),
                      (k % 90 + 1).alias("width"), F.lit(500).cast("bigint").alias("height"), F.when(k % 8 == 0, "Figure").alias("caption"))
    return G.image_signals(images).select("material", "page", "repeated", "margin", "page_sized", "role")
