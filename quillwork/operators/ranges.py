"""Ranges of topics in paged materials: their borders moved to headings, and cut at the headings of their parts.

A position is a page and the place of a fragment on it (0: the page's beginning); ranges are half open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def title_form(x: Column) -> Column:
    """Titles as they are compared: case, white space and ё don't tell them apart."""
    return X.squeezed(X.fold(x))


def at(page: Column, place: Column) -> Column:
    return F.struct(page.cast("int").alias("page"), place.cast("int").alias("place"))


def headings(fragments: DataFrame) -> DataFrame:
    """key, page, place, level, form, back of the headings among ``fragments`` (key, page, place, text, heading, level, content).
    ``back`` is where what precedes a heading begins to belong to it: after the last content before it on its page."""
    before = Window.partitionBy("key", "page").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    back = F.coalesce(F.max(F.when(F.col("content"), F.col("place"))).over(before) + 1, F.lit(0))
    rows = fragments.withColumn("back", back).where(F.col("heading") & F.col("content"))
    return rows.select("key", "page", "place", "level", title_form(F.col("text")).alias("form"), "back")


def refined(topics: DataFrame, fragments: DataFrame) -> DataFrame:
    """``topics`` with start and end (positions).

    ``topics`` has key, ord, title, page_from, page_to, next_title and next_page (null: nothing follows), page_count (null:
    unknown). A topic begins at its title on its first page, if that is there. It ends at the next one's title, or at the
    first heading there that isn't deeper than its own, where the next one begins on the topic's first page or on the page
    after its last one. A page that both share and that has no such heading, or isn't read, belongs to both.
    """
    heads = headings(fragments)
    named = heads.select("key", F.col("page").alias("page_from"), F.col("form").alias("_form"), "place", "back", "level")
    t = topics.withColumn("_form", title_form(F.col("title")))
    first = t.join(named, ["key", "page_from", "_form"]).groupBy("key", "ord").agg(F.min(F.struct("place", "back", "level")).alias("_own"))
    t = t.join(first, ["key", "ord"], "left").withColumn("start", at(F.col("page_from"), F.coalesce("_own.back", F.lit(0))))
    same, after = F.col("next_page") == F.col("page_from"), F.col("next_page") == F.col("page_to") + 1
    reached = F.coalesce(same | (after & (F.col("page_count").isNull() | (F.col("next_page") <= F.col("page_count")))), F.lit(False))
    t = t.withColumn("_cut", F.when(reached, F.col("next_page"))).withColumn("_same", F.coalesce(same, F.lit(False)))
    floor = F.when(F.col("_same"), F.col("start.place") + 1).otherwise(0)
    there = heads.select(F.col("key").alias("_k"), F.col("page").alias("_p"), F.col("place").alias("_i"), F.col("back").alias("_b"), F.col("level").alias("_l"), F.col("form").alias("_f"))
    met = t.join(there, (F.col("key") == F.col("_k")) & (F.col("_cut") == F.col("_p")) & (F.col("_i") >= floor))
    top = F.col("_own.level")
    is_next, shallow = F.col("_f") == title_form(F.col("next_title")), top.isNull() | F.col("_l").isNull() | (F.col("_l") <= top)
    cuts = met.groupBy("key", "ord").agg(F.min(F.when(is_next, F.struct("_i", "_b"))).alias("_n"), F.min(F.when(shallow, F.struct("_i", "_b"))).alias("_s")).select("key", "ord", F.coalesce("_n", "_s")["_b"].alias("_at"))
    pages = fragments.groupBy("key", F.col("page").alias("_cut")).agg(F.bool_or("content").alias("_content"))
    t = t.join(cuts, ["key", "ord"], "left").join(pages, ["key", "_cut"], "left")
    whole = at(F.col("page_to") + 1, F.lit(0))
    end = (
        F.when(F.col("_cut").isNull(), whole)
        .when(F.col("_same"), F.when(F.col("_at").isNotNull(), at(F.col("_cut"), F.col("_at"))).otherwise(whole))
        .when(F.col("_content").isNull(), at(F.col("_cut") + 1, F.lit(0))).when(~F.col("_content"), whole)
        .otherwise(F.when(F.col("_at").isNotNull(), at(F.col("_cut"), F.col("_at"))).otherwise(at(F.col("_cut") + 1, F.lit(0)))))
    return t.withColumn("end", end).select(*topics.columns, "start", "end")


def split_by_parts(ranges: DataFrame, parts: DataFrame, fragments: DataFrame) -> DataFrame:
    """key, ord, part, page_from, place_from, page_to, end (position), for each part of each range, and for what stands before the
    first one (part null); a part without anything has nulls.

    ``ranges`` has key, ord, start, end; ``parts`` key, ord, part, title, page_from. A part begins at its title on its page, else
    where the page does; cuts never go back; parts that begin before the range's page, or at its end or later, have no piece.
    """
    heads = headings(fragments).select("key", F.col("page").alias("page_from"), F.col("form").alias("_form"), "place", "back")
    p = parts.withColumn("_form", title_form(F.col("title"))).join(ranges.select("key", "ord", "start", "end"), ["key", "ord"]).where(F.col("page_from") >= F.col("start.page"))
    floor = F.when(F.col("page_from") == F.col("start.page"), F.col("start.place") + 1).otherwise(0)
    own = p.join(heads, ["key", "page_from", "_form"]).where(F.col("place") >= floor).groupBy("key", "ord", "part").agg(F.min(F.struct("place", "back")).alias("_h"))
    p = p.join(own, ["key", "ord", "part"], "left").withColumn("_at", F.greatest(at(F.col("page_from"), F.coalesce("_h.back", F.lit(0))), F.col("start"))).where(F.col("_at") < F.col("end"))
    order = Window.partitionBy("key", "ord").orderBy("page_from", "part")
    cuts = p.select("key", "ord", "part", "end", F.max("_at").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_from"), F.row_number().over(order).alias("_n"))
    bounds = ranges.select("key", "ord", F.lit(None).cast(dict(parts.dtypes)["part"]).alias("part"), "end", F.col("start").alias("_from"), F.lit(0).alias("_n")).unionByName(cuts)
    to = F.coalesce(F.lead("_from").over(Window.partitionBy("key", "ord").orderBy("_n")), F.col("end"))
    size = fragments.groupBy("key", F.col("page").alias("_p")).agg(F.count(F.lit(1)).cast("int").alias("_size"))
    rows = bounds.withColumn("_to", to).withColumn("_p", F.col("_from.page")).join(size, ["key", "_p"], "left")
    # A piece that would begin after its page's last fragment begins with the next page.
    over = (F.col("_from.place") > 0) & (F.col("_from.place") >= F.coalesce("_size", F.lit(0)))
    rows = rows.withColumn("_a", F.when(over, at(F.col("_p") + 1, F.lit(0))).otherwise(F.col("_from"))).withColumn("_z", F.col("_to.page") - (F.col("_to.place") == 0).cast("int"))
    some = (F.col("_from") < F.col("_to")) & (F.col("_z") >= F.col("_a.page")) & (F.col("_a") < F.col("_to"))
    kept = rows.withColumn("_some", some).where("part IS NOT NULL OR _some")
    return kept.select("key", "ord", "part", *(F.when(F.col("_some"), c).alias(n) for c, n in ((F.col("_a.page"), "page_from"), (F.col("_a.place"), "place_from"), (F.col("_z"), "page_to"), (F.col("_to.place"), "place_to"))))
