"""Alignment of revisions, outlines, ranges and anchors; monotone chains."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import tables as T


def outline(items: DataFrame, key: str, order: str, level: str, page: str, last_page: str, deepest: int = 6) -> DataFrame:
    """Each outline item with its parent (the last item before it of a lower level) and its last page (one before the page of
    the next item of the same or a lower level, not before its own first page).

    Levels are few, so "the last of each level" is a handful of windows; nothing is joined.
    """
    w = Window.partitionBy(key).orderBy(order)
    past, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    parents = [F.when(F.col(level) > d, F.last(F.when(F.col(level) == d, F.col(order)), ignorenulls=True).over(past)) for d in range(1, deepest)]
    nexts = [F.when(F.col(level) >= d, F.first(F.when(F.col(level) == d, F.struct(F.col(order).alias("o"), F.col(page).alias("p"))), ignorenulls=True).over(ahead)) for d in range(1, deepest + 1)]
    end = F.array_min(F.filter(F.array(*nexts), lambda x: x.isNotNull()))["p"] - 1
    return items.withColumn("parent", F.greatest(*parents)).withColumn("page_to", F.greatest(F.col(page), F.coalesce(end, F.col(last_page))))


def expanded(ranges: DataFrame, key: str, first: str, last: str, order: str, value: str) -> DataFrame:
    """Ranges in order expanded to places; of several for one place the later one counts."""
    places = ranges.withColumn("place", F.explode(F.sequence(F.col(first), F.col(last))))
    return places.groupBy(key, "place").agg(F.max_by(value, order).alias(value))


def covered_exactly(source: DataFrame, result: DataFrame, key: str, place: str) -> DataFrame:
    """Keys with how many places a rewritten list lost, invented or has twice; ``result`` has each place kept or dropped."""
    s = source.select(key, place, F.lit(1).alias("_s"))
    r = result.groupBy(key, place).agg(F.count(F.lit(1)).alias("_r"))
    both = s.join(r, [key, place], "full")
    return both.groupBy(key).agg(F.count_if(F.col("_r").isNull()).alias("lost"), F.count_if(F.col("_s").isNull()).alias("invented"), F.count_if(F.col("_r") > 1).alias("twice"))


# Fixed value: characters that the beginnings of two texts at the same place must share.
BEGINNING = 40


def anchored(anchors: DataFrame, rows: DataFrame, key: str, pos: str, line: str) -> DataFrame:
    """Where anchors (key, pos, line) are among rows: the first row of equal text (white space and case aside), else the same
    place if its text begins with the same BEGINNING characters, else null. Texts without a character have no beginning."""
    form = F.lower(X.squeezed(F.col(line)))
    same = rows.groupBy(key, F.sha2(form, 256).alias("_h")).agg(F.min(pos).alias("_same"))
    at = rows.select(F.col(key).alias("_k"), F.col(pos).alias("_at"), F.substring(form, 1, BEGINNING).alias("_p"))
    a = anchors.withColumn("_h", F.sha2(form, 256)).join(same, [key, "_h"], "left").withColumn("_q", F.substring(form, 1, BEGINNING))
    b = a.join(at, (F.col(key) == F.col("_k")) & (F.col(pos) == F.col("_at")) & (F.col("_q") == F.col("_p")) & (F.col("_q") != ""), "left")
    how = F.when(F.col("_same").isNotNull(), "text").when(F.col("_at").isNotNull(), "place").otherwise("lost")
    return b.select(key, pos, F.coalesce("_same", "_at").alias("found"), how.alias("how"))


def merged_answers(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What an import does with each answer: create, restore (a deleted one), preserve (edited by hand), unchanged, update;
    and keep for those that the import doesn't have. ``old`` has (key, text, manual, deleted), ``new`` (key, text)."""
    both = old.join(new.select(key, F.col("text").alias("new_text")), key, "full")
    act = (
        F.when(F.col("new_text").isNull(), "keep").when(F.col("text").isNull(), "create").when(F.col("deleted"), "restore")
        .when(F.col("manual"), "preserve").when(F.col("text") == F.col("new_text"), "unchanged").otherwise("update"))
    return both.select(key, act.alias("action"))


def monotone(pairs: DataFrame, key: str, left: str, right: str, score: str, bonus: float) -> DataFrame:
    """Of candidate pairs, each key's chain with both sides increasing that has the largest sum of scores and bonuses.

    A dynamic program over a key's candidates; a key is one document's anchors.
    """
    kinds = dict(pairs.dtypes)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values([left, right]).reset_index(drop=True)
        l, r, s = (rows[c].tolist() for c in (left, right, score))
        best, back = [], []
        for i in range(len(rows)):
            before = max(((best[j], -j) for j in range(i) if l[j] < l[i] and r[j] < r[i]), default=(0.0, 1))
            best.append(before[0] + s[i] + bonus)
            back.append(-before[1] if before[1] <= 0 else None)
        at = max(range(len(rows)), key=lambda i: (best[i], -i), default=None)
        out = []
        while at is not None:
            out.append(at)
            at = back[at]
        return rows.loc[sorted(out), [key, left, right]]

    return pairs.groupBy(key).applyInPandas(chain, f"{key} {kinds[key]}, {left} {kinds[left]}, {right} {kinds[right]}")


def passages(rows: DataFrame, key: str, pos: str, wanted: str, gap: int = 2) -> DataFrame:
    """Runs of wanted rows with at most ``gap`` other rows between: first and last place, and how many are wanted."""
    w = Window.partitionBy(key).orderBy(pos)
    hits = rows.withColumn("_n", F.row_number().over(w)).where(F.col(wanted))
    fresh = F.coalesce(F.col("_n") - F.lag("_n").over(w) - 1 > gap, F.lit(True)).cast("int")
    runs = hits.withColumn("_f", fresh).withColumn("passage", F.sum("_f").over(w))
    return runs.groupBy(key, "passage").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("wanted"))


def quoted(docs: DataFrame, quotes: DataFrame, id_col: str, text_col: str, k: int = 4) -> DataFrame:
    """(quote_id, id, text, quote): documents that may have quotations (quote_id, quote), by ``k`` neighbouring tokens.

    A quotation's first token may be the end of a longer word, so the key is its second to its ``k + 1``-th one. Documents'
    runs of ``k`` tokens meet keys, and only the pairs that do are joined with texts; quotations of fewer than ``k + 2``
    tokens, which have no such key, are looked for in all documents.
    """
    toks = X.tokens(F.col("quote"))
    q = quotes.withColumn("_n", F.size(toks)).withColumn("_key", F.xxhash64(*(F.try_element_at(toks, F.lit(i + 2)) for i in range(k))))
    runs = F.arrays_zip(*(F.slice(X.tokens(F.col(text_col)), F.lit(i + 1), F.greatest(F.lit(0), F.size(X.tokens(F.col(text_col))) - k + 1)).alias(f"t{i}") for i in range(k)))
    grams = docs.select(id_col, F.explode(runs).alias("g")).select(id_col, F.xxhash64(*(F.col("g")[f"t{i}"] for i in range(k))).alias("_key"))
    long = T.bounded(q.where(F.col("_n") >= k + 2).select("quote_id", "_key"))
    pairs = grams.join(long, "_key").select(id_col, "quote_id").distinct()
    met = docs.select(id_col, text_col).join(pairs, id_col).join(T.bounded(quotes), "quote_id")
    short = docs.select(id_col, text_col).join(T.bounded(q.where(F.col("_n") < k + 2).select("quote_id", "quote")), X.fold(F.col(text_col)).contains(F.element_at(F.concat(toks, F.array(F.lit(""))), 1)))
    columns = ["quote_id", F.col(id_col), F.col(text_col), "quote"]
    return met.select(*columns).unionByName(short.select(*columns))


def located(candidates: DataFrame, text_col: str) -> DataFrame:
    """Adds start, end (characters) and how to candidates (quote, text) and drops the rest: where the quotation stands as it
    is, else where its tokens stand one after the other, whatever is between them and whatever their case."""
    text, quote = F.col(text_col), F.col("quote")
    exact = F.instr(text, quote).cast("bigint")
    pattern = F.concat(F.lit("(?<![0-9a-zа-я])"), F.array_join(X.tokens(quote), "[^0-9a-zа-я]+"), F.lit("(?![0-9a-zа-я])"))
    at = F.when(F.size(X.tokens(quote)) > 0, F.regexp_instr(X.fold(text), pattern)).otherwise(0).cast("bigint")
    found = candidates.withColumn("_e", exact).withColumn("_t", F.when(exact > 0, 0).otherwise(at)).where("_e > 0 OR _t > 0")
    size = F.when(F.col("_e") > 0, F.length(quote)).otherwise(F.length(F.regexp_substr(X.fold(text), pattern)))
    start = F.greatest("_e", "_t") - 1
    return found.withColumn("start", start).withColumn("end", start + size).withColumn("how", F.when(F.col("_e") > 0, "exact").otherwise("tokens")).drop("_e", "_t")
