"""Spelling variants of a corpus's words: near words (one edit apart) and the form that each word is a variant of.

A word's mask has a bit for each letter, set where the word has the letter an odd number of times. One edit changes the counts
of two letters at most and so flips at most two bits; of three bands that the bits are dealt out to, one at least stays as it
is. A band that no edited letter belongs to keeps not only its bits but all its letters in order, so words meet where such a
band is equal:

* Replacement: lengths are equal, and the letters of one band stand at the same places in both words.
* Insertion: lengths differ by one, and the letter is of one band, so the other two are equal together.

An edit also lies in one half of the word; the other half is equal as it stands, and is part of what words meet on. That keeps
the meeting words few where a word has no letters of a band (a third of all short words share their empty bands). Those who
meet are compared by edit distance. No length, group or number of partners is capped.

A word's form is a near word that occurs much more often; forms are followed to the last, the root, by doubling the steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Least code points and occurrences of a word, and how many times as often as the word its form occurs.
LENGTH, OCCURRENCES, TIMES = 5, 3, 2
#: One of so many (document, word) loses a letter.
SLIP = 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All letters of words. Those of a to z have a bit each, the others share the rest of 64 bits.
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
BANDS = 3


def bit(letter: str) -> int:
    code = ord(letter)
    return code - 97 if code < 128 else 26 + (code - 0xC0) % 38


def band_bits(band: int) -> int:
    """The mask's bits that belong to a band, as a signed number."""
    bits = sum(1 << i for i in range(band, 64, BANDS))
    return bits - (1 << 64) if bits >> 63 else bits


def slips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = SLIP) -> DataFrame:
    """A row for each letter run of a text (lower-cased in A to Z), as ``word``; one of ``one_in`` (document, run), chosen by
    their crc32, has lost a letter. Without an identifier no letter is lost."""
    low = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(F.col(id_col).cast("string").alias("_i"), F.explode(F.regexp_extract_all(low, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("_w"))
    hashed = runs.where(F.length("_w") >= LENGTH).withColumn("_h", F.expr("crc32(concat(_i, ':', _w))"))
    at = "cast(_h % length(_w) as int)"
    return hashed.select(F.expr(f"CASE WHEN _h % {one_in} = 0 THEN concat(substring(_w, 1, {at}), substring(_w, {at} + 2)) ELSE _w END").alias("word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """word, n: the words of LENGTH code points and OCCURRENCES occurrences at least."""
    return words.where(F.length("word") >= LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OCCURRENCES)


def _mask() -> str:
    number = "ascii(substring(word, i, 1))"
    place = f"CASE WHEN {number} < 128 THEN {number} - 97 ELSE 26 + ({number} - 192) % 38 END"
    return f"aggregate(sequence(1, length(word)), 0L, (m, i) -> m ^ shiftleft(1L, {place}))"


def meeting_places(words: DataFrame) -> DataFrame:
    """word, n, key, role: what a word meets others on. Role 0 meets 0 (replacement); 1, the longer word, meets 2."""
    rows = []
    for band in range(BANDS):
        own = "".join(c for c in LETTERS if bit(c) % BANDS == band)
        others = "".join(c for c in LETTERS if bit(c) % BANDS != band)
        kept, bits = f"translate(word, '{others}', '{'.' * len(others)}')", f"_mask & {band_bits(band)}L"
        half = "length(word) div 2"
        rows += [f"struct(xxhash64(0, {band}, {bits}, {kept}, {side}, {text}) AS key, 0Y AS role)" for side, text in ((0, f"substring(word, 1, {half})"), (1, f"substring(word, {half} + 1)"))]
        without, bits = f"translate(word, '{own}', '')", f"_mask & {~band_bits(band)}L"
        for role, length in ((1, "length(word)"), (2, "(length(word) + 1)")):
            half = f"{length} div 2"
            ends = f"substring(word, {half} + 1)" if role == 1 else f"substring(word, {half})"
            rows += [f"struct(xxhash64(1, {band}, {bits}, {without}, {side}, {length}, {text}) AS key, {role}Y AS role)" for side, text in ((0, f"substring(word, 1, {half})"), (1, ends))]
    return words.withColumn("_mask", F.expr(_mask())).selectExpr("word", "n", f"inline(array({', '.join(rows)}))")


def near_words(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: each pair of words (of ``word`` and ``n``) that are one edit apart, once."""
    places = meeting_places(words)
    a = places.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("role").alias("role_a"))
    b = places.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("role").alias("role_b"))
    met = a.join(b, "key").where("(role_a < role_b OR (role_a + role_b = 0 AND a < b)) AND levenshtein(a, b, 1) = 1")
    swap = F.col("a") > F.col("b")
    ordered = met.select(*(F.when(swap, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("b", "a"), ("a", "b"), ("n_b", "n_a"), ("n_a", "n_b"))))
    return ordered.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last. Counts at least double with each step, so the rounds are few."""
    steps, moved = forms.select("word", F.col("form").alias("root")), True
    while moved:
        ahead = steps.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        steps = common.cut(steps.join(ahead, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")))
        moved = not steps.where("moved").isEmpty()
        steps = steps.select("word", "root")
    return steps


def grouped(words: DataFrame) -> DataFrame:
    """For each word (``word``, ``n``) its form (the near word of largest n, of equals the smallest in code-point order, if that
    n is at least TIMES the word's; else null), form_n, n_near and root (the word itself where it has no form). No words
    give no rows."""
    words = common.cut(words)
    pairs = near_words(words)
    both = pairs.selectExpr("inline(array(struct(a AS word, n_a AS n, b AS other, n_b AS other_n), struct(b AS word, n_b AS n, a AS other, n_a AS other_n)))")
    # min over (-n, word): the largest n, then the smallest word.
    each = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"), F.first("n").alias("own"))
    likely = -F.col("best.m") >= TIMES * F.col("own")
    each = common.cut(each.select("word", "n_near", F.when(likely, F.col("best.other")).alias("form"), F.when(likely, -F.col("best.m")).alias("form_n")))
    last = roots(each.where("form IS NOT NULL"))
    out = words.join(each, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, a few of which lose a letter (``slips``), with their forms. Null and empty texts have no words,
    long texts are read whole, repeated rows count as often as they stand; an empty table gives no rows."""
    return grouped(vocabulary(slips(common.table(spark, sf_dir, "documents"))))
