"""Secret scans by patterns and by a battery of randomness tests, in DataFrame functions only.

Patterns find assignments, access keys and hexadecimal runs. The battery looks at each run of 20 or more characters and
infers its encoding from its characters. A chi-squared test of alphabet uniformity, a runs test and a serial-correlation
test ask whether it could be drawn at random from that alphabet; a run that they refute is no secret. For the others the
null hypothesis is ordinary text: how likely are as few repeated letters, and as many changes between digits, small
letters, capitals and marks, in ordinary text of that length? A secret is a discovery against that hypothesis. Benjamini
and Hochberg's procedure, for each encoding and length class apart (so that the many short runs don't set the bar of the
long ones), bounds the share of ordinary runs among the discoveries. Its ranks come from counts by p-value on a scale of
logarithms over all documents: a table of fixed size, whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

# The contract's patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: What a text must contain for a pattern to be worth its scan; each follows from the pattern itself.
ASSIGN_HINT = r"(?i:passw|secret|token|api_?key)"
#: A run that the battery looks at, and its kinds of characters.
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Rate of false discoveries, the level under which the battery refutes a random draw, and length classes in characters.
RATE, REFUTED, CLASSES = 0.05, 0.001, (20, 32, 48, 96)
#: P-values are counted in bins, so many a power of ten, down to 10**-POWERS; a bin counts as its largest p-value.
BINS, POWERS = 20, 300
LEAST = 10.0**-POWERS
#: Ordinary text: chances that two, and three, of its letters are equal (sums of squares and cubes of the letters' shares in
#: English), and changes of the sort of character a step where letters are of one case (a word and a number of six each),
#: and where cases and marks mix (words of three).
TWO, THREE, ONE_CASE, MIXED = 0.0654, 0.00534, 1 / 12, 1 / 3
#: Spans of a text that are placed, or replaced, together.
BLOCK = 64
#: Alphabet sizes by encoding.
SIZES = {"hex": 16, "base32": 32, "base36": 36, "base62": 62, "base64": 64}
SPAN = "array<struct<s:bigint,e:bigint,m:string>>"


def _once(df: DataFrame, *values: Column) -> DataFrame:
    """``df`` with more columns, computed once whatever uses them: Catalyst doesn't fold a generator into its uses."""
    return df.select("*", F.inline(F.array(F.struct(*values))))


def _blocks(items: Column) -> Column:
    """An array that isn't empty, in arrays of BLOCK items."""
    last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))


def _sums(sizes: Column) -> Column:
    """What comes before each item, from their sizes."""
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(sizes, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out")), step, lambda acc: acc["out"])


def _matches(text: Column, pattern: str) -> Column:
    """The pattern's leftmost matches and the stretches before, between and after them."""
    return F.struct(F.split(text, f"(?:{pattern})", -1).alias("gaps"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("found"))


def _steps(matches: Column) -> Column:
    """For each match, how many characters come between it and the one before, its length, and what it is."""
    step = lambda g, m: F.struct(F.length(g).cast("bigint").alias("g"), F.length(m).cast("bigint").alias("n"), m.alias("m"))
    return F.zip_with(F.slice(matches["gaps"], F.lit(1), F.size(matches["found"])), matches["found"], step)


def _placed(steps: Column, start: Column) -> Column:
    """Spans of matches, code points from 0, with the matched string."""
    end = lambda acc, x: acc["at"] + x["g"] + x["n"]
    one = lambda acc, x: F.struct((acc["at"] + x["g"]).alias("s"), end(acc, x).alias("e"), x["m"].alias("m"))
    grown = lambda acc, x: F.struct(end(acc, x).alias("at"), F.concat(acc["out"], F.array(one(acc, x))).alias("out"))
    return F.aggregate(steps, F.struct(start.alias("at"), F.array().cast(SPAN).alias("out")), grown, lambda acc: acc["out"])


def _found(df: DataFrame, wanted: dict[str, tuple[Column, str, str]]) -> DataFrame:
    """``df`` with an array of spans for each name: (hint that there may be any, text, pattern).

    Each match is placed after what is before it. Many matches are placed block by block, each from its block's own start, so
    that no array grows by one item over the whole text.
    """
    own = df.columns
    none = F.array().cast("array<string>")
    df = _once(df, *(F.when(hint, _matches(F.col(text), pattern)).otherwise(F.struct(none.alias("gaps"), none.alias("found"))).alias(f"_{k}") for k, (hint, text, pattern) in wanted.items()))
    df = _once(df, *(_steps(F.col(f"_{k}")).alias(f"_{k}s") for k in wanted))
    many = {k: F.size(f"_{k}s") > BLOCK for k in wanted}
    df = _once(df, *(F.when(many[k], _blocks(F.col(f"_{k}s"))).alias(f"_{k}b") for k in wanted))
    size = lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x["g"] + x["n"])
    df = _once(df, *(_sums(F.transform(F.col(f"_{k}b"), size)).alias(f"_{k}a") for k in wanted))
    spans_ = {k: F.when(many[k], F.flatten(F.zip_with(f"_{k}b", f"_{k}a", _placed))).otherwise(_placed(F.col(f"_{k}s"), F.lit(0).cast("bigint"))) for k in wanted}
    return df.select(*own, *(v.alias(k) for k, v in spans_.items()))


def _patterns(text: str) -> dict[str, tuple[Column, str, str]]:
    """The patterns by kind. A run of hexadecimal digits is as long as it can be, and what follows AKIA is too, so there the
    least length may stand in the pattern; an assignment's value is measured after the match."""
    access, hexa, t = rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", rf"[0-9a-f]{{{HEX_LEAST},}}", F.col(text)
    return {"assign": (t.rlike(ASSIGN_HINT), text, ASSIGN), "access": (t.contains("AKIA"), text, access), "hex": (t.rlike(hexa), text, hexa)}


def _normal_tail(z: Column) -> Column:
    """P(|Z| > z), by a rational approximation whose error is under 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), poly * F.exp(-x * x)))


def _above(z: Column) -> Column:
    """P(Z > z)."""
    return F.when(z > 0, _normal_tail(z) / 2).otherwise(1 - _normal_tail(z) / 2)


def _cube(x: Column, mean: Column, variance: Column) -> Column:
    """About normal: the cube root of a sum of squares of this mean and variance (Wilson and Hilferty)."""
    part = variance / (9 * mean * mean)
    return (F.pow(F.greatest(x, F.lit(0.0)) / mean, F.lit(1 / 3)) - (1 - part)) / F.sqrt(part)


def _encoding(body: Column) -> Column:
    has = lambda p: body.rlike(p)
    return (
        F.when(has("^[0-9a-f]+$") | has("^[0-9A-F]+$"), "hex").when(has("^[A-Z2-7]+$"), "base32").when(has("^[0-9a-z]+$") | has("^[0-9A-Z]+$"), "base36")
        .when(has("^[0-9A-Za-z]+$"), "base62").otherwise("base64"))


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + f(x))


def _pairs(items: Column) -> Column:
    """Neighbours x and y."""
    return F.zip_with(F.slice(items, F.lit(1), F.size(items) - 1), F.slice(items, F.lit(2), F.size(items) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))


def _sort(c: Column) -> Column:
    return F.when((c >= 48) & (c <= 57), 0).when((c >= 65) & (c <= 90), 1).when((c >= 97) & (c <= 122), 2).otherwise(3)


def _measured(runs: DataFrame) -> DataFrame:
    """Adds what the tests need of each run (column m), numbers all of them."""
    sizes = F.create_map(*[F.lit(v) for p in SIZES.items() for v in p])
    unlike = lambda p: F.when(p["x"] != p["y"], 1.0).otherwise(0.0)
    df = _once(runs, F.regexp_replace("m", "=+$", "").alias("_b"))
    codes = F.filter(F.transform(F.split("_b", ""), lambda c: F.ascii(c).cast("double")), lambda c: c > 0)
    df = _once(df, _encoding(F.col("_b")).alias("encoding"), codes.alias("_x"))
    x, mean, n = F.col("_x"), F.col("_mean"), F.size("_x").cast("double")
    df = _once(df, (_sum(x, lambda y: y) / n).alias("_mean"), F.transform(x, _sort).alias("_c"))
    return _once(
        df, F.element_at(sizes, F.col("encoding")).cast("double").alias("k"), n.alias("n"),
        _sum(F.array_distinct(x), lambda c: F.pow(F.size(F.filter(x, lambda y: y == c)).cast("double"), F.lit(2.0))).alias("square"),
        _sum(F.col("_c"), lambda c: F.when(c == 0, 1.0).otherwise(0.0)).alias("digits"),
        (1 + _sum(_pairs(F.transform("_c", lambda c: c == 0)), unlike)).alias("turns"),
        _sum(_pairs(F.col("_c")), unlike).alias("changes"),
        _sum(x, lambda c: (c - mean) * (c - mean)).alias("total"),
        _sum(_pairs(x), lambda p: (p["x"] - mean) * (p["y"] - mean)).alias("serial"))


def _battery(runs: DataFrame) -> DataFrame:
    """Adds encoding, length_class, p_random (the battery's p-value for a random draw), p (for ordinary text, 1 where the
    battery refutes a random draw) and its bin to runs (column m)."""
    v, n, k = F.col, F.col("n"), F.col("k")
    # The statistic's own mean and variance under uniform draws, exact for any length.
    p_chi = _normal_tail(F.greatest(_cube(v("square") * k / n - n, k - 1, 2 * (k - 1) * (n - 1) / n), F.lit(0.0)))
    # Runs of digits and others: their number against the mean and variance given how many there are of each. Where all
    # are of one sort there is nothing to run; then the p-value is the chance of that under uniform draws.
    twice = 2 * v("digits") * (n - v("digits"))
    share = F.when(v("encoding") == "base32", 6.0).otherwise(10.0) / k
    spread = twice * (twice - n) / (n * n * (n - 1))
    p_runs = F.when(spread > 0, _normal_tail((v("turns") - twice / n - 1) / F.sqrt(spread))).otherwise(F.pow(F.when(v("digits") == 0, 1 - share).otherwise(share), n))
    # Serial correlation of neighbouring codes, about normal with variance 1/n.
    p_serial = F.when(v("total") > 0, _normal_tail((v("serial") / v("total") + 1 / n) * F.sqrt(n))).otherwise(0.0)
    # Ordinary text: equal letters by their shares in it, changes of sort by its rate of them.
    variance = 4 * n * (n - 1) * (n - 2) * THREE + 2 * n * (n - 1) * TWO - 2 * n * (n - 1) * (2 * n - 3) * TWO * TWO
    few = _above(-_cube(v("square") - n, n * (n - 1) * TWO, variance))
    rate = F.when(v("encoding").isin("base62", "base64"), MIXED).otherwise(ONE_CASE)
    many = _above((v("changes") - (n - 1) * rate - 0.5) / F.sqrt((n - 1) * rate * (1 - rate)))
    length = F.size(F.filter(F.array(*map(F.lit, CLASSES)), lambda c: c <= n)).cast("int")
    tested = _once(_measured(runs), p_chi.alias("_chi"), p_runs.alias("_runs"), p_serial.alias("_serial"), few.alias("_few"), many.alias("_many"), length.alias("length_class"))
    # Three tests of one run: the smallest p-value, three times (Bonferroni). Two of ordinary text: Fisher's method.
    x = -F.log(F.greatest("_few", F.lit(LEAST))) - F.log(F.greatest("_many", F.lit(LEAST)))
    found = _once(tested, F.least(F.lit(1.0), 3 * F.least("_chi", "_runs", "_serial")).alias("p_random"), F.least(F.lit(1.0), F.exp(-x) * (1 + x)).alias("_text"))
    found = _once(found, F.when(F.col("p_random") < REFUTED, 1.0).otherwise(F.col("_text")).alias("p"))
    bin_ = F.least(F.lit(BINS * POWERS), F.floor(-F.log10(F.greatest(F.col("p"), F.lit(LEAST))) * BINS)).cast("int")
    return found.select(*runs.columns, "encoding", "length_class", "p_random", "p", bin_.alias("bin"))


def _bars(tested: DataFrame) -> DataFrame:
    """By encoding and length class, the least bin whose runs are discoveries (null: none); from counts by bin."""
    counts = tested.groupBy("encoding", "length_class", "bin").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy("encoding", "length_class")
    ranked = counts.withColumn("rank", F.sum("c").over(group.orderBy(F.desc("bin")))).withColumn("all", F.sum("c").over(group))
    ok = F.pow(F.lit(10.0), -F.col("bin") / BINS) <= RATE * F.col("rank") / F.col("all")
    return ranked.groupBy("encoding", "length_class").agg(F.min(F.when(ok, F.col("bin"))).alias("bar"))


def scan(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the arrays assign, access, hex (the patterns' spans) and runs (what the battery tests)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    inner = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), text.alias("_text"))
    found = _found(inner, _patterns("_text") | {"runs": (F.col("_text").rlike(RUN), "_text", RUN)})
    value = lambda x: F.length(F.regexp_extract(x["m"], f"^{ASSIGN}$", 1)) >= ASSIGN_LEAST
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.filter("assign", value).alias("assign"), "access", "hex", "runs")


def _secret(tested: DataFrame) -> DataFrame:
    """The runs that are discoveries; the bars are a table of fixed size. The battery is computed once, for both uses."""
    tested = common.cut(tested)
    return tested.join(F.broadcast(_bars(tested)), ["encoding", "length_class"]).where(F.col("bin") >= F.col("bar"))


def _kinds(columns: dict[str, int]) -> Column:
    """All spans of the named columns as structs (s, k, kind, e), by start and kind's place."""

    def labelled(c: str, k: int) -> Column:
        return F.transform(F.col(c), lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), F.lit(c).alias("kind"), x["e"].alias("e")))

    return F.array_sort(F.concat(*(labelled(c, k) for c, k in columns.items())))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: the identifier, and arrays assign, access, hex and random of spans (s, e, m: start, end in
    code points, and what stands there).

    Null texts count as empty and have no spans. Repeated rows are scanned each, other columns aren't looked at, no rows
    give no rows. Spans of different kinds may overlap. Only rows that have runs to test are shuffled, without their texts.
    """
    scanned = scan(docs, id_col, text_col, [id_col])
    kept = common.cut(scanned.withColumn("_row", F.monotonically_increasing_id()))
    tested = _battery(kept.where(F.size("runs") > 0).select("_row", F.inline("runs")))
    random = _secret(tested).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("s", "e", "m"))).alias("random"))
    return kept.drop("runs").join(random, "_row", "left").withColumn("random", F.coalesce("random", F.array().cast(SPAN)))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans by document; null texts are empty."""
    found = spans(common.table(spark, sf_dir, "documents"))
    base = {"assign": 0, "access": 1, "hex": 2}
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(_digest(_kinds(base)), 256).alias("base_sha256"), _digest(_kinds(base | {"random": 3})).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every secret span replaced by ``mark``; texts without secrets stay as they are.

    Overlapping spans are one. Texts are scanned once, and rows with what was found are kept in the shared folder. Only those
    that have spans are joined with them; all others pass through where they are. Null texts, other columns and repeated
    rows stay. No rows give no rows.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own, text = docs.toDF(*names.values()), names[text_col]
    scanned = common.cut(scan(own, text, text, own.columns).withColumn("_row", F.monotonically_increasing_id()))
    tested = _battery(scanned.where(F.size("runs") > 0).select("_row", F.inline("runs"))).select("_row", "s", "e", "encoding", "length_class", "bin")
    base = scanned.select("_row", F.inline(F.concat("assign", "access", "hex"))).select("_row", "s", "e")
    spans_ = _disjoint(base.unionByName(_secret(tested).select("_row", "s", "e"))).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_spans"))
    hit = F.size(F.concat("assign", "access", "hex", "runs")) > 0
    changed = _replaced(scanned.where(hit).join(spans_, "_row", "left"), text, mark)
    return scanned.where(~hit).select(*own.columns).unionByName(changed.select(*own.columns)).toDF(*docs.columns)


def _disjoint(found: DataFrame) -> DataFrame:
    """Spans (_row, s, e), those that overlap put together."""
    order = Window.partitionBy("_row").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("s") >= before, F.lit(True)).cast("int")
    return found.withColumn("_fresh", fresh).withColumn("_group", F.sum("_fresh").over(order)).groupBy("_row", "_group").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_group")


def _replaced(rows: DataFrame, text: str, mark: str) -> DataFrame:
    """``text`` with ``mark`` for each of the column _spans, which are disjoint and in order. A text of many spans is cut into
    as many stretches as there are blocks of spans, so that no character is passed over once for every span."""
    starts = lambda a, spans_: F.concat(F.array(a), F.transform(F.slice(spans_, F.lit(1), F.size(spans_) - 1), lambda x: x["e"]))

    def between(t: Column, a: Column, spans_: Column) -> Column:
        """What stands before the spans, each followed by the mark; ``t`` begins at ``a``."""
        kept = F.zip_with(starts(a, spans_), spans_, lambda b, x: F.concat(t.substr((b - a + 1).cast("int"), (x["s"] - b).cast("int")), F.lit(mark)))
        return F.array_join(kept, "")

    t, spans_, zero = F.col(text), F.col("_spans"), F.lit(0).cast("bigint")
    own, many = rows.columns, F.size("_spans") > BLOCK
    df = _once(rows, F.when(many, _blocks(spans_)).alias("_b"))
    df = _once(df, F.transform("_b", lambda b: F.element_at(b, -1)).alias("_last"))
    df = _once(df, F.transform(F.arrays_zip(starts(zero, F.col("_last")).alias("a"), F.col("_last").alias("z"), F.col("_b").alias("b")),
               lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), t.substr((x["a"] + 1).cast("int"), (x["z"]["e"] - x["a"]).cast("int")).alias("t"))).alias("_parts"))
    head = F.when(many, F.array_join(F.transform("_parts", lambda x: between(x["t"], x["a"], x["b"])), "")).otherwise(between(t, zero, spans_))
    rest = t.substr((F.element_at(spans_, -1)["e"] + 1).cast("int"), F.length(t))
    return df.withColumn(text, F.when(spans_.isNull(), t).otherwise(F.concat(head, rest))).select(*own)
