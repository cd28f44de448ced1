"""Near-duplicates by BagMinHash on multisets of word shingles.

Signatures. An element's weight is its count in the text. Each element has a Poisson process over time and weight: the
weight axis is cut into dyadic blocks [0,1), [1,2), [2,4), ..., each a process of its own whose rate is the block's length.
An event of a block is uniform over the block's units of weight; its unit is drawn at once (which is what halving the block
bit by bit comes to), and events beyond the weight are dropped from the one block that the weight ends in. An event lands on
one of the signature's slots, and a slot keeps its first event's mark. Two slots agree with the texts' weighted Jaccard
similarity as probability. Events later than a text's horizon (by which all slots have one) are never made, so the work
for a text is about its elements plus slots times the slots' logarithm.

Links. Texts with the same multiset are one class from the start. Bands of slots deal the classes out to buckets; in a
bucket, each class is compared with the bucket's first one only (a star), and signatures rule out pairs that are far under
the threshold before texts are compared in full. Buckets whose members are then still of several components get the exact
way, which has no cap: a prefix filter over their members' shingles, rarest first, with the positional bound, finds every
pair of different components that can reach the threshold, and full comparison decides. Components come from iterated
minimum labels in Spark; nothing is gathered on the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, THRESHOLD = 5, 0.8
#: Bands and slots of a band; a pair of the threshold's similarity shares a band with probability 1 - (1 - 0.8**4)**24.
BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS
#: Least share of equal slots for a pair to be compared: 5 standard errors under the threshold.
SEEMING = THRESHOLD - 5 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / SLOTS)
#: Pairs with the same first identifier that are compared in one task, as a rule.
PART = 256
#: A text's horizon leaves each slot empty with probability exp(-SPAN) / SLOTS; texts with empty slots get longer ones.
SPAN = 4.0


def shingles(raw: list[bytes], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and their texts; a text of fewer words (but one at least) is one shingle."""
    w = common.word_table([x.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass") for x in raw])
    h, at = common.grams(w.hash, w.doc, k)
    doc = w.doc[at]
    n = np.bincount(w.doc, minlength=len(raw))
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        base = np.concatenate([[0], np.cumsum(n)])
        extra = np.array([_chain(w.hash[base[i] : base[i + 1]]) for i in few], np.uint64)
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, few])
    return h, doc


def _chain(words: np.ndarray) -> int:
    out = len(words)
    for x in words.tolist():
        out = ((out ^ x) * 0x9FB21C651E98DF25 + 0x1B873593) & 0xFFFFFFFFFFFFFFFF
        out ^= out >> 29
    return out


def multisets(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, by text and hash: hash, text, count."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[fresh], doc[fresh], np.diff(np.append(fresh, len(h)))


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)


def _events(h: np.ndarray, doc: np.ndarray, count: np.ndarray, horizon: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, time, slot, mark) of the elements' events up to their texts' horizons, in rounds: n-th events of all blocks."""
    top = np.frexp(count - 0.5)[1] + 1  # blocks that a count reaches: 1 for 1, 2 for 2, 3 for 3 and 4, ...
    top = np.maximum(top, 1)
    row = np.repeat(np.arange(len(h)), top)
    block = np.arange(len(row)) - np.repeat(np.cumsum(top) - top, top)
    low = np.where(block == 0, 0, 1 << np.maximum(block - 1, 0))
    size = np.maximum(low, 1)
    state = common.mix(h[row] + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    time = np.zeros(len(row))
    number = 0
    while len(row):
        number += 1
        draw = common.mix(state + np.uint64(number * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(_uniform(draw)) / (size * SLOTS)
        live = np.flatnonzero(time <= horizon[doc[row]])
        row, low, size, state, time = row[live], low[live], size[live], state[live], time[live]
        mark = common.mix(draw[live] + np.uint64(0xA0761D6478BD642F))
        # The event's unit of weight, uniform over the block; those beyond the element's weight don't count.
        unit = low + (_uniform(common.mix(mark ^ np.uint64(0xE7037ED1A0B428DB))) * size).astype(np.int64).clip(max=size - 1)
        ok = np.flatnonzero(unit < count[row])
        yield doc[row[ok]], time[ok], ((mark[ok] >> np.uint64(32)) * np.uint64(SLOTS) >> np.uint64(32)).astype(np.int64), mark[ok]


def signatures(h: np.ndarray, doc: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """A row of SLOTS marks for each of ``n`` texts; texts without elements get zeros."""
    marks = np.zeros((n, SLOTS), np.uint64)
    total = np.bincount(doc, weights=count, minlength=n)
    horizon = np.where(total > 0, (math.log(SLOTS) + SPAN) / np.maximum(total, 1), 0.0)
    todo = total > 0
    while todo.any():
        use = np.flatnonzero(todo[doc])
        best, mark_of = np.full(n * SLOTS, np.inf), np.zeros(n * SLOTS, np.uint64)
        for text, time, slot, mark in _events(h[use], doc[use], count[use], horizon):
            key = text * SLOTS + slot
            before = best[key]
            np.minimum.at(best, key, time)
            first = np.flatnonzero((time == best[key]) & (time < before))
            mark_of[key[first]] = mark[first]
        whole = todo & np.isfinite(best).reshape(n, SLOTS).all(axis=1)
        marks[whole] = mark_of.reshape(n, SLOTS)[whole]
        todo &= ~whole
        horizon = horizon * 2
    return marks


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By row: a key of its multiset (of the text itself where it has no words), its size, bands' hashes, a sketch."""
    for batch in batches:
        texts = common.strings(batch.column(1))
        for at, raw in common.slices(texts):
            n = len(raw)
            h, doc, count = multisets(*shingles(raw))
            marks = signatures(h, doc, count, n)
            mixed = [common.mix(common.mix(h + np.uint64(i)) * count.astype(np.uint64) + count.astype(np.uint64)) for i in (3, 5)]
            keys = np.zeros((n, 2), np.uint64)
            for i in (0, 1):
                np.add.at(keys[:, i], doc, mixed[i])
            total = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
            for i in np.flatnonzero(total == 0):
                keys[i] = np.frombuffer(hashlib.blake2b(raw[i], digest_size=16).digest(), np.uint64)
            bands = np.zeros((n, BANDS), np.uint64)
            for j in range(ROWS):
                bands = common.mix(bands * np.uint64(0x9FB21C651E98DF25) + marks[:, j::ROWS])
            bands[total == 0] = 0
            sketch = (marks & np.uint64(0xFFFF)).astype("<u2")
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(total > 0, BANDS, 0))]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, n), pa.array([f"{a:016x}{b:016x}" for a, b in keys.tolist()]), pa.array(total),
                 pa.ListArray.from_arrays(offsets, pa.array(bands[total > 0].reshape(-1).view(np.int64))), pa.array([x.tobytes() for x in sketch], pa.binary())],
                names=["id", "key", "size", "bands", "sketch"])


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of two texts' multisets of shingles."""
    h, doc, count = multisets(*shingles([a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")]))
    total = int(count.sum())
    order = np.argsort(h, kind="stable")
    h, doc, count = h[order], doc[order], count[order]
    both = np.flatnonzero(h[1:] == h[:-1]) if len(h) else np.zeros(0, np.int64)
    common_ = int(np.minimum(count[both], count[both + 1]).sum())
    return common_ / (total - common_) if total else float(a == b)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text of a, text of b) whose similarity reaches the threshold."""
    for batch in batches:
        left, right = common.strings(batch.column(2)), common.strings(batch.column(3))
        keep = [i for i in range(len(left)) if similarity(left[i], right[i]) >= THRESHOLD]
        yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sketch of a, sketch of b) that seem alike enough to compare."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SLOTS) for i in (2, 3))
        keep = np.flatnonzero((x == y).mean(axis=1) >= SEEMING)
        yield batch.select([0, 1]).take(pa.array(keep))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are near-duplicates. Only texts of some pair are moved.

    An identifier may be the first of very many pairs (a star's centre): its pairs are dealt out to as many parts as hold
    PART each, and its text goes to each of them.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int"))
    one = dealt.join(texts.withColumnRenamed("id", "b").withColumnRenamed("text", "tb"), "b")
    first = texts.withColumnRenamed("id", "a").withColumnRenamed("text", "ta").join(parts, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    both = one.join(first, ["a", "part"])
    return both.select("a", "b", "ta", "tb").mapInArrow(_compared, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """id and label (the least id of its component) of every id that ``links`` (a, b) has.

    Each round every node takes the least label among its neighbours and its own, and then its label's label, so labels
    travel twice as far each round; rounds end when none changes. Groups are aggregated by node, where Spark combines
    before it shuffles.
    """
    both = common.cut(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("id", "to"))
    label = common.cut(both.groupBy("id").agg(F.least("id", F.min("to")).alias("label")))
    while True:
        heard = both.join(label.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("label").alias("heard"))
        met = label.join(heard, "id").select("id", F.least("label", "heard").alias("new"), F.col("label").alias("old"))
        jump = label.select(F.col("id").alias("new"), F.col("label").alias("far"))
        step = common.cut(met.join(jump, "new", "left").select("id", F.coalesce("far", "new").alias("label"), "old"))
        label = step.select("id", "label")
        if step.where("label <> old").isEmpty():
            return label


def _prefix_pairs(held: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of different labels among classes (id, label, text), by prefix filter.

    Copies of a shingle count as elements of their own, so a multiset is a set. Two sets of sizes x and y reach similarity t
    only if they share t/(1+t)(x+y) elements, so in any common order their first elements up to that bound must meet: here
    the order is by how many of the texts have an element. A pair comes out only where the place of the shared element
    still allows the bound. For each element, only members that aren't of its largest label look for others.
    """

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in common.slices(common.strings(batch.column(2))):
                h, doc, count = multisets(*shingles(raw))
                rep = np.repeat(np.arange(len(h)), count)
                copy = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
                e = common.mix(h[rep] + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                total = np.bincount(doc[rep], minlength=len(raw))
                of = pa.array(doc[rep] + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(e.view(np.int64)), pa.array(total[doc[rep]].astype(np.int32))], names=["id", "label", "e", "size"])

    all_ = held.select("id", "label", "text").mapInArrow(elements, "id bigint, label bigint, e bigint, size int")
    seen = all_.groupBy("e").agg(F.count(F.lit(1)).alias("seen"))
    # Elements that one text alone has can't be shared; they only move the others back in the order.
    shared = all_.join(seen.where("seen > 1"), "e")
    t = THRESHOLD / (1 + THRESHOLD)
    listed = shared.groupBy("id", "label", "size").agg(F.array_sort(F.collect_list(F.struct("seen", "e"))).alias("es"))
    lead = F.col("size") - F.size("es")  # elements that no other text has come first
    # A partner is at most size/t long, at least size*t: the bound for the shortest one is the longest prefix.
    longest = F.col("size") - F.ceil(F.col("size") * THRESHOLD - 1e-9) + 1 - lead
    prefix = listed.where(longest > 0).select("id", "label", "size", F.posexplode(F.slice("es", F.lit(1), longest.cast("int"))).alias("place", "x"), lead.alias("lead"))
    prefix = common.cut(prefix.select("id", "label", "size", F.col("x.e").alias("e"), (F.col("place") + F.col("lead")).alias("place")))
    labels = prefix.groupBy("e", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = labels.groupBy("e").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "label"))["label"].alias("main")).where("k > 1").select("e", "main")
    live = prefix.join(mixed, "e")
    few = live.where("label <> main").select("e", *(F.col(c).alias(f"{c}1") for c in ("id", "label", "size", "place")))
    rest = live.select("e", "main", *(F.col(c).alias(f"{c}2") for c in ("id", "label", "size", "place")))
    fits = F.least(F.col("size1") - F.col("place1"), F.col("size2") - F.col("place2")) >= t * (F.col("size1") + F.col("size2")) - 1e-9
    once = (F.col("label2") == F.col("main")) | (F.col("id1") < F.col("id2"))
    found = few.join(rest, (few.e == rest.e) & (F.col("label1") != F.col("label2")) & fits & once)
    return found.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()


def _labelled(classes: DataFrame, found: DataFrame) -> DataFrame:
    return classes.join(found, "id", "left").withColumn("label", F.coalesce("label", "id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the least identifier of its group), class_size, kept.

    A group is a component of the relation "similarity of the shingles' multisets at least 0.8". Words are runs of
    letters and digits in lower case; texts of one to four words are one shingle; texts without words are alike if they are
    equal. Null texts count as empty. Rows with a null identifier are groups of one each. Rows that repeat an identifier
    are of one group, with all that any of their texts is alike to; ``kept`` is true for the rows whose identifier is
    class_id (and for null ones). Other columns aren't looked at; no rows give no rows.
    """
    common.tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = rows.mapInArrow(_signed, "id bigint, key string, size bigint, bands array<bigint>, sketch binary")
    member = common.cut(signed)
    # One class for each multiset, known by its least identifier.
    best = F.min(F.struct("id", "bands", "sketch"))
    classes = common.cut(member.where("id IS NOT NULL").groupBy("key").agg(best.alias("m"), F.count(F.lit(1)).alias("copies")).select("key", F.col("m.id").alias("id"), F.col("m.bands").alias("bands"), F.col("m.sketch").alias("sketch"), "copies"))
    texts = rows.where("id IS NOT NULL")
    dealt = classes.select("id", F.posexplode("bands").alias("band", "h"))
    full = dealt.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = common.cut(dealt.join(full, ["band", "h"]))
    # The star's centre is the member that shares most buckets with most others: copies gather around what they were made of.
    met = buckets.groupBy("id").agg(F.sum("n").alias("met"))
    placed = buckets.join(met, "id")
    first = placed.groupBy("band", "h").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("first"))
    stars = placed.select("band", "h", "id").join(first, ["band", "h"]).where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    sketch = classes.select("id", "sketch")
    likely = stars.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(_sketched, "a bigint, b bigint")
    near = common.cut(texts.join(buckets.select("id").distinct(), "id", "left_semi"))  # from here on only these texts are read
    links = common.cut(_verified(common.cut(likely), near))
    star = common.cut(_labelled(classes.select("key", "id", "copies"), components(links)))
    known = buckets.join(star.select("id", "label"), "id")
    ends = known.groupBy("band", "h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band", "h")
    open_ = known.join(ends, ["band", "h"], "left_semi").select("id", "label").distinct()
    held = common.cut(near.join(open_, "id"))
    joined = components(_bridges(common.cut(_prefix_pairs(held)), held)).toDF("label", "root")
    whole = star.join(joined, "label", "left").select("key", F.coalesce("root", "label").alias("label"), "copies")
    sizes = whole.groupBy("label").agg(F.sum("copies").alias("class_size"))
    classed = common.cut(whole.join(sizes, "label").select("key", "label", "class_size"))
    null = F.col("id").isNull()
    return member.select("id", "key").join(classed, "key", "left").select(
        F.col("id").alias("doc_id"), F.when(~null, F.col("label")).alias("class_id"), F.when(null, 1).otherwise(F.col("class_size")).cast("bigint").alias("class_size"),
        (null | (F.col("id") == F.col("label"))).alias("kept"))


def _bridges(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of labels (a, b) that some verified pair of their members links.

    One pair for each two labels is compared first; the others only where the labels are still apart after that. What is
    left of the links is one edge for two labels, however many members they have.
    """
    texts = held.select("id", "text")
    of = lambda c, n: held.select(F.col("id").alias(c), F.col("label").alias(n)).distinct()
    placed = common.cut(pairs.join(of("a", "la"), "a").join(of("b", "lb"), "b").select("a", "b", F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb")))
    edge = lambda found: placed.join(found, ["a", "b"], "left_semi").select("la", "lb").distinct()
    one = placed.groupBy("la", "lb").agg(F.min(F.struct("a", "b")).alias("p")).select("p.*")
    first = common.cut(edge(_verified(one, texts)))
    roots = components(first.toDF("a", "b"))
    up = lambda df, c: df.join(roots.toDF(c, f"r{c}"), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    rest = up(up(placed.join(one, ["a", "b"], "left_anti"), "la"), "lb").where("rla <> rlb").select("a", "b")
    second = edge(_verified(common.cut(rest), texts))
    return first.union(second).toDF("a", "b")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose identifier is their group's least, and those without one; all columns as they are."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*names.values())
    gone = near_duplicates(own, names[id_col], names[text_col]).where(~F.col("kept")).select(F.col("doc_id").alias(names[id_col])).distinct()
    return own.join(gone, names[id_col], "left_anti").toDF(*docs.columns)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their group of near-duplicates, as ``near_duplicates`` says of nulls, ties and repeated rows; an empty
    table gives no rows."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))

