"""Toxicity by multiple-instance learning.

A document is a bag of instances: its sentences, very short neighbours put together (else a text of thousands of one-word
sentences would look toxic by their number) and long ones cut to WINDOW words, so that an instance's evidence is bounded. An instance's probability is a logistic function of its hashed words; a document is toxic if any instance is,
so the document's probability is their noisy-or. Only documents have labels; the gradient of the noisy-or tells instances
apart, and an L1 step keeps the weights of words that tell nothing at zero. The fitted model then names sentences: of each
instance that is toxic, the whole sentence that says most for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, learn

BITS, WINDOW, MERGED = 20, 24, 12
#: Besides whole words, their beginnings of so many bytes are features: inflected and compound words share them.
HEADS = (4, 5, 6, 7, 8)
#: Labelled documents that a feature must be in to get a weight.
SUPPORT = 4
STEPS, RATE, L1, START = 200, 0.5, 3e-4, -8.0


@dataclass
class Bags:
    words: common.Words
    sentence: np.ndarray  # of each word
    feature: np.ndarray
    word: np.ndarray  # of each feature
    instance: np.ndarray  # of each word
    doc: np.ndarray  # of each instance
    first: np.ndarray  # first word of each instance


def _bags(raw: list[bytes]) -> Bags:
    w = common.word_table(raw)
    n = len(w.start)
    if not n:
        none = np.zeros(0, np.int64)
        return Bags(w, none, none, none, none, none, none)
    stop = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum((w.data == 46) | (w.data == 33) | (w.data == 63) | (w.data == 10), out=stop[1:])
    sentence = stop[w.start]
    head = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    # Sentences that begin within the same MERGED words of their text are one instance; what is longer is cut.
    text = np.searchsorted(w.doc, np.arange(len(raw)))
    bucket = (head - text[w.doc[head]]) // MERGED
    fresh = np.zeros(n, bool)
    fresh[head[np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (w.doc[head[1:]] != w.doc[head[:-1]])])]] = True
    head = np.flatnonzero(fresh)
    within = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
    fresh |= within % WINDOW == 0
    first = np.flatnonzero(fresh)
    hashes, word = [w.hash], [np.arange(n)]
    size = w.end - w.start
    for k in HEADS:
        long = np.flatnonzero(size > k)
        hashes.append(common.mix(common.span_hashes(w.data, w.start[long], w.start[long] + k) + np.uint64(k)))
        word.append(long)
    feature = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    return Bags(w, sentence, feature, np.concatenate(word), np.cumsum(fresh) - 1, w.doc[first], first)


def _instances(raw: list[bytes]) -> tuple[common.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words; each feature and its instance; each instance's text, and its first word."""
    b = _bags(raw)
    return b.words, b.feature, b.instance[b.word], b.doc, b.first


def _lowered(texts: list[str]) -> list[str]:
    """In small letters, with as many characters: the one capital that would become two is read as its plain letter."""
    return [t.replace("\u0130", "i").lower() for t in texts]


def _located(bags: Bags, raw: list[bytes], weights: np.ndarray, z: np.ndarray, over: np.ndarray, least: float) -> Iterator[tuple[int, int, int, float]]:
    """(text, start, end, score) of the offending sentences, in code points, by place: of each instance whose own score is
    ``least`` or more, and of the worst instance of each text that is ``over`` the bar as a whole, the sentence whose words add
    most to it."""
    w = bags.words
    worst = np.lexsort((-z, bags.doc))[np.searchsorted(bags.doc, np.unique(bags.doc))]
    bad = np.union1d(np.flatnonzero(z >= np.log(least / (1 - least))), worst[over[bags.doc[worst]]])
    if not len(bad):
        return
    said = np.zeros(len(w.start))
    np.add.at(said, bags.word, weights[bags.feature])
    last = np.append(bags.first[1:], len(w.start))
    best: dict[int, float] = {}  # by a sentence's first word; sentence numbers grow with place
    for i in bad:
        words = slice(bags.first[i], last[i])
        numbers, which = np.unique(bags.sentence[words], return_inverse=True)
        number = numbers[np.bincount(which, weights=said[words]).argmax()]
        head = int(np.searchsorted(bags.sentence, number))
        best[head] = max(best.get(head, 0.0), float(1 / (1 + np.exp(-z[i]))))
    before: dict[int, np.ndarray] = {}
    for head, score in sorted(best.items()):
        doc = int(w.doc[head])
        if doc not in before:
            before = {doc: np.concatenate([[0], np.cumsum((np.frombuffer(raw[doc], np.uint8) & 0xC0) != 0x80)])}
        tail = int(np.searchsorted(bags.sentence, bags.sentence[head], side="right")) - 1
        yield doc, int(before[doc][w.start[head] - w.first[doc]]), int(before[doc][w.end[tail] - w.first[doc]]), score


def fit(texts: list[str], y: np.ndarray) -> np.ndarray:
    """Weights of the features and, last, the bias; by proximal adaptive-gradient steps on the noisy-or's likelihood."""
    size = 1 << BITS
    weights = np.zeros(size + 1)
    weights[size] = START
    if not len(texts):
        return weights
    feature, instance, doc, n_inst = [], [], [], 0
    for at, raw in common.slices(_lowered(texts)):
        _, f, i, d, _ = _instances(raw)
        feature.append(f)
        instance.append(i + n_inst)
        doc.append(d + at)
        n_inst += len(d)
    feature, instance, doc = map(np.concatenate, (feature, instance, doc))
    # A word counts once in an instance.
    both = np.unique(instance * size + feature)
    instance, feature = both // size, both % size
    seen = np.unique(doc[instance] * size + feature) % size
    enough = np.bincount(seen, minlength=size) >= SUPPORT
    instance, feature = instance[enough[feature]], feature[enough[feature]]
    used, feature = np.unique(feature, return_inverse=True)
    w, bias = np.zeros(len(used)), START
    g2, b2 = np.full(len(used), 1e-6), 1e-6
    balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(STEPS):
        z = bias + np.bincount(instance, weights=w[feature], minlength=n_inst)
        miss = np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(y))  # -log P(no instance is toxic)
        # d loss / d miss: +1 for clean documents, -1/(exp(miss)-1) for toxic ones.
        slope = np.where(y > 0, -1 / np.expm1(np.clip(miss, 1e-6, 500)), 1.0) * balance
        dz = slope[doc] / (1 + np.exp(-z))
        gw, gb = np.bincount(feature, weights=dz[instance], minlength=len(used)), dz.sum()
        g2 += gw * gw
        b2 += gb * gb
        step = RATE / np.sqrt(g2)
        w -= step * gw
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * L1)
        bias -= RATE / np.sqrt(b2) * gb
    weights[used], weights[size] = w, bias
    return weights


def score_schema() -> str:
    return "score double, offending array<struct<start:bigint,end:bigint,score:double>>"


def scored(docs: DataFrame, weights: np.ndarray, keep: list[str], text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Columns ``keep`` of ``docs`` with score (0 to 1) and offending: whole sentences, as code points of the text from the
    first word to the end of the last, by place, each with the score of the instance that it offends in (``least`` or more; where
    only all instances together reach that, the worst one's sentence stands).

    Null and empty texts, and texts without words, have a document score of 0 and no sentences. Each row is scored alone,
    so repeated rows get equal scores; no rows give no rows. Whole texts are read, in slices of whole texts.
    """
    common.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS numbers
    kinds = [f"{c} {t}" for c, t in docs.select(*keep).dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        bias, w = w[-1], w[:-1]
        for batch in batches:
            texts = _lowered(common.strings(batch.column(batch.num_columns - 1)))
            score = np.zeros(len(texts))
            places: list[list[dict]] = [[] for _ in texts]
            for at, raw in common.slices(texts):
                bags = _bags(raw)
                instance, doc = bags.instance[bags.word], bags.doc
                if not len(doc):
                    continue
                live = np.flatnonzero(w[bags.feature])
                live = live[_first_of_pair(instance[live], bags.feature[live])]
                z = bias + np.bincount(instance[live], weights=w[bags.feature[live]], minlength=len(doc))
                score[at : at + len(raw)] = -np.expm1(-np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(raw)))
                for i, start, end, own in _located(bags, raw, w, z, score[at : at + len(raw)] >= least, least):
                    places[at + i].append({"start": start, "end": end, "score": own})
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.clip(score, 0, 1)), pa.array(places, kind)], names=[*(f"k{i}" for i in range(len(kept))), "score", "offending"])

    inner = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("_text"))
    schema = ", ".join(f"k{i} {k.split(' ', 1)[1]}" for i, k in enumerate(kinds)) + f", {score_schema()}"
    return inner.mapInArrow(run, schema).toDF(*keep, "score", "offending")


def _first_of_pair(instance: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Indices of the first word of each (instance, feature): a word counts once in an instance."""
    return np.unique(instance * (1 << BITS) + feature, return_index=True)[1]


def model(docs: DataFrame, labels: DataFrame, sample: int = learn.SAMPLE) -> np.ndarray:
    """Weights learned from labelled rows whose crc32 of the identifier, modulo 5, isn't 0; ``sample`` of them at most."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return learn.fitted(learn.labelled(docs, labels, "toxic", held, sample), fit)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents and their offending sentences. Null and empty texts score 0; a score of exactly 0.5 predicts 1;
    repeated rows score alike; an empty table of documents gives no rows, one of labels a model that scores nothing toxic."""
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    common.tune(spark)
    found = scored(docs, model(docs, labels), ["doc_id"])
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                        F.size("offending").cast("long").alias("n_offending"), F.array_join(F.transform("offending", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("offending"))
