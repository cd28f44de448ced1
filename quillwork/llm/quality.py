"""Quality by logistic regression on hashed word n-grams, learned with follow-the-regularised-leader updates.

Tokens are words (case kept) and runs of punctuation. Features are single tokens, pairs, and triples of token shapes
(letter case, digits, punctuation, a repetition of the token before), hashed to 2**BITS places. A text's feature vector is
its counts divided by its tokens, so a score is a sparse dot product whose size doesn't depend on the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, learn

BITS, SCALE = 18, 12.0
ALPHA, BETA, L1, L2 = 0.15, 1.0, 0.002, 0.001
#: Passes over the sample, whatever its size.
EPOCHS = 6

_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~common.WORD


def _features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and text index of each n-gram; tokens of each text."""
    data, first = common.joined(raw)
    parts = [common.runs(k[data]) for k in (common.WORD, _MARK)]
    start, end = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    doc = np.searchsorted(first, start, side="right") - 1
    h = common.span_hashes(data, start, end)
    a, b = data[start], data[end - 1]
    upper = lambda x: (x >= 65) & (x <= 90)
    shape = np.select([_MARK[a], (a >= 48) & (a <= 57), upper(a) & upper(b) & (end - start > 1), upper(a), a >= 128], [1, 2, 3, 4, 5], 6).astype(np.uint64)
    shape[1:] += np.uint64(8) * ((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    pair, at2 = common.grams(h, doc, 2)
    triple, at3 = common.grams(shape + np.uint64(1), doc, 3)
    feature = np.concatenate([h, pair, triple]) >> np.uint64(64 - BITS)
    return feature.astype(np.int64), np.concatenate([doc, doc[at2], doc[at3]]), np.bincount(doc, minlength=len(raw))


def fit(texts: list[str], y: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias, by FTRL-proximal updates, text after text in an order drawn by a fixed seed."""
    size = 1 << BITS
    out = np.zeros(size + 1)
    if not len(texts):
        return out
    vectors: list[tuple[np.ndarray, np.ndarray]] = []
    for _, raw in common.slices(texts):
        feature, doc, n = _features(raw)
        key, count = np.unique(doc * size + feature, return_counts=True)
        cuts = np.searchsorted(key, np.arange(len(raw) + 1) * size)
        for i in range(len(raw)):
            k = slice(cuts[i], cuts[i + 1])
            vectors.append((np.append(key[k] - i * size, size), np.append(count[k] * (SCALE / max(1, n[i])), 1.0)))
    z, g2 = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in order.permutation(len(texts)):
            k, x = vectors[i]
            zk, nk = z[k], g2[k]
            root = np.sqrt(nk)
            w = np.where(np.abs(zk) <= L1, 0.0, -(zk - np.sign(zk) * L1) / ((BETA + root) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y[i]) * x
            z[k] = zk + g - (np.sqrt(nk + g * g) - root) / ALPHA * w
            g2[k] = nk + g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(g2)) / ALPHA + L2))


def scored(docs: DataFrame, weights: np.ndarray, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with score, 0 to 1.

    Null, empty and blank texts get the score of no features, that is of the bias. Rows are scored alone, repeated ones
    alike; no rows give no rows. Whole texts are read.
    """
    common.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for batch in batches:
            texts = common.strings(batch.column(batch.num_columns - 1))
            score = np.zeros(len(texts))
            for at, raw in common.slices(texts):
                feature, doc, n = _features(raw)
                dot = np.bincount(doc, weights=w[feature], minlength=len(raw)) * SCALE / np.maximum(1, n)
                score[at : at + len(raw)] = 1 / (1 + np.exp(-np.clip(dot + w[-1], -30, 30)))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], names=[*(f"k{i}" for i in range(len(kept))), "score"])

    inner = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("_text"))
    schema = ", ".join(f"k{i} {t}" for i, (_, t) in enumerate(docs.select(*keep).dtypes)) + ", score double"
    return inner.mapInArrow(run, schema).toDF(*keep, "score")


def model(docs: DataFrame, labels: DataFrame, sample: int = learn.SAMPLE) -> np.ndarray:
    """Weights learned from labelled rows whose crc32 of the identifier, modulo 4, isn't 2; ``sample`` of them at most."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return learn.fitted(learn.labelled(docs, labels, "quality", held, sample, even=False), fit)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. Null, empty and blank texts get the bias's score; a score of exactly 0.7 predicts 1; repeated
    rows score alike; an empty table gives no rows, one of labels scores of 0.5."""
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    common.tune(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = scored(docs, model(docs, labels), ["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
