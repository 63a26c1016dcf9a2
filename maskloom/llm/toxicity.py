"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes
log-count ratios (NB-SVM features, logistic loss), trained on ``labels.toxic``.

1. Every labelled training text adds its distinct hashed n-grams to per-class
   document counts, summed over all partitions: the log-count ratios ``r``
   cover all training rows.  A ratio counts only where the two classes differ
   by ``MIN_Z`` pooled standard errors; the noise of tens of thousands of chance
   n-grams in a long text then adds nothing.
2. A logistic regression on the binary features times ``r`` is fitted on a
   bounded sample of the labelled rows: ``SAMPLE`` a class in expectation,
   chosen by a hash of the id; its intercept is corrected for the sampling.
3. Every text is scored over all its n-grams by tasks that hold the
   ``2 ** BITS`` weights (a fixed size).

Only ``text`` enters a score.  Rows whose crc32(doc_id as text) mod 4 is 2 are
held out of steps 1 and 2.  Nulls: a null or empty text has no n-grams and
gets the prior; a null doc_id is not held out and has no label; rows with a
null label are ignored, several labels of an id count as their largest.
Without any labels the score is the prior of the smoothing, 0.05.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import SpanHash, boxed, doc_bucket, lower_ascii, pieces, text_bytes, text_codes, unboxed

NGRAMS = (4, 6)
BITS = 18
SAMPLE = 4000
MIN_Z = 4.5
#: Features the model may use: those of the largest significance.
FEATURES = 1 << 13
THRESHOLD = 0.3
HELD_OUT = (4, 2)
_SIZE = 1 << BITS


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of every place, and the text each belongs to."""
    codes, at = text_codes(lower_ascii(data), offsets)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    spans = SpanHash(codes)
    ids, docs = [], []
    for n in NGRAMS:
        a = np.arange(max(0, len(codes) - n + 1))
        a = a[doc[a] == doc[a + n - 1]]
        ids.append((spans(a, a + n) >> np.uint64(64 - BITS)).astype(np.int32))
        docs.append(doc[a])
    return np.concatenate(ids), np.concatenate(docs)


def _distinct(ids: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(docs.astype(np.int64) << BITS | ids)
    return (key & (_SIZE - 1)).astype(np.int32), key >> BITS


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold each n-gram, over a whole partition."""
    counts = np.zeros((2, _SIZE), np.int64)
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        data, offsets = text_bytes(batch.column(0))
        for i, j in pieces(offsets):
            ids, docs = _distinct(*_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            for c in (0, 1):
                counts[c] += np.bincount(ids[toxic[i:j][docs] == c], minlength=_SIZE)
    i = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(counts[0][i]), pa.array(counts[1][i])], ["feature", "clean", "toxic"])


def _sample_batches(used: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            rows: list[np.ndarray] = []
            for i, j in pieces(offsets):
                ids, docs = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids, docs = _distinct(ids[used[ids]], docs[used[ids]])
                rows += np.split(ids, np.searchsorted(docs, np.arange(1, j - i)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "features"])

    return run


def _score_batches(model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        used = weights != 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(text_at))
            z = np.full(batch.num_rows, bias)
            for i, j in pieces(offsets):
                ids, docs = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids, docs = _distinct(ids[used[ids]], docs[used[ids]])
                z[i:j] += np.bincount(docs, weights[ids], minlength=j - i)
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "score"])

    return run


def log_count_ratios(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Smoothed log ratios of the per-class document rates, zero where not significant
    or not among the ``FEATURES`` most significant."""
    p, q = (toxic + 0.5) / (n_toxic + 1), (clean + 0.5) / (n_clean + 1)
    both = (toxic + clean + 1) / (n_toxic + n_clean + 2)
    z = (p - q) / np.sqrt(both * (1 - both) * (1 / (n_toxic + 1) + 1 / (n_clean + 1)))
    z = np.abs(z)
    least = max(MIN_Z, np.partition(z, -FEATURES)[-FEATURES])
    return np.where(z >= least, np.log(p / q), 0.0)


def _fit(size: np.ndarray, col: np.ndarray, y: np.ndarray, r: np.ndarray, l2: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled binary features ``col`` of rows of ``size`` features
    each (full-batch Adam); the weights returned include ``r``."""
    rows = len(size)
    used, col = np.unique(col, return_inverse=True)
    all_r, r = r, r[used]
    row, x = np.repeat(np.arange(rows), size), r[col]
    w, m, v = np.zeros(len(r) + 1), np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[col] * x, minlength=rows) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
        g = np.append(np.bincount(col, e[row] * x, minlength=len(r)) + l2 * w[:-1], e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    weights = np.zeros(len(all_r))
    weights[used] = w[:-1] * r
    return weights, float(w[-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(doc_bucket(doc_id, HELD_OUT[0]) == HELD_OUT[1], F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights of the hashed n-grams and the intercept."""
    known = (
        labels.where("toxic is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    known = stored(known, "toxicity_labels")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    rows = texts.join(known.hint("merge"), "doc_id")  # labels have no size bound: one plan at every size
    counts = rows.select("text", "toxic").mapInArrow(_count_batches, "feature int, clean long, toxic long")
    counts = counts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    total = {x["toxic"]: x["count"] for x in known.groupBy("toxic").count().collect()}
    n = [total.get(0, 0), total.get(1, 0)]
    bias = float(np.log((n[1] + 0.5) / (n[0] + 9.5)))
    if not all(n):
        return np.zeros(_SIZE), bias
    dense = np.zeros((2, _SIZE), np.int64)
    at = counts["feature"].to_numpy()
    dense[0][at], dense[1][at] = counts["clean"].to_numpy(), counts["toxic"].to_numpy()
    r = log_count_ratios(*dense, *n)
    share = [min(1.0, SAMPLE / x) for x in n]
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, share[1] * 1e6).otherwise(share[0] * 1e6)
    chosen = stored(known.where(pick), "toxicity_sample")  # some 2 * SAMPLE rows: small enough to go to the texts
    sample = texts.join(chosen, "doc_id").select("text", "toxic").mapInArrow(_sample_batches(r != 0), "toxic int, features array<int>").toArrow()
    if not sample.num_rows or len(sample["toxic"].unique()) < 2:
        return np.zeros(_SIZE), bias
    features = sample["features"].combine_chunks()
    w, b = _fit(np.diff(features.offsets.to_numpy()), features.values.to_numpy(), sample["toxic"].to_numpy(), r)
    return w, b + float(np.log(share[0] / share[1]))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with ``score`` in [0, 1]; extra columns pass through."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(_score_batches(sent, docs.columns.index("text")), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    s = score(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")), train(docs, labels))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, columns as they are."""
    return score(boxed(docs), train(docs, labels)).where(F.col("score") < THRESHOLD).transform(unboxed, docs)
