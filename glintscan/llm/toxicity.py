"""Toxicity by a linear classifier over character n-grams scaled with naive Bayes log-count ratios.

A text is lower-cased and its white space becomes single spaces. Its distinct n-grams (``SIZES`` characters, across
words) fall into hash buckets. For each bucket, the logarithm of the ratio of its rates among toxic and clean documents scales
its presence; a logistic regression on the scaled features gives the score. Buckets of a few documents and those with a
small ratio are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import staged

SIZES = (3, 4, 5)
BITS = 20
#: Most documents of each class that the model is fitted on, the ones with the smallest hash of their id.
MAX_TOXIC, MAX_CLEAN = 1_500, 3_000
MIN_DOCS = 4
MIN_RATIO = 1.5
STEPS = 300
PENALTY = 1e-4
THRESHOLD = 0.7
FACTOR = np.uint64(0x9E3779B97F4A7C15)
WINDOW = 200_000


def buckets(text: str) -> np.ndarray:
    """The distinct buckets of a text; a long one is taken in windows that overlap by the longest n-gram."""
    clean = " " + " ".join(text.lower().split()) + " "
    parts = [_window(clean[at:at + WINDOW + SIZES[-1] - 1]) for at in range(0, len(clean), WINDOW)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _window(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    found, gram = [], codes
    for size in range(2, SIZES[-1] + 1):
        gram = (gram[:-1] ^ (gram[:-1] >> np.uint64(29))) * FACTOR + codes[size - 1:] if len(gram) > 1 else gram[:0]
        if size in SIZES:
            found.append(((gram * FACTOR) >> np.uint64(64 - BITS)).astype(np.uint32))
    return np.unique(np.concatenate(found))


def fit(features: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """A weight for every bucket (0: not used) and the bias."""
    size = 1 << BITS
    y = toxic.astype(np.float64)
    if not 0 < y.sum() < len(y):  # nothing to tell apart
        return np.zeros(size, np.float32), -4.0 if not y.sum() else 4.0
    lengths = np.array([len(f) for f in features])
    flat = np.concatenate(features)
    of = np.repeat(np.arange(len(y)), lengths)
    bad = np.bincount(flat[y[of] == 1], minlength=size)
    good = np.bincount(flat[y[of] == 0], minlength=size)
    ratio = np.log((bad + 1) / (y.sum() + 2)) - np.log((good + 1) / ((1 - y).sum() + 2))
    used = (bad + good >= MIN_DOCS) & (np.abs(ratio) >= MIN_RATIO)
    keep = used[flat]
    flat, of = flat[keep], of[keep]
    number = np.cumsum(used) - 1
    column, value = number[flat], ratio[flat]
    n = int(used.sum())
    # Accelerated gradient descent; the step follows from the largest row.
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    rows = np.bincount(of, value * value, len(y)) + 1
    step = 1 / (0.25 * (each * rows).sum() + PENALTY)
    w, b = np.zeros(n), 0.0
    w_old, b_old = w, b
    for k in range(STEPS):
        ahead = k / (k + 3)
        v, c = w + ahead * (w - w_old), b + ahead * (b - b_old)
        score = np.bincount(of, v[column] * value, len(y)) + c
        error = each * (1 / (1 + np.exp(-np.clip(score, -50, 50))) - y)
        w_old, b_old = w, b
        w = v - step * (np.bincount(column, error[of] * value, n) + PENALTY * v)
        b = c - step * error.sum()
    weights = np.zeros(size, np.float32)
    weights[used] = (w * ratio[used]).astype(np.float32)
    return weights, float(b)


def score(text: str, weights: np.ndarray, bias: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(weights[buckets(text)].sum(dtype=np.float64) + bias, -50, 50))))


def held_out(id_column: str = "doc_id"):
    """True for the third of the ids whose labels no model learns; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[np.ndarray, float]:
    """Weights and bias, from at most ``max_toxic`` and ``max_clean`` labelled documents that are not held out.

    Several labels of one id count as toxic if one says so; null labels are ignored. Only the chosen ids (a bounded
    table) are broadcast, one task fits the model, and the driver gets its used weights.
    """
    known = labels.filter(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = staged(known.filter("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(
        known.filter("toxic <> 1").orderBy(*order).limit(max_clean)).withColumnRenamed("doc_id", "label_id"))
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    sample = sample.select((F.col("toxic") == 1).cast("int").alias("toxic"), "text")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("toxic"), pa.array([buckets(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["toxic", "buckets"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, features = [], []
        for batch in batches:
            toxic += batch.column("toxic").to_pylist()
            features += [np.frombuffer(b, "<u4") for b in batch.column("buckets").to_pylist()]
        if features:
            weights, bias = fit(features, np.array(toxic))
            used = np.flatnonzero(weights).astype("<u4")
            yield pa.record_batch([pa.array([used.tobytes()], pa.binary()), pa.array([weights[used].tobytes()], pa.binary()), pa.array([bias])], ["used", "weights", "bias"])

    rows = sample.mapInArrow(featurize, "toxic int, buckets binary").repartition(1).sortWithinPartitions("toxic", F.xxhash64("buckets"))
    model = rows.mapInArrow(learn, "used binary, weights binary, bias double").collect()  # one row
    weights = np.zeros(1 << BITS, np.float32)
    if not model:
        return weights, -4.0
    weights[np.frombuffer(model[0]["used"], "<u4")] = np.frombuffer(model[0]["weights"], "<f4")
    return weights, model[0]["bias"]


def classify(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """``doc_id`` and ``score`` of every row; a null text is empty, other columns are ignored."""
    used = np.flatnonzero(weights)
    values = weights[used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS, np.float32)
        table[used] = values
        for batch in batches:
            scores = [score(t, table, bias) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score`` and ``predicted``.

    ``docs`` has ``doc_id`` and ``text``; ``labels`` has ``doc_id`` and ``toxic`` and is read for training only, without
    the held-out third. Equal texts get equal scores. Without labels of both classes every score is the same.
    """
    scored = classify(docs, *train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
