"""Toxicity: a character n-gram linear classifier with features scaled by naive Bayes log-count ratios.

Features of a text are the distinct hashed n-grams (3 to 5 characters) of its lower-cased form. Each
is scaled by its log-count ratio between toxic and clean training texts; a logistic regression over
the scaled features is trained by full-batch gradient steps with an L2 penalty.

It learns from a bounded sample: about ``SAMPLE[c]`` labelled rows of class c, chosen by a hash of the
id, whose texts have at most ``LONGEST`` characters. Scoring reads every whole text in one pass.

Defined results: null text counts as empty; an empty text gets the score of the intercept; with no
rows of a class to learn from, every score is 0; null ids or labels are never learned from and are not
held out; different labels of one document all count, equal ones once; repeated rows give repeated rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS, SIZES = 20, (3, 4, 5)
SAMPLE, LONGEST, SEED = (3000, 1500), 20_000, 17
STEPS, RATE, PENALTY, SMOOTH, LEAST = 60, 0.5, 1e-3, 1.0, 3


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the text's n-grams; texts of any length, a slice of bounded size at a time."""
    text = f" {(text or '').lower()} "
    found, step = [], 1 << 20
    for at in range(0, len(text), step):
        a = np.frombuffer(text[at : at + step + max(SIZES) - 1].encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(0x9E3779B1)
        own = [np.zeros(0, np.uint32)]
        for n in (n for n in SIZES if n <= len(a)):
            h = np.full(len(a) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h ^ a[i : len(a) - n + 1 + i]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
            own.append(h >> np.uint32(32 - BITS))
        h = np.sort(np.concatenate(own))
        found.append(h[np.flatnonzero(np.diff(h, prepend=-1))] if len(h) else h)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


class Model:
    """``weights`` by bucket, and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[features(text)].sum(dtype=np.float64), -50, 50))))


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    y = np.array(toxic, np.float64)
    if not (0 < y.sum() < len(y)):
        return Model(np.zeros(1 << BITS, np.float32), -50.0)
    rows = [features(t) for t in texts]
    flat, size = np.concatenate(rows), 1 << BITS
    in_toxic = np.bincount(np.concatenate([r for r, t in zip(rows, toxic, strict=True) if t]), minlength=size)
    in_clean = np.bincount(flat, minlength=size) - in_toxic
    p, q = in_toxic + SMOOTH, in_clean + SMOOTH
    ratio = np.log((p / (y.sum() + 2 * SMOOTH)) / (q / ((1 - y).sum() + 2 * SMOOTH)))
    ratio[in_toxic + in_clean < LEAST] = 0  # too rare to tell
    keep = np.abs(ratio) > 1.0
    remap = np.cumsum(keep) - 1
    kept = [remap[r[keep[r]]] for r in rows]
    flat, lengths = np.concatenate(kept), np.array([len(r) for r in kept])
    doc, scale = np.repeat(np.arange(len(kept)), lengths), ratio[keep]
    norm = 1 / np.sqrt(np.maximum(1, np.bincount(doc, scale[flat] ** 2, len(kept))).mean())
    value, beta, bias = scale[flat] * norm, np.zeros(len(scale)), 0.0
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) / len(y)
    m = [np.zeros_like(beta), np.zeros_like(beta), 0.0, 0.0]
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(doc, value * beta[flat], len(kept))
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        grad, gb = np.bincount(flat, value * g[doc], len(beta)) + PENALTY * beta / len(y), g.sum()
        m = [0.9 * m[0] + 0.1 * grad, 0.99 * m[1] + 0.01 * grad**2, 0.9 * m[2] + 0.1 * gb, 0.99 * m[3] + 0.01 * gb**2]
        rate = RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        beta -= rate * m[0] / (np.sqrt(m[1]) + 1e-6) * 0.1
        bias -= rate * m[2] / (np.sqrt(m[3]) + 1e-6) * 0.1
    weights = np.zeros(size, np.float32)
    weights[keep] = beta * scale * norm
    return Model(weights, bias)


def learn(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    """Train on ``docs(doc_id, text)`` labelled by ``labels(doc_id, toxic)``, but for held-out ids.

    Labels are counted by class first; then a threshold on a hash of the id lets about ``sample[c]`` of each
    class c through, so what is broadcast and collected has a bound that doesn't grow with the tables.
    """
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out("doc_id")).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return fit([], [])
    share = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.where(share < F.when(F.col("toxic") == 1, sample[1] / counts[1]).otherwise(sample[0] / counts[0]))
    held = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST).join(F.broadcast(chosen.distinct()), "doc_id")
    # however often an id is repeated, one text of it comes to the driver for each label
    rows = held.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "toxic", "text").collect()
    rows.sort(key=lambda r: (r[0], r[1], r[2] or ""))
    return fit([r[2] for r in rows], [r[1] for r in rows])


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` (0 to 1) of every whole text; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.released(run), "doc_id long, score double")


def reject(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text scores below ``least``; one pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t.as_py()) < least for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(common.released(run), docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    model = learn(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
