"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other text is unlabelled, toxic or not.
A linear classifier over hashed words and stems is trained in numpy on the risk
``prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])``: the share of
toxic text that unlabelled text must hold is taken off its loss, and never below
zero, so that the classifier can't gain by calling hidden positives negative.

The fit uses bounded samples (``POSITIVES``, ``UNLABELLED`` documents with the least
hashes of their ids, both in training rows only) and returns at most ``FEATURES``
weights; every whole text is then scored where it lies.

Defined results: a null text is empty; each id is learned from once, however many rows
or labels it has (any toxic label makes it toxic, and of its texts one is chosen by
hash); null ids are never learned from; with no toxic label to learn from, every score is zero. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, texts

POSITIVES, UNLABELLED, FEATURES = 4000, 12_000, 512
#: Dimensions that words are hashed to.
BITS = 20
_CUT = bytes(c if chr(c).isalnum() or c > 127 or c == 39 else 32 for c in range(256))


#: Beginnings of words, in characters, that are features beside whole words: endings vary.
STEMS = (4, 5, 7)


def hashes(text: str) -> set[int]:
    """The distinct hashed words and stems of a text; punctuation and case don't count."""
    words = set(text.lower().encode().translate(_CUT).decode(errors="replace").split())
    parts = words.copy()
    for k in STEMS:
        parts.update(w[:k] + "-" for w in words if len(w) >= k)
    mask = (1 << BITS) - 1
    return {zlib.crc32(x.encode()) & mask for x in parts}


def hashed(text: str) -> np.ndarray:
    found = hashes(text)
    return np.sort(np.fromiter(found, np.int64, len(found)))


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def choose(p: np.ndarray, u: np.ndarray, n_pos: int, n_unl: int, most: int = FEATURES) -> np.ndarray:
    """The hashed words that positives hold most clearly more often than unlabelled text does, from how many rows hold each."""
    rate_p, rate_u = p / max(1, n_pos), (u + 0.5) / (n_unl + 1)
    pooled = (p + u + 0.5) / (n_pos + n_unl + 1)
    z = (rate_p - rate_u) / np.sqrt(pooled * (1 - pooled) * (1 / max(1, n_pos) + 1 / max(1, n_unl)) + 1e-12)
    chosen = np.argsort(-z, kind="stable")[:most]
    return np.sort(chosen[z[chosen] > 4])


def matrix(rows: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """A row of 0 and 1 for each text, by the chosen words it holds, and a last column of ones."""
    x = np.zeros((len(rows), len(chosen) + 1), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, np.searchsorted(chosen, np.intersect1d(r, chosen))] = 1
    return x


def _sigmoid(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of every row; in the matrix's own precision, so that it is not copied."""
    return 1 / (1 + np.exp(-(x @ w.astype(x.dtype)).astype(float)))


def risk(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float]:
    """(positive part, negative part before it is held at zero) of the risk with the sigmoid loss."""
    sp, su = _sigmoid(xp, w), _sigmoid(xu, w)
    return prior * float((1 - sp).mean()), float(su.mean()) - prior * float(sp.mean())


def gradient(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> np.ndarray:
    """Of the sum of both parts; where the negative part is below zero, that which brings it back up."""
    sp, su = _sigmoid(xp, w), _sigmoid(xu, w)
    slope = lambda x, p: x.T @ (p * (1 - p)).astype(x.dtype) / len(x)
    of_p, of_u = slope(xp, sp), slope(xu, su)
    negative = of_u - prior * of_p
    return -prior * of_p + negative if su.mean() >= prior * sp.mean() else -negative


def descend(xp: np.ndarray, xu: np.ndarray, prior: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """(weights, bias) by Adam."""
    w = np.zeros(xp.shape[1])
    w[-1] = -1.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        grad = gradient(w, xp, xu, prior)
        grad[:-1] += 1e-5 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


#: What a classifier is that has nothing to learn from.
NOTHING = (np.zeros(0, np.int64), np.zeros(0), -np.inf)


def _hashes(docs: DataFrame) -> DataFrame:
    """(positive, words): the hashed words of every text as 32-bit numbers."""

    def run(batches):
        for b in batches:
            words = [hashed(t).astype("<i4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary())], names=["positive", "words"])

    return docs.mapInArrow(run, "positive boolean, words binary")


def _held(batches):
    """How many positive and unlabelled rows hold each word, task by task."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for b in batches:
        for positive, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts[int(not positive)][np.frombuffer(words, "<i4")] += 1
    used = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])], names=["h", "p", "u"])


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """(hashed words, their weights, bias), from training rows of ``labels`` (doc_id, toxic) and of ``docs``.

    The driver receives at most 2^BITS counts, and of every sampled text the chosen words alone.
    """
    train = labels.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = train.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not prior:
        return NOTHING
    by_hash = F.xxhash64("doc_id")
    toxic = train.where("toxic = 1").select("doc_id").orderBy(by_hash).limit(positives)
    others = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).distinct().orderBy(by_hash).limit(unlabelled)
    asked = toxic.select("doc_id", F.lit(True).alias("positive")).union(others.select("doc_id", F.lit(False)))
    found = texts(docs).join(F.broadcast(asked), "doc_id")  # at most positives + unlabelled ids
    # of rows with one id, one text
    sample = found.groupBy("doc_id", "positive").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("positive", "text")
    rows = durable(_hashes(sample))
    counts = rows.mapInArrow(_held, "h long, p long, u long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()
    totals = {r["positive"]: r["count"] for r in rows.groupBy("positive").count().collect()}
    p, u = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    h = counts.column("h").to_numpy()
    p[h], u[h] = counts.column("p").to_numpy(), counts.column("u").to_numpy()
    chosen = choose(p, u, totals.get(True, 0), totals.get(False, 0))
    if not totals.get(True) or not totals.get(False) or not len(chosen):
        return NOTHING

    def reduce(batches):
        for b in batches:
            kept = [np.intersect1d(np.frombuffer(x, "<i4"), chosen).astype("<i4").tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary())], names=["positive", "words"])

    few = rows.mapInArrow(reduce, "positive boolean, words binary").toArrow()
    flags, words = few.column(0).to_pylist(), [np.frombuffer(x, "<i4").astype(np.int64) for x in few.column(1).to_pylist()]
    xp, xu = (matrix([x for x, f in zip(words, flags, strict=True) if f is k], chosen) for k in (True, False))
    return chosen, *descend(xp, xu, min(0.9, max(0.005, float(prior))))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    chosen, weights, bias = learn(docs, labels)
    model = dict(zip(chosen.tolist(), weights.tolist(), strict=True))  # at most FEATURES weights

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                out.append(bias + sum(map(model.__getitem__, hashes(t) & model.keys())))
            margin = np.clip(np.array(out, float), -700, 700)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(1 / (1 + np.exp(-margin)) if np.isfinite(bias) else np.zeros(len(out)))], names=["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
