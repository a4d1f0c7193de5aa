"""Linear text classifiers on hashed n-grams, fitted on a bounded sample of labelled rows.

The sample (at most ``per_class`` rows of each label, those with the smallest
seeded md5 of their id) is fitted in one Spark task with numpy; its size does
not grow with the corpus. Only the weights, a vector of fixed length, come back
to the driver and travel to the executors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavement.llm.columns import order_key


@dataclass
class Model:
    """Weights over hashed features, with the map from score to probability (a * score + b, then logistic)."""

    weights: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def probability(self, score: float) -> float:
        z = self.a * (score + self.bias) + self.b
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def text_codes(text: str) -> np.ndarray:
    """Lower-cased code points as uint64, runs of white space as one space, with a space at both ends."""
    plain = " " + " ".join(text.lower().split()) + " "
    return np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def word_codes(codes: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word of ``text_codes``: an order-dependent sum over its characters."""
    gap = np.flatnonzero(codes == 32)
    starts, ends = gap[:-1] + 1, gap[1:]
    starts, ends = starts[ends > starts], ends[ends > starts]
    if not len(starts):
        return np.empty(0, np.uint64)
    at = np.arange(len(codes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        first = np.zeros(len(codes), np.uint64)
        first[starts] = starts.astype(np.uint64)
        place = at - np.maximum.accumulate(first)
        mixed = (codes + np.uint64(0x51ED27) * (place + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed[codes == 32] = 0
        total = np.concatenate(([np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)))
        return total[ends] - total[starts]


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def sample_ids(labels: DataFrame, id_: str, label: str, per_class: int, seed: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, those with the smallest seeded md5."""
    parts = [labels.where(F.col(label) == value).select(F.col(id_).alias("_id"), F.col(label).cast("int").alias("_y"))
             .orderBy(order_key(F.col("_id"), seed)).limit(per_class) for value in (0, 1)]
    return parts[0].union(parts[1])


def newton_logistic(score: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt scaling: a and b of the logistic curve of one score, with smoothed targets."""
    spread = float(np.std(score)) or 1.0
    s = np.asarray(score, float) / spread
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(a: float, b: float) -> float:
        z = a * s + b
        return float((np.logaddexp(0, z) - t * z).sum())

    a, b, now = 1.0, 0.0, loss(1.0, 0.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - t) * s).sum(), (p - t).sum()])
        d = np.linalg.solve(np.array([[(w * s * s).sum(), (w * s).sum()], [(w * s).sum(), w.sum()]]) + 1e-6 * np.eye(2), g)
        step = 1.0
        while step > 1e-6 and loss(a - step * d[0], b - step * d[1]) > now:
            step /= 2
        a, b = a - step * d[0], b - step * d[1]
        better = loss(a, b)
        if now - better < 1e-9:
            break
        now = better
    return float(max(a, 1e-3)) / spread, float(b)


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, epochs: int = 8,
                 rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad over sparse rows (slots, values); both classes weigh the same."""
    w, seen, bias, seen_b = np.zeros(size), np.full(size, 1e-6), 0.0, 1e-6
    if not len(y):
        return w.astype(np.float32), 0.0
    weight = np.where(y > 0, len(y) / 2 / max(y.sum(), 1), len(y) / 2 / max((1 - y).sum(), 1))
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(y)):
            at, v = rows[i]
            p = 1 / (1 + np.exp(-np.clip(v @ w[at] + bias, -40, 40)))
            g = (p - y[i]) * weight[i]
            step = g * v + decay * w[at]
            seen[at] += step * step
            w[at] -= rate * step / np.sqrt(seen[at])
            seen_b += g * g
            bias -= rate * g / np.sqrt(seen_b)
    return w.astype(np.float32), float(bias)


def fitted(docs: DataFrame, picked: DataFrame, id_: str, text: str, fit: Callable) -> Model:
    """``fit(texts, y)`` over the picked rows of ``docs``, in one task; the picked ids are a bounded sample.

    Rows with a null text take part as empty texts. Of rows that share an id, the one whose id and text have
    the smallest md5 takes part, so that the sample is bounded in rows. Without any labelled row the model is
    all zeros.
    """
    sample = (docs.select(F.col(f"`{id_}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
              .join(F.broadcast(picked), "_id").withColumn("_k", F.md5(F.concat(F.col("_id").cast("string"), F.lit("|"), F.col("_t"))))
              .groupBy("_id", "_y").agg(F.min_by("_t", "_k").alias("_t"), F.min("_k").alias("_k")).withColumn("_g", F.lit(0)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k", kind="stable")
        m = fit(pdf["_t"].tolist(), pdf["_y"].to_numpy(float))
        used = np.flatnonzero(m.weights)
        return pd.DataFrame({"slots": [used.astype("<i4").tobytes()], "weights": [m.weights[used].astype("<f4").tobytes()],
                             "size": [len(m.weights)], "bias": [m.bias], "a": [m.a], "b": [m.b]})

    got = (sample.groupBy("_g").applyInPandas(
        run, "slots binary, weights binary, size int, bias double, a double, b double").collect())
    if not got:
        return Model(np.zeros(1, np.float32), 0.0)
    r = got[0]
    w = np.zeros(r["size"], np.float32)
    w[np.frombuffer(r["slots"], "<i4")] = np.frombuffer(r["weights"], "<f4")
    return Model(w, r["bias"], r["a"], r["b"])


def folds(n: int, k: int = 4) -> np.ndarray:
    """Fold number of each of n rows in their (hashed) order."""
    return np.arange(n) % k
