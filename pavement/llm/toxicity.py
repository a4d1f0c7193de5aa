"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Presence of each hashed n-gram of a word (with its edges) is weighted by the
log ratio of its smoothed document counts in the two classes; a logistic
regression is fitted on the scaled features. Both use at most ``PER_CLASS``
labelled rows of each class, and never a held-out one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavement.llm.columns import arrow_struct, gram_hashes, with_struct
from pavement.llm.linear import Model, fit_logistic, fitted, folds, newton_logistic, sample_ids, slots, text_codes

BITS = 22
SIZES = (4, 5, 6)
#: Rows of each label that the classifier is fitted on, at most.
PER_CLASS = 2000
#: Log-count ratios nearer to zero than this say too little and are set to zero.
LEAST_RATIO = 1.0
HELD_OUT_OF = 5

FIELDS = [("score", pa.float64()), ("predicted", pa.int32())]


def held_out(id_: Column) -> Column:
    """Whether a row is never learned from: crc32 of the id as text is divisible by five (a null id: true)."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(True))


def grams(text: str) -> np.ndarray:
    """Slots of the character n-grams of a text, repeats included."""
    return slots(np.concatenate(gram_hashes(text_codes(text), SIZES)), BITS)


def raw_score(model: Model, text: str) -> float:
    """Sum of the weights of the distinct n-grams."""
    if len(model.weights) < 2:
        return 0.0
    at = grams(text)
    at = np.unique(at[model.weights[at] != 0])
    return float(model.weights[at].sum(dtype=np.float64))


def fit(texts: list[str], y: np.ndarray) -> Model:
    """Log-count ratios and weights, multiplied into one vector."""
    rows = [np.unique(grams(t)) for t in texts]

    def learn(use: np.ndarray) -> tuple[np.ndarray, float]:
        pos, neg = np.ones(1 << BITS, np.float32), np.ones(1 << BITS, np.float32)
        for i in np.flatnonzero(use):
            (pos if y[i] else neg)[rows[i]] += 1
        ratio = np.log(pos / (y[use].sum() + 2)) - np.log(neg / ((1 - y[use]).sum() + 2))
        ratio[(pos + neg <= 4) | (np.abs(ratio) < LEAST_RATIO)] = 0
        scaled = []
        for i in np.flatnonzero(use):
            at = rows[i][ratio[rows[i]] != 0]
            scaled.append((at, ratio[at].astype(np.float64)))
        w, b = fit_logistic(scaled, y[use], 1 << BITS, epochs=6, rate=0.05)
        return (w * ratio).astype(np.float32), b

    fold, held = folds(len(y), 2), np.zeros(len(y))
    for k in range(2):
        w, b = learn(fold != k)
        for i in np.flatnonzero(fold == k):
            held[i] = w[rows[i]].sum() + b
    w, b = learn(np.ones(len(y), bool))
    return Model(w, b, *newton_logistic(held, y)) if 0 < y.sum() < len(y) else Model(w, b)


def train(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", label: str = "toxic",
          per_class: int = PER_CLASS, seed: int = 5) -> Model:
    """A model from a bounded sample of the labelled rows that are not held out."""
    usable = labels.where(~held_out(F.col(f"`{id_}`")))
    return fitted(docs, sample_ids(usable, id_, label, per_class, seed), id_, text, fit)


def scored(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct (score, predicted) per row, and the struct's name.

    Null and empty texts get the score of a text without n-grams; repeated rows
    are scored alike; other columns pass through and are never read.
    """

    @F.arrow_udf("score double, predicted int")
    def score(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            p = model.probability(raw_score(model, t.as_py() or ""))
            rows.append((p, int(p >= 0.5)))
        return arrow_struct(FIELDS, rows)

    return with_struct(docs, text, score, "_toxicity")
