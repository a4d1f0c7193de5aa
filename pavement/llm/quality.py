"""Quality rules: length and repetition first, then a calibrated classifier against fixed thresholds.

The classifier is logistic regression over hashed word and character n-grams,
fitted on at most ``PER_CLASS`` labelled rows of each class and calibrated on
folds it was not fitted on (Platt scaling). A text's score is its weights' mean
over all its n-grams, so no length is favoured and the whole text counts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavement.llm.columns import arrow_struct, gram_hashes, with_struct
from pavement.llm.linear import (Model, fit_logistic, fitted, folds, newton_logistic, sample_ids, slots, text_codes,
                                 word_codes)

BITS = 18
SCALE = 30.0
#: Rows of each label that the classifier is fitted on, at most.
PER_CLASS = 2000
#: Probability of good quality from which a document is kept.
KEEP = 0.3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_BLANK = "\x20\x09\x0A\x0B\x0C\x0D"
_SYMBOLS = "#*$%&|<>"

FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
          ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("probability", pa.float64())]
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, probability double")


def features(text: str) -> np.ndarray:
    """Slots of all word 1- and 2-grams and character 3-grams of a text, repeats included.

    Words are hashed in lower case; letters keep their case, so shouting shows.
    """
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    words = word_codes(text_codes(text))
    return slots(np.concatenate([*gram_hashes(words, (1, 2), 1), *gram_hashes(raw, (3,), 2)]), BITS)


def _row(text: str) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(features(text), return_counts=True)
    return at, n * (SCALE / max(n.sum(), 1))


def raw_score(model: Model, text: str) -> float:
    at = features(text)
    return float(model.weights[at].mean(dtype=np.float64) * SCALE) if len(at) and len(model.weights) > 1 else 0.0


def fit(texts: list[str], y: np.ndarray) -> Model:
    """Weights from all rows; the curve from score to probability from rows left out in turn."""
    rows, fold, held = [_row(t) for t in texts], folds(len(y)), np.zeros(len(y))
    for k in range(4):
        inside = fold != k
        w, b = fit_logistic([r for r, use in zip(rows, inside) if use], y[inside], 1 << BITS)
        for i in np.flatnonzero(~inside):
            held[i] = rows[i][1] @ w[rows[i][0]] + b
    w, b = fit_logistic(rows, y, 1 << BITS)
    return Model(w, b, *newton_logistic(held, y)) if 0 < y.sum() < len(y) else Model(w, b)


def train(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", label: str = "quality",
          per_class: int = PER_CLASS, seed: int = 3) -> Model:
    """A model from a bounded sample of the labelled rows."""
    return fitted(docs, sample_ids(labels, id_, label, per_class, seed), id_, text, fit)


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    words = text.encode("utf-8").split()  # bytes split at the six ASCII white spaces of the rule only
    n = len(words)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(_BLANK):
            seen.add(line)
    repeat = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:]))
        if len(set(grams)) < len(grams):
            times = Counter(grams)
            upto = 0  # words before this one are counted already
            for i, g in enumerate(grams):
                if times[g] > 1:
                    repeat += i + 3 - max(i, upto)
                    upto = i + 3
    return n, len(text) - sum(map(text.count, _BLANK)), sum(map(text.count, _SYMBOLS)), dup, repeat


def judged(docs: DataFrame, model: Model, text: str = "text", keep: float = KEEP) -> tuple[DataFrame, str]:
    """``docs`` with a struct (counts, base_failed, kept, probability) per row, and the struct's name.

    Null and empty texts have no words, fail the base rule and are not kept;
    repeated rows are judged alike; other columns pass through.
    """

    @F.arrow_udf(SCHEMA)
    def judge(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            s = t.as_py() or ""
            c = counts(s)
            failed = c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEAT_PERCENT * c[0]
            p = model.probability(raw_score(model, s))
            rows.append((*c, failed, not failed and p >= keep, p))
        return arrow_struct(FIELDS, rows)

    return with_struct(docs, text, judge, "_quality")


def good_documents(docs: DataFrame, model: Model, text: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they are."""
    found, name = judged(docs, model, text, keep)
    return found.where(F.col(f"{name}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
