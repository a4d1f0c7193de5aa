"""A small network trained data-parallel: regression, adversarial training and attributions.

Rows are dealt to blocks by a digest of their id and kept as one written row per
block, so a block is the same on any number of partitions. A step reads the blocks of
its turn only; every block is a batch of its own, with its own batch statistics and
dropout masks seeded by (seed, step, block). Its gradients are rounded to a fixed
step (2 ** -40) and added as whole numbers, so the order of the additions does not
matter: the weights are the same bit for bit on one partition and on a thousand.
What goes to the driver is one sum per step, as long as the weights.

The weights are plain arrays on the driver; scoring and attribution run in Arrow
batches with the arrays in the closure.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavement.operators.learning import batch_score
from pavement.plans.storage import written

UNIT = 1 << 40
NORM_EPS, KEEP = 1e-5, 0.9


@dataclass
class Network:
    """Dense layers with batch normalisation, rectifier and dropout; one number out, and class scores of a second head."""

    weights: dict[str, np.ndarray]
    hidden: tuple[int, ...]
    drop: tuple[float, ...]
    classes: list = field(default_factory=list)
    features: str = "tabular"
    history: list[dict] = field(default_factory=list)

    @classmethod
    def fresh(cls, width: int, hidden: tuple[int, ...] = (256, 128, 64), drop: tuple[float, ...] = (0.3, 0.2, 0.1),
              classes: list | None = None, class_hidden: int = 64, seed: int = 42, features: str = "tabular") -> Network:
        """Random weights (uniform, by fan-in) from the seed; ``classes`` adds the second head."""
        rng, weights = np.random.default_rng(seed), {}

        def dense(name: str, before: int, after: int) -> None:
            limit = 1 / math.sqrt(before)
            weights[f"{name}.w"] = rng.uniform(-limit, limit, (before, after))
            weights[f"{name}.b"] = rng.uniform(-limit, limit, after)

        sizes = [width, *hidden]
        for k, (a, b) in enumerate(zip(sizes, sizes[1:])):
            dense(f"l{k}", a, b)
            weights |= {f"l{k}.scale": np.ones(b), f"l{k}.shift": np.zeros(b), f"l{k}.mean": np.zeros(b), f"l{k}.var": np.ones(b)}
        dense("out", sizes[-1], 1)
        if classes:
            dense("c0", sizes[-1], class_hidden)
            dense("c1", class_hidden, len(classes))
        return cls(weights, tuple(hidden), tuple(drop), list(classes or []), features)

    # ---- one batch ------------------------------------------------------------------------

    def forward(self, x: np.ndarray, masks: list[np.ndarray] | None = None, train: bool = False):
        """(values, class scores or None, what ``backward`` needs). In training, statistics are those of the batch."""
        w, tape, h = self.weights, [], x
        for k in range(len(self.hidden)):
            z = h @ w[f"l{k}.w"] + w[f"l{k}.b"]
            mean, var = (z.mean(axis=0), z.var(axis=0)) if train else (w[f"l{k}.mean"], w[f"l{k}.var"])
            spread = np.sqrt(var + NORM_EPS)
            unit = (z - mean) / spread
            y = unit * w[f"l{k}.scale"] + w[f"l{k}.shift"]
            mask = (y > 0).astype(float)
            if masks is not None:
                mask = mask * masks[k]
            tape.append((h, unit, spread, mask, mean, var))
            h = y * mask
        value = (h @ w["out.w"] + w["out.b"])[:, 0]
        scores, inner = None, None
        if self.classes:
            inner = np.maximum(h @ w["c0.w"] + w["c0.b"], 0)
            scores = inner @ w["c1.w"] + w["c1.b"]
        return value, scores, (tape, h, inner, train)

    def backward(self, kept, d_value: np.ndarray, d_scores: np.ndarray | None = None, reverse: float = 0.0):
        """(gradients by name, gradient of the input). The second head's gradient enters the trunk times ``-reverse``."""
        w, (tape, top, inner, train) = self.weights, kept
        grads = {"out.w": top.T @ d_value[:, None], "out.b": np.array([d_value.sum()])}
        d = d_value[:, None] @ w["out.w"].T
        if d_scores is not None:
            grads |= {"c1.w": inner.T @ d_scores, "c1.b": d_scores.sum(axis=0)}
            d_inner = (d_scores @ w["c1.w"].T) * (inner > 0)
            grads |= {"c0.w": top.T @ d_inner, "c0.b": d_inner.sum(axis=0)}
            d = d - reverse * (d_inner @ w["c0.w"].T)
        for k in reversed(range(len(self.hidden))):
            before, unit, spread, mask, _, _ = tape[k]
            d = d * mask
            grads |= {f"l{k}.scale": (d * unit).sum(axis=0), f"l{k}.shift": d.sum(axis=0)}
            d = d * w[f"l{k}.scale"] / spread
            if train:  # the batch's mean and variance depend on every row
                d = d - d.mean(axis=0) - unit * (d * unit).mean(axis=0)
            grads |= {f"l{k}.w": before.T @ d, f"l{k}.b": d.sum(axis=0)}
            d = d @ w[f"l{k}.w"].T
        return grads, d

    def masks(self, n: int, key: tuple[int, ...]) -> list[np.ndarray]:
        """Inverted dropout masks, drawn from the key."""
        rng = np.random.default_rng(list(key))
        return [(rng.random((n, size)) >= p) / (1 - p) for size, p in zip(self.hidden, self.drop)]

    def input_gradient(self, x: np.ndarray) -> np.ndarray:
        """Derivative of the value by each feature, per row."""
        value, _, kept = self.forward(x)
        return self.backward(kept, np.ones(len(value)))[1]

    # ---- tables ---------------------------------------------------------------------------

    def transform(self, df: DataFrame, out: str = "z_pred") -> DataFrame:
        """Values of every row, from its feature array."""
        return batch_score(df, lambda: lambda batch: self.forward(np.asarray(batch, float))[0], self.features,
                           self.weights["l0.w" if self.hidden else "out.w"].shape[0], 1024, out)

    def told(self, df: DataFrame, out: str = "told") -> DataFrame:
        """The class that the second head finds most likely."""
        names = [str(c) for c in self.classes]

        @F.pandas_udf("string")
        def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([names[k] for k in self.forward(np.stack(batch))[1].argmax(axis=1)] if len(batch) else [], dtype=object)

        return df.withColumn(out, best(F.col(self.features).cast("array<double>")))


def _blocks(df: DataFrame, id_: str, features: str, label: str, target: str | None, classes: list, batch: int,
            steps: int | None) -> tuple[DataFrame, int]:
    """(step, block, n, x, y, t): one written row per batch, and the number of steps of an epoch.

    Rows without features or label are left out. Rows are ordered within a block by
    their digest, so that a block is always the same. Blocks are dealt by a digest
    of the id: about ``batch`` rows each, whatever the number of rows.
    """
    usable = df.where(F.col(features).isNotNull() & F.col(label).isNotNull())
    number = F.lit(0) if target is None else (F.coalesce(F.array_position(F.array(*[F.lit(str(c)) for c in classes]),
                                                                          F.col(target).cast("string")), F.lit(0)) - 1).cast("int")
    key = F.xxhash64(F.col(id_).cast("string"), F.lit(17))
    rows = usable.select(key.alias("_key"), F.md5(F.concat_ws(":", F.col(id_).cast("string"), F.to_json(F.struct(features, label)))).alias("_tie"),
                         F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), number.alias("t"))
    total = max(1, usable.count() // batch)
    steps = max(1, min(steps or max(1, total // 8), total))
    grouped = (rows.groupBy(F.pmod("_key", F.lit(total)).alias("block"))
               .agg(F.array_sort(F.collect_list(F.struct("_key", "_tie", "x", "y", "t"))).alias("_rows")))

    @F.arrow_udf("struct<n:int,x:binary,y:binary,t:binary>")
    def packed(groups: pa.Array) -> pa.Array:
        rows = []
        for g in groups:
            v = g.values
            x = np.array(v.field("x").to_pylist(), float)
            rows.append((len(v), x.tobytes(), v.field("y").to_numpy(zero_copy_only=False).tobytes(),
                         v.field("t").to_numpy(zero_copy_only=False).astype("<i4").tobytes()))
        columns = list(zip(*rows)) or [()] * 4
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
                                          names=["n", "x", "y", "t"])

    out = grouped.select((F.col("block") % steps).cast("int").alias("step"), "block", packed("_rows").alias("_b")).select("step", "block", "_b.*")
    return written(out.sortWithinPartitions("step")), steps


def _losses(model: Network, x, y, t, masks, reverse: float, train: bool):
    """Huber loss of the values, cross-entropy of the classes, hits, and the gradients (all as sums over rows)."""
    value, scores, kept = model.forward(x, masks, train)
    gap = value - y
    loss = np.where(np.abs(gap) <= 1, 0.5 * gap * gap, np.abs(gap) - 0.5).sum()
    d_scores, cross, hits = None, 0.0, 0
    if scores is not None:
        known = t >= 0
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        rows = np.flatnonzero(known)
        cross = -np.log(np.maximum(p[rows, t[rows]], 1e-300)).sum()
        hits = int((p.argmax(axis=1) == t)[known].sum())
        d_scores = p * known[:, None]
        d_scores[rows, t[rows]] -= 1
    grads = model.backward(kept, np.clip(gap, -1, 1), d_scores, reverse)[0] if train else None
    return loss, cross, hits, grads, kept


def _pass(model: Network, blocks: DataFrame, key: tuple[int, ...] | None, reverse: float) -> dict:
    """Sums over blocks: rows, losses, hits and, with a key, gradients and batch statistics; added as whole numbers."""
    names = sorted(model.weights)
    shapes = [model.weights[k].shape for k in names]
    train = key is not None

    def flat(values: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([np.ravel(values.get(k, np.zeros(s))) for k, s in zip(names, shapes)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, meters = 0, np.zeros(4)
        meters = meters.astype(object)
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["x"]).reshape(r["n"], -1)
                y, t = np.frombuffer(r["y"]), np.frombuffer(r["t"], "<i4")
                masks = model.masks(r["n"], (*key, r["block"])) if train else None
                loss, cross, hits, grads, kept = _losses(model, x, y, t, masks, reverse, train)
                meters = meters + np.array([r["n"], int(round(loss * (1 << 20))), int(round(cross * (1 << 20))), hits], object)
                if train:
                    for k, (_, _, _, _, mean, var) in enumerate(kept[0]):
                        grads |= {f"l{k}.mean": mean * r["n"], f"l{k}.var": var * r["n"]}
                    total = total + np.rint(flat(grads) * (UNIT / 4096)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([[int(m) for m in meters]], pa.list_(pa.int64())),
                                          pa.array([total.tobytes() if train and len(np.shape(total)) else b""], pa.binary())],
                                         names=["meters", "total"])

    def add(a, b):
        return [x + y for x, y in zip(a[0], b[0])], (a[1] + b[1] if len(a[1]) and len(b[1]) else a[1] if len(a[1]) else b[1])

    parts = blocks.mapInArrow(sums, "meters array<long>, total binary").rdd.map(
        lambda r: (list(r["meters"]), np.frombuffer(bytes(r["total"]), np.int64)))
    meters, total = parts.treeReduce(add)
    out = {"n": meters[0], "loss": meters[1] / (1 << 20), "cross": meters[2] / (1 << 20), "hits": meters[3]}
    if train and meters[0]:
        cuts = np.cumsum([math.prod(s) for s in shapes])[:-1]
        mean = total / (UNIT / 4096) / meters[0]
        out["grads"] = {k: v.reshape(s) for k, v, s in zip(names, np.split(mean, cuts), shapes)}
    return out


def ramp(epoch: int, epochs: int, top: float = 1.0) -> float:
    """From 0 to ``top`` along a logistic curve over the training."""
    return top * math.tanh(5 * epoch / max(epochs - 1, 1))


def _fit(model: Network, train: DataFrame, valid: DataFrame | None, id_: str, label: str, target: str | None, epochs: int,
         batch: int, steps: int | None, rate: float, decay: float, patience: int, top: float, seed: int) -> Network:
    blocks, steps = _blocks(train, id_, model.features, label, target, model.classes, batch, steps)
    check = None if valid is None else _blocks(valid, id_, model.features, label, target, model.classes, 4096, 1)[0]
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second, count, best, waited = copy.deepcopy(first), 0, None, 0
    for epoch in range(epochs):
        reverse, seen = ramp(epoch, epochs, top), []
        for step in range(steps):
            done = _pass(model, blocks.where(F.col("step") == step), (seed, epoch, step), reverse)
            if not done["n"]:
                continue
            seen.append(done)
            count += 1
            for name, g in done["grads"].items():
                w = model.weights[name]
                if name.endswith((".mean", ".var")):
                    model.weights[name] = KEEP * w + (1 - KEEP) * g
                    continue
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                move = (first[name] / (1 - 0.9 ** count)) / (np.sqrt(second[name] / (1 - 0.999 ** count)) + 1e-8)
                model.weights[name] = w - rate * (move + decay * w)
        n = max(1, sum(s["n"] for s in seen))
        entry = {"epoch": epoch + 1, "train_loss": sum(s["loss"] for s in seen) / n, "rate": rate, "ramp": reverse,
                 "class_accuracy": sum(s["hits"] for s in seen) / n if model.classes else None}
        if check is not None:
            found = _pass(model, check, None, 0.0)
            entry["val_loss"] = found["loss"] / max(1, found["n"])
            if best is None or entry["val_loss"] < best[0]:
                best, waited = (entry["val_loss"], copy.deepcopy(model.weights)), 0
            else:
                waited += 1
        model.history.append(entry)
        if waited and waited % 5 == 0:
            rate = max(rate / 2, 1e-7)
        if patience and waited >= patience:
            break
    if best is not None:
        model.weights = best[1]
    return model


def mlp_regressor(train: DataFrame, valid: DataFrame | None = None, id_: str = "sid", features: str = "tabular", label: str = "z",
                  hidden: tuple[int, ...] = (256, 128, 64), drop: tuple[float, ...] = (0.3, 0.2, 0.1), epochs: int = 20,
                  batch: int = 256, steps: int | None = None, rate: float = 1e-3, decay: float = 1e-4, patience: int = 20,
                  seed: int = 42) -> Network:
    """Fit the label by a network: Huber loss, adaptive steps with weight decay, batch normalisation, dropout.

    An epoch has ``steps`` steps (an eighth of the batches, if not given), each over
    its share of the batches. With ``valid``, the rate is halved after five epochs
    without progress, training stops after ``patience`` of them, and the best weights
    are kept. ``hidden=()`` is a linear model. No rows leave the weights as drawn.
    """
    width = train.select(F.max(F.size(features))).first()[0] or 1
    model = Network.fresh(width, hidden, drop, None, seed=seed, features=features)
    return _fit(model, train, valid, id_, label, None, epochs, batch, steps, rate, decay, patience, 0.0, seed)


def adversarial_probe(train: DataFrame, target: str, id_: str = "sid", features: str = "tabular", label: str = "z",
                      hidden: tuple[int, ...] = (64, 32), drop: tuple[float, ...] = (0.0, 0.0), epochs: int = 30, batch: int = 256,
                      steps: int | None = None, rate: float = 2e-3, decay: float = 1e-4, top: float = 1.0, seed: int = 42,
                      most_classes: int = 1000) -> Network:
    """A network that fits the label while its trunk unlearns ``target``.

    The second head tells the class of ``target``; its gradient enters the trunk with
    the opposite sign, by a strength that ramps up from 0 to ``top``. ``top=0`` is a
    head beside a trunk that does not care. More than ``most_classes`` classes are
    an error; rows with a null class train the value only.
    """
    found = train.select(F.col(target).cast("string").alias("c")).where("c IS NOT NULL").distinct().limit(most_classes + 1).collect()
    if len(found) > most_classes:
        raise ValueError(f"{target} has more than {most_classes} classes")
    width = train.select(F.max(F.size(features))).first()[0] or 1
    model = Network.fresh(width, hidden, drop, sorted(r["c"] for r in found), seed=seed, features=features)
    return _fit(model, train, None, id_, label, target, epochs, batch, steps, rate, decay, 0, top, seed)


def gradient_attribution(model: Network, df: DataFrame, id_: str, keep=("cluster",)) -> DataFrame:
    """Derivative of the value by each feature, times the feature, per row: (id, idx, value), long.

    Rows with null features are left out.
    """
    @F.pandas_udf("array<double>")
    def shares(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            x = np.stack(batch).astype(float)
            yield pd.Series(list(model.input_gradient(x) * x))

    usable = df.where(F.col(model.features).isNotNull())
    return usable.select(id_, *keep, F.posexplode(shares(F.col(model.features).cast("array<double>"))).alias("idx", "value"))
