"""The data-parallel network: gradients, determinism, learning, opposed heads, attributions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavement.operators import learning as L
from pavement.operators import network as N


def small(classes=None, seed=3, drop=(0.0, 0.0)):
    model = N.Network.fresh(4, (5, 3), drop, classes, class_hidden=4, seed=seed)
    rng = np.random.default_rng(seed)
    for k in (0, 1):
        model.weights[f"l{k}.mean"] = rng.normal(size=model.hidden[k])
        model.weights[f"l{k}.var"] = rng.uniform(0.5, 2, model.hidden[k])
        model.weights[f"l{k}.shift"] = rng.normal(size=model.hidden[k])
    return model


@pytest.mark.parametrize("train", [False, True])
def test_gradients_equal_finite_differences(train):
    rng = np.random.default_rng(0)
    x, y, t = rng.normal(size=(9, 4)), rng.normal(size=9) * 2, np.array([0, 1, 2, 0, 1, 2, -1, 0, 1], np.int32)
    model = small(["a", "b", "c"])
    masks = model.masks(9, (1, 2)) if train else None

    def total(reverse):
        """The objective whose gradient the trunk follows: label loss less the other head's, as often as it is reversed."""
        loss, cross, *_ = N._losses(model, x, y, t, masks, reverse, train)
        return loss, cross

    value, scores, kept = model.forward(x, masks, train)
    p = np.exp(scores - scores.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    d = p.copy()
    d[np.arange(9), np.maximum(t, 0)] -= 1
    d[t < 0] = 0
    reverse = 0.7
    grads = model.backward(kept, np.clip(value - y, -1, 1), d, reverse)[0]
    for name, w in model.weights.items():
        if name.endswith((".mean", ".var")):
            continue
        for at in list(np.ndindex(w.shape))[:12]:
            before = w[at]
            w[at] = before + 1e-6
            up = total(reverse)
            w[at] = before - 1e-6
            down = total(reverse)
            w[at] = before
            d_loss, d_cross = (up[0] - down[0]) / 2e-6, (up[1] - down[1]) / 2e-6
            expected = d_loss + (d_cross if name.startswith("c") else -reverse * d_cross)
            assert abs(grads[name][at] - expected) < 1e-4, name


def test_input_gradients(spark):
    model = small()
    x = np.random.default_rng(1).normal(size=(30, 4))
    rows = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)] + [(99, 0, None)], "sid long, cluster int, tabular array<double>")
    got = {(r["sid"], r["idx"]): r["value"] for r in N.gradient_attribution(model, rows, "sid").collect()}
    assert len(got) == 120
    for i in range(30):
        for k in range(4):
            step = np.zeros(4)
            step[k] = 1e-6
            slope = (model.forward(x[i:i + 1] + step)[0] - model.forward(x[i:i + 1] - step)[0])[0] / 2e-6
            assert abs(got[(i, k)] - slope * x[i, k]) < 1e-5


def test_linear_model_gives_coefficient_times_input(spark):
    model = N.Network.fresh(3, (), (), seed=1)
    rows = spark.createDataFrame([(1, 0, [1.0, -2.0, 0.5])], "sid long, cluster int, tabular array<double>")
    got = [r["value"] for r in N.gradient_attribution(model, rows, "sid").orderBy("idx").collect()]
    assert np.allclose(got, model.weights["out.w"][:, 0] * [1, -2, 0.5])


@pytest.fixture(scope="module")
def curved(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    z = np.tanh(2 * x[:, 0] * x[:, 1]) + 0.7 * np.abs(x[:, 2]) + 0.05 * rng.normal(size=3000)
    rows = [(i, v.tolist(), float(t), i % 5) for i, (v, t) in enumerate(zip(x, z))]
    return spark.createDataFrame(rows, "sid long, tabular array<double>, z double, fold int").cache()


def test_beats_the_linear_fit_on_unseen_rows(curved):
    train, test = curved.where("fold > 1"), curved.where("fold = 0")
    model = N.mlp_regressor(train, curved.where("fold = 1"), hidden=(32, 16), drop=(0.0, 0.0), epochs=25, batch=64, steps=4, rate=1e-2)
    line = L.tabular_regressor(train)

    def error(scored):
        return scored.agg(F.avg(F.abs(F.col("z_pred") - F.col("z")))).first()[0]

    assert error(model.transform(test)) < 0.6 * error(line.transform(L.vectors(test, "tabular")))
    assert len(model.history) <= 25 and min(h["val_loss"] for h in model.history) < 0.5 * model.history[0]["val_loss"]


def test_the_same_weights_on_any_partitioning(curved):
    one, many = (N.mlp_regressor(df, hidden=(8, 4), drop=(0.2, 0.1), epochs=2, batch=100, steps=3)
                 for df in (curved.coalesce(1), curved.orderBy(F.desc("z")).repartition(8)))
    assert all(np.array_equal(one.weights[k], many.weights[k]) for k in one.weights)


def test_a_whole_pass_equals_one_batch(spark, curved):
    """Gradients and losses added over blocks are those of the blocks by themselves."""
    model = N.Network.fresh(5, (6,), (0.3,), seed=2)
    blocks, steps = N._blocks(curved, "sid", "tabular", "z", None, [], 200, 2)
    assert steps == 2 and blocks.agg(F.sum("n")).first()[0] == 3000
    done = N._pass(model, blocks, (1, 2, 3), 0.0)
    loss, grads = 0.0, {}
    for r in blocks.collect():
        x, y = np.frombuffer(r["x"]).reshape(r["n"], -1), np.frombuffer(r["y"])
        one = N._losses(model, x, y, np.full(r["n"], -1), model.masks(r["n"], (1, 2, 3, r["block"])), 0.0, True)
        loss += one[0]
        grads = {k: grads.get(k, 0) + v for k, v in one[3].items()}
    assert done["n"] == 3000 and abs(done["loss"] - loss) < 1e-3
    assert all(np.allclose(done["grads"][k] * 3000, grads[k], atol=1e-5) for k in grads)


def test_opposed_heads(spark):
    """The trunk forgets a class that the features tell, and keeps the label."""
    rng = np.random.default_rng(4)
    country = rng.integers(0, 2, 2400)
    z = rng.normal(size=2400)
    x = np.stack([z + 0.1 * rng.normal(size=2400), 2.0 * country - 1 + 0.3 * rng.normal(size=2400), rng.normal(size=2400)], axis=1)
    df = spark.createDataFrame([(i, v.tolist(), float(t), "ab"[c]) for i, (v, t, c) in enumerate(zip(x, z, country))],
                               "sid long, tabular array<double>, z double, country string").cache()
    train, test = df.where("sid % 3 > 0"), df.where("sid % 3 = 0").cache()
    share = max(test.groupBy("country").count().select(F.max("count")).first()[0] / test.count(), 0.5)
    found = {}
    for top in (0.0, 2.0):
        model = N.adversarial_probe(train, "country", hidden=(16, 8), epochs=40 if top else 20, batch=100, steps=4, rate=1e-2, top=top)
        found[top] = model.told(model.transform(test)).agg(
            F.avg((F.col("told") == F.col("country")).cast("double")), F.avg(F.abs(F.col("z_pred") - F.col("z")))).first()
    assert found[0.0][0] > 0.95
    assert found[2.0][0] < share + 0.15
    assert found[2.0][1] < 0.35 and found[0.0][1] < 0.35


def test_nothing_to_learn_from(spark):
    schema = "sid long, tabular array<double>, z double, country string, cluster int"
    empty = spark.createDataFrame([], schema)
    assert N.mlp_regressor(empty, hidden=(4,), drop=(0.0,), epochs=1).weights["l0.w"].shape == (1, 4)
    bad = spark.createDataFrame([(1, None, 1.0, "a", 0), (2, [1.0, 2.0], None, None, 0), (None, [1.0, 2.0], 1.0, None, 0), (3, [0.0, 1.0], 2.0, "b", 0)], schema)
    model = N.adversarial_probe(bad, "country", hidden=(4,), drop=(0.0,), epochs=2, batch=2)
    assert model.classes == ["a", "b"] and all(np.isfinite(w).all() for w in model.weights.values())
    assert N.gradient_attribution(model, bad, "sid").count() == 6
    with pytest.raises(ValueError, match="classes"):
        N.adversarial_probe(bad, "country", most_classes=1)


def test_ramp():
    assert N.ramp(0, 10) == 0 and 0.99 < N.ramp(9, 10) < 1 and N.ramp(0, 1) == 0 and N.ramp(4, 5, 0.5) < 0.5
