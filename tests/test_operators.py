"""Ranking, sampling, splits, metrics, rasters and learning on small frames."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pavement.operators import joins as J
from pavement.operators import learning as L
from pavement.operators import metrics as M
from pavement.operators import ranking as R
from pavement.operators import raster as A
from pavement.operators import sampling as P
from pavement.operators import separation as Z
from pavement.operators import splits as T
from pavement.operators import statistics as S


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40), st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 0.98, 1.0]))
def test_percentile_of_small_groups(spark, values, q):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert R.exact_percentiles(df, "v", {"p": q}).collect()[0].p == pytest.approx(float(np.percentile(values, q * 100)), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("kind", ["spread", "copies"])
def test_percentile_of_large_groups(spark, kind):
    """Groups beyond the whole-group limit, and one where a value fills a third of the rows."""
    rng = np.random.default_rng(5)
    values = rng.normal(size=30_011)
    if kind == "copies":
        values[rng.random(len(values)) < 0.34] = 0.25
    pdf = pd.DataFrame({"g": np.where(np.arange(len(values)) % 50 == 0, "small", "large"), "v": values})
    out = {r.g: r for r in R.exact_percentiles(spark.createDataFrame(pdf), "v", {"a": 0.02, "b": 0.5, "c": 0.975}, ("g",)).collect()}
    for g, part in pdf.groupby("g"):
        for name, q in (("a", 2), ("b", 50), ("c", 97.5)):
            assert out[g][name] == pytest.approx(float(np.percentile(part.v, q)), abs=1e-12)


def test_global_rank(spark):
    rng = random.Random(4)
    rows = [("A" if i % 4 else "B", i, float(rng.choice([7, 7, 7, rng.randrange(500)]))) for i in range(3000)]
    df = spark.createDataFrame(rows, "city string, sid long, v double")
    got = {r.sid: r.rank for r in R.global_rank(df, "v", "sid", ("city",), buckets=16).collect()}
    for city in "AB":
        ordered = sorted((r for r in rows if r[0] == city), key=lambda r: (r[2], r[1] % 64, r[1]))
        assert [got[r[1]] for r in ordered] == list(range(len(ordered)))


def test_first_rows_beyond_the_group_limit(spark):
    df = spark.range(20_000).select(F.lit("A").alias("city"), F.lit(0).alias("cluster"), F.col("id").alias("pid"))
    got = {r.pid for r in P.stratified_sample(df, n=1500).collect()}
    assert got == set(sorted(range(20_000), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())[:1500])


def test_small_stratum_is_kept_whole(spark):
    df = spark.createDataFrame([("A", 1, i) for i in range(7)] + [("A", 2, 100 + i) for i in range(300)], "city string, cluster int, pid long")
    counts = {r.cluster: r["count"] for r in P.stratified_sample(df).groupBy("cluster").count().collect()}
    assert counts == {1: 7, 2: 100}


def _greedy(rows, n, crop):
    """Plain sequential version of the spread picks."""
    order = sorted(rows, key=lambda r: (r[2], r[1] % 64, r[1]))
    last = len(order) - 1
    wide, taken, out = max(1, len(order) // 20), [], []
    for slot in range(n):
        target = int(last * (slot / (n - 1)))
        for rank in sorted(range(max(0, target - wide), min(last, target + wide) + 1), key=lambda k: (abs(k - target), k)):
            r = order[rank]
            if not any(abs(r[3] - a) < crop and abs(r[4] - b) < crop for a, b in taken):
                taken.append((r[3], r[4]))
                out.append((slot, r[1]))
                break
    return out


def test_spread_picks(spark):
    rng = random.Random(9)
    rows = [("A" if i % 3 else "B", i, float(rng.randrange(200)), rng.randrange(12), rng.randrange(12)) for i in range(240)]
    df = spark.createDataFrame(rows, "city string, sid long, population double, prow int, pcol int")
    got = P.spread_picks(df, n=5, crop=4).collect()
    for city in "AB":
        assert sorted((r.slot, r.sid) for r in got if r.city == city) == _greedy([r for r in rows if r[0] == city], 5, 4)


def test_quartile_pools_of_equal_labels(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(10)], "sid long, target double")
    counts = {r.pool: r["count"] for r in P.quartile_pools(df, n=4).groupBy("pool").count().collect()}
    assert counts == {"high": 4, "low": 4}


def _profiles(spark, rows):
    return spark.createDataFrame(rows, "city string, country string, avg_label double, dom_cluster int, n long")


def test_small_countries_and_broken_cities_go_to_train(spark):
    rows = [(f"c{i}, Big", "Big", float(i), 0, 5) for i in range(6)] + [(f"s{i}, Small", "Small", float(i), 0, 5) for i in range(3)]
    split = {r.city: r.split for r in T.city_split(_profiles(spark, rows), broken=("c0, Big",)).collect()}
    assert {c for c, s in split.items() if s != "train"} == {"c2, Big", "c4, Big"}
    assert split["c2, Big"] == "val" and split["c4, Big"] == "test" and split["c0, Big"] == "train"


def _swap_by_hand(table, wanted=(3, 4)):
    """Sequential version: lists in order of entry, one swap per missing cluster."""
    ordered = sorted(table, key=lambda r: (r["country"], r["slot"] or 0, r["avg_label"], r["city"]))
    lists = {s: [r for r in ordered if r["split"] == s] for s in ("train", "val", "test")}
    for target in ("val", "test"):
        for cluster in wanted:
            if any(r["dom_cluster"] == cluster for r in lists[target]):
                continue
            options = [r for r in lists["train"] if r["dom_cluster"] == cluster]
            if not options:
                continue
            median = float(np.median([r["avg_label"] for r in lists[target]]))
            comes = min(options, key=lambda r: abs(r["avg_label"] - median))
            counts = {}
            for r in lists[target]:
                counts.setdefault(r["dom_cluster"], []).append(r)
            goes = max(counts.values(), key=len)[0]
            lists[target].remove(goes)
            lists["train"].remove(comes)
            lists[target].append(comes)
            lists["train"].append(goes)
    return {r["city"]: s for s, rows in lists.items() for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_coverage_swap(spark, seed):
    rng = random.Random(seed)
    rows = [(f"c{i}, N{i % 4}", f"N{i % 4}", rng.uniform(0, 100), rng.choice([0, 0, 1, 2, 3, 4]), 5) for i in range(24)]
    split = T.city_split(_profiles(spark, rows))
    expected = _swap_by_hand([r.asDict() for r in split.collect()])
    swapped = T.coverage_swap(split)
    assert {r.city: r.split for r in swapped.collect()} == expected
    audit = {(r.finding, r.split): r.value for r in T.split_audit(swapped.select("city", "split"), split).collect()}
    assert audit[("unassigned", "(all)")] == 0 and audit[("in two splits", "(all)")] == 0


def test_audit_finds_faults(spark):
    split = spark.createDataFrame([("a", "train"), ("a", "val"), ("b", "train")], "city string, split string")
    profiles = _profiles(spark, [(c, "N", 1.0, 0, 1) for c in ("a", "b", "c")])
    audit = {(r.finding, r.split): r.value for r in T.split_audit(split, profiles).collect()}
    assert audit[("unassigned", "(all)")] == 1 and audit[("in two splits", "(all)")] == 1


def test_metric_edge_cases(spark):
    flat = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0)], "pred double, target double")
    row = M.regression_metrics(flat).collect()[0]
    assert (row.r2, row.mape, row.mae) == (0.0, 0.0, 1.5)
    grouped = M.grouped_metrics(flat.withColumn("country", F.lit("X"))).collect()[0]
    assert grouped.r2 == pytest.approx(1 - 5 / 1e-8)
    doubled = M.regression_metrics(flat, inverse=lambda c: c * 2).collect()[0]
    assert doubled.mae == 3.0

    @F.pandas_udf("double")
    def tripled(v: pd.Series) -> pd.Series:
        return v * 3
    assert M.regression_metrics(flat, inverse=tripled).collect()[0].mae == 4.5


def test_single_sample_city_has_floored_deviation(spark):
    df = spark.createDataFrame([("A", 10.0), ("B", 1.0), ("B", None)], "city string, population double")
    stats = {r.city: r for r in S.city_target_stats(df).collect()}
    assert stats["A"].log_std == 1e-4 and stats["A"].log_mean == pytest.approx(math.log1p(10))


def test_dominant_cluster_tie(spark):
    df = spark.createDataFrame([("A, N", 3, 1.0), ("A, N", 1, 2.0)], "city string, cluster int, population double")
    row = S.city_profiles(df).collect()[0]
    assert (row.dom_cluster, row.avg_label, row.n, row.country) == (1, 1.5, 2, "N")


@pytest.mark.parametrize("block", [2, 4096])
def test_early_stop(spark, monkeypatch, block):
    losses = {"a": [5, 4, 4, 4, 4, 1], "b": [3, 2, 1], "c": [1, 2, 0.5, 2, 2, 2, 0.1], "d": [2]}
    rows = [(k, i + 1, float(v)) for k, vs in losses.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "run string, epoch int, val_loss double")
    monkeypatch.setattr(R.running_min, "__defaults__", (block,))
    got = {r.run: tuple(r)[1:] for r in M.early_stop(df, patience=3).collect()}
    assert got == {"a": (2, 4.0, True, 5), "b": (3, 1.0, False, 3), "c": (3, 0.5, True, 6), "d": (1, 2.0, False, 1)}


def test_split_of_unknown_city_is_test(spark):
    rows = spark.createDataFrame([("A",), ("Z",)], "city string")
    split = spark.createDataFrame([("A", "train")], "city string, split string")
    assert {r.city: r.split for r in J.assign_split(rows, split).collect()} == {"A": "train", "Z": "test"}


def test_silhouette_against_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(70, 3)), np.r_[np.arange(60) % 3, np.full(9, 3), [4]]
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(70)], "vec_id long, embedding array<double>, label int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(70):
        own = y == y[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, y == o].mean() for o in set(y) - {y[i]})
        s.append((b - a) / max(a, b))
    s = np.array(s)
    got = {r.label: r.silhouette for r in Z.silhouette(df).collect()}
    assert got[None] == pytest.approx(s.mean()) and got[4] == 0.0
    for label in range(4):
        assert got[label] == pytest.approx(s[y == label].mean())


def test_composite_without_clear_scene_is_black(spark):
    rows = [("A", 0, 0, 10, 20, 30, 4), ("A", 0, 0, 20, 40, 60, 5), ("A", 0, 0, 999, 999, 999, 9), ("A", 0, 1, 7, 7, 7, 8)]
    df = spark.createDataFrame(rows, "city string, prow int, pcol int, red long, green long, blue long, scl int")
    got = {r.pcol: (r.red, r.green, r.blue) for r in A.median_composite(df).collect()}
    assert got == {0: (15.0, 30.0, 45.0), 1: (0.0, 0.0, 0.0)}


def test_augmented_tiles(spark):
    size, crop, jitter = 8, 4, 2
    tile = np.arange(size * size).reshape(size, size)
    df = spark.createDataFrame([(i, tile.tolist()) for i in range(12)], "sample_id long, tile array<array<int>>")
    out = A.augmented_tiles(df, crop, jitter, copies=4).collect()
    assert len(out) == 48 and len({(r.row_offset, r.col_offset, r.quarter_turns) for r in out}) > 10
    for r in out:
        want = tile[r.row_offset:r.row_offset + crop, r.col_offset:r.col_offset + crop]
        want = want[:, ::-1] if r.flipped_h else want
        want = want[::-1] if r.flipped_v else want
        assert np.array_equal(np.array(r.tile), np.rot90(want, r.quarter_turns))


def test_kmeans_keeps_small_and_empty_cities(spark):
    rng = random.Random(6)
    rows = [("A", i, rng.random(), rng.random(), float(rng.randrange(9))) for i in range(60)]
    rows += [("few", 100 + i, 1.0, 1.0, 1.0) for i in range(3)] + [("none", 200 + i, 0.0, 0.0, 0.0) for i in range(9)]
    df = spark.createDataFrame(rows, "city string, pid int, road_density double, building_density double, poi_density double")
    out = L.kmeans_by_city(df, iters=3).toPandas()
    assert len(out) == 72
    assert out[out.city != "A"].cluster.isna().all() and set(out[out.city == "A"].cluster) == {0, 1, 2, 3, 4}
    means = out[out.city == "A"].groupby("cluster")[[c for c in out if c.endswith("_scaled")]].mean().sum(axis=1)
    assert means.is_monotonic_increasing


def test_linear_attribution_sums_to_prediction(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 15))
    z = x @ np.arange(15) / 10 + 0.3
    df = spark.createDataFrame([(i, 0, x[i].tolist(), float(z[i])) for i in range(200)], "sid long, cluster int, tabular array<double>, z double")
    model = L.tabular_regressor(df)
    parts = L.linear_attribution(model, df, "sid").groupBy("sid").agg(F.sum("value").alias("v"))
    back = parts.join(df, "sid").select((F.col("v") + model.intercept - F.col("z")).alias("gap")).toPandas().gap
    assert back.abs().max() < 0.05


def test_attribution_query_covers_every_split(spark, monkeypatch):
    """Samples of train, val and test all count, not those of test alone."""
    from pavement.plans import learning_queries as Q
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 15)) + np.arange(90)[:, None] // 30
    z = x @ np.arange(15) / 10
    table = spark.createDataFrame([(i, 0, ("train", "val", "test")[i // 30], x[i].tolist(), float(z[i])) for i in range(90)],
                                  "sid long, cluster int, split string, tabular array<double>, z double")
    monkeypatch.setattr(Q, "training_table", lambda b: table)
    got = {r.idx: (r.mean_abs, r.mean_signed) for r in Q._attribution(None).collect()}
    shares = x * np.array(L.tabular_regressor(table.where("split = 'train'")).coefficients)
    for i in range(15):
        assert got[i] == pytest.approx((np.abs(shares[:, i]).mean(), shares[:, i].mean()), rel=1e-6, abs=1e-9)


def test_a_pair_of_blocks_gives_the_sums_of_both(spark):
    """Both directions from one meeting; copies far from the origin are at distance 0; points without a label have sums but are in none."""
    import pandas as pd
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(90, 5)) + 1e4, [float(i % 3) if i % 10 else None for i in range(90)]
    x[40:60] = x[0:20]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    side = lambda at: pd.DataFrame({"_id": at, "_label": [y[i] for i in at], "_f": [x[i] for i in at], "_from": 0, "_to": 1})
    met = Z._block_distances(side(range(35)), side(range(35, 90)))
    assert len(met) == 90 * 3
    for row in met.itertuples():
        others = [i for i in (range(35, 90) if row._1 < 35 else range(35)) if y[i] == row._3]
        assert row._5 == len(others) and row._4 == pytest.approx(d[row._1, others].sum(), rel=1e-9, abs=1e-9)
    df = spark.createDataFrame([(i, x[i].tolist(), i % 3) for i in range(90)] + [(90 + i, x[0].tolist(), 7) for i in range(600)],
                               "vec_id long, embedding array<double>, label int")
    got = {r.label: r.silhouette for r in Z.silhouette(df).collect()}
    z, w = np.r_[x, np.repeat(x[:1], 600, axis=0)], np.r_[np.arange(90) % 3, np.full(600, 7)]
    away = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    sums = np.stack([away[:, w == o].sum(1) for o in (0, 1, 2, 7)], 1)
    n = np.array([(w == o).sum() for o in (0, 1, 2, 7)])
    own = np.searchsorted([0, 1, 2, 7], w)
    a = sums[np.arange(690), own] / (n[own] - 1)
    b = np.where(np.arange(4) == own[:, None], np.inf, sums / n).min(1)
    s = np.where(np.maximum(a, b) > 0, (b - a) / np.maximum(a, b), 0)
    assert got[None] == pytest.approx(s.mean()) and got[7] == pytest.approx(s[w == 7].mean())
