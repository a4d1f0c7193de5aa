"""Distance joins against brute force, including large features and a dense cell."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pavement.operators import density as D
from pavement.operators import discs
from pavement.operators import spatial as S
from pavement.plans import catalog


def _segment_gap(px, py, s):
    x1, y1, x2, y2 = s
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = 0 if n == 0 else max(0, min(1, ((px - x1) * dx + (py - y1) * dy) / n))
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


def _centres(spark, n, seed=1, span=3000):
    rng = random.Random(seed)
    rows = [("A" if i % 3 else "B", i, rng.uniform(-span, span), rng.uniform(-span, span)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "city string, pid int, x double, y double")


def test_lines_of_all_sizes(spark):
    rng = random.Random(2)
    rows, centres = _centres(spark, 60)
    feats = []
    for i in range(200):  # from single points to lines far longer than the disc
        x, y, reach = rng.uniform(-3000, 3000), rng.uniform(-3000, 3000), 10 ** rng.uniform(-1, 4) if i % 10 else 0
        a = rng.uniform(0, 6.28)
        feats.append(("A" if i % 2 else "B", i, x, y, x + reach * math.cos(a), y + reach * math.sin(a)))
    lines = spark.createDataFrame(feats, "city string, oid int, x1 double, y1 double, x2 double, y2 double")
    expected = {(p[1], f[1]) for p in rows for f in feats if p[0] == f[0] and _segment_gap(p[2], p[3], f[2:]) <= 250}
    got = [(r.pid, r.oid) for r in S.disc_join_lines(centres, lines, 250).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    # the same lines as vertex lists with an extra vertex in the middle
    paths = lines.withColumn("mx", (F.col("x1") + F.col("x2")) / 2).withColumn("my", (F.col("y1") + F.col("y2")) / 2).select(
        "city", "oid", F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
                                 for x, y in (("x1", "y1"), ("mx", "my"), ("x2", "y2"))]).alias("path"))
    assert {(r.pid, r.oid) for r in S.disc_join_lines(centres, paths, 250).collect()} == expected


def test_polygons_of_all_sizes(spark):
    rng = random.Random(3)
    rows, centres = _centres(spark, 60)
    feats = []
    for i in range(120):
        x, y, h = rng.uniform(-3000, 3000), rng.uniform(-3000, 3000), 10 ** rng.uniform(0, 3.6)
        feats.append(("A" if i % 2 else "B", i, x, y, h))
    squares = spark.createDataFrame(feats, "city string, oid int, cx double, cy double, h double").withColumn(
        "rings", F.array(F.array(*[F.struct((F.col("cx") + a * F.col("h")).alias("x"), (F.col("cy") + b * F.col("h")).alias("y"))
                                   for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])))
    expected = {(p[1], f[1]) for p in rows for f in feats if p[0] == f[0] and math.hypot(
        max(abs(p[2] - f[2]) - f[4], 0), max(abs(p[3] - f[3]) - f[4], 0)) <= 250}
    got = [(r.pid, r.oid) for r in S.disc_join_polygons(centres, squares, 250).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_crossing_line_counts_whole_and_empty_layers_give_zero(spark):
    centres = spark.createDataFrame([("A", 1, 0.0, 0.0), ("A", 2, 9000.0, 0.0)], "city string, pid int, x double, y double")
    roads = spark.createDataFrame([("A", -1000.0, 100.0, 1000.0, 100.0)], "city string, x1 double, y1 double, x2 double, y2 double")
    ring = "array<array<struct<x:double,y:double>>>"
    huge = [[(-5000.0, -5000.0), (5000.0, -5000.0), (5000.0, 5000.0), (-5000.0, 5000.0)]]
    built = spark.createDataFrame([("A", "Polygon", huge)], f"city string, geom_type string, rings {ring}")
    pois = spark.createDataFrame([], "city string, x double, y double")
    out = {r.pid: r for r in D.density_metrics(centres, roads, built, pois).collect()}
    area = math.pi * 250 ** 2
    assert abs(out[1].road_density - 2000 / area) < 1e-12 and abs(out[1].building_density - 1e8 / area) < 1e-6
    assert tuple(out[2])[2:] == (0.0, 0.0, 0.0) and out[1].poi_density == 0.0


def test_feature_fallbacks(spark):
    """Layers without optional columns: geometric length, half the nodes, no tags."""
    centres = spark.createDataFrame([("A", 1, 0.0, 0.0)], "city string, pid int, x double, y double")
    point = "city string, x double, y double"
    layers = {
        "road_edges": spark.createDataFrame([("A", 0.0, 0.0, 30.0, 40.0)], "city string, x1 double, y1 double, x2 double, y2 double"),
        "road_nodes": spark.createDataFrame([("A", 0.0, 0.0), ("A", 0.0, 0.0), ("A", 1.0, 0.0)], point),
        "buildings": spark.createDataFrame([("A", "Point", [[(0.0, 0.0)]])], "city string, geom_type string, rings array<array<struct<x:double,y:double>>>"),
        "pois": spark.createDataFrame([("A", 5.0, 5.0, "cafe", None)], point + ", amenity string, shop string"),
        "transport": spark.createDataFrame([("A", 1200.0, 0.0)], point),
    }
    row = D.osm_features_15(centres, layers).collect()[0]
    assert (row.road_length, row.node_count, row.intersection_count) == (50.0, 3.0, 1.5)
    assert (row.building_count, row.building_area) == (1.0, 0.0)
    assert (row.poi_count, row.amenity_count, row.shop_count, row.stop_count) == (1.0, 1.0, 0.0, 0.0)


def test_dense_cell_is_split(spark):
    """A third of all features in one cell: the skewed partition is split, nothing is lost."""
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 30_000
        x = F.when(F.col("id") % 3 == 0, F.rand(1) * 100).otherwise(F.rand(2) * 20000)
        feats = spark.range(0, n, 1, 8).select(F.lit("A").alias("city"), F.col("id").alias("oid"), x.alias("x"), (F.rand(3) * 100).alias("y"))
        centres = spark.range(0, 40).select(F.lit("A").alias("city"), F.col("id").alias("pid"), (F.col("id") * 500.0).alias("x"), F.lit(50.0).alias("y"))
        pairs = S.disc_join_points(centres, feats, 250).groupBy("pid").agg(F.count("*").alias("n"))
        got = {r.pid: r.n for r in pairs.collect()}
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
        points = feats.toPandas()
        for pid, count in got.items():
            assert count == int((((points.x - pid * 500.0) ** 2 + (points.y - 50.0) ** 2) <= 250 ** 2).sum())
        assert got[0] > n / 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_copies_collapse_before_the_join(spark):
    centres = spark.createDataFrame([("A", 1, 0.0, 0.0)], "city string, pid int, x double, y double")
    copies = spark.range(5000).select(F.lit("A").alias("city"), F.lit(10.0).alias("x"), F.lit(10.0).alias("y"))
    merged = S.merge_copies(copies, ["city", "x", "y"], {"n": F.lit(1)})
    assert merged.count() == 1
    assert S.disc_sums(centres, [(copies, "points", ["x", "y"], {"n": F.lit(1)})], 250).collect()[0].n == 5000


def test_parts_areas_and_empty_shapes(spark):
    """Parts add up, POIs may be areas, and features without coordinates meet nothing and stop nothing."""
    def square(x, y, side):
        return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]

    vertices = "array<struct<x:double, y:double>>"
    centres = spark.createDataFrame([("c", 1, 0.0, 0.0)], "city string, pid long, x double, y double")
    roads = spark.createDataFrame([("c", [(0.0, 0.0), (30.0, 40.0)]), ("c", []), ("c", None)], f"city string, path {vertices}")
    buildings = spark.createDataFrame(
        [("c", "MultiPolygon", None, [[square(0.0, 0.0, 20.0)], [square(100.0, 0.0, 40.0)]]),
         ("c", "Polygon", [square(0.0, 50.0, 10.0), square(2.0, 52.0, 2.0)], None),
         ("c", "Polygon", [], None), ("c", "Polygon", None, None), ("c", "Polygon", [[]], None)],
        f"city string, geom_type string, rings array<{vertices}>, parts array<array<{vertices}>>")
    pois = spark.createDataFrame([("c", 1.0, 1.0, None), ("c", None, None, [square(200.0, 0.0, 100.0)]), ("c", None, None, None),
                                  ("c", None, None, [square(900.0, 0.0, 9.0)])],
                                 f"city string, x double, y double, rings array<{vertices}>")
    row = D.density_metrics(centres, roads, buildings, pois, r=250).collect()[0]
    disc = math.pi * 250 ** 2
    assert row.road_density == pytest.approx(50 / disc) and row.poi_density == 2
    assert row.building_density == pytest.approx((400 + 1600 + 100 - 4) / disc)


@pytest.mark.parametrize("cut", [False, True])
def test_sums_without_pairs(spark, monkeypatch, cut):
    """Sums of all kinds equal plain ones, in whole and in cut blocks, and no pair of a centre and a feature is a row."""
    if cut:
        monkeypatch.setattr(S, "_FEATURES", 40)
        monkeypatch.setattr(S, "_CENTRES", 15)
    rng = random.Random(5)
    rows, centres = _centres(spark, 150)
    rows, centres = rows + [("A", 150, None, 0.0)], centres.unionByName(
        spark.createDataFrame([("A", 150, None, 0.0)], centres.schema))
    places = [("A" if i % 2 else "B", rng.uniform(-3000, 3000), rng.uniform(-3000, 3000),
               10 ** rng.uniform(0, 3.6), rng.uniform(0, 6.28), [1.0, 0.1, None][i % 3]) for i in range(300)]
    places += [places[0]] * 20 + [("A", float("nan"), 0.0, 1.0, 0.0, 1.0), (None, 0.0, 0.0, 1.0, 0.0, 1.0)]
    base = spark.createDataFrame(places, "city string, cx double, cy double, h double, a double, w double")
    x, y, h = F.col("cx"), F.col("cy"), F.col("h")
    ends = base.select("city", "w", x.alias("x1"), y.alias("y1"), (x + h * F.cos("a")).alias("x2"), (y + h * F.sin("a")).alias("y2"))
    squares = base.select("city", "w", F.array(F.array(*[
        F.struct((x + i * h).alias("x"), (y + j * h).alias("y")) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))])).alias("rings"))
    points = base.select("city", "w", x.alias("x"), y.alias("y"))
    sums = S.disc_sums(centres, [
        (ends, "lines", ["x1", "y1", "x2", "y2"], {"lines": F.col("w")}), (squares, "polygons", ["rings"], {"areas": F.col("w")}),
        (points, "points", ["x", "y"], {"points": F.col("w"), "n": F.lit(1)})], 250)
    got = {r.pid: r for r in sums.collect()}
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Inner" not in plan
    assert len(got) == 151 and tuple(got[150])[2:] == (0.0, 0.0, 0.0, 0.0)
    for city, pid, px, py in rows[:-1]:
        mine = [f for f in places if f[0] == city]
        line = sum(f[5] or 0 for f in mine if _segment_gap(px, py, (
            f[1], f[2], f[1] + f[3] * math.cos(f[4]), f[2] + f[3] * math.sin(f[4]))) <= 250)
        area = sum(f[5] or 0 for f in mine if math.hypot(max(abs(px - f[1]) - f[3], 0), max(abs(py - f[2]) - f[3], 0)) <= 250)
        near = [f[5] or 0 for f in mine if math.hypot(px - f[1], py - f[2]) <= 250]
        assert tuple(got[pid])[2:] == pytest.approx((line, area, sum(near), len(near)), abs=1e-9)


def _shapes(rng, kind, n, side):
    """Shapes of a kind, among them single points, hollow squares and shapes that are not convex, with their edges per shape."""
    x, y = rng.uniform(0, side, n), rng.uniform(0, side, n)
    if kind == "points":
        return pa.table({"_ax": x, "_ay": y}), [[(a, b, a, b)] for a, b in zip(x, y)]
    h, turn = 10 ** rng.uniform(0, 1.9, n), rng.uniform(0, 6.28, n)
    if kind == "segments":
        ends = {"x1": x, "y1": y, "x2": x + h * np.cos(turn), "y2": y + h * np.sin(turn)}
        return pa.table(ends), [[e] for e in zip(*ends.values())]
    plans = [[[(0, 0)]], [[(0, 0), (1, 0), (1, 1), (0, 1)]], [[(0, 0), (1, 0), (1, 1), (.9, 1), (.9, .1), (0, .1)]],
             [[(0, 0), (1, 0), (1, 1), (0, 1)], [(.2, .2), (.8, .2), (.8, .8), (.2, .8)]]]
    edges = []
    for i in range(n):
        rings = [[(x[i] + h[i] * a, y[i] + h[i] * b) for a, b in ring] for ring in plans[i % 4 if kind == "polygons" else i % 2 * 2]]
        edges.append([(*a, *b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])][:None if kind == "polygons" else 5])
    half = [max(math.hypot(e[k] - own[0][0], e[k + 1] - own[0][1]) for e in own for k in (0, 2)) for own in edges]
    return pa.table({"_ax": x, "_ay": y, "_half": half,
                     "_edges": [[dict(zip(("x1", "y1", "x2", "y2"), e)) for e in own] for own in edges]}), edges


@pytest.mark.parametrize("kind", ["points", "segments", "lines", "polygons"])
def test_cells_share_the_work_of_their_centres(kind, monkeypatch):
    """Sums of dense centres equal plain ones, and few pairs of a centre and a feature are tested."""
    rng = np.random.default_rng(3)
    r, side = 250.0, 900.0
    table, edges = _shapes(rng, kind, 2000, side)
    shapes = discs.Shapes(table, kind)
    cx, cy = rng.uniform(0, side, 1500), rng.uniform(0, side, 1500)
    cx[:50], cy[:50] = cx[0], cy[0]
    values = np.stack([np.arange(2000) % 7, rng.normal(size=2000)], axis=1)
    hit = np.zeros((len(cx), 2000), bool)
    for k, own in enumerate(edges):
        inside = np.zeros(len(cx), bool)
        for x1, y1, x2, y2 in own:
            t = np.clip(((cx - x1) * (x2 - x1) + (cy - y1) * (y2 - y1)) / max((x2 - x1) ** 2 + (y2 - y1) ** 2, 1e-300), 0, 1)
            hit[:, k] |= np.hypot(cx - x1 - t * (x2 - x1), cy - y1 - t * (y2 - y1)) <= r
            if y1 != y2:
                inside ^= ((y1 > cy) != (y2 > cy)) & (cx < x1 + (cy - y1) * (x2 - x1) / (y2 - y1))
        if kind == "polygons":
            hit[:, k] |= inside
    tested = []
    plain = discs.Shapes.hits
    monkeypatch.setattr(discs.Shapes, "hits", lambda self, px, py, at, r: tested.append(len(at)) or plain(self, px, py, at, r))
    assert discs.disc_totals(cx, cy, shapes, values, r) == pytest.approx(hit @ values, abs=1e-9)
    sums = discs._Sums(shapes, np.arange(2000), values, r)
    counts = []
    for work in (lambda: sums.alone(cx, cy, True), lambda: sums.by_cells(cx, cy, r / 3, 64), lambda: sums.by_cells(cx, cy, r / 10, 16)):
        tested.clear()
        assert work() == pytest.approx(hit @ values, abs=1e-9)
        counts.append(sum(tested))
    if kind == "segments":
        assert max(counts[1:]) < counts[0] / 2


def test_polygons_with_a_missing_vertex_are_tested_one_by_one():
    """The even-odd rule over their remaining edges has no bound, so no cell may decide for its centres."""
    rng = np.random.default_rng(6)
    table, _ = _shapes(rng, "polygons", 800, 900.0)
    edges = table.column("_edges").to_pylist()
    for own in edges[1::8]:
        own[0]["x2"] = own[1]["x1"] = None
    table = table.set_column(table.column_names.index("_edges"), "_edges", pa.array(edges, table.schema.field("_edges").type))
    shapes, values = discs.Shapes(table, "polygons"), np.ones((800, 1))
    cx, cy = rng.uniform(0, 900, 1500), rng.uniform(0, 900, 1500)
    alone = discs._Sums(shapes, np.arange(800), values, 250.0).alone(cx, cy, True)
    assert shapes.whole.sum() == 700 and discs.disc_totals(cx, cy, shapes, values, 250.0) == pytest.approx(alone, abs=1e-9)


def test_dense_centres_test_few_features(monkeypatch):
    """Of 6,000 centres and 60,000 segments, not every segment near the edge of a disc is tested for every centre."""
    count = []
    plain = discs.Shapes.hits
    monkeypatch.setattr(discs.Shapes, "hits", lambda self, px, py, at, r: count.append(len(at)) or plain(self, px, py, at, r))
    rng = np.random.default_rng(3)
    table, _ = _shapes(rng, "segments", 60_000, 3000.0)
    discs.disc_totals(rng.uniform(0, 3000, 6000), rng.uniform(0, 3000, 6000), discs.Shapes(table, "segments"), np.ones((60_000, 1)), 1000.0)
    assert sum(count) < 3_000_000


def test_infinite_measures_stay_with_their_features(spark):
    centres = spark.createDataFrame([("A", i, i * 1000.0, 0.0) for i in range(4)], "city string, pid int, x double, y double")
    points = spark.createDataFrame([("A", 0.0, 0.0, 1.5), ("A", 1000.0, 0.0, float("inf")), ("A", 2000.0, 0.0, float("nan")),
                                    ("A", 3000.0, 0.0, 2.5)], "city string, x double, y double, w double")
    out = {r.pid: r.w for r in S.disc_sums(centres, [(points, "points", ["x", "y"], {"w": F.col("w")})], 250).collect()}
    assert (out[0], out[1], out[3]) == (1.5, math.inf, 2.5) and math.isnan(out[2])


def test_anchors_decide_before_whole_features(spark):
    """Edges are looked at only where the anchor does not decide, and the bound of a feature is squared before the join."""
    _, centres = _centres(spark, 3)
    paths = spark.createDataFrame([("A", 1, [(0.0, 0.0), (9.0, 9.0)])], "city string, oid int, path array<struct<x:double,y:double>>")
    plan = S.disc_join_lines(centres, paths, 250)._jdf.queryExecution().optimizedPlan().toString()
    joined = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "<= _near" in joined and " OR exists(" in joined and "POWER" not in joined.upper()


def test_polygon_pairs_are_found_without_their_edges(spark):
    """Bounds decide inside the join, whole polygons only above it, for every kind of shape."""
    rows, centres = _centres(spark, 60, span=600)
    h = 120.0
    plans = {0: [[(0, 0)]], 1: [[(0, 0), (1, 0), (1, 1), (0, 1)]], 2: [[(0, 0), (1, 0), (1, 1), (.9, 1), (.9, .1), (0, .1)]],
             3: [[(0, 0), (4, 0), (4, 4), (0, 4)], [(.2, .2), (3.8, .2), (3.8, 3.8), (.2, 3.8)]], 4: [[(0, 0), (9, 0), (0, 9)]]}
    rng = random.Random(8)
    feats = []
    for i in range(50):
        x, y = rng.uniform(-900, 900), rng.uniform(-900, 900)
        feats.append(("A" if i % 2 else "B", i, [[(x + h * a, y + h * b) for a, b in ring] for ring in plans[i % 5]]))
    feats.append(("A", 50, [[(0.0, 0.0), (None, 5.0), (30.0, 40.0)]]))
    vertices = "array<array<struct<x:double, y:double>>>"
    pairs = S.disc_join_polygons(centres, spark.createDataFrame([*feats, ("A", 51, []), ("A", 52, None)], f"city string, oid int, rings {vertices}"), 250)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    joined = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "<= _near" in joined and "exists(" not in joined and "exists(" in plan
    got = {(r.city, r.pid, r.oid) for r in pairs.collect()}
    want = set()
    for city, pid, px, py in rows:
        for own, oid, rings in feats:
            edges = [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1]) if None not in (*a, *b)]
            if city == own and (any(_segment_gap(px, py, e) <= 250 for e in edges) or sum(
                    (e[1] > py) != (e[3] > py) and px < e[0] + (py - e[1]) * (e[2] - e[0]) / (e[3] - e[1]) for e in edges) % 2):
                want.add((city, pid, oid))
    near = {(c, p, 50) for c, p, x, y in rows if c == "A" and math.hypot(x, y) <= 250}  # by its anchor
    assert {g for g in got if g[2] != 50} == {w for w in want if w[2] != 50} and len(want) > 200
    assert near <= {g for g in got if g[2] == 50}


def test_box_pairs(spark):
    """Boxes of all sizes equal plain comparisons; boxes turned inside out, without an end or a side; no ring is made."""
    rows, centres = _centres(spark, 80)
    rng = random.Random(9)
    boxes = []
    for i in range(150):
        x, y, w, h = rng.uniform(-3000, 3000), rng.uniform(-3000, 3000), 10 ** rng.uniform(0, 3.5), 10 ** rng.uniform(0, 3.5)
        boxes.append(("A" if i % 2 else "B", i, x, y, x + w, y + h) if i % 10 else ("A", i, x + w, y, x, y + h))
    boxes += [("A", 150, float("-inf"), 0.0, float("inf"), 9.0), ("A", 151, None, 0.0, 5.0, 9.0), ("A", 152, 0.0, 0.0, 0.0, 0.0)]
    feats = spark.createDataFrame(boxes, "city string, oid int, min_x double, min_y double, max_x double, max_y double")
    pairs = S.box_candidates(centres, feats, 250)
    assert "_near" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    want = {(c, pid, oid) for c, pid, px, py in rows for own, oid, a, b, x, y in boxes
            if c == own and a is not None and math.isfinite(a) and a <= px + 250 and x >= px - 250 and b <= py + 250 and y >= py - 250}
    assert {(r.city, r.pid, r.oid) for r in pairs.collect()} == want and len(want) > 80


def test_paths_are_made_after_the_joins(spark):
    plan = catalog.QUERIES["disc_intersects"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join", 1)
    assert "array(" in above and "array(" not in below
