"""Rasterised polygons against a point-in-polygon test of every pixel centre."""

import random

from pavement.operators.rasterise import rasterise_polygons

SHAPE = "city string, rings array<array<struct<x:double,y:double>>>, parts array<array<array<struct<x:double,y:double>>>>, landuse int, weight int"
GRID = "city string, a double, c double, e double, f double, height int, width int"
GRIDS = [("a", 10.0, 3.0, -10.0, 400.0, 40, 30), ("b", 7.0, -50.0, -5.0, 90.0, 25, 33)]


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def plain(shapes, weighted):
    out = {}
    for city, a, c, e, f, height, width in GRIDS:
        for r in range(height):
            for k in range(width):
                hits = [(w if weighted else 0, kind) for town, rings, parts, kind, w in shapes
                        if town == city and kind is not None and any(inside(c + (k + .5) * a, f + (r + .5) * e, p) for p in parts or [rings or []])]
                if hits:
                    out[city, r, k] = max(hits)[1]
    return out


def test_against_every_pixel(spark):
    draw = random.Random(4)
    ring = lambda n, lo, hi: [(float(draw.randrange(lo, hi)), float(draw.randrange(lo, hi))) for _ in range(n)]
    square = lambda x, y, s: [(x, y), (x, y + s), (x + s, y + s), (x + s, y)]
    shapes = [(draw.choice("ab"), [ring(draw.randrange(3, 9), -80, 420)], None, draw.randrange(8), draw.randrange(5)) for _ in range(14)]
    shapes += [("a", [square(20.0, 30.0, 200.0), square(60.0, 70.0, 55.0)], None, 3, 9),  # a hole
               ("a", None, [[square(8.0, 300.0, 45.0)], [square(150.0, 310.0, 40.0), square(160.0, 320.0, 11.0)]], 6, 9),  # parts
               ("b", [square(-1000.0, -1000.0, 5000.0)], None, 0, 0),  # larger than the raster
               ("b", [[(1.0, 1.0)]], None, 7, 9), ("b", [], None, 7, 9), ("b", None, None, 7, 9), ("c", [square(0.0, 0.0, 9.0)], None, 1, 1),
               ("a", [square(0.0, 0.0, 300.0)], None, None, 9)]
    shapes += shapes[:3]  # copies
    vertices = lambda rings: rings and [[{"x": x, "y": y} for x, y in r] for r in rings]
    rows = [(t, vertices(rings), parts and [vertices(p) for p in parts], k, w) for t, rings, parts, k, w in shapes]
    df, grids = spark.createDataFrame(rows, SHAPE).repartition(3), spark.createDataFrame(GRIDS, GRID)
    for priority in (None, "weight"):
        got = {(r.city, r.prow, r.pcol): r.landuse for r in rasterise_polygons(df, grids, priority=priority).collect()}
        assert got == plain(shapes, priority is not None)
        assert len(got) > 1000
    assert rasterise_polygons(df.limit(0), grids).count() == 0
