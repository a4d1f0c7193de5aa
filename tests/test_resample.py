"""Resampled rasters against a plain bilinear formula over the whole raster, seams and edges included."""

import numpy as np
import pytest

from pavement.operators import crops as K
from pavement.operators.resample import resample_raster

GRID = "city string, a double, c double, e double, f double, height int, width int"
SOURCE = [("a", 30.0, 0.0, -30.0, 600.0, 17, 23), ("b", 30.0, 100.0, -20.0, 90.0, 4, 9)]
TARGET = [("a", 10.0, 5.0, -10.0, 580.0, 46, 61), ("b", 45.0, 80.0, -30.0, 120.0, 6, 8), ("c", 1.0, 0.0, -1.0, 0.0, 2, 2)]


def plain(values, source, target):
    _, a, c, e, f, height, width = source
    _, ta, tc, te, tf, rows, columns = target
    out = np.zeros((rows, columns))
    for r in range(rows):
        for k in range(columns):
            v, u = (tf + (r + .5) * te - f) / e - .5, (tc + (k + .5) * ta - c) / a - .5
            if -.5 <= v <= height - .5 and -.5 <= u <= width - .5:
                v, u = min(max(v, 0), height - 1), min(max(u, 0), width - 1)
                i, j = int(v), int(u)
                below, right = min(i + 1, height - 1), min(j + 1, width - 1)
                out[r, k] = ((values[i, j] * (1 - u + j) + values[i, right] * (u - j)) * (1 - v + i)
                             + (values[below, j] * (1 - u + j) + values[below, right] * (u - j)) * (v - i))
    return out


def whole(rows, target, tile):
    _, *_, height, width = target
    out = np.full((-(-height // tile) * tile, -(-width // tile) * tile), np.nan)
    for r in rows:
        if r.city == target[0]:
            out[r.ti * tile:(r.ti + 1) * tile, r.tj * tile:(r.tj + 1) * tile] = np.array(r.dem)
    assert not np.isnan(out).any() and not out[height:].any() and not out[:, width:].any()
    return out[:height, :width]


@pytest.mark.parametrize("tile", [5, 8])
def test_against_the_formula(spark, tile):
    rng = np.random.default_rng(3)
    values = {s[0]: rng.integers(-50, 900, s[5:]).astype(float) for s in SOURCE}
    rows = [(city, r, k, float(v[r, k])) for city, v in values.items() for r in range(v.shape[0]) for k in range(v.shape[1])]
    tiles = K.raster_tiles(spark.createDataFrame(rows, "city string, prow int, pcol int, dem double"), tile, ("dem",))
    source, target = spark.createDataFrame(SOURCE, GRID), spark.createDataFrame(TARGET, GRID)
    found = resample_raster(tiles, source, target, tile).collect()
    assert {r.city for r in found} == {"a", "b"}
    for s, t in zip(SOURCE, TARGET):
        assert np.allclose(whole(found, t, tile), plain(values[s[0]], s, t))
    assert resample_raster(tiles, source, target.limit(0), tile).count() == 0


def test_planes_stay_planes(spark):
    source, target = [("a", 30.0, 0.0, -30.0, 300.0, 10, 10)], [("a", 10.0, 20.0, -10.0, 280.0, 20, 20)]
    plane = lambda x, y: 2 * x - 3 * y + 7
    rows = [("a", r, k, plane(30 * (k + .5), 300 - 30 * (r + .5))) for r in range(10) for k in range(10)]
    tiles = K.raster_tiles(spark.createDataFrame(rows, "city string, prow int, pcol int, dem double"), 4, ("dem",))
    found = resample_raster(tiles, spark.createDataFrame(source, GRID), spark.createDataFrame(target, GRID), 4).collect()
    want = [[plane(20 + 10 * (k + .5), 280 - 10 * (r + .5)) for k in range(20)] for r in range(20)]
    assert np.allclose(whole(found, target[0], 4), want)
