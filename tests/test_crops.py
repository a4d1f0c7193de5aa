"""Windows cut from tiles, and the channels made of them, against plain slices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavement.functions import scaling as C
from pavement.operators import crops as K
from pavement.operators import learning as L
from pavement.plans.storage import written


def a_raster(height, width, seed):
    rng = np.random.default_rng(seed)
    return {"red": rng.integers(0, 256, (height, width)).astype(float), "green": rng.integers(0, 256, (height, width)).astype(float),
            "blue": rng.integers(0, 256, (height, width)).astype(float), "dem": rng.integers(-200, 4000, (height, width)).astype(float),
            "landuse": rng.integers(0, 10, (height, width)).astype(float)}


@pytest.fixture(scope="module")
def rasters():
    return {"a": a_raster(17, 23, 1), "b": a_raster(4, 9, 2)}


@pytest.fixture(scope="module")
def pixels(spark, rasters):
    rows = [(city, r, c, *(float(bands[b][r, c]) for b in K.BANDS)) for city, bands in rasters.items()
            for r in range(bands["red"].shape[0]) for c in range(bands["red"].shape[1]) if (r, c) != (3, 3)]
    return spark.createDataFrame(rows, "city string, prow int, pcol int, " + ", ".join(f"{b} double" for b in K.BANDS))


def cut(raster, r0, c0, size):
    out = np.zeros((size, size))
    for i in range(size):
        for j in range(size):
            if 0 <= r0 + i < raster.shape[0] and 0 <= c0 + j < raster.shape[1] and (r0 + i, c0 + j) != (3, 3):
                out[i, j] = raster[r0 + i, c0 + j]
    return out


@pytest.mark.parametrize(("size", "tile"), [(6, 5), (4, 8), (7, 3), (1, 4)])
def test_windows_are_slices(spark, rasters, pixels, size, tile):
    rng = np.random.default_rng(size)
    rows = [(i, city, int(rng.integers(-2, 17)), int(rng.integers(-2, 20)), "kept") for i, city in enumerate("ab" * 20)]
    rows += [(100, "none", 0, 0, "kept"), (101, "a", None, 3, "kept")]
    samples = spark.createDataFrame(rows, "sid long, city string, row_start long, col_start long, red_note string")
    got = K.extract_crops(samples, K.raster_tiles(pixels, tile), size, tile).collect()
    assert len(got) == len(rows) and got[0]["red_note"] == "kept"
    for r in got:
        for b in K.BANDS:
            if r["sid"] == 101:
                assert r[b] is None
            elif r["sid"] == 100:
                assert r[b] == [[0.0] * size] * size
            else:
                assert np.array_equal(r[b], cut(rasters[r["city"]][b], r["row_start"], r["col_start"], size))


def test_plan_has_no_pixel_row_per_sample(spark, pixels):
    samples = spark.createDataFrame([(i, "a", 5, 5) for i in range(40)], "sid long, city string, row_start long, col_start long")
    tiles = K.raster_tiles(pixels, 8)
    tiles.write.mode("overwrite").format("noop").save()
    met = K.extract_crops(samples, tiles, 8, 8).withColumn("n", F.size("red"))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(sequence") == 2 or plan.lower().count("generate explode") == 2
    # 8 x 8 windows from (5, 5) meet four tiles of 8 x 8
    wanted = samples.select(F.explode(F.sequence(F.floor(F.col("row_start") / 8), F.floor((F.col("row_start") + 7) / 8))))
    assert wanted.count() == 80


def test_the_same_pixel_twice_is_an_error(spark):
    twice = spark.createDataFrame([("a", 0, 0, 1.0)] * 2, "city string, prow int, pcol int, v double")
    with pytest.raises(Exception, match="twice"):
        K.raster_tiles(twice, 4, ("v",)).collect()


def test_no_samples_and_no_tiles(spark, pixels):
    none = spark.createDataFrame([], "sid long, city string, row_start long, col_start long")
    assert K.extract_crops(none, K.raster_tiles(pixels, 4), 4, 4).count() == 0
    assert K.raster_tiles(pixels.limit(0), 4).count() == 0
    one = spark.createDataFrame([(1, "a", 0, 0)], none.schema)
    assert K.extract_crops(one, K.raster_tiles(pixels, 4).limit(0), 2, 4).first()["dem"] == [[0.0, 0.0]] * 2


@pytest.mark.parametrize("normalise", [False, True])
def test_channels(spark, rasters, pixels, normalise):
    size, tile = 6, 7
    samples = spark.createDataFrame([(1, "a", 2, 9), (2, "b", -1, 5), (3, "a", None, None)],
                                    "sid long, city string, row_start long, col_start long")
    images = K.model_channels(K.extract_crops(samples, K.raster_tiles(pixels, tile), size, tile), normalise).collect()
    for r in images:
        if r["sid"] == 3:
            assert r["image"] is None
            continue
        window = {b: cut(rasters[r["city"]][b], r["row_start"], r["col_start"], size) for b in K.BANDS}
        expected = [window[c] / 255 for c in C.CHANNELS]
        if normalise:
            expected = [(x - C.IMAGENET_MEAN[c]) / C.IMAGENET_STD[c] for x, c in zip(expected, C.CHANNELS)]
        expected.append((np.clip(window["dem"], -50, 3000) + 50) / 3050)
        expected += [(window["landuse"] == k).astype(float) for k in range(8)]
        assert np.allclose(np.array(r["image"]).reshape(K.channel_shape(size)), expected)


def test_a_function_of_tensors(spark, pixels):
    samples = spark.createDataFrame([(k, "a", k, k) for k in range(9)], "sid long, city string, row_start long, col_start long")
    images = K.model_channels(K.extract_crops(samples, K.raster_tiles(pixels, 4), 3, 4)).select("sid", "image")

    def make():
        return lambda batch: batch[:, 3, 1, 2] + 10 * batch.shape[1]

    got = {r["sid"]: r["v"] for r in L.batch_score(images, make, "image", K.channel_shape(3), batch_size=4, out="v").collect()}
    plain = {r["sid"]: r["image"][3 * 9 + 1 * 3 + 2] + 120 for r in images.collect()}
    assert all(abs(got[k] - plain[k]) < 1e-5 for k in plain) and len(got) == 9


def test_windows_are_cut_in_many_tasks(spark, pixels):
    tiles = written(K.raster_tiles(pixels, 8))
    samples = spark.createDataFrame([(i, "a", i % 9, i % 13) for i in range(200)],
                                    "sid long, city string, row_start long, col_start long").coalesce(1)
    made = K.extract_crops(samples, tiles, 8, 8).select(F.spark_partition_id().alias("task"), F.size("red").alias("n"))
    assert len({r["task"] for r in made.where("n = 8").collect()}) > 1
