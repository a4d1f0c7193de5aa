"""Readers, writers, the stream and the two pipelines."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavement.operators import learning as L
from pavement.operators.metrics import run_comparison
from pavement.plans import pipelines
from pavement.sources import readers, schemas, writers
from pavement.streaming import enrich as E


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


BOXES = {"cities": [{"city": "Graz, Austria", "bbox": [[47.0, 15.3], [47.0, 15.5], [47.1, 15.5], [47.1, 15.3]]},
                    {"city": "Linz, Austria", "bbox": [[48.2, 14.2], [48.2, 14.3], [48.3, 14.3], [48.3, 14.2]]}]}


def test_city_boxes(spark, folder):
    with open(f"{folder}/boxes.json", "w") as f:
        json.dump(BOXES, f, indent=2)
    rows = [tuple(r) for r in readers.read_city_boxes(spark, f"{folder}/boxes.json").collect()]
    assert rows == [("Graz, Austria", 15.3, 47.0, 15.5, 47.1), ("Linz, Austria", 14.2, 48.2, 14.3, 48.3)]


@pytest.mark.parametrize("layout", ["array", "lines"])
def test_samples(spark, folder, layout):
    records = [{"city": "A, N", "lat": 1.0, "lon": 2.0, "population_15min_walk": 5.0, "start_point": {"lat": 1.5, "lng": 2.5},
                "walking_isochrone": {"type": "Polygon", "coordinates": [[[1, 2], [3, 4]]]}},
               {"city": "B, N", "lat": 3.0, "lon": 4.0, "population_15min_walk": 6.0},
               {"city": "A, N", "lat": 5.0, "lon": 6.0, "error": "Failed to get isochrone", "population_15min_walk": None}]
    with open(f"{folder}/s.json", "w") as f:
        json.dump(records, f, indent=4) if layout == "array" else f.writelines(json.dumps(r) + "\n" for r in records)
    path = f"{folder}/s.json"
    assert readers.read_samples(spark, path, layout=layout).count() == 2
    assert readers.read_samples(spark, path, labelled=False, cities=["A, N"], layout=layout).count() == 2
    row = readers.read_samples(spark, path, cities=["A, N"], layout=layout).collect()[0]
    assert row.start_point.lng == 2.5 and json.loads(row.walking_isochrone.coordinates) == [[[1, 2], [3, 4]]]
    with pytest.raises(ValueError):
        readers.read_samples(spark, path, layout="lines" if layout == "array" else "array")


def test_samples_of_other_shapes(spark, folder):
    records = [{"city": "A", "population_15min_walk": 1.0, "osm_features": [1.0, 2.0]},
               {"city": "B", "population_15min_walk": 1.0, "osm_features": {"pois": 4.0, "roads": 3.0}},
               {"city": "C", "population_15min_walk": 1.0}]
    with open(f"{folder}/s.json", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in records)
    names = ("roads", "pois", "stops")
    rows = readers.read_samples(spark, f"{folder}/s.json", layout="lines", features=names).orderBy("city").collect()
    assert [r.osm_features for r in rows] == [[1.0, 2.0], [3.0, 4.0, None], None]
    with pytest.raises(Exception, match="pois"):  # names that are not among the fifteen
        readers.read_samples(spark, f"{folder}/s.json", layout="lines").collect()
    with open(f"{folder}/s.json", "a") as f:
        f.write('{"city": "D", "popul\n')
    with pytest.raises(Exception):
        readers.read_samples(spark, f"{folder}/s.json", layout="lines").collect()


def test_layers(spark, folder):
    stops = spark.createDataFrame([("A, N", "s1", 1.0, 2.0), ("B, N", "s2", 3.0, 4.0)], schemas.LAYERS["transport"])
    writers.write_layer(stops, folder, "transport")
    assert [r.oid for r in readers.read_layers(spark, folder, "A, N", "transport").collect()] == ["s1"]
    for city, layer in (("A, N", "pois"), ("C, N", "transport")):
        absent = readers.read_layers(spark, folder, city, layer)
        assert absent.count() == 0 and {"city", "oid", "x", "y"} <= set(absent.columns)


def test_rerun_replaces_only_its_cities(spark, folder):
    def frame(*rows):
        return spark.createDataFrame(list(rows), "city string, lat double, lon double")

    writers.write_samples(frame(("A", 1.0, 1.0), ("B", 2.0, 2.0)), f"{folder}/samples")
    writers.write_samples(frame(("B", 9.0, 9.0), ("C", 3.0, 3.0)), f"{folder}/samples")
    got = sorted((r.city, r.lat) for r in spark.read.parquet(f"{folder}/samples").collect())
    assert got == [("A", 1.0), ("B", 9.0), ("C", 3.0)]


def test_report(spark, folder):
    writers.write_report(spark.createDataFrame([("X", 1.5)], "country string, mae double"), f"{folder}/report")
    assert [r.mae for r in spark.read.json(f"{folder}/report").collect()] == [1.5]


def test_incremental_enrichment(spark, folder):
    """Batch and stream give the same rows; a rerun adds nothing; new files add only new points."""
    points = spark.range(300).select("id", (F.col("id") * 1.0).alias("x"))
    labels = spark.range(0, 300, 2).select("id", (F.col("id") * 10.0).alias("population"))

    def add_labels(batch):
        joined = batch.join(labels, "id", "left")
        return joined.withColumn("error", F.when(F.col("population").isNull(), "Failed to get population"))

    def run():
        stream = spark.readStream.schema("id long, x double").parquet(f"{folder}/in")
        E.incremental_enrich(stream, add_labels, f"{folder}/out", f"{folder}/state").awaitTermination()
        return E.enriched(spark, f"{folder}/out", "id long, x double, population double, error string").select(
            "id", "x", "population", "error")

    points.where("id < 200").write.parquet(f"{folder}/in")
    first = run()
    assert first.exceptAll(add_labels(points.where("id < 200"))).count() == 0 and first.count() == 200
    assert run().count() == 200
    points.where("id >= 100").write.mode("append").parquet(f"{folder}/in")
    assert run().count() == 300
    assert E.failed_points(run()).count() == 150
    labels = points.select("id", F.lit(7.0).alias("population"))  # the service answers again
    points.where("id < 10").write.mode("append").parquet(f"{folder}/in")
    last = {r.id: r.population for r in run().collect()}
    assert len(last) == 300 and last[1] == 7.0 and last[2] == 20.0 and last[11] is None


def test_enrichment_by_client(spark):
    def client(batches):
        for pdf in batches:
            yield pdf.assign(population=pdf.x * 2, error=None)

    out = E.enrich_with(client, "id long, x double, population double, error string")(spark.range(5).select("id", (F.col("id") * 1.0).alias("x")))
    assert sorted(r.population for r in out.collect()) == [0.0, 2.0, 4.0, 6.0, 8.0]
    assert E.enriched(spark, "/tmp/none-such", "id long").count() == 0


def test_sample_and_training_pipelines(spark, folder):
    boxes = spark.createDataFrame([("Graz, Austria", 15.40, 47.00, 15.44, 47.03), ("Linz, Austria", 14.20, 48.20, 14.24, 48.23)],
                                  "city string, min_lon double, min_lat double, max_lon double, max_lat double")
    points = pipelines.grid_points(boxes, min_candidates=150)
    near = points.select("city", (F.col("x") + 20).alias("x"), (F.col("y") + 20).alias("y"), "pid")
    roads = near.select("city", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("pid") % 97).alias("x2"), F.col("y").alias("y2"))
    ring = [F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in ((0, 0), (9, 0), (9, 9), (0, 9))]
    built = near.where("pid % 3 = 0").select("city", F.lit("Polygon").alias("geom_type"), F.array(F.array(*ring)).alias("rings"))
    done = spark.createDataFrame([("Linz, Austria",)], "city string")
    sampled = pipelines.sample_table(boxes, roads, built, near, done, per_cluster=20, iters=3)
    counts = sampled.groupBy("city", "cluster").count().collect()
    assert {r.city for r in counts} == {"Graz, Austria"} and all(r["count"] <= 20 for r in counts)

    rows = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, "Graz, Austria").when(F.col("id") % 4 == 1, "Linz, Austria").otherwise("Wels, Austria").alias("city"),
        (F.col("id") % 5).cast("int").alias("cluster"), F.lit(47.0).alias("lat"), F.lit(15.0).alias("lon"),
        F.when(F.col("id") % 7 > 0, F.col("id") * 3.0).alias("population_15min_walk"),
        F.lit(None).cast("struct<lat:double,lng:double>").alias("start_point"),
        F.when(F.col("id") % 9 > 0, F.array(*[(F.col("id") % (k + 2)).cast("double") for k in range(15)])).alias("osm_features"))
    files = [spark.createDataFrame([(f"{c}_{s}.tif",) for c in ("Graz_Austria", "Linz_Austria")], "file string") for s in ("10m", "DEM", "LandUse")]
    split = spark.createDataFrame([("Graz, Austria", "train")], "city string, split string")
    table, stats = pipelines.training_table(rows, tuple(files), split)
    writers.write_training_table(table, stats, folder)
    back = spark.read.parquet(f"{folder}/samples")
    assert {r.city for r in back.select("city").distinct().collect()} == {"Graz, Austria", "Linz, Austria"}
    assert spark.read.parquet(f"{folder}/feature_stats").count() == 15
    z = back.where("city = 'Linz, Austria'").agg(F.avg("target"), F.stddev_pop("target")).collect()[0]
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)

    def perfect(frame):
        return frame.withColumn("pred", F.least("population_15min_walk", F.lit(80000.0)))

    overall, clusters = pipelines.evaluate(back, perfect, "population_15min_walk")
    assert overall.collect()[0].mae == 0.0 and clusters.count() == 5


def test_batch_score_and_transform(spark):
    df = spark.createDataFrame([(i, [float(i)] * 15) for i in range(10)], "id long, tabular array<double>")

    def make():
        return lambda batch: batch.sum(axis=1)

    assert sorted(r.z_pred for r in L.batch_score(df, make).collect()) == [15.0 * i for i in range(10)]
    turned = L.with_transform(df, lambda v: np.flip(v) + 1, "tabular").collect()
    assert all(r.tabular == [r.id + 1.0] * 15 for r in turned)


def test_split_file(spark, folder):
    cities = spark.createDataFrame([("B", "train"), ("A", "train"), ("C", "test")], "city string, split string")
    samples = spark.createDataFrame([(c,) for c in "AABCCCD"], "city string")
    writers.write_split(cities, samples, f"{folder}/split.json")
    rows = {r.city: (r.split, r.n_cities, r.n_samples) for r in readers.read_split(spark, f"{folder}/split.json").collect()}
    assert rows == {"A": ("train", 2, 3), "B": ("train", 2, 3), "C": ("test", 1, 3)}
    with open(f"{folder}/other.json", "w") as f:
        json.dump({"seed": 1, "strategy": "x", "n_cities": {"train": 1}, "train": ["Z"], "val": []}, f, indent=2)
    assert [tuple(r) for r in readers.read_split(spark, f"{folder}/other.json").collect()] == [("Z", "train", 1, None)]


def test_results_of_runs(spark, folder):
    assert readers.read_results(spark, f"{folder}/none").count() == 0
    for run, found in {"dual 1": {"mae": 2.0, "rmse": 3.0, "r2": 0.5, "loss": 1, "epoch": 7}, "film+": {"mae": 1.5}}.items():
        os.makedirs(f"{folder}/{run}")
        with open(f"{folder}/{run}/test_results.json", "w") as f:
            json.dump(found, f, indent=2)
    os.makedirs(f"{folder}/unfinished")
    runs = {r.run: (r.mae, r.rmse) for r in run_comparison(readers.read_results(spark, folder)).collect()}
    assert runs == {"dual 1": (2.0, 3.0), "film+": (1.5, None)}
    results = spark.createDataFrame([("x", 1.0, 2.0)], "run string, mae double, loss double")
    for _ in range(2):
        writers.write_results(results, f"{folder}/written")
    assert sorted(tuple(r) for r in readers.read_results(spark, f"{folder}/written", "*/*.json").collect()) == [("x", "loss", 2.0), ("x", "mae", 1.0)]
