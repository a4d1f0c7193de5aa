"""Queries of the split file, of result folders and of rasterised polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from pavement.operators import metrics as M
from pavement.operators import rasterise as Z
from pavement.plans.registry import query
from pavement.plans.sample_queries import rounded
from pavement.plans.source_queries import _place
from pavement.plans.spatial_queries import buildings
from pavement.sources import readers, writers


@query("split_file", """
SELECT city, split, count(*) OVER (PARTITION BY split) AS n_cities, CAST(sum(n) OVER (PARTITION BY split) AS BIGINT) AS n_samples FROM (
  SELECT city, CASE length(city) % 3 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM b_label GROUP BY city)""")
def _split(b):
    path = _place(b)
    size = F.length("city") % 3
    split = F.when(size == 0, "val").when(size == 1, "test").otherwise("train")
    writers.write_split(b.label.select("city", split.alias("split")).distinct(), b.label, path)
    return readers.read_split(b.spark, path)


@query("read_results", """
SELECT concat('run_', cluster) AS run, round(avg(abs(pred - target)), 4) AS mae,
       round(sqrt(avg((pred - target) * (pred - target))), 4) AS rmse FROM b_pred GROUP BY cluster""")
def _results(b):
    """One result document per run, read back and compared."""
    path = _place(b)
    writers.write_results(M.grouped_metrics(b.pred.withColumn("run", F.concat(F.lit("run_"), "cluster")), "run").select("run", "mae", "rmse"), path)
    return rounded(M.run_comparison(readers.read_results(b.spark, path, "*/*.json"), ("mae", "rmse")), 4, "mae", "rmse")


RES, SIDE = 20, 500

_COVERED = {
    "shape": f"""SELECT city, 1 + oid % 7 AS landuse, floor((10000 - cy - half) / {RES} - 0.5) + 1 AS r0, floor((10000 - cy + half) / {RES} - 0.5) AS r1,
  ceil((cx - half) / {RES} - 0.5) AS c0, ceil((cx + half) / {RES} - 0.5) - 1 AS c1 FROM b_building WHERE geom_type = 'Polygon'""",
    "lines": f"""SELECT *, unnest(range(CAST(greatest(r0, 0) AS BIGINT), CAST(least(r1, {SIDE - 1}) AS BIGINT) + 1)) AS prow FROM shape""",
    "covered": f"""SELECT *, unnest(range(CAST(greatest(c0, 0) AS BIGINT), CAST(least(c1, {SIDE - 1}) AS BIGINT) + 1)) AS pcol FROM lines""",
}


@query("rasterise_polygons", "SELECT city, prow, pcol, max(landuse) AS landuse FROM covered GROUP BY city, prow, pcol", _COVERED)
def _rasterise(b):
    """The buildings' squares as classes on a 20 m raster per city."""
    grids = b.city.select("city", F.lit(float(RES)).alias("a"), F.lit(0.0).alias("c"), F.lit(-float(RES)).alias("e"), F.lit(10000.0).alias("f"),
                          F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width")).distinct()
    shapes = buildings(b).where("geom_type = 'Polygon'").withColumn("landuse", (1 + F.col("oid") % 7).cast("long"))
    return Z.rasterise_polygons(shapes, grids).select("city", F.col("prow").cast("long").alias("prow"), F.col("pcol").cast("long").alias("pcol"), "landuse")
