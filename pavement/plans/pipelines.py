"""The two table-building pipelines, for all cities at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavement.functions.projection import utm_xy, utm_zone
from pavement.functions.scaling import default_features, log_clip, zscore
from pavement.operators import joins, statistics
from pavement.operators.density import density_metrics
from pavement.operators.grid import adaptive_grid
from pavement.operators.learning import kmeans_by_city
from pavement.operators.sampling import stratified_sample
from pavement.plans.storage import written


def grid_points(boxes: DataFrame, min_candidates: int = 2000, step_m: float = 450.0) -> DataFrame:
    """Sample lattice of every city with ids and UTM metres; the zone is that of the box."""
    zone = utm_zone((F.col("min_lon") + F.col("max_lon")) / 2)
    zones = written(boxes.select("city", zone.alias("zone"), ((F.col("min_lat") + F.col("max_lat")) < 0).alias("south")))
    points = adaptive_grid(boxes, min_candidates, step_m).join(zones, "city")
    x, y = utm_xy(F.col("lon"), F.col("lat"), F.col("zone"), F.col("south"))
    # lattice positions fit in 31 bits each
    return points.select("city", (F.shiftleft("gi", 31) + F.col("gj")).alias("pid"), "lon", "lat",
                         x.alias("x"), y.alias("y"))


def sample_table(boxes: DataFrame, roads: DataFrame, buildings: DataFrame, pois: DataFrame,
                 done: DataFrame | None = None, per_cluster: int = 100, iters: int = 20) -> DataFrame:
    """City boxes and map layers (in UTM metres) to clustered, stratified sample points.

    Cities that ``done`` already holds are skipped.
    """
    if done is not None:
        boxes = joins.resume_cities(boxes, done)
    points = written(grid_points(boxes))
    clustered = kmeans_by_city(density_metrics(points, roads, buildings, pois), iters=iters)
    rows = points.join(clustered.drop("x", "y"), ["city", "pid"])
    small = rows.where(F.col("cluster").isNull())  # too few points to cluster: all are kept
    sampled = stratified_sample(rows.where(F.col("cluster").isNotNull()), n=per_cluster)
    return sampled.unionByName(small).select(
        "city", "cluster", "lat", "lon", "road_density", "building_density", "poi_density")


def training_table(samples: DataFrame, rasters: tuple[DataFrame, DataFrame, DataFrame], split: DataFrame,
                   label: str = "population_15min_walk") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Labelled samples of cities with rasters to training rows, and their statistics tables."""
    rows = statistics.sample_coords(statistics.labelled_only(samples, label)).withColumn(
        "osm_features", default_features(F.col("osm_features")))
    kept = joins.mappable_samples(rows, joins.complete_cities(*rasters)).where("mappable").drop("mappable")
    placed = written(joins.assign_split(kept, split))
    city_stats = statistics.city_target_stats(placed, label)
    table = joins.attach_city_stats(statistics.standardise_features(placed), city_stats)
    table = table.withColumn("target", zscore(log_clip(F.col(label)), F.col("log_mean"), F.col("log_std")))
    return table, {"city_stats": city_stats, "global_stats": statistics.global_target_stats(placed, label),
                   "feature_stats": statistics.feature_stats(placed)}


def evaluate(table: DataFrame, score: Callable[[DataFrame], DataFrame], label: str) -> tuple[DataFrame, DataFrame]:
    """Score the test split and return overall metrics and the error per cluster, as counts."""
    from pavement.operators.metrics import cluster_mae, regression_metrics

    scored = written(score(statistics.split_rows(table, "test")))
    return regression_metrics(scored, "pred", label), cluster_mae(scored, "pred", label)
