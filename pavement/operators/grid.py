"""Point lattices over city boxes and window lattices over rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavement.functions.projection import utm_xy, utm_zone
from pavement.plans.storage import join_side

# Metres per degree.
METRES_PER_DEGREE = 111320.0
EQUATOR = 40_075_000.0


def total_bounds(points: DataFrame, keys=("city",)) -> DataFrame:
    """Smallest and largest longitude and latitude per city."""
    return points.groupBy(*keys).agg(*[
        fn(axis).alias(f"{name}_{axis}")
        for axis in ("lon", "lat") for name, fn in (("min", F.min), ("max", F.max))])


def _steps(n: Column) -> Column:
    """0 .. n-1, empty for n = 0 (a descending sequence otherwise)."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def _lattice(boxes: DataFrame, step_x: Column, step_y: Column, keys: list[str]) -> DataFrame:
    """Half-open lattice over each box. The columns of the lattice are spread over the
    cluster before they are filled, so one very large city is not one task."""
    return (
        boxes.withColumns({"_sx": step_x, "_sy": step_y})
        .withColumn("gi", F.explode(_steps(F.ceil((F.col("max_lon") - F.col("min_lon")) / F.col("_sx")))))
        .repartition(*keys, "gi")
        .withColumn("gj", F.explode(_steps(F.ceil((F.col("max_lat") - F.col("min_lat")) / F.col("_sy")))))
        .select(*keys, "gi", "gj",
                (F.col("min_lon") + F.col("gi") * F.col("_sx")).alias("lon"),
                (F.col("min_lat") + F.col("gj") * F.col("_sy")).alias("lat"))
    )


def adaptive_grid(boxes: DataFrame, min_candidates: int = 2000, step_m: float = 450.0,
                  keys=("city",)) -> DataFrame:
    """Sample lattice: ``step_m`` apart, closer in a box that would get too few points."""
    per_lon = F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2)) * EQUATOR / 360
    area = ((F.col("max_lon") - F.col("min_lon")) * per_lon
            * (F.col("max_lat") - F.col("min_lat")) * METRES_PER_DEGREE)
    step = F.when(area / (step_m * step_m) < min_candidates, F.sqrt(area / min_candidates)).otherwise(float(step_m))
    real = boxes.where((F.col("max_lon") > F.col("min_lon")) & (F.col("max_lat") > F.col("min_lat")))
    return _lattice(real, step / per_lon, step / METRES_PER_DEGREE, list(keys))


def tile_centres(boxes: DataFrame, step_m: float = 2900.0, keys=("city",)) -> DataFrame:
    """Download tile centres covering each box."""
    per_lon = F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2)) * METRES_PER_DEGREE
    return _lattice(boxes, step_m / per_lon, F.lit(step_m / METRES_PER_DEGREE), list(keys))


def sliding_windows(meta: DataFrame, crop: int = 224, stride: int = 56, key: str = "city") -> DataFrame:
    """Window centres of each raster with their position in the prediction grid."""
    half = crop // 2

    def count(extent: str) -> Column:
        return F.greatest(F.ceil((F.col(extent) - 2 * half) / F.lit(stride)), F.lit(0).cast("bigint"))

    return (
        meta.withColumn("gi", F.explode(_steps(count("height"))))
        .repartition(key, "gi")
        .withColumn("gj", F.explode(_steps(count("width"))))
        .select(key, "gi", "gj", (half + F.col("gi") * stride).alias("prow"),
                (half + F.col("gj") * stride).alias("pcol"))
    )


def utm_project(points: DataFrame, key: str = "city") -> DataFrame:
    """UTM zone and metres of every point; the zone is that of the centre of the city's extent."""
    bounds = total_bounds(points, (key,))
    zones = bounds.select(
        key, utm_zone((F.col("min_lon") + F.col("max_lon")) / 2).alias("zone"),
        (F.col("min_lat") + F.col("max_lat") < 0).alias("_south"))
    east, north = utm_xy(F.col("lon"), F.col("lat"), F.col("zone"), F.col("_south"))
    return (join_side(points, zones, [key])
            .withColumns({"easting": east, "northing": north}).drop("_south"))
