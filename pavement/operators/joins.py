"""Joins between sample tables and the small tables about cities and countries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavement.functions.text import city_key
from pavement.plans.storage import join_side, written


def complete_cities(rgb: DataFrame, dem: DataFrame, landuse: DataFrame, name: str = "file") -> DataFrame:
    """Cities that have all three rasters, matched on the key of the file name; of several files of a key, the first by name."""
    sides = [df.select(city_key(F.col(name)).alias("key"), F.col(name).alias("_f")).groupBy("key")
             .agg(F.min("_f").alias(f"{tag}_file")) for df, tag in ((rgb, "rgb"), (dem, "dem"), (landuse, "landuse"))]
    return sides[0].join(sides[1], "key").join(sides[2], "key")


def mappable_samples(samples: DataFrame, cities: DataFrame, city: str = "city") -> DataFrame:
    """Samples with a flag: does their city have its rasters? Kept and dropped rows in one pass.

    The key is worked out once per city, not once per sample.
    """
    names = samples.select(city).distinct().withColumn("key", city_key(F.col(city)))
    flags = names.join(cities.select("key", F.lit(True).alias("_has")), "key", "left")
    return join_side(samples, flags.select(city, "_has"), [city]).select(
        *samples.columns, F.coalesce("_has", F.lit(False)).alias("mappable"))


def resume_cities(cities: DataFrame, done: DataFrame, key: str = "city") -> DataFrame:
    """Cities that are not in the output yet."""
    return cities.join(done.select(key).distinct(), key, "left_anti")


def attach_city_stats(df: DataFrame, stats: DataFrame, key: str = "city") -> DataFrame:
    return join_side(df, stats, [key])


def assign_split(df: DataFrame, split: DataFrame, key: str = "city") -> DataFrame:
    """Split label of each row by its city; a city that is in no split is test."""
    joined = join_side(df, split.select(key, "split"), [key])
    return joined.withColumn("split", F.coalesce("split", F.lit("test")))


def country_join(dim: DataFrame, metrics: DataFrame, rename: dict[str, str], key: str = "country") -> DataFrame:
    """Metrics onto a country table after renaming; countries without metrics stay, with nulls."""
    names = F.create_map(*[F.lit(v) for pair in rename.items() for v in pair])
    renamed = metrics.withColumn(key, F.coalesce(names[F.col(key)], F.col(key)))
    return dim.join(renamed, key, "left")


def valid_window_fallback(windows: DataFrame, feats: DataFrame, city_avg: DataFrame,
                          on: list[str], columns: list[str]) -> DataFrame:
    """Own features of each window where there are any, else the average of its city."""
    own = feats.select(*on, *[F.col(c).alias(f"_own_{c}") for c in columns])
    avg = written(city_avg.select("city", *[F.col(c).alias(f"_avg_{c}") for c in columns]))
    joined = windows.join(own, on, "left").join(avg, "city", "left")
    return joined.select(*windows.columns, *[
        F.coalesce(f"_own_{c}", f"_avg_{c}").alias(c) for c in columns])
