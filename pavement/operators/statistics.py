"""Row filters, label and feature statistics, and status reports of sample tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavement.functions import scaling as C
from pavement.functions.text import country_of
from pavement.operators.ranking import exact_percentiles
from pavement.plans.storage import join_side

LABEL = "population"


def labelled_only(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.where(F.col(label).isNotNull())


def pending_only(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.where(F.col(label).isNull())


def split_rows(df: DataFrame, split: str, valid: str | None = "valid") -> DataFrame:
    """Rows of one split that are valid; with a table partitioned by split, a partition filter."""
    rows = df.where(F.col("split") == split)
    return rows.where(F.col(valid)) if valid and valid in df.columns else rows


def union_splits(df: DataFrame, splits=("val", "test")) -> DataFrame:
    return df.where(F.col("split").isin(*splits))


def union_chunks(frames: list[DataFrame]) -> DataFrame:
    """Concatenate frames whose columns differ; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sample_coords(df: DataFrame) -> DataFrame:
    """Start point of the walk if known, else the sample point, else 0."""
    return df.withColumns({
        "lat": F.coalesce(F.col("start_point.lat"), F.col("lat"), F.lit(0.0)),
        "lon": F.coalesce(F.col("start_point.lng"), F.col("lon"), F.lit(0.0))})


def city_target_stats(df: DataFrame, label: str = LABEL, key: str = "city") -> DataFrame:
    """Mean and population deviation of the log label per city; the deviation has a floor."""
    log_label = C.log_clip(F.col(label))
    return labelled_only(df, label).groupBy(key).agg(
        F.avg(log_label).alias("log_mean"),
        F.greatest(F.stddev_pop(log_label), F.lit(C.STD_FLOOR)).alias("log_std"))


def global_target_stats(df: DataFrame, label: str = LABEL) -> DataFrame:
    """The same over the train split as a whole."""
    log_label = C.log_clip(F.col(label))
    return labelled_only(split_rows(df, "train", None), label).agg(
        F.avg(log_label).alias("log_mean"), F.stddev_pop(log_label).alias("log_std"))


def _feature_aggregates(features: str, n: int) -> list[Column]:
    logs = [F.log1p(F.col(features)[i]) for i in range(n)]
    return [F.array(*[F.avg(v) for v in logs]).alias("_mean"),
            F.array(*[F.stddev_pop(v) + 1e-8 for v in logs]).alias("_std")]


def feature_stats(df: DataFrame, features: str = "osm_features", n: int = 15) -> DataFrame:
    """Mean and deviation of each log feature over the train split, one row per feature, in one pass."""
    wide = split_rows(df, "train", None).agg(*_feature_aggregates(features, n))
    return wide.select(F.posexplode(F.arrays_zip("_mean", "_std")).alias("idx", "_s")).select(
        F.col("idx"), F.col("_s._mean").alias("mean"), F.col("_s._std").alias("std"))


def standardise_features(df: DataFrame, features: str = "osm_features", n: int = 15,
                         out: str = "tabular") -> DataFrame:
    """Log z-score of the features of all splits with the statistics of the train split.

    The input is read twice: pass a written table when it is expensive to compute.
    """
    stats = split_rows(df, "train", None).agg(*_feature_aggregates(features, n)).select(
        F.struct("_mean", "_std").alias("_s")).scalar()
    return (df.withColumn("_s", stats)
            .withColumn(out, F.array(*[
                (F.log1p(F.col(features)[i]) - F.col("_s._mean")[i]) / F.col("_s._std")[i] for i in range(n)]))
            .drop("_s"))


def feature_coverage(df: DataFrame, features: str = "osm_features") -> DataFrame:
    """Rows, and rows with any non-zero feature."""
    return df.agg(F.count("*").alias("n"),
                  F.count_if(F.exists(F.col(features), lambda v: v > 0)).alias("with_features"))


def feature_table(df: DataFrame, id_: str, features: str = "osm_features") -> DataFrame:
    """Features as long rows (id, idx, name, value): named for maps, numbered for lists."""
    if dict(df.dtypes)[features].startswith("map"):
        pairs = F.map_entries(F.col(features))
        return df.select(id_, F.posexplode(pairs).alias("idx", "_e")).select(
            id_, "idx", F.col("_e.key").alias("name"), F.col("_e.value").alias("value"))
    return df.select(id_, F.posexplode(features).alias("idx", "value")).select(
        id_, "idx", F.format_string("osm_feat_%02d", F.col("idx")).alias("name"), "value")


def city_profiles(df: DataFrame, label: str = LABEL, key: str = "city") -> DataFrame:
    """Per city: mean label, dominant cluster (smallest on ties; a missing one counts as 0), labelled rows, country."""
    rows = labelled_only(df, label).withColumn("cluster", F.coalesce("cluster", F.lit(0)))
    per_cluster = rows.groupBy(key, "cluster").agg(F.count("*").alias("_n"), F.sum(label).alias("_s"))
    return per_cluster.groupBy(key).agg(
        (F.sum("_s") / F.sum("_n")).alias("avg_label"),
        F.min_by("cluster", F.struct(-F.col("_n"), "cluster")).alias("dom_cluster"),
        F.sum("_n").alias("n"),
    ).withColumn("country", country_of(F.col(key)))


def label_summary(df: DataFrame, label: str = LABEL, distance: str = "approximation_m") -> DataFrame:
    """Count, mean, median, extremes of label and distance, and how many points lie far from a street."""
    far, very_far = F.count_if(F.col(distance) > 100), F.count_if(F.col(distance) > 250)
    plain = df.agg(
        *[fn(c).alias(f"{c}_{name}") for c in (label, distance)
          for name, fn in (("n", F.count), ("mean", F.avg), ("min", F.min), ("max", F.max))],
        far.alias("n_over_100m"), very_far.alias("n_over_250m"),
        (far / F.nullif(F.count(distance), F.lit(0)) * 100).alias("pct_over_100m"),
        (very_far / F.nullif(F.count(distance), F.lit(0)) * 100).alias("pct_over_250m"))
    for column in (label, distance):
        median = exact_percentiles(df, column, {"m": 0.5}).scalar()
        plain = plain.withColumn(f"{column}_median", median)
    return plain


def enrich_status(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Total, done, pending, failed and valid rows by split and city, by split, and over all."""
    done = F.col(label).isNotNull()
    return df.rollup("split", "city").agg(
        F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(~done).alias("pending"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count_if(done & F.col("valid")).alias("valid"), F.grouping_id().alias("level"),
    ).fillna("(all)", subset=["split", "city"])


def minmax_by_city(df: DataFrame, columns: list[str], key: str = "city") -> DataFrame:
    """Min-max scaling within each city: 0 for a constant column, null for one that sums to 0.

    Aggregate and join back, not a window, so that a city is never one task. The
    input is read twice: pass a written table when it is expensive to compute.
    """
    stats = df.groupBy(key).agg(*[
        fn(c).alias(f"_{name}_{c}") for c in columns
        for name, fn in (("min", F.min), ("max", F.max), ("sum", F.sum))])
    scaled = {}
    for c in columns:
        span = F.nullif(F.col(f"_max_{c}") - F.col(f"_min_{c}"), F.lit(0.0))
        scaled[f"{c}_scaled"] = F.when(
            F.col(f"_sum_{c}") > 0, F.coalesce((F.col(c) - F.col(f"_min_{c}")) / span, F.lit(0.0)))
    return join_side(df, stats, [key]).select(*df.columns, *[v.alias(n) for n, v in scaled.items()])
