"""Clustering, regression baselines, probes and distributed scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StringIndexer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pavement.functions.scaling import LABEL_MAX, clip, inverse_target
from pavement.operators.grid import sliding_windows
from pavement.operators.ranking import exact_percentiles
from pavement.operators.statistics import minmax_by_city
from pavement.plans.storage import join_side, written

DENSITIES = ("road_density", "building_density", "poi_density")


def _centroids(assigned: DataFrame, key: str, scaled: list[str]) -> DataFrame:
    """One row per city with its centroids, written so that the join knows its size."""
    means = assigned.groupBy(key, "cluster").agg(*[F.avg(c).alias(c) for c in scaled])
    return written(means.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("cluster", *scaled))).alias("_centroids")))


def _nearest(points: DataFrame, centroids: DataFrame, key: str, scaled: list[str]) -> DataFrame:
    """Nearest centroid of the own city; the smaller cluster number on ties. The few
    centroids of a city are one array on its row, so points are not multiplied."""
    def away(c: Column) -> Column:
        total = F.lit(0.0)
        for name in scaled:
            total = total + (F.col(name) - c[name]) * (F.col(name) - c[name])
        return F.struct(total.alias("d"), c["cluster"].alias("cluster"))

    return (points.join(centroids, key)
            .withColumn("cluster", F.array_min(F.transform("_centroids", away))["cluster"]).drop("_centroids"))


def kmeans_by_city(df: DataFrame, columns=DENSITIES, k: int = 5, iters: int = 20, key: str = "city",
                   id_: str = "pid") -> DataFrame:
    """K-means of the scaled densities, in all cities at once.

    Seeds are the means of ``k`` bands between quantiles of the *distinct* summed
    densities, so that many equal ones (water, fields) leave no band empty where a
    city has ``k`` different sums. Every Lloyd step is one scan of the written points
    and one small aggregate, until no centroid moves; the last assignment numbers
    the clusters by their mean density, so that they compare across cities. A city
    with fewer than ``k`` points, or without any density, keeps its points with a
    null cluster.
    """
    scaled = [f"{c}_scaled" for c in columns]
    rows = minmax_by_city(written(df), list(columns), key)
    score = sum((F.coalesce(c, F.lit(0.0)) for c in scaled[1:]), F.coalesce(scaled[0], F.lit(0.0)))
    usable = F.coalesce(*scaled).isNotNull()
    all_points = rows.withColumns({"_score": score, "_usable": usable})
    sizes = all_points.where("_usable").groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= k)
    points = join_side(all_points.where("_usable"), sizes.select(key), [key], "left_semi").fillna(0.0, subset=scaled)
    points = written(points.select(key, id_, "_score", *scaled))
    cuts = exact_percentiles(points.select(key, "_score").distinct(), "_score", {f"_q{j}": j / k for j in range(1, k)}, (key,))
    bands = join_side(points, cuts, [key], "inner")
    band = sum(((F.col("_score") > F.col(f"_q{j}")).cast("int") for j in range(2, k)),
               (F.col("_score") > F.col("_q1")).cast("int"))
    centroids = _centroids(bands.withColumn("cluster", band), key, scaled)
    for _ in range(iters - 1):
        moved = _centroids(_nearest(points, centroids, key, scaled), key, scaled)
        still = moved.exceptAll(centroids).isEmpty()
        centroids = moved
        if still:
            break
    order = F.transform(F.array_sort(F.transform("_centroids", lambda c: F.struct(
        sum((c[s] for s in scaled[1:]), c[scaled[0]]).alias("m"), c["cluster"].alias("cluster")))), lambda c: c["cluster"])
    final = _nearest(points, centroids, key, scaled)
    numbered = final.join(centroids.select(key, order.alias("_order")), key).select(
        key, id_, (F.array_position("_order", F.col("cluster")) - 1).cast("int").alias("cluster"))
    return all_points.drop("_score", "_usable").join(numbered, [key, id_], "left")


def vectors(df: DataFrame, features: str, out: str = "_vector") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(features).cast("array<double>")))


def kmeans_global(df: DataFrame, k: int, features: str = "embedding", seed: int = 42,
                  out: str = "cluster") -> DataFrame:
    """One clustering over all rows."""
    data = vectors(df, features)
    model = KMeans(k=k, seed=seed, featuresCol="_vector", predictionCol=out).fit(data)
    return model.transform(data).drop("_vector")


def tabular_regressor(train: DataFrame, kind: str = "huber", features: str = "tabular", label: str = "z"):
    """Fit the log z-score label on the standardised features: robust linear (``huber``), boosted trees
    (``boosted``) or a network (``mlp``, which needs the ids ``sid``)."""
    if kind == "mlp":
        from pavement.operators.network import mlp_regressor
        return mlp_regressor(train, features=features, label=label)
    data = vectors(train, features)
    common = {"featuresCol": "_vector", "labelCol": label, "predictionCol": "z_pred"}
    estimator = (LinearRegression(loss="huber", maxIter=50, regParam=1e-4, **common) if kind == "huber"
                 else GBTRegressor(maxIter=20, maxDepth=4, seed=42, **common))
    return estimator.fit(data)


def score_counts(model, df: DataFrame, features: str = "tabular") -> DataFrame:
    """Predictions of a fitted model back on the count scale of each row's city."""
    scored = model.transform(vectors(df, features)).drop("_vector")
    return scored.withColumn("pred", inverse_target(F.col("z_pred"), F.col("log_mean"), F.col("log_std")))


def label_probe(train: DataFrame, test: DataFrame, label: str, features: str = "tabular") -> DataFrame:
    """How well features tell a label: accuracy and cross-entropy, on ``test``, of a multinomial probe fitted on ``train``.

    A label that only ``test`` has counts as told wrongly.
    """
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
    data = vectors(indexer.transform(train), features)
    model = LogisticRegression(featuresCol="_vector", labelCol="_y", family="multinomial", maxIter=50,
                               regParam=1e-3).fit(data)
    scored = model.transform(vectors(indexer.transform(test), features)).withColumn("_p", vector_to_array("probability"))
    own = F.coalesce(F.get("_p", F.col("_y").cast("int")), F.lit(0.0))
    return scored.agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("accuracy"),
                      F.avg(-F.ln(F.greatest(own, F.lit(1e-15)))).alias("cross_entropy"))


def batch_score(df: DataFrame, make_predict_fn: Callable, features: str = "tabular", width: int | list[int] = 15,
                batch_size: int = 64, out: str = "z_pred") -> DataFrame:
    """Any user prediction function over a table, in Arrow batches.

    ``make_predict_fn()`` runs once per Python worker and returns a function from a
    (batch, width) array to one value per row; ``width`` may be the shape of a tensor
    that the column holds flat. With ``log_mean`` and ``log_std`` on
    the rows, ``pred`` is the count.
    """
    predict = predict_batch_udf(make_predict_fn, return_type=DoubleType(), batch_size=batch_size,
                                input_tensor_shapes=[width if isinstance(width, list) else [width]])
    scored = df.withColumn(out, predict(F.col(features).cast("array<double>")))
    if {"log_mean", "log_std"} <= set(df.columns):
        scored = scored.withColumn("pred", inverse_target(F.col(out), F.col("log_mean"), F.col("log_std")))
    return scored


def with_transform(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], column: str) -> DataFrame:
    """A user function on each row's array, in Arrow batches."""
    @F.pandas_udf("array<double>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda v: None if v is None else np.asarray(fn(np.asarray(v)), dtype="float64"))

    return df.withColumn(column, apply(F.col(column)))


def linear_attribution(model, df: DataFrame, id_: str, features: str = "tabular", keep=("cluster",)) -> DataFrame:
    """Coefficient times input per sample and feature, long."""
    coefficients = F.array(*[F.lit(float(c)) for c in model.coefficients])
    return df.select(id_, *keep, F.posexplode(F.zip_with(coefficients, features, lambda c, v: c * v)).alias("idx", "value"))


def project_2d(df: DataFrame, features: str = "embedding") -> DataFrame:
    """First two principal components."""
    data = vectors(df, features)
    model = PCA(k=2, inputCol="_vector", outputCol="_pc").fit(data)
    pc = vector_to_array("_pc")
    return model.transform(data).select(*df.columns, pc[0].alias("px"), pc[1].alias("py"))


def city_surface(meta: DataFrame, features: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame],
                 crop: int = 224, stride: int = 56, key: str = "city") -> DataFrame:
    """Dense prediction grid of every city: windows, their features, the score, clipped.

    ``meta`` carries the affine of each raster. ``features`` gets window centres in
    raster coordinates (x, y) with an id; ``score`` returns a ``pred`` column.
    """
    windows = sliding_windows(meta, crop, stride, key)
    centres = join_side(windows, meta.select(key, "a", "b", "c", "d", "e", "f"), [key], "inner").select(
        key, "gi", "gj", F.concat_ws("_", "gi", "gj").alias("pid"),
        (F.col("a") * (F.col("pcol") + 0.5) + F.col("b") * (F.col("prow") + 0.5) + F.col("c")).alias("x"),
        (F.col("d") * (F.col("pcol") + 0.5) + F.col("e") * (F.col("prow") + 0.5) + F.col("f")).alias("y"))
    centres = written(centres)
    scored = score(features(centres)).select(key, "pid", clip(F.col("pred"), 0.0, LABEL_MAX).alias("pred"))
    return centres.join(scored, [key, "pid"]).select(key, "gi", "gj", "pred")
