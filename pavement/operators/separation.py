"""How well a feature space separates labels, and what attributions say about features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pavement.operators.ranking import draw
from pavement.plans.storage import written

_LARGEST = 16_384  # points of a block
_SUMS = 4_000_000  # sums (point, label) that a pair of blocks returns
_TILE = 2_000_000  # distances at once
_CLOSE = 1e-6  # of the squared norms: below, a squared distance is taken from the differences


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances, by a matrix product; those it would lose to cancellation (copies) by the differences."""
    middle = b.mean(axis=0)
    with np.errstate(invalid="ignore", over="ignore"):
        ca, cb = a - middle, b - middle
        norms = (ca * ca).sum(axis=1)[:, None] + (cb * cb).sum(axis=1)
        square = norms - 2 * (ca @ cb.T)
        left, right = np.nonzero(~((square > _CLOSE * norms) & (square < np.inf)))
        for low in range(0, len(left), 20_000):
            i, j = left[low:low + 20_000], right[low:low + 20_000]
            square[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    return np.sqrt(square)


def _by_label(points: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Points in the order of their labels (none last), the labels, their first positions and sizes."""
    points = points.sort_values("_label", kind="stable", na_position="last")
    labels, first, sizes = np.unique(points["_label"].dropna().to_numpy(), return_index=True, return_counts=True)
    return points, labels, first, sizes


def _sum_rows(points: pd.DataFrame, labels: np.ndarray, sums: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    """Rows (point, other label) of a matrix with a row per point and a column per label."""
    n = len(labels)
    return pd.DataFrame({"_id": points["_id"].repeat(n).to_numpy(), "_label": points["_label"].repeat(n).to_numpy(),
                         "_other": np.tile(labels, len(points)), "_sum": sums.ravel(), "_n": np.tile(sizes, len(points))})


def _block_distances(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Sum of distances from each left point to the right points of each label, and the other
    way round if the blocks are two."""
    if left.empty or right.empty:
        return pd.DataFrame({c: [] for c in ("_id", "_label", "_other", "_sum", "_n")}).astype(
            {"_id": "int64", "_label": "int64", "_other": "int64", "_sum": "float64", "_n": "int64"})
    two = left["_from"].iat[0] != left["_to"].iat[0]
    left, rows, row_first, row_sizes = _by_label(left)
    right, columns, column_first, column_sizes = _by_label(right)
    a, b = (np.stack(side["_f"].to_numpy()).astype("float64") for side in (left, right))
    ahead, back = np.zeros((len(a), len(columns))), np.zeros((len(rows), len(b)))
    labelled = [int(sizes.sum()) for sizes in (row_sizes, column_sizes)]
    step = max(1, _TILE // len(b))
    for low in range(0, len(a), step):
        away = _distances(a[low:low + step], b)
        if len(columns):
            ahead[low:low + step] = np.add.reduceat(away[:, :labelled[1]], column_first, axis=1)
        high = min(low + step, labelled[0])
        if two and low < high:
            held = np.flatnonzero((row_first < high) & (row_first + row_sizes > low))
            back[held] += np.add.reduceat(away[:high - low], np.maximum(row_first[held] - low, 0), axis=0)
    parts = [_sum_rows(left, columns, ahead, column_sizes)]
    if two:
        parts.append(_sum_rows(right, rows, back.T, row_sizes))
    return pd.concat(parts)


def label_distances(df: DataFrame, features: str, label: str, id_: str, sample: int | None = None) -> DataFrame:
    """Per point and label: sum of distances and number of points.

    All points, or a seeded ``sample`` of so many; the work grows with the square
    of their number. They are cut into blocks and every pair of blocks is one small group, so
    no pair of points is ever a row: a group returns one sum per point and label. Blocks grow with
    the points up to a fixed size, smaller where labels are many; each pair of blocks is met once.
    """
    points = df.select(F.col(id_).alias("_id"), F.col(label).cast("bigint").alias("_label"), F.col(features).alias("_f"))
    if sample is not None:
        points = points.orderBy(draw(F.col("_id")), "_id").limit(sample)
    points = written(points)
    number, labels = points.agg(F.count("*"), F.approx_count_distinct("_label")).first()
    size = max(256, min(_LARGEST, -(-number // 16), _SUMS // max(1, labels)))
    blocks = max(1, -(-number // size))
    placed = points.withColumn("_blk", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"))
    left = placed.withColumn("_to", F.explode(F.sequence("_blk", F.lit(blocks - 1)))).withColumnRenamed("_blk", "_from")
    right = placed.withColumn("_from", F.explode(F.sequence(F.lit(0), "_blk"))).withColumnRenamed("_blk", "_to")
    met = left.groupBy("_from", "_to").cogroup(right.groupBy("_from", "_to")).applyInPandas(
        _block_distances, "_id bigint, _label bigint, _other bigint, _sum double, _n bigint")
    return met.groupBy("_id", "_label", "_other").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))


def silhouette(df: DataFrame, features: str = "embedding", label: str = "label", id_: str = "vec_id",
               sample: int | None = None) -> DataFrame:
    """Euclidean silhouette: mean per label, and overall (label null), over all points or a stated sample.

    A point alone in its label scores 0. The work grows with the square of the
    points; ``silhouette_squared`` is linear.
    """
    sums = label_distances(df, features, label, id_, sample)
    own = F.col("_other") == F.col("_label")
    scored = sums.groupBy("_id", "_label").agg(
        F.max(F.when(own, F.col("_n"))).alias("_k"), F.max(F.when(own, F.col("_sum"))).alias("_own"),
        F.min(F.when(~own, F.col("_sum") / F.col("_n"))).alias("_b"))
    a = F.col("_own") / F.nullif(F.col("_k") - 1, F.lit(0))
    widest = F.nullif(F.greatest(a, F.col("_b")), F.lit(0.0))
    points = scored.select("_label", F.coalesce(F.when(F.col("_k") > 1, (F.col("_b") - a) / widest), F.lit(0.0)).alias("_s"))
    return points.rollup("_label").agg(F.avg("_s").alias("silhouette"), F.count("*").alias("n")).select(
        F.col("_label").alias("label"), "silhouette", "n")


def silhouette_squared(df: DataFrame, features: str = "embedding", label: str = "label", id_: str = "vec_id") -> DataFrame:
    """Silhouette of squared Euclidean distances over all points: mean per label, and overall (label null).

    The mean squared distance to a label follows from the label's size, mean and
    mean squared norm, so a point meets one small table and never another point.
    Points without a label are left out; one alone in its label scores 0.
    """
    points = df.select(F.col(id_).alias("_id"), F.col(label).cast("bigint").alias("_label"),
                       F.col(features).cast("array<double>").alias("_f")).where("_label IS NOT NULL")

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)

    means = (points.select("_label", F.posexplode("_f").alias("_i", "_v")).groupBy("_label", "_i")
             .agg(F.avg("_v").alias("_m"), F.avg(F.col("_v") * F.col("_v")).alias("_q"), F.count("*").alias("_n")))
    stats = means.groupBy("_label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda e: e["_m"]).alias("_mean"),
        F.sum("_q").alias("_norm"), F.max("_n").alias("_n"))
    # one row per label, with the labels' number as its bound: an array on every point
    every = stats.agg(F.array_sort(F.collect_list(F.struct("_label", "_mean", "_norm", "_n")))).scalar()
    own = F.col("_s._label") == F.col("_label")
    away = dot(F.col("_f"), F.col("_f")) + F.col("_s._norm") - 2 * dot(F.col("_f"), F.col("_s._mean"))
    met = (points.withColumn("_s", F.explode(every))
           .select("_id", "_label", own.alias("_own"), F.greatest(away, F.lit(0.0)).alias("_d"), F.col("_s._n").alias("_n")))
    scored = met.groupBy("_id", "_label").agg(
        F.max(F.when(F.col("_own"), F.col("_n"))).alias("_k"), F.max(F.when(F.col("_own"), F.col("_d") * F.col("_n"))).alias("_sum"),
        F.min(F.when(~F.col("_own"), F.col("_d"))).alias("_b"))
    a = F.col("_sum") / F.nullif(F.col("_k") - 1, F.lit(0))
    widest = F.nullif(F.greatest(a, F.col("_b")), F.lit(0.0))
    scores = scored.select("_label", F.coalesce(F.when(F.col("_k") > 1, (F.col("_b") - a) / widest), F.lit(0.0)).alias("_s"))
    return scores.rollup("_label").agg(F.avg("_s").alias("silhouette"), F.count("*").alias("n")).select(
        F.col("_label").alias("label"), "silhouette", "n")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency table."""
    table = df.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").cast("double").alias("_n"))
    levels = table.cube("_a", "_b").agg(F.sum("_n").alias("_n"), F.grouping_id().alias("_g"))
    pairs = F.col("_n") * (F.col("_n") - 1) / 2
    sums = levels.groupBy().agg(*[F.sum(F.when(F.col("_g") == g, pairs)).alias(f"_{name}")
                                  for g, name in ((0, "both"), (1, "a"), (2, "b"), (3, "all"))])
    expected = F.col("_a") * F.col("_b") / F.nullif("_all", F.lit(0.0))
    room = F.nullif((F.col("_a") + F.col("_b")) / 2 - expected, F.lit(0.0))
    return sums.select(F.coalesce((F.col("_both") - expected) / room, F.lit(1.0)).alias("ari"))


def long_attributions(df: DataFrame, values: str, *keep: str) -> DataFrame:
    """Attribution arrays as rows (idx, value)."""
    return df.select(*keep, F.posexplode(values).alias("idx", "value"))


def attribution_summary(attributions: DataFrame) -> DataFrame:
    """Mean absolute and signed mean attribution per feature."""
    return attributions.groupBy("idx").agg(F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean_signed"))


def attribution_by_cluster(attributions: DataFrame) -> DataFrame:
    """Mean attribution per cluster and feature (0 for an absent cluster), features ranked by
    their deviation across clusters. Past the first aggregation there is one row per
    (feature, cluster)."""
    means = attributions.groupBy("idx", "cluster").agg(F.avg("value").alias("_m"))
    last = means.agg(F.max("cluster")).scalar()
    filled = (means.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "_m"))).alias("_t"))
              .withColumn("_last", last)
              .withColumn("_v", F.transform(F.sequence(F.lit(0), F.col("_last")), lambda c: F.struct(
                  c.alias("cluster"), F.coalesce(F.try_element_at("_t", c), F.lit(0.0)).alias("mean")))))
    spread = filled.select("idx", F.inline("_v")).groupBy("idx").agg(F.stddev_pop("mean").alias("spread"))
    order = spread.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("spread"), "idx")))
    return filled.select("idx", F.inline("_v")).join(order, "idx").select("rank", "idx", "cluster", "mean", "spread")
