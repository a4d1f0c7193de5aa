"""Deduplication, seeded samples, picks and top-k reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavement.functions.scaling import percent_error
from pavement.operators.ranking import draw, exact_percentiles, global_rank
from pavement.plans.storage import join_side, written


_GROUP_LIMIT = 1000  # up to this rank Spark cuts a group inside each task, before the shuffle


def _first(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group.

    The rank filter is applied per task before the shuffle (window group limit), so
    a huge group sends only ``n`` rows per task. Beyond that limit the group is cut
    in 64 slices first; the first ``n`` of a group are among the first ``n`` of its slices.
    """
    def ranked(rows: DataFrame, groups: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
        return rows.withColumn("_rank", rank).where(F.col("_rank") <= n)

    if n > _GROUP_LIMIT:
        sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(64)))
        df = ranked(sliced, [*by, "_slice"]).drop("_slice", "_rank")
    return ranked(df, by)


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in the given order."""
    return _first(df, keys, [F.col(c) for c in order], 1).drop("_rank")


def stratified_sample(df: DataFrame, by=("city", "cluster"), n: int = 100, seed: int = 42,
                      id_: str = "pid") -> DataFrame:
    """Up to ``n`` seeded random rows per stratum; smaller strata are kept whole."""
    return _first(df, list(by), [draw(F.col(id_), seed), F.col(id_)], n).drop("_rank")


def _ranked_top(df: DataFrame, order: list[Column], k: int, tag: str) -> DataFrame:
    return (df.orderBy(*order).limit(k)
            .withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
            .withColumn("pick", F.lit(tag)))


def best_worst_random(df: DataFrame, k: int = 5, seed: int = 42, id_: str = "sid") -> DataFrame:
    """The ``k`` smallest errors, the ``k`` largest (largest first) and ``k`` random rows."""
    scored = df.withColumns({"abs_error": F.abs(F.col("pred") - F.col("target")),
                             "pct_error": percent_error(F.col("pred"), F.col("target"))})
    error, key = F.col("abs_error"), F.col(id_)
    return reduce(DataFrame.unionByName, [
        _ranked_top(scored, [error, key], k, "best"),
        _ranked_top(scored, [error.desc(), key], k, "worst"),
        _ranked_top(scored, [draw(key, seed), key], k, "random")])


def top_features(summary: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` features of largest mean absolute attribution, ranked."""
    return _ranked_top(summary, [F.col("mean_abs").desc(), F.col("idx")], n, "top").drop("pick")


def quartile_pools(df: DataFrame, n: int = 40, label: str = "target", seed: int = 42,
                   id_: str = "sid") -> DataFrame:
    """Equal seeded draws from the top and from the bottom quartile of the label."""
    cuts = exact_percentiles(df, label, {"p25": 0.25, "p75": 0.75})
    cut = cuts.select(F.struct("p25", "p75").alias("c")).scalar()
    pool = F.when(F.col(label) >= F.col("_c.p75"), "high").when(F.col(label) <= F.col("_c.p25"), "low")
    pooled = df.withColumn("_c", cut).withColumn("pool", pool).where(F.col("pool").isNotNull()).drop("_c")
    # a row that is in both pools (all labels equal) counts for both
    low = F.col(label) <= F.col("_c.p25")
    both = (df.withColumn("_c", cut).where((F.col(label) >= F.col("_c.p75")) & low)
            .withColumn("pool", F.lit("low")).drop("_c"))
    picked = written(_first(pooled.unionByName(both), ["pool"], [draw(F.col(id_), seed), F.col(id_)], n))
    even = picked.groupBy("pool").agg(F.max("_rank").alias("_m")).agg(
        F.when(F.count("*") == 2, F.min("_m")).otherwise(0)).scalar()
    return picked.where(F.col("_rank") <= even).drop("_rank")


def label_index(df: DataFrame, column: str = "country") -> DataFrame:
    """Sorted distinct values numbered from 0. The numbering sees one row per value."""
    return df.select(column).distinct().withColumn(
        "label", (F.row_number().over(Window.orderBy(column)) - 1).cast("bigint"))


def spread_picks(samples: DataFrame, n: int = 5, crop: int = 224, label: str = "population",
                 id_: str = "sid", key: str = "city") -> DataFrame:
    """``n`` samples per city at evenly spaced label ranks, no two closer than a crop.

    Slot by slot: the candidates of a slot are the ranks within 5 % around it, nearest
    first (the lower one on ties); those within a crop of an earlier pick drop out and
    the nearest of the rest wins. Each slot is one aggregation over all cities.
    ``samples`` needs ``prow, pcol``.
    """
    ranked = written(global_rank(samples, label, id_, (key,)).select(key, id_, label, "prow", "pcol", "rank"))
    sizes = ranked.groupBy(key).agg(F.count("*").alias("_n"))
    placed = written(join_side(ranked, sizes, [key], "inner"))
    picks = None
    for slot in range(n):
        target = F.floor((F.col("_n") - 1) * (slot / max(n - 1, 1)))
        window = F.greatest(F.lit(1), F.floor(F.col("_n") / 20))
        away = F.abs(F.col("rank") - target)
        near = placed.withColumn("_away", away).where(away <= window)
        if picks is not None:
            taken = picks.groupBy(key).agg(F.collect_list(F.struct("prow", "pcol")).alias("_taken"))
            close = F.exists("_taken", lambda t: (F.abs(F.col("prow") - t["prow"]) < crop)
                             & (F.abs(F.col("pcol") - t["pcol"]) < crop))
            near = join_side(near, taken, [key]).where(F.coalesce(~close, F.lit(True)))
        pick = near.groupBy(key).agg(F.min(F.struct("_away", "rank", id_, label, "prow", "pcol")).alias("_p"))
        pick = written(pick.select(key, F.lit(slot).alias("slot"), "_p.rank",
                                   f"_p.{id_}", f"_p.{label}", "_p.prow", "_p.pcol"))
        picks = pick if picks is None else picks.unionByName(pick)
    return picks
