"""Exact percentiles and row numbers without one task per group.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer
and ``row_number`` sorts a whole group in one task. One group may hold a third
of all rows, so both are done in two steps here: a mergeable sketch first finds
where to look, then only that part is counted or sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavement.plans.storage import join_side

_ACCURACY = 10_000
_SMALL = _ACCURACY // 2   # groups up to this size are counted whole
_SLICES = 64              # how far one very frequent value is split


def _keyed(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, by) if by else (df.withColumn("_all", F.lit(1)), ["_all"])


def exact_percentiles(df: DataFrame, value: str, probs: dict[str, float], by=()) -> DataFrame:
    """Interpolated percentiles, one row per group, one column per entry of ``probs``.

    A sketch brackets each percentile to within a few ten-thousandths of the
    group. Values below the bracket are only counted, values inside are counted
    by value, both before the shuffle; the order statistics are then read off.
    """
    data, keys = _keyed(df.where(F.col(value).isNotNull()), list(by))
    data = data.select(*keys, F.col(value).cast("double").alias("_v"))
    slack = 4 / _ACCURACY
    grid = [p for q in probs.values() for p in (max(q - slack, 0.0), min(q + slack, 1.0))]
    brackets = data.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, grid)), _ACCURACY).alias("_g"))
    whole = F.col("_n") <= _SMALL
    asked = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(q).alias("q"),
                 F.when(whole, float("-inf")).otherwise(F.col("_g")[2 * i]).alias("lo"),
                 F.when(whole, float("inf")).otherwise(F.col("_g")[2 * i + 1]).alias("hi"))
        for i, (name, q) in enumerate(probs.items())])
    # the first and last percentile may sit on the extremes, where the bracket is exact
    counts = (
        join_side(data, brackets.select(*keys, "_n", asked.alias("_a")), keys, "inner")
        .withColumn("_a", F.explode("_a"))
        .where(F.col("_v") <= F.col("_a.hi"))
        .withColumn("_v", F.when(F.col("_v") < F.col("_a.lo"), float("-inf")).otherwise(F.col("_v")))
        .groupBy(*keys, F.col("_a.name").alias("_name"), F.col("_a.q").alias("_q"), "_n", "_v")
        .agg(F.count("*").alias("_c"))
    )
    upto = Window.partitionBy(*keys, "_name").orderBy("_v")
    at = F.col("_q") * (F.col("_n") - 1)
    picked = (
        counts.withColumns({"_cum": F.sum("_c").over(upto), "_at": at})
        .groupBy(*keys, "_name", "_at")
        .agg(F.min(F.when(F.col("_cum") > F.floor("_at"), F.col("_v"))).alias("_lo"),
             F.min(F.when(F.col("_cum") > F.ceil("_at"), F.col("_v"))).alias("_hi"))
        .withColumn("_r", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at")))
    )
    out = picked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_name") == name, F.col("_r"))).alias(name) for name in probs])
    return out if by else out.drop("_all")


def global_rank(df: DataFrame, value: str, tie: str, by=(), out: str = "rank", buckets: int = 128) -> DataFrame:
    """Zero-based position of each row in the order (value, tie % 64, tie) of its group.

    Value ranges of about equal size come from a sketch; a value so frequent that
    it fills several ranges is further split by ``tie % 64``. Each range is
    numbered on its own and shifted by the rows before it.
    """
    data, keys = _keyed(df, list(by))
    edges = data.groupBy(*keys).agg(F.percentile_approx(
        F.col(value).cast("double"), F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), _ACCURACY).alias("_e"))
    below = F.size(F.filter("_e", lambda e: e < F.col(value)))
    upto = F.size(F.filter("_e", lambda e: e <= F.col(value)))
    slice_ = F.pmod(F.col(tie), F.lit(_SLICES)).cast("int")
    frequent = upto - below >= 2
    placed = (
        join_side(data, edges, keys, "inner")
        .withColumns({"_s": slice_, "_b": upto * 2 + F.when(frequent, 0).otherwise(1)})
        .withColumn("_b", F.col("_b") * _SLICES + F.when(frequent, F.col("_s")).otherwise(0))
        .drop("_e")
    )
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
               .select(*keys, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off")))
    within = Window.partitionBy(*keys, "_b").orderBy(value, "_s", tie)
    return (join_side(placed, offsets, [*keys, "_b"], "inner")
            .withColumn(out, F.col("_off") + F.row_number().over(within) - 1)
            .select(*df.columns, out))


def running_min(df: DataFrame, by: list[str], order: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Smallest value of the rows before each row, in the order of an integer column.

    Blocks of ``block`` steps are reduced first, so a very long run is many tasks.
    """
    data = df.withColumn("_blk", F.floor(F.col(order) / block))
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    heads = (data.groupBy(*by, "_blk").agg(F.min(value).alias("_m"))
             .select(*by, "_blk", F.min("_m").over(before).alias("_head")))
    inside = Window.partitionBy(*by, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (data.withColumn("_in", F.min(value).over(inside))
            .join(heads, [*by, "_blk"])
            .withColumn(out, F.least("_in", "_head"))
            .drop("_blk", "_in", "_head"))


def draw(id_: Column, seed: int = 42) -> Column:
    """Seeded pseudo-random order key of an id of any type: md5 of id and seed, the same on any engine."""
    return F.md5(F.concat(id_.cast("string"), F.lit(f":{seed}")).cast("binary"))


__all__ = ["exact_percentiles", "global_rank", "running_min", "draw"]
