"""City-level train / val / test splits and their audit.

All windows here run over the table of cities (one row per city), never over samples.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavement.operators.ranking import draw
from pavement.plans.storage import written

# Countries of up to this many cities are train only, the quota
# (val, test) of the others, and the clusters that val and test must contain.
SMALL_COUNTRY = 3
QUOTA = (1, 1)
WANTED_CLUSTERS = (3, 4)


def _lookup(quota: dict[str, tuple[int, int]], which: int) -> Column:
    value = F.lit(QUOTA[which])
    for country, pair in quota.items():
        value = F.when(F.col("country") == country, pair[which]).otherwise(value)
    return value


def quantile_picks(profiles: DataFrame, quota: dict[str, tuple[int, int]] | None = None,
                   broken=()) -> DataFrame:
    """Per country, cities at spread-out ranks of the mean label: the lower ones to val, the upper to test.

    Broken cities are left out; a country with too few others gives none.
    """
    eligible = profiles.where(~F.col("city").isin(*broken)) if broken else profiles
    in_country = Window.partitionBy("country")
    val, test = _lookup(quota or {}, 0), _lookup(quota or {}, 1)
    ranked = eligible.withColumns({
        "_n": F.count("*").over(in_country),
        "_i": F.row_number().over(in_country.orderBy("avg_label", "city")) - 1,
        "_v": val, "_k": val + test})
    slots = F.transform(F.sequence(F.lit(1), F.col("_k")),
                        lambda i: F.floor(F.col("_n") / (F.col("_k") + 1) * i))
    at = F.array_position(slots, F.col("_i").cast("bigint"))
    return (ranked.where((F.col("_n") >= F.col("_k")) & (at > 0))
            .select("country", "city", F.when(at <= F.col("_v"), "val").otherwise("test").alias("split"),
                    at.alias("slot")))


def city_split(profiles: DataFrame, quota: dict[str, tuple[int, int]] | None = None, broken=()) -> DataFrame:
    """Split of every city: small countries and broken cities to train, quantile picks to val and test."""
    sized = profiles.withColumn("_all", F.count("*").over(Window.partitionBy("country")))
    large = sized.where(F.col("_all") > SMALL_COUNTRY)
    picks = quantile_picks(large, quota, broken).select("city", "split", "slot")
    return (profiles.join(picks, "city", "left")
            .withColumn("split", F.coalesce("split", F.lit("train"))))


def coverage_swap(split: DataFrame, wanted=WANTED_CLUSTERS, broken=()) -> DataFrame:
    """Bring wanted clusters into val and test by swapping cities with train.

    If no city of the target split has the cluster, the train city of that cluster
    nearest to the target's median label comes in, and the first city of the
    target's most common cluster goes out. One written step per (target, cluster).
    """
    # order in which cities entered their split: by country, then pick or label rank
    entry = Window.partitionBy("split").orderBy("country", F.coalesce("slot", F.lit(0)), "avg_label", "city")
    state = written(split.withColumn("_pos", F.row_number().over(entry).cast("bigint")))
    for target in ("val", "test"):
        for cluster in wanted:
            inside = state.where(F.col("split") == target)
            median = inside.agg(F.percentile("avg_label", 0.5)).scalar()
            missing = inside.where(F.col("dom_cluster") == cluster).agg(F.count("*") == 0).scalar()
            train = state.where((F.col("split") == "train") & (F.col("dom_cluster") == cluster))
            if broken:
                train = train.where(~F.col("city").isin(*broken))
            comes = (train.withColumn("_d", F.abs(F.col("avg_label") - median))
                     .agg(F.min_by("city", F.struct("_d", "_pos"))).scalar())
            common = (inside.groupBy("dom_cluster").agg(F.count("*").alias("_c"), F.min("_pos").alias("_f"))
                      .agg(F.min_by("dom_cluster", F.struct(-F.col("_c"), "_f"))).scalar())
            goes = inside.where(F.col("dom_cluster") == common).agg(F.min_by("city", "_pos")).scalar()
            end = state.agg(F.max("_pos") + 1).scalar()
            swap = state.select("*", missing.alias("_missing"), comes.alias("_comes"),
                                goes.alias("_goes"), end.alias("_end"))
            act = F.coalesce(F.col("_missing") & F.col("_comes").isNotNull() & F.col("_goes").isNotNull(), F.lit(False))
            is_in, is_out = act & (F.col("city") == F.col("_comes")), act & (F.col("city") == F.col("_goes"))
            state = written(swap.select(
                *[c for c in state.columns if c not in ("split", "_pos")],
                F.when(is_in, target).when(is_out, "train").otherwise(F.col("split")).alias("split"),
                F.when(is_in | is_out, F.col("_end")).otherwise(F.col("_pos")).alias("_pos")))
    return state.drop("_pos")


def shuffle_split(cities: DataFrame, ratios=(0.70, 0.15), seed: int = 42, id_: str = "city_id") -> DataFrame:
    """Seeded shuffle of the cities, then the first 70 % train, the next 15 % val, the rest test."""
    order = F.row_number().over(Window.orderBy(draw(F.col(id_), seed), id_)) - 1
    n = cities.agg(F.count("*")).scalar()
    placed = cities.withColumns({"_i": order, "_n": n})
    train, val = F.floor(F.col("_n") * ratios[0]), F.floor(F.col("_n") * ratios[1])
    split = F.when(F.col("_i") < train, "train").when(F.col("_i") < train + val, "val").otherwise("test")
    return placed.withColumn("split", split).drop("_i", "_n")


def split_audit(split: DataFrame, profiles: DataFrame) -> DataFrame:
    """Findings as rows (finding, split, value): unassigned cities, cities in two splits,
    cities per split, clusters covered per split."""
    value = F.count("*").cast("bigint").alias("value")
    total = F.lit("(all)").alias("split")
    pairs = split.select("city", "split").distinct()
    unassigned = profiles.select("city").exceptAll(split.select("city").distinct())
    double = pairs.groupBy("city").agg(F.count("*").alias("_k")).where(F.col("_k") > 1)
    covered = pairs.join(profiles.select("city", "dom_cluster"), "city").select("split", "dom_cluster").distinct()
    return reduce(DataFrame.unionByName, [
        unassigned.agg(value).select(F.lit("unassigned").alias("finding"), total, "value"),
        double.agg(value).select(F.lit("in two splits").alias("finding"), total, "value"),
        pairs.groupBy("split").agg(value).select(F.lit("cities").alias("finding"), "split", "value"),
        covered.groupBy("split").agg(value).select(F.lit("clusters").alias("finding"), "split", "value")])
