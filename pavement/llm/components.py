"""Connected components of links that are tables of any size.

Each round hooks every node to its smallest neighbour, follows the hooks to
their ends by pointer doubling, and contracts the links. Nothing is collected;
every round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavement.plans.storage import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) for every id in a link; the label is the smallest id that it can reach.

    A link from an id to itself gives the id its own label; links with a null end
    are left out; repeated links do no harm; no links give no rows.
    """
    edges = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
                    .distinct())
    both = edges.union(edges.select("b", "a"))
    labels = written(_ends(both.groupBy("a").agg(F.min("b").alias("low"))
                           .select(F.col("a").alias("id"), F.least("a", "low").alias("label"))))
    while True:
        left = written(edges.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a")
                       .join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
                       .where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
        if left.isEmpty():
            return labels
        both = left.union(left.select("b", "a"))
        hooks = _ends(both.groupBy("a").agg(F.min("b").alias("low"))
                      .select(F.col("a").alias("id"), F.least("a", "low").alias("label")))
        labels = written(labels.join(hooks.select(F.col("id").alias("label"), F.col("label").alias("_to")), "label", "left")
                         .select("id", F.coalesce("_to", "label").alias("label")))


def _ends(hooks: DataFrame) -> DataFrame:
    """Follow id -> label to the ends; labels are never larger than ids, so there are no cycles."""
    hooks = written(hooks)
    while True:
        step = hooks.select(F.col("id").alias("label"), F.col("label").alias("_to"))
        moved = written(hooks.join(step, "label", "left")
                        .select("id", F.coalesce("_to", "label").alias("label"), (F.col("_to") != F.col("label")).alias("_new")))
        hooks = moved.drop("_new")
        if moved.where("_new").isEmpty():
            return hooks
