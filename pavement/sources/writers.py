"""Writers of sample tables, training tables, layers and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavement.sources.schemas import SPLITS


def write_samples(df: DataFrame, path: str) -> None:
    """One folder per city. A rerun replaces the cities it holds and leaves the others.

    Rows are rebalanced by city: small cities share a writer, a very large one is
    split over many.
    """
    (df.hint("rebalance", "city").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("city").parquet(path))


def write_layer(df: DataFrame, root: str, layer: str) -> None:
    """A map layer, one folder per city."""
    (df.hint("rebalance", "city").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("city").parquet(f"{root.rstrip('/')}/{layer}"))


def write_training_table(df: DataFrame, stats: dict[str, DataFrame], path: str) -> None:
    """Training rows keyed by sample, one folder per split, beside their statistics tables.

    A rerun replaces all splits, so that a sample that moved to another split is
    nowhere twice. The input must not be read from ``path``.
    """
    root = path.rstrip("/")
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("split").parquet(f"{root}/samples")
    for name, table in stats.items():
        table.write.mode("overwrite").parquet(f"{root}/{name}")


def write_report(df: DataFrame, path: str) -> None:
    """A metric table as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_split(cities: DataFrame, samples: DataFrame, path: str, seed: int = 42) -> None:
    """The split as one JSON document: sorted cities per split, their number and that of their samples.

    ``cities`` are (city, split), one row each: a list of cities is what the document
    is, so it is as long as there are cities. ``samples`` have a ``city``; those of
    other cities are not counted.
    """
    counted = cities.join(samples.groupBy("city").agg(F.count("*").alias("_n")), "city", "left")
    mine = {s: F.col("split") == s for s in SPLITS}
    row = counted.agg(
        F.lit(seed).alias("seed"),
        F.struct(*[F.count_if(m).alias(s) for s, m in mine.items()]).alias("n_cities"),
        F.struct(*[F.coalesce(F.sum(F.when(m, F.col("_n"))), F.lit(0)).alias(s) for s, m in mine.items()]).alias("n_samples"),
        *[F.sort_array(F.collect_list(F.when(m, F.col("city")))).alias(s) for s, m in mine.items()])
    row.write.mode("overwrite").json(path)


def write_results(results: DataFrame, root: str) -> None:
    """One folder ``run=name`` per run with its result document; ``results`` have one row per run. Other runs stay."""
    (results.repartition("run").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", 1).partitionBy("run").json(root))
