"""Session settings the operators are designed for."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Adaptive execution splits skewed join partitions and sizes reducers at run
# time; that is what keeps the cell joins even when one cell is very dense.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # small enough reducer inputs are hashed instead of sorted; the distance joins gain a quarter
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the Python workers of a session, once per application.

    Without it, workers that do not start in the repository, or on another
    machine, could not import what the operators send them.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="pavement-"), "pavement.zip")
        with zipfile.ZipFile(path, "w") as packed:
            for folder, _, names in os.walk(here):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        packed.write(full, os.path.relpath(full, os.path.dirname(here)))
        context.addPyFile(path)
        _SHIPPED.add(context.applicationId)
    return spark


def local_session(cores: str = "*", app: str = "pavement") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("PAVEMENT_SHUFFLE", "8"))
        .config("spark.driver.memory", os.environ.get("PAVEMENT_MEMORY", "12g"))
        # test tables are small single files: broadcast only what is small next to them
        .config("spark.sql.autoBroadcastJoinThreshold", "1m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
