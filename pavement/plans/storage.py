"""Written intermediate tables: lineage cuts and size checks in one step.

A derived side table (statistics per city, centroids, a split) is written once
to the shared checkpoint folder and read back. The optimizer then knows the
real size of the files, so a join with it is broadcast when it is below
``spark.sql.autoBroadcastJoinThreshold`` and is a sort-merge join, with
adaptive skew splitting, when it is not. No broadcast hint is ever needed, and
a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; a scratch folder only in local mode."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if named:
        return named
    in_use = spark.sparkContext.getCheckpointDir()
    if in_use:
        return in_use
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pavement-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and return it as a file scan."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing will read any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_side(df: DataFrame, side: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a derived side table whose size is only known once it is written."""
    return df.join(written(side), on, how)
