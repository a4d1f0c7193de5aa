"""Incremental label enrichment with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def incremental_enrich(stream: DataFrame, enrich: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                       id_: str = "id") -> StreamingQuery:
    """Enrich each point until it has a label; the query ends when the input is used up and resumes on restart.

    ``enrich`` adds ``population`` and ``error`` to a batch of points: a join with a
    label table, or ``enrich_with`` for a per-batch client. Failures stay, with
    their reason, until the point is sent again (``failed_points``). A point that an
    earlier batch has labelled is skipped: batches are held against the labelled
    rows of the output, so the stream keeps no state of its own. A batch is written
    to its own folder, by batch id, in overwrite mode: a batch that is run again
    after a crash sees the batches before it and replaces itself.
    """
    root = out.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        todo = batch.dropDuplicates([id_])
        try:
            done = batch.sparkSession.read.option("basePath", root).parquet(root)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            labelled = done.where((F.col("batch_id") < batch_id) & F.col("population").isNotNull())
            todo = todo.join(labelled.select(id_).distinct(), id_, "left_anti")
        enrich(todo).write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def enrich_with(client: Callable, schema: str) -> Callable[[DataFrame], DataFrame]:
    """Enrichment by a user client: ``client`` gets an iterator of pandas batches in each
    task and yields them with the label columns added; an exception belongs in ``error``."""
    return lambda batch: batch.mapInPandas(client, schema)


def enriched(spark: SparkSession, out: str, schema: str, id_: str = "id") -> DataFrame:
    """The newest row of every enriched point so far, empty before the first batch."""
    try:
        rows = spark.read.schema(f"{schema}, batch_id long").parquet(out)
        newest = rows.groupBy(id_).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (id_, "batch_id")]), "batch_id").alias("_new"))
        return newest.select(id_, "_new.*") if len(rows.columns) > 2 else newest.select(id_)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def failed_points(done: DataFrame) -> DataFrame:
    """Points to try again: no label, with a reason."""
    return done.where(F.col("population").isNull() & F.col("error").isNotNull())
