"""Error metrics of predictions, overall and by group, and comparisons of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavement.functions.scaling import huber_loss
from pavement.operators.ranking import running_min


def _sums(pred: Column, target: Column) -> list[Column]:
    err = pred - target
    return [F.count(err).alias("n"), F.avg(F.abs(err)).alias("mae"),
            F.sqrt(F.avg(err * err)).alias("rmse"), F.sum(err * err).alias("_sse"),
            (F.var_pop(target) * F.count(target)).alias("_sst"),
            (F.avg(F.when(target != 0, F.abs(err / F.nullif(target, F.lit(0.0))))) * 100).alias("_mape")]


def regression_metrics(df: DataFrame, pred: str = "pred", target: str = "target",
                       inverse: Callable[[Column], Column] | None = None) -> DataFrame:
    """MAE, RMSE, R2 (0 without variance) and MAPE over non-zero targets (0 without any), in one pass.

    ``inverse`` is applied to both columns first; it may be a pandas UDF.
    """
    p, t = F.col(pred), F.col(target)
    if inverse is not None:
        df = df.select(inverse(p).alias("_p"), inverse(t).alias("_t"))
        p, t = F.col("_p"), F.col("_t")
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.nullif("_sst", F.lit(0.0))).otherwise(0.0)
    return df.agg(*_sums(p, t)).select(
        "n", "mae", "rmse", r2.alias("r2"), F.coalesce("_mape", F.lit(0.0)).alias("mape"))


def grouped_metrics(df: DataFrame, by: str = "country", pred: str = "pred", target: str = "target") -> DataFrame:
    """MAE, RMSE, R2 (with a small constant under the fraction) and n per group."""
    return df.groupBy(by).agg(*_sums(F.col(pred), F.col(target))).select(
        by, "n", "mae", "rmse", (1 - F.col("_sse") / (F.col("_sst") + 1e-8)).alias("r2"))


def cluster_mae(df: DataFrame, pred: str = "pred", target: str = "target") -> DataFrame:
    """MAE on the count scale per cluster that has rows; rows without a cluster are one of their own (null)."""
    return df.groupBy("cluster").agg(F.avg(F.abs(F.col(pred) - F.col(target))).alias("mae"))


def macro_mae(metrics: DataFrame) -> DataFrame:
    """Unweighted mean of the group errors."""
    return metrics.agg(F.avg("mae").alias("macro_mae"))


def error_ranking(metrics: DataFrame, by: str = "country") -> DataFrame:
    """Groups by error, best first. The input is one row per group."""
    return metrics.withColumn("rank", F.rank().over(Window.orderBy("mae"))).select("rank", by, "n", "mae", "rmse", "r2")


def epoch_loss(df: DataFrame, probs: str = "probs", label: str = "domain") -> DataFrame:
    """Per epoch: mean Huber loss, mean cross-entropy and accuracy of the domain head, over rows."""
    p = F.col(probs)
    hit = F.array_position(p, F.array_max(p)) - 1 == F.col(label)
    return df.groupBy("epoch").agg(
        F.avg(huber_loss(F.col("pred"), F.col("target"))).alias("loss"),
        F.avg(-F.ln(F.get(p, F.col(label)))).alias("domain_loss"),
        F.avg(hit.cast("double")).alias("domain_acc"))


def run_comparison(results: DataFrame, metrics=("mae", "rmse", "r2", "loss")) -> DataFrame:
    """One row per run with its metrics; runs without any result are left out."""
    return (results.where(F.col("value").isNotNull()).groupBy("run")
            .pivot("metric", list(metrics)).agg(F.first("value")).orderBy("run"))


def early_stop(history: DataFrame, patience: int = 15) -> DataFrame:
    """Per run: best epoch and loss until the run stops, and the epoch at which patience ends it.

    Only strict improvements count. The run stops ``patience`` epochs after an
    improvement that is not followed by another one in time. Only the improving
    epochs are kept after the running minimum.
    """
    seen = running_min(history, ["run"], "epoch", "val_loss", "_before")
    better = seen.where(F.col("_before").isNull() | (F.col("val_loss") < F.col("_before")))
    last = history.groupBy("run").agg(F.max("epoch").alias("last_epoch"))
    following = F.lead("epoch").over(Window.partitionBy("run").orderBy("epoch"))
    limit = F.col("epoch") + F.lit(patience)
    waits = (better.withColumn("_next", following).join(last, "run")
             .withColumn("_stops", (F.coalesce("_next", F.col("last_epoch") + 1) > limit)
                         & (F.col("last_epoch") >= limit)))
    ends = waits.groupBy("run", "last_epoch").agg(
        F.min(F.when(F.col("_stops"), F.struct("epoch", "val_loss"))).alias("_stop"),
        F.max(F.struct("epoch", "val_loss")).alias("_open"))
    best = F.coalesce("_stop", "_open")
    return ends.select(
        "run", best["epoch"].alias("best_epoch"), best["val_loss"].alias("best_loss"),
        F.col("_stop").isNotNull().alias("stopped"),
        F.when(F.col("_stop").isNotNull(), F.col("_stop.epoch") + patience)
        .otherwise(F.col("last_epoch")).alias("final_epoch"))
