"""Queries of the network operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pavement.operators import learning as L
from pavement.operators import metrics as M
from pavement.operators import network as N
from pavement.operators import separation as Z
from pavement.operators import statistics as S
from pavement.plans.learning_queries import training_table
from pavement.plans.registry import query
from pavement.plans.sample_queries import rounded


@query("mlp_regressor")
def _mlp(b):
    table = training_table(b)
    model = N.mlp_regressor(S.split_rows(table, "train"), S.split_rows(table, "val"), epochs=6, steps=4)
    return M.regression_metrics(L.score_counts(model, S.split_rows(table, "test")), "pred", "population")


@query("adversarial_probe")
def _adversarial(b):
    """Accuracy of the country head on unseen rows, and the error of the label, without and with the opposed gradient."""
    table = training_table(b)
    train, test = S.split_rows(table, "train"), table.where("split <> 'train'")
    parts = []
    for top in (0.0, 1.0):
        model = N.adversarial_probe(train, "country", epochs=5, steps=3, top=top)
        told = model.told(model.transform(test))
        parts.append(told.agg(F.count("*").alias("n"), F.avg((F.col("told") == F.col("country")).cast("double")).alias("accuracy"),
                              F.avg(F.abs(F.col("z_pred") - F.col("z"))).alias("label_error")).withColumn("strength", F.lit(top)))
    return S.union_chunks(parts)


HIDDEN = 3


def stated_network(width: int = 64) -> N.Network:
    """A network of one hidden layer whose weights follow a rule that SQL can state."""
    model = N.Network.fresh(width, (HIDDEN,), (0.0,), features="tabular")
    i, h = np.arange(width)[:, None], np.arange(HIDDEN)[None, :]
    model.weights |= {"l0.w": ((i * 7 + h * 3) % 11 - 5) / 8.0, "l0.b": (np.arange(HIDDEN) - 1) / 64.0,
                      "l0.var": np.full(HIDDEN, 1 - N.NORM_EPS), "out.w": (np.arange(HIDDEN)[:, None] + 1) / 2.0}
    return model


@query("gradient_attribution", f"""
SELECT idx, round(avg(abs(value)), 9) AS mean_abs, round(avg(value), 9) AS mean_signed FROM (
  SELECT x.vec_id, x.i AS idx, x.v * sum(CASE WHEN z.z > 0 THEN ((x.i * 7 + z.h * 3) % 11 - 5) / 8.0E0 * (z.h + 1) / 2.0E0 ELSE 0 END) AS value
  FROM x JOIN z ON x.vec_id = z.vec_id GROUP BY x.vec_id, x.i, x.v) GROUP BY idx""", {
    "x": "SELECT vec_id, CAST(i - 1 AS INT) AS i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT range AS i FROM range(1, 65)) r",
    "z": f"""SELECT vec_id, CAST(h.range AS INT) AS h, sum(v * ((i * 7 + h.range * 3) % 11 - 5) / 8.0E0) + (h.range - 1) / 64.0E0 AS z
FROM x, range({HIDDEN}) h GROUP BY vec_id, h.range"""})
def _gradients(b):
    rows = b.base("embeddings").select("vec_id", F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("tabular"))
    found = N.gradient_attribution(stated_network(), rows, "vec_id")
    return rounded(Z.attribution_summary(found), 9, "mean_abs", "mean_signed")
