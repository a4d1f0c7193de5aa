"""Queries of clustering, regression, probes and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from pavement.functions.scaling import log_clip, zscore
from pavement.operators import joins as J
from pavement.operators import learning as L
from pavement.operators import metrics as M
from pavement.operators import separation as Z
from pavement.operators import statistics as S
from pavement.operators.density import FEATURES, feature_array, osm_features_15
from pavement.plans.registry import query
from pavement.plans.sample_queries import FEATURED, STATS, featured, rounded
from pavement.plans.scalar_queries import raster_meta
from pavement.plans.spatial_queries import DENSITY, DENSITY_CTES, FEATURES_CTES, densities, layers
from pavement.plans.storage import written

ITERS, K = 10, 5
_SCALED = [f"{c}_s" for c in ("road", "building", "poi")]


def _kmeans_ctes() -> dict[str, str]:
    """The same steps unrolled: scaling, quantile bands as seeds, ITERS centroid updates."""
    scale = ", ".join(
        f"CASE WHEN sum({c}_density) OVER w > 0 THEN coalesce(({c}_density - min({c}_density) OVER w) / "
        f"nullif(max({c}_density) OVER w - min({c}_density) OVER w, 0), 0) ELSE 0 END AS {c}_s"
        for c in ("road", "building", "poi"))
    cuts = ", ".join(f"quantile_cont(score, {j / K}) AS q{j}" for j in range(1, K))
    band = " + ".join(f"CAST(score > q{j} AS INT)" for j in range(1, K))
    means = ", ".join(f"avg({c}) AS {c}" for c in _SCALED)
    ctes = {
        **DENSITY_CTES, "density": DENSITY,
        "scaled": f"SELECT city, pid, {scale}, count(*) OVER w AS n, "
                  f"sum(road_density + building_density + poi_density) OVER w AS mass FROM density WINDOW w AS (PARTITION BY city)",
        "pts": f"SELECT *, {' + '.join(_SCALED)} AS score FROM scaled WHERE n >= {K} AND mass > 0",  # a city without any density is not clustered
        "cuts": f"SELECT city, {cuts} FROM (SELECT DISTINCT city, score FROM pts) GROUP BY city",
        "c1": f"SELECT city, cluster, {means} FROM (SELECT p.*, {band} AS cluster FROM pts p JOIN cuts USING (city)) GROUP BY city, cluster",
    }
    away = " + ".join(f"(p.{c} - c.{c}) * (p.{c} - c.{c})" for c in _SCALED)
    for i in range(1, ITERS + 1):
        ctes[f"a{i}"] = (f"SELECT city, pid, {', '.join(_SCALED)}, cluster FROM (SELECT p.*, c.cluster, row_number() OVER ("
                         f"PARTITION BY p.city, p.pid ORDER BY {away}, c.cluster) AS k FROM pts p JOIN c{i} c ON p.city = c.city) WHERE k = 1")
        if i < ITERS:
            ctes[f"c{i + 1}"] = f"SELECT city, cluster, {means} FROM a{i} GROUP BY city, cluster"
    ctes["numbered"] = (f"SELECT city, cluster, row_number() OVER (PARTITION BY city ORDER BY {' + '.join(_SCALED)}, cluster) - 1 AS number FROM c{ITERS}")
    return ctes


@query("kmeans_by_city", f"""
SELECT d.city, d.pid, coalesce(CAST(number AS INT), -1) AS cluster FROM density d LEFT JOIN a{ITERS} a ON d.pid = a.pid
LEFT JOIN numbered n ON a.city = n.city AND a.cluster = n.cluster""", _kmeans_ctes())
def _kmeans(b):
    clustered = L.kmeans_by_city(densities(b), iters=ITERS)
    return clustered.select("city", "pid", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


@query("kmeans_global")
def _kmeans_global(b):
    vectors = b.base("embeddings")
    k = vectors.select("label").distinct().count()
    clustered = written(L.kmeans_global(vectors, k).select("vec_id", "label", "cluster"))
    return clustered.groupBy("label", "cluster").agg(F.count("*").alias("n"))


def training_table(b):
    """Labelled samples with split, standardised features, log z-score label and city statistics."""
    rows = S.standardise_features(written(S.labelled_only(featured(b))))
    stats = S.city_target_stats(b.label)
    joined = J.attach_city_stats(rows, stats)
    return written(joined.withColumn("z", zscore(log_clip(F.col("population")), F.col("log_mean"), F.col("log_std")))
                   .select("sid", "city", "country", "cluster", "split", "population", "tabular", "z", "log_mean", "log_std"))


@query("tabular_regressor")
def _regressor(b):
    table = training_table(b)
    parts = []
    for kind in ("huber", "boosted"):
        model = L.tabular_regressor(S.split_rows(table, "train"), kind)
        scored = L.score_counts(model, S.split_rows(table, "test"))
        parts.append(M.regression_metrics(scored, "pred", "population").withColumn("model", F.lit(kind)))
    return S.union_chunks(parts)


@query("label_probe")
def _probe(b):
    table = training_table(b)
    train = S.split_rows(table, "train")
    test = table.where("split <> 'train'")
    return S.union_chunks([L.label_probe(train, test, c).withColumn("label", F.lit(c)) for c in ("country", "cluster")])


def mean_feature():
    """A prediction function with no state: the mean of the standardised features."""
    return lambda batch: batch.mean(axis=1).astype("float64")


_Z = {f: f"(ln(1 + {f}) - m_{f}) / s_{f}" for f in FEATURES}


@query("batch_score", f"""
SELECT sid, round(zm, 4) AS z_pred, round(exp(zm * log_std + log_mean) - 1, 4) AS pred
FROM (SELECT sid, city, ({' + '.join(_Z.values())}) / 15 AS zm FROM sample, train_stats WHERE population IS NOT NULL) z
JOIN stats USING (city)""", {**FEATURED, **STATS, "train_stats": "SELECT " + ", ".join(
    f"avg(ln(1 + {f})) AS m_{f}, stddev_pop(ln(1 + {f})) + 1E-8 AS s_{f}" for f in FEATURES)
    + " FROM sample WHERE split = 'train' AND population IS NOT NULL"})
def _score(b):
    scored = L.batch_score(training_table(b), mean_feature)
    return rounded(scored.select("sid", "z_pred", "pred"), 4, "z_pred", "pred")


@query("linear_attribution")
def _attribution(b):
    """The attributions of every labelled sample, whatever its split, by the model of the train split."""
    table = training_table(b)
    model = L.tabular_regressor(S.split_rows(table, "train"))
    return Z.attribution_summary(L.linear_attribution(model, table, "sid"))


@query("project_2d")
def _project(b):
    return L.project_2d(b.base("embeddings").select("vec_id", "label", "embedding")).select("vec_id", "label", "px", "py")


_CENTRES = {
    "raster": "SELECT city, max(prow) + 1 AS height, max(pcol) + 1 AS width FROM b_scene_pixel GROUP BY city",
    "centre": """SELECT city, concat(city, '_', r.range, '_', c.range) AS pid, r.range AS gi, c.range AS gj,
  500 * (2 + 2 * c.range + 0.5E0) AS x, 10000 - 500 * (2 + 2 * r.range + 0.5E0) AS y
FROM raster, range(100) r, range(100) c WHERE 2 + 2 * r.range < height - 2 AND 2 + 2 * c.range < width - 2"""}


@query("city_surface", f"""
SELECT c.city, gi, gj, round(least(greatest(exp(({' + '.join(f'ln(1 + {f})' for f in FEATURES)}) / 150 * log_std + log_mean) - 1, 0), 80000), 4) AS pred
FROM centre c JOIN feats f ON c.pid = f.pid JOIN stats s ON c.city = s.city""",
       {**_CENTRES, **{n: t.replace("b_point p", "centre p") for n, t in FEATURES_CTES.items()}, **STATS})
def _surface(b):
    def score(windows):
        fed = windows.withColumn("tabular", F.transform("osm_features", lambda v: F.log1p(v)))
        stats = S.city_target_stats(b.label)
        return L.batch_score(J.attach_city_stats(fed, stats), small_mean_feature)

    surface = L.city_surface(raster_meta(b), lambda c: feature_array(osm_features_15(c, layers(b))), score, crop=4, stride=2)
    return rounded(surface, 4, "pred")


def small_mean_feature():
    return lambda batch: (batch.mean(axis=1) / 10).astype("float64")


@query("with_transform", """
SELECT vec_id, CAST(i - 1 AS INT) AS idx, round(CAST(embedding[i] AS DOUBLE) * 2 + 1, 6) AS value
FROM embeddings, (SELECT range AS i FROM range(1, 65)) r""")
def _transform(b):
    doubles = b.base("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    out = L.with_transform(doubles, lambda v: v * 2 + 1, "v")
    return rounded(out.select("vec_id", F.posexplode("v").alias("idx", "value")), 6, "value")
