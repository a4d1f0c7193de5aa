"""Queries of label statistics, joins, metrics, sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pavement.functions import scaling as C
from pavement.operators import joins as J
from pavement.operators import metrics as M
from pavement.operators import ranking as R
from pavement.operators import sampling as P
from pavement.operators import splits as L
from pavement.operators import statistics as S
from pavement.plans.registry import query
from pavement.plans.scalar_queries import raster_meta
from pavement.plans.spatial_queries import (DENSITY, DENSITY_CTES, FEATURES_CTES, densities, neighbourhoods)
from pavement.operators.density import FEATURES, feature_array
from pavement.functions.projection import pixel_of
from pavement.plans.storage import written

QUOTA = {"EUROPE": (2, 2)}
LOG = "ln(1 + least(greatest(population, 0), 80000))"


def rounded(df, digits: int, *columns):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else c for c in df.columns])


# ---- splits -----------------------------------------------------------------

PROFILE = """
SELECT city, country, avg(population) AS avg_label, CAST(count(*) AS BIGINT) AS n,
  (SELECT cluster FROM (SELECT cluster, count(*) AS k FROM b_label i WHERE i.city = o.city AND population IS NOT NULL
   GROUP BY cluster ORDER BY k DESC, cluster LIMIT 1)) AS dom_cluster
FROM b_label o WHERE population IS NOT NULL GROUP BY city, country"""
PICKS = """
SELECT country, city, CASE WHEN slot <= v THEN 'val' ELSE 'test' END AS split, slot FROM (
  SELECT *, CASE WHEN n >= k AND i = CAST(floor(n / (k + 1) * 1) AS BIGINT) THEN 1
                 WHEN n >= k AND i = CAST(floor(n / (k + 1) * 2) AS BIGINT) THEN 2
                 WHEN n >= k AND k >= 3 AND i = CAST(floor(n / (k + 1) * 3) AS BIGINT) THEN 3
                 WHEN n >= k AND k >= 4 AND i = CAST(floor(n / (k + 1) * 4) AS BIGINT) THEN 4 END AS slot
  FROM (SELECT country, city, count(*) OVER (PARTITION BY country) AS n,
               row_number() OVER (PARTITION BY country ORDER BY avg_label, city) - 1 AS i,
               CASE WHEN country = 'EUROPE' THEN 2 ELSE 1 END AS v, CASE WHEN country = 'EUROPE' THEN 4 ELSE 2 END AS k
        FROM profile)) WHERE slot IS NOT NULL"""
SPLIT = """
SELECT p.city, p.country, p.avg_label, p.dom_cluster, coalesce(q.split, 'train') AS split
FROM profile p LEFT JOIN (SELECT * FROM picks WHERE country IN
  (SELECT country FROM profile GROUP BY country HAVING count(*) > 3)) q ON p.city = q.city"""
SPLIT_CTES = {"profile": PROFILE, "picks": PICKS, "split": SPLIT}


def profiles(b):
    return S.city_profiles(b.label)


def the_split(b):
    return L.city_split(profiles(b), QUOTA)


@query("city_profiles", "SELECT city, country, round(avg_label, 4) AS avg_label, n, dom_cluster FROM profile",
       {"profile": PROFILE})
def _profiles(b):
    return rounded(profiles(b).select("city", "country", "avg_label", "n", "dom_cluster"), 4, "avg_label")


@query("quantile_picks", "SELECT country, city, split, CAST(slot AS BIGINT) AS slot FROM picks",
       {"profile": PROFILE, "picks": PICKS})
def _picks(b):
    return L.quantile_picks(profiles(b), QUOTA)


@query("city_split", "SELECT city, country, split, round(avg_label, 4) AS avg_label FROM split", SPLIT_CTES)
def _split(b):
    return rounded(the_split(b).select("city", "country", "split", "avg_label"), 4, "avg_label")


@query("coverage_swap")
def _swap(b):
    return rounded(L.coverage_swap(the_split(b)).select("city", "split", "dom_cluster", "avg_label"), 4, "avg_label")


@query("shuffle_split", """
SELECT city_id, city, CASE WHEN i < floor(n * 0.7E0) THEN 'train'
  WHEN i < floor(n * 0.7E0) + floor(n * 0.15E0) THEN 'val' ELSE 'test' END AS split
FROM (SELECT city_id, city, count(*) OVER () AS n, row_number() OVER (ORDER BY md5(concat(city_id, ':42')), city_id) - 1 AS i
      FROM (SELECT DISTINCT c_nationkey AS city_id, city FROM customer JOIN b_city ON c_nationkey = city_id))""")
def _shuffle(b):
    cities = b.base("customer").select(F.col("c_nationkey").alias("city_id")).distinct().join(b.city, "city_id")
    return L.shuffle_split(cities.select("city_id", "city"))


@query("split_audit", """
SELECT 'unassigned' AS finding, '(all)' AS split, (SELECT count(*) FROM profile WHERE city NOT IN (SELECT city FROM split)) AS value
UNION ALL SELECT 'in two splits', '(all)', (SELECT count(*) FROM (SELECT city FROM split GROUP BY city HAVING count(DISTINCT split) > 1))
UNION ALL SELECT 'cities', split, count(*) FROM split GROUP BY split
UNION ALL SELECT 'clusters', split, count(DISTINCT dom_cluster) FROM split GROUP BY split""", SPLIT_CTES)
def _audit(b):
    table = profiles(b)
    return L.split_audit(L.city_split(table, QUOTA).select("city", "split"), table)


@query("assign_split", "SELECT sid, l.city, coalesce(s.split, 'test') AS split FROM b_label l LEFT JOIN split s ON l.city = s.city",
       SPLIT_CTES)
def _assign(b):
    return J.assign_split(b.label, the_split(b)).select("sid", "city", "split")


ASSIGNED = {**SPLIT_CTES, "sample": """
SELECT l.*, s.split, (approximation_m <= 390) AS valid,
       CASE WHEN population IS NULL AND approximation_m > 200 THEN 'Failed to get population' END AS error
FROM b_label l JOIN split s ON l.city = s.city"""}


def samples(b):
    """Labelled and unlabelled samples with their split, a validity flag and an error text."""
    rows = J.assign_split(b.label, the_split(b))
    failed = F.col("population").isNull() & (F.col("approximation_m") > 200)
    return rows.withColumns({"valid": F.col("approximation_m") <= 390,
                             "error": F.when(failed, "Failed to get population")})


@query("split_rows", "SELECT sid, city, cluster FROM sample WHERE split = 'val' AND valid", ASSIGNED)
def _split_rows(b):
    return S.split_rows(samples(b), "val").select("sid", "city", "cluster")


@query("union_splits", "SELECT sid, city, split FROM sample WHERE split IN ('val', 'test')", ASSIGNED)
def _union_splits(b):
    return S.union_splits(samples(b)).select("sid", "city", "split")


@query("enrich_status", """
SELECT coalesce(split, '(all)') AS split, coalesce(city, '(all)') AS city, count(*) AS total,
       count(population) AS done, count(*) - count(population) AS pending, count(error) AS failed,
       count(*) FILTER (WHERE population IS NOT NULL AND valid) AS valid, grouping(split, city) AS level
FROM sample GROUP BY ROLLUP (split, city)""", ASSIGNED)
def _status(b):
    return S.enrich_status(samples(b))


# ---- label statistics ---------------------------------------------------------

@query("labelled_only", "SELECT sid, city, population FROM b_label WHERE population IS NOT NULL")
def _labelled(b):
    return S.labelled_only(b.label).select("sid", "city", "population")


@query("pending_only", "SELECT sid, city FROM b_label WHERE population IS NULL")
def _pending(b):
    return S.pending_only(b.label).select("sid", "city")


STATS = {"stats": f"""SELECT city, avg({LOG}) AS log_mean, greatest(stddev_pop({LOG}), 1E-4) AS log_std
FROM b_label WHERE population IS NOT NULL GROUP BY city"""}


@query("city_target_stats", "SELECT city, round(log_mean, 6) AS log_mean, round(log_std, 6) AS log_std FROM stats", STATS)
def _city_stats(b):
    return rounded(S.city_target_stats(b.label), 6, "log_mean", "log_std")


@query("global_target_stats", f"""
SELECT round(avg({LOG}), 6) AS log_mean, round(stddev_pop({LOG}), 6) AS log_std
FROM sample WHERE split = 'train' AND population IS NOT NULL""", ASSIGNED)
def _global_stats(b):
    return rounded(S.global_target_stats(samples(b)), 6, "log_mean", "log_std")


def standardised(b):
    """Labelled samples with city statistics and the z-score of their log label."""
    rows = S.labelled_only(b.label)
    joined = J.attach_city_stats(rows, S.city_target_stats(b.label))
    return joined.withColumn("z", C.zscore(C.log_clip(F.col("population")), F.col("log_mean"), F.col("log_std")))


@query("attach_city_stats", """
SELECT sid, l.city, round(log_mean, 6) AS log_mean, round(log_std, 6) AS log_std
FROM b_label l LEFT JOIN stats s ON l.city = s.city""", STATS)
def _attach(b):
    joined = J.attach_city_stats(b.label, S.city_target_stats(b.label))
    return rounded(joined.select("sid", "city", "log_mean", "log_std"), 6, "log_mean", "log_std")


@query("zscore", f"""
SELECT sid, round(({LOG} - log_mean) / log_std, 6) AS z FROM b_label l JOIN stats s ON l.city = s.city
WHERE population IS NOT NULL""", STATS)
def _zscore(b):
    return rounded(standardised(b).select("sid", "z"), 6, "z")


@query("inverse_target", f"""
SELECT sid, round(exp(({LOG} - log_mean) / log_std * log_std + log_mean) - 1, 3) AS count_back
FROM b_label l JOIN stats s ON l.city = s.city WHERE population IS NOT NULL""", STATS)
def _inverse(b):
    back = C.inverse_target(F.col("z"), F.col("log_mean"), F.col("log_std"))
    return standardised(b).select("sid", F.round(back, 3).alias("count_back"))


@query("label_summary", """
SELECT count(population) AS population_n, round(avg(population), 4) AS population_mean,
       min(population) AS population_min, max(population) AS population_max,
       count(approximation_m) AS approximation_m_n, round(avg(approximation_m), 4) AS approximation_m_mean,
       min(approximation_m) AS approximation_m_min, max(approximation_m) AS approximation_m_max,
       count(*) FILTER (WHERE approximation_m > 100) AS n_over_100m, count(*) FILTER (WHERE approximation_m > 250) AS n_over_250m,
       round(count(*) FILTER (WHERE approximation_m > 100) / count(approximation_m) * 100, 4) AS pct_over_100m,
       round(count(*) FILTER (WHERE approximation_m > 250) / count(approximation_m) * 100, 4) AS pct_over_250m,
       round(median(population), 4) AS population_median, round(median(approximation_m), 4) AS approximation_m_median
FROM b_label""")
def _summary(b):
    out = S.label_summary(b.label)
    return rounded(out, 4, *[c for c in out.columns if c.endswith(("mean", "median")) or c.startswith("pct")])


@query("minmax_by_city", """
SELECT d.city, pid, """ + ", ".join(f"""round(CASE WHEN s_{c} > 0 THEN
  coalesce(({c}_density - lo_{c}) / nullif(hi_{c} - lo_{c}, 0), 0) END, 6) AS {c}_scaled""" for c in ("road", "building", "poi")) + """
FROM density d JOIN (SELECT city, """ + ", ".join(
    f"min({c}_density) AS lo_{c}, max({c}_density) AS hi_{c}, sum({c}_density) AS s_{c}" for c in ("road", "building", "poi"))
    + " FROM density GROUP BY city) s ON d.city = s.city", {**DENSITY_CTES, "density": DENSITY})
def _minmax(b):
    columns = [f"{c}_density" for c in ("road", "building", "poi")]
    scaled = S.minmax_by_city(written(densities(b)), columns)
    return scaled.select("city", "pid", *[F.round(f"{c}_density_scaled", 6).alias(f"{c}_scaled")
                                          for c in ("road", "building", "poi")])


# ---- feature statistics ---------------------------------------------------------

def featured(b):
    """Samples with their split and the feature list of their point."""
    feats = feature_array(neighbourhoods(b)).select("pid", "osm_features")
    return J.assign_split(b.label, the_split(b)).join(feats, "pid")


FEATURED = {**FEATURES_CTES, **SPLIT_CTES,
            "sample": """SELECT l.*, s.split, f.* EXCLUDE (city, pid) FROM b_label l
JOIN split s ON l.city = s.city JOIN feats f ON l.pid = f.pid"""}


@query("feature_stats", " UNION ALL ".join(
    f"SELECT {i} AS idx, round(avg(ln(1 + {f})), 6) AS mean, round(stddev_pop(ln(1 + {f})) + 1E-8, 6) AS std FROM sample WHERE split = 'train'"
    for i, f in enumerate(FEATURES)), FEATURED)
def _feature_stats(b):
    return rounded(S.feature_stats(featured(b)), 6, "mean", "std")


@query("feature_coverage", "SELECT count(*) AS n, count(*) FILTER (WHERE "
       + " OR ".join(f"{f} > 0" for f in FEATURES) + ") AS with_features FROM sample", FEATURED)
def _coverage(b):
    return S.feature_coverage(featured(b))


@query("feature_table", " UNION ALL ".join(
    f"SELECT pid, {i} AS idx, 'osm_feat_{i:02d}' AS name, round(CAST({f} AS DOUBLE), 6) AS value FROM feats"
    for i, f in enumerate(FEATURES)), FEATURES_CTES)
def _feature_table(b):
    return rounded(S.feature_table(feature_array(neighbourhoods(b)), "pid"), 6, "value")


# ---- joins ------------------------------------------------------------------------

RASTERS = {
    "rgb": "SELECT DISTINCT concat(replace(city, ', ', '_'), '_10m.tif') AS file FROM b_scene_pixel",
    "dem_files": "SELECT DISTINCT concat(replace(city, ', ', '_'), '_DEM.tif') AS file FROM b_stop",
    # land use is mapped where customers are better off than on average
    "lu": """SELECT concat(replace(city, ', ', '_'), '_LandUse.tif') AS file FROM b_point p JOIN customer c ON c.c_custkey = p.pid
GROUP BY city HAVING avg(c_acctbal) > (SELECT avg(c_acctbal) FROM customer)""",
    "complete": """SELECT r.key, r.file AS rgb_file, d.file AS dem_file, l.file AS landuse_file FROM
  (SELECT *, regexp_replace(lower(replace(file, '_10m.tif', '')), '[^a-z0-9]', '', 'g') AS key FROM rgb) r
  JOIN (SELECT *, regexp_replace(lower(replace(file, '_DEM.tif', '')), '[^a-z0-9]', '', 'g') AS key FROM dem_files) d ON r.key = d.key
  JOIN (SELECT *, regexp_replace(lower(replace(file, '_LandUse.tif', '')), '[^a-z0-9]', '', 'g') AS key FROM lu) l ON r.key = l.key""",
}


def rasters(b):
    def files(cities, suffix):
        return cities.select(F.concat(F.replace("city", F.lit(", "), F.lit("_")), F.lit(suffix)).alias("file")).distinct()

    customers = b.base("customer").select(F.col("c_custkey").alias("pid"), "c_acctbal")
    means = b.point.join(customers, "pid").groupBy("city").agg(F.avg("c_acctbal").alias("_m"))
    overall = customers.agg(F.avg("c_acctbal")).scalar()
    mapped = means.withColumn("_o", overall).where("_m > _o")
    return files(b.scene_pixel, "_10m.tif"), files(b.stop, "_DEM.tif"), files(mapped, "_LandUse.tif")


@query("complete_cities", "SELECT * FROM complete", RASTERS)
def _complete(b):
    return J.complete_cities(*rasters(b))


@query("mappable_samples", """
SELECT sid, city, regexp_replace(lower(city), '[^a-z0-9]', '', 'g') IN (SELECT key FROM complete) AS mappable FROM b_label""", RASTERS)
def _mappable(b):
    return J.mappable_samples(b.label, J.complete_cities(*rasters(b))).select("sid", "city", "mappable")


@query("resume_cities", """
SELECT DISTINCT city FROM b_label WHERE city NOT IN (SELECT city FROM b_label WHERE population > 99900)""")
def _resume(b):
    done = b.label.where("population > 99900")
    return J.resume_cities(b.label.select("city").distinct(), done)


_METRIC_SQL = """
SELECT {by} AS {by}, count(*) AS n, avg(abs(pred - target)) AS mae, sqrt(avg((pred - target) * (pred - target))) AS rmse,
       1 - sum((pred - target) * (pred - target)) / (var_pop(target) * count(*) + 1E-8) AS r2 FROM b_pred GROUP BY {by}"""
GROUPED = {"grouped": _METRIC_SQL.format(by="country")}


@query("country_join", """
SELECT d.country, round(coalesce(mae, -1), 4) AS mae, coalesce(n, 0) AS n
FROM (SELECT DISTINCT CASE WHEN country = 'ASIA' THEN 'ASIA AND PACIFIC' WHEN country = 'AFRICA' THEN 'MAGHREB' ELSE country END AS country
      FROM b_label) d
LEFT JOIN (SELECT CASE WHEN country = 'ASIA' THEN 'ASIA AND PACIFIC' ELSE country END AS country, mae, n FROM grouped) g
  ON d.country = g.country""", GROUPED)
def _country_join(b):
    names = F.when(F.col("country") == "ASIA", "ASIA AND PACIFIC").when(
        F.col("country") == "AFRICA", "MAGHREB").otherwise(F.col("country"))
    dim = b.label.select(names.alias("country")).distinct()
    joined = J.country_join(dim, M.grouped_metrics(b.pred), {"ASIA": "ASIA AND PACIFIC"})
    return joined.select("country", F.round(F.coalesce("mae", F.lit(-1.0)), 4).alias("mae"),
                         F.coalesce("n", F.lit(0)).alias("n"))


@query("valid_window_fallback", """
SELECT p.city, p.pid, round(coalesce(d.road_density, a.road_density), 9) AS road_density,
       round(coalesce(d.poi_density, a.poi_density), 6) AS poi_density
FROM b_point p LEFT JOIN (SELECT * FROM density WHERE poi_density > 0) d ON p.pid = d.pid
JOIN (SELECT city, avg(road_density) AS road_density, avg(poi_density) AS poi_density FROM density GROUP BY city) a
  ON p.city = a.city""", {**DENSITY_CTES, "density": DENSITY})
def _fallback(b):
    # points without any POI count as windows without layers
    columns = ["road_density", "poi_density"]
    feats = written(densities(b))
    avg = feats.groupBy("city").agg(*[F.avg(c).alias(c) for c in columns])
    out = J.valid_window_fallback(b.point.select("city", "pid"), feats.where("poi_density > 0"), avg,
                                  ["city", "pid"], columns)
    return rounded(rounded(out, 9, "road_density"), 6, "poi_density")


# ---- metrics --------------------------------------------------------------------------

@query("regression_metrics", """
SELECT count(*) AS n, round(avg(abs(pred - target)), 4) AS mae, round(sqrt(avg((pred - target) * (pred - target))), 4) AS rmse,
       round(CASE WHEN var_pop(target) > 0 THEN 1 - sum((pred - target) * (pred - target)) / (var_pop(target) * count(*)) ELSE 0 END, 6) AS r2,
       round(coalesce(avg(abs((target - pred) / target)) FILTER (WHERE target <> 0) * 100, 0), 6) AS mape FROM b_pred""")
def _regression(b):
    return rounded(rounded(M.regression_metrics(b.pred), 4, "mae", "rmse"), 6, "r2", "mape")


@query("grouped_metrics", "SELECT country, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 6) AS r2 FROM grouped", GROUPED)
def _grouped(b):
    return rounded(rounded(M.grouped_metrics(b.pred), 4, "mae", "rmse"), 6, "r2")


@query("macro_mae", "SELECT round(avg(mae), 4) AS macro_mae FROM grouped", GROUPED)
def _macro(b):
    return rounded(M.macro_mae(M.grouped_metrics(b.pred)), 4, "macro_mae")


@query("error_ranking", """
SELECT CAST(rank() OVER (ORDER BY mae) AS INT) AS rank, country, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 6) AS r2
FROM grouped""", GROUPED)
def _ranking(b):
    return rounded(rounded(M.error_ranking(M.grouped_metrics(b.pred)), 4, "mae", "rmse"), 6, "r2")


@query("cluster_mae", f"""
SELECT cluster, round(avg(abs(exp((p - log_mean) / log_std * log_std + log_mean) - exp((t - log_mean) / log_std * log_std + log_mean))), 4) AS mae
FROM (SELECT q.cluster, log_mean, log_std, ln(1 + least(greatest(pred, 0), 80000)) AS p, ln(1 + least(greatest(target, 0), 80000)) AS t
      FROM b_pred q JOIN stats s ON q.city = s.city) GROUP BY cluster""", STATS)
def _cluster_mae(b):
    rows = J.attach_city_stats(b.pred, S.city_target_stats(b.label))
    mean, std = F.col("log_mean"), F.col("log_std")
    back = rows.select("cluster", *[
        C.inverse_target(C.zscore(C.log_clip(F.col(c)), mean, std), mean, std).alias(c) for c in ("pred", "target")])
    return rounded(M.cluster_mae(back), 4, "mae")


@query("epoch_loss", """
SELECT epoch, round(avg(CASE WHEN d <= 1 THEN d * d / 2 ELSE d - 0.5E0 END), 6) AS loss, round(avg(-ln(w[label + 1] / s)), 6) AS domain_loss,
       round(avg(CASE WHEN list_position(w, list_max(w)) - 1 = label THEN 1.0E0 ELSE 0 END), 6) AS domain_acc
FROM (SELECT epoch, d, label, w, list_sum(w) AS s FROM (
  SELECT CAST(sid % 10 AS INT) AS epoch, abs(pred - target) / 20000 AS d, r_regionkey AS label,
         [1.0E0 + sid % 5, 1.0E0 + (sid + 7) % 5, 1.0E0 + (sid + 14) % 5, 1.0E0 + (sid + 21) % 5, 1.0E0 + (sid + 28) % 5] AS w
  FROM b_pred JOIN region ON country = r_name)) GROUP BY epoch""")
def _epoch(b):
    weights = F.array(*[F.lit(1.0) + (F.col("sid") + 7 * k) % 5 for k in range(5)])
    rows = (b.pred.join(b.base("region").select(F.col("r_name").alias("country"), F.col("r_regionkey").alias("domain")), "country")
            .withColumns({"epoch": (F.col("sid") % 10).cast("int"), "w": weights})
            .withColumn("probs", F.transform("w", lambda v: v / F.aggregate("w", F.lit(0.0), lambda a, x: a + x)))
            .withColumns({c: F.col(c) / 20000 for c in ("pred", "target")}))
    return rounded(M.epoch_loss(rows), 6, "loss", "domain_loss", "domain_acc")


@query("run_comparison", """
SELECT concat('run_', cluster) AS run, round(avg(abs(pred - target)), 4) AS mae,
       round(sqrt(avg((pred - target) * (pred - target))), 4) AS rmse FROM b_pred GROUP BY cluster""")
def _runs(b):
    by_run = M.grouped_metrics(b.pred.withColumn("run", F.concat(F.lit("run_"), "cluster")), "run")
    long = by_run.unpivot("run", ["mae", "rmse"], "metric", "value")
    empty = by_run.select(F.concat(F.col("run"), F.lit("_unfinished")).alias("run"), F.lit("mae").alias("metric"),
                          F.lit(None).cast("double").alias("value"))
    return rounded(M.run_comparison(long.unionByName(empty), ("mae", "rmse")), 4, "mae", "rmse")


PATIENCE = 5


@query("early_stop", f"""
SELECT run, best_epoch, best_loss, stop_epoch IS NOT NULL AS stopped, coalesce(stop_epoch, last_epoch) AS final_epoch FROM (
  SELECT run, last_epoch, stop_epoch, max(epoch) AS best_epoch, arg_max(val_loss, epoch) AS best_loss FROM (
    SELECT *, min(CASE WHEN counter = {PATIENCE} THEN epoch END) OVER (PARTITION BY run) AS stop_epoch,
           max(epoch) OVER (PARTITION BY run) AS last_epoch FROM (
      SELECT *, epoch - max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS counter FROM (
        SELECT *, coalesce(val_loss < min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better
        FROM b_history)))
  WHERE better AND (stop_epoch IS NULL OR epoch <= stop_epoch) GROUP BY run, last_epoch, stop_epoch)""")
def _early(b):
    return M.early_stop(b.history, PATIENCE)


# ---- sampling and picks -----------------------------------------------------------------

@query("dedupe_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k
  FROM lineitem) WHERE k = 1""")
def _dedupe(b):
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return P.dedupe_first(b.base("lineitem").select(*columns), columns[:2], columns[2:])


@query("stratified_sample", """
SELECT city, cluster, sid FROM (SELECT *, row_number() OVER (PARTITION BY city, cluster ORDER BY md5(concat(sid, ':42')), sid) AS k
FROM b_label) WHERE k <= 100""")
def _stratified(b):
    return P.stratified_sample(b.label, id_="sid").select("city", "cluster", "sid")


@query("best_worst_random", """
WITH e AS (SELECT sid, city, target, pred, abs(pred - target) AS err FROM b_pred), r AS (
  SELECT *, row_number() OVER (ORDER BY err, sid) AS a, row_number() OVER (ORDER BY err DESC, sid) AS z,
         row_number() OVER (ORDER BY md5(concat(sid, ':42')), sid) AS d FROM e), t AS (
SELECT 'best' AS pick, a AS rank, * FROM r WHERE a <= 5 UNION ALL SELECT 'worst', z, * FROM r WHERE z <= 5
UNION ALL SELECT 'random', d, * FROM r WHERE d <= 5)
SELECT pick, rank, sid, city, round(err, 4) AS abs_error, round(100 * err / greatest(target, 1), 6) AS pct_error FROM t""".replace(
    "WITH e AS", "SELECT * FROM (WITH e AS") + ")")
def _bwr(b):
    out = P.best_worst_random(b.pred).select("pick", "rank", "sid", "city", "abs_error", "pct_error")
    return rounded(rounded(out, 4, "abs_error"), 6, "pct_error")


@query("quartile_pools", """
SELECT pool, sid, target FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY md5(concat(sid, ':42')), sid) AS k FROM (
  SELECT 'high' AS pool, sid, target FROM b_pred WHERE target >= (SELECT quantile_cont(target, 0.75) FROM b_pred)
  UNION ALL SELECT 'low', sid, target FROM b_pred WHERE target <= (SELECT quantile_cont(target, 0.25) FROM b_pred)))
WHERE k <= 40""")
def _pools(b):
    return P.quartile_pools(b.pred).select("pool", "sid", "target")


@query("label_index", """
SELECT country, dense_rank() OVER (ORDER BY country) - 1 AS label FROM (SELECT DISTINCT country FROM b_label)""")
def _index(b):
    return P.label_index(b.label)


@query("spread_picks")
def _spread(b):
    placed = pixel_of(S.labelled_only(b.label).join(b.point.select("pid", "x", "y"), "pid"), raster_meta(b), 4)
    return P.spread_picks(placed.select("city", "sid", "population", "prow", "pcol"), n=5, crop=4)


@query("union_chunks", """
SELECT oid, city, 'poi' AS layer, tag, -1 AS street_count FROM b_poi
UNION ALL SELECT oid, city, 'node', '', street_count FROM b_node
UNION ALL SELECT oid, city, 'stop', '', -1 FROM b_stop""")
def _chunks(b):
    parts = [b.poi.select("oid", "city", F.lit("poi").alias("layer"), "tag"),
             b.node.select("oid", "city", F.lit("node").alias("layer"), "street_count"),
             b.stop.select("oid", "city", F.lit("stop").alias("layer"))]
    return S.union_chunks(parts).fillna({"tag": "", "street_count": -1})
