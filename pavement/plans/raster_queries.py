"""Queries of scenes, pixels, attributions and feature-space separation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pavement.functions import scaling as C
from pavement.operators import grid as N
from pavement.operators import raster as R
from pavement.operators import sampling as P
from pavement.operators import separation as Z
from pavement.operators.statistics import labelled_only
from pavement.plans.registry import query
from pavement.plans.sample_queries import rounded
from pavement.plans.scalar_queries import raster_meta

SEASONS = {"EUROPE": "1996-03-01/1996-09-01", "ASIA": "1997-01-01/1997-12-31"}
DEFAULT = "1995-06-01/1995-12-01"
_SEASON_SQL = """SELECT pid, city, country,
  CASE country WHEN 'EUROPE' THEN '1996-03-01' WHEN 'ASIA' THEN '1997-01-01' ELSE '1995-06-01' END AS first_day,
  CASE country WHEN 'EUROPE' THEN '1996-09-01' WHEN 'ASIA' THEN '1997-12-31' ELSE '1995-12-01' END AS last_day FROM b_point"""


@query("census_window", "SELECT pid, first_day, last_day FROM season", {"season": _SEASON_SQL})
def _census(b):
    first, last = R.census_window(F.col("country"), SEASONS, DEFAULT)
    return b.point.select("pid", first.cast("string").alias("first_day"), last.cast("string").alias("last_day"))


@query("scene_search", """
SELECT c.city, s.scene_id, s.cloud_cover FROM b_scene s JOIN (
  SELECT city, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1, min(first_day) AS d0, min(last_day) AS d1
  FROM b_point p JOIN season USING (pid, city) GROUP BY city) c
ON s.min_lon <= x1 AND s.max_lon >= x0 AND s.min_lat <= y1 AND s.max_lat >= y0
WHERE s.collection = 'sentinel-2-l2a' AND s.cloud_cover < 95
  AND CAST(s.ts AS DATE) BETWEEN CAST(d0 AS DATE) AND CAST(d1 AS DATE)""", {"season": _SEASON_SQL})
def _search(b):
    first, last = R.census_window(F.col("country"), SEASONS, DEFAULT)
    boxes = N.total_bounds(b.point, ("city", "country")).withColumns({"start": first, "end": last})
    return R.scene_search(b.scene, boxes).select("city", "scene_id", "cloud_cover")


@query("clear_pixels", "SELECT city, scene_id, prow, pcol, red FROM b_scene_pixel WHERE scl NOT IN (0, 1, 3, 8, 9, 10, 11)")
def _clear(b):
    return R.clear_pixels(b.scene_pixel).select("city", "scene_id", "prow", "pcol", "red")


# the day of a pixel is that of its scene, the order it comes from, at longitude 9.05
_DAY = {
    "dated": "SELECT p.*, CAST(o_orderdate + INTERVAL 2172 SECOND AS DATE) AS solar_day FROM b_scene_pixel p JOIN orders ON p.scene_id = o_orderkey",
    "mosaic": "SELECT city, solar_day, prow, pcol, " + ", ".join(
        f"coalesce((min({{'s': scene_id, 'v': CAST({c} AS BIGINT)}}) FILTER (WHERE {c} <> 0)).v, 0) AS {c}"
        for c in ("red", "green", "blue", "scl")) + " FROM dated GROUP BY city, solar_day, prow, pcol",
    "composite": "SELECT city, prow, pcol, " + ", ".join(
        f"coalesce(median({c}) FILTER (WHERE scl NOT IN (0, 1, 3, 8, 9, 10, 11)), 0) AS {c}" for c in C.CHANNELS)
        + " FROM mosaic GROUP BY city, prow, pcol",
}


def mosaic(b):
    scenes = b.base("orders").select(F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").alias("ts"))
    day = R.solar_day(F.col("ts"), F.lit(9.05))
    return R.solar_day_mosaic(b.scene_pixel.join(scenes, "scene_id").withColumn("solar_day", day))


@query("solar_day_mosaic", """
SELECT city, strftime(solar_day, '%Y-%m-%d') AS solar_day, prow, pcol, red, green, blue, scl FROM mosaic""", _DAY)
def _mosaic(b):
    return mosaic(b).withColumn("solar_day", F.col("solar_day").cast("string"))


@query("median_composite", """
SELECT city, prow, pcol, round(red, 4) AS red, round(green, 4) AS green, round(blue, 4) AS blue FROM composite""", _DAY)
def _composite(b):
    return rounded(R.median_composite(mosaic(b)), 4, *C.CHANNELS)


_UNIT = {"unit": "SELECT city, scene_id, prow, pcol, " + ", ".join(
    f"floor(least(greatest(CAST({c} AS DOUBLE), 0), 3000) / 3000 * 255) / 255 AS {c}" for c in C.CHANNELS) + " FROM b_scene_pixel"}
_LIT = {**_UNIT, "lit": " UNION ALL ".join(
    f"""SELECT city, '{c}' AS channel, count({c}) AS n, count(*) FILTER (WHERE {c} > 0.01) AS n_lit,
    CASE WHEN count(*) FILTER (WHERE {c} > 0.01) >= 100 THEN avg({c}) FILTER (WHERE {c} > 0.01) ELSE avg({c}) END AS mean,
    CASE WHEN count(*) FILTER (WHERE {c} > 0.01) >= 100 THEN stddev_pop({c}) FILTER (WHERE {c} > 0.01) ELSE stddev_pop({c}) END AS std
    FROM unit GROUP BY city""" for c in C.CHANNELS)}


def unit_pixels(b):
    """Pixel colours in [0, 1]."""
    return b.scene_pixel.select("city", "scene_id", "prow", "pcol", *[
        (C.reflectance_to_byte(F.col(c).cast("double")) / 255.0).alias(c) for c in C.CHANNELS])


@query("lit_pixels", "SELECT city, channel, n, n_lit, round(mean, 6) AS mean, round(std, 6) AS std FROM lit", _LIT)
def _lit(b):
    return rounded(R.lit_pixels(unit_pixels(b)), 6, "mean", "std")


_RGB = {**_LIT, "wanted": "SELECT city FROM b_city UNION ALL SELECT concat('New ', city) FROM b_city",
        "rgb_stats": """
SELECT w.city, c.channel, coalesce(mean, m) AS mean, coalesce(greatest(std, 1E-4), s) AS std
FROM wanted w CROSS JOIN (VALUES ('red', 0.485E0, 0.229E0), ('green', 0.456E0, 0.224E0), ('blue', 0.406E0, 0.225E0)) c(channel, m, s)
LEFT JOIN lit l ON l.city = w.city AND l.channel = c.channel"""}


@query("city_rgb_stats", "SELECT city, channel, round(mean, 6) AS mean, round(std, 6) AS std FROM rgb_stats", _RGB)
def _rgb_stats(b):
    wanted = b.city.select("city").unionByName(b.city.select(F.concat(F.lit("New "), "city").alias("city")))
    return rounded(R.city_rgb_stats(unit_pixels(b), wanted), 6, "mean", "std")


@query("rgb_city_prewarp", "SELECT u.city, scene_id, prow, pcol, " + ", ".join(
    f"round({C.IMAGENET_MEAN[c]}E0 + {C.IMAGENET_STD[c]}E0 * ({c} - {c[0]}.mean) / greatest({c[0]}.std, 1E-4), 6) AS {c}"
    for c in C.CHANNELS) + " FROM unit u " + " ".join(
    f"JOIN lit {c[0]} ON {c[0]}.city = u.city AND {c[0]}.channel = '{c}'" for c in C.CHANNELS), _LIT)
def _prewarp(b):
    pixels = unit_pixels(b)
    return rounded(R.rgb_city_prewarp(pixels, R.city_rgb_stats(pixels, b.city.select("city"))), 6, *C.CHANNELS)


@query("percentile_stretch", "SELECT p.city, scene_id, prow, pcol, " + ", ".join(
    f"round(least(greatest(({c} - {c}2) / ({c}98 - {c}2 + 1E-8), 0), 1), 6) AS {c}" for c in C.CHANNELS)
    + " FROM b_scene_pixel p JOIN (SELECT city, " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.02) AS {c}2, quantile_cont(CAST({c} AS DOUBLE), 0.98) AS {c}98" for c in C.CHANNELS)
    + " FROM b_scene_pixel GROUP BY city) q ON p.city = q.city")
def _stretch(b):
    pixels = b.scene_pixel.select("city", "scene_id", "prow", "pcol", *C.CHANNELS)
    return rounded(R.percentile_stretch(pixels), 6, *C.CHANNELS)


@query("downsample_mean", "SELECT city, CAST(floor(prow / 4) AS BIGINT) AS prow, CAST(floor(pcol / 4) AS BIGINT) AS pcol, "
       + ", ".join(f"round(avg({c}), 4) AS {c}" for c in C.CHANNELS) + " FROM b_scene_pixel GROUP BY ALL")
def _downsample(b):
    return rounded(R.downsample_mean(b.scene_pixel, raster_meta(b), target=5), 4, *C.CHANNELS)


@query("quartile_mean_tile", "SELECT pool, prow, pcol, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in C.CHANNELS) + """
FROM b_scene_pixel JOIN (
  SELECT 'high' AS pool, city FROM means WHERE target >= (SELECT quantile_cont(target, 0.75) FROM means)
  UNION ALL SELECT 'low', city FROM means WHERE target <= (SELECT quantile_cont(target, 0.25) FROM means)) USING (city)
GROUP BY pool, prow, pcol""", {"means": "SELECT city, avg(population) AS target FROM b_label WHERE population IS NOT NULL GROUP BY city"})
def _mean_tile(b):
    means = labelled_only(b.label).groupBy("city").agg(F.avg("population").alias("target"))
    pools = P.quartile_pools(means.withColumn("city_no", F.xxhash64("city")), n=40, id_="city_no")
    return rounded(R.quartile_mean_tile(b.scene_pixel, pools, "city"), 4, *C.CHANNELS)


# ---- prediction grid ------------------------------------------------------------------

SIGMA = 1.0


def _smooth_sql() -> str:
    kernel = [math.exp(-0.5 * (k / SIGMA) ** 2) for k in range(-4, 5)]
    taps = ", ".join(f"({k}, CAST({w / sum(kernel)!r} AS DOUBLE))" for k, w in zip(range(-4, 5), kernel))

    def zoomed(axis: str) -> str:  # bilinear value of grid column at output position o
        return f"""least(floor({axis} * 7 / 19.0E0), 7)"""

    mirror = "CASE WHEN ({0}) < 0 THEN -({0}) - 1 WHEN ({0}) > 19 THEN 39 - ({0}) ELSE ({0}) END"
    return f"""
SELECT city, prow, pcol, round(least(greatest(pred, 0), 80000), 4) AS pred FROM (
SELECT city, prow, pcol, sum(wr * wc * v) AS pred FROM (
  SELECT z.city, o.r AS prow, o.c AS pcol, a.w AS wr, e.w AS wc, z.v
  FROM (SELECT CAST(r.range AS BIGINT) AS r, CAST(c.range AS BIGINT) AS c FROM range(20) r, range(20) c) o,
       (VALUES {taps}) a(k, w), (VALUES {taps}) e(k, w),
       zoom z WHERE z.zr = {mirror.format('o.r + a.k')} AND z.zc = {mirror.format('o.c + e.k')})
GROUP BY city, prow, pcol)""", {
        "seen": """SELECT city, CAST(floor(prow * 8 / 20) AS BIGINT) AS gi, CAST(floor(pcol * 8 / 20) AS BIGINT) AS gj, avg(red) * 30 AS pred
FROM b_scene_pixel GROUP BY ALL""",
        # a grid cell that was never predicted is 0
        "cell": """SELECT c.city, r.range AS gi, k.range AS gj, coalesce(s.pred, 0) AS pred
FROM (SELECT DISTINCT city FROM seen) c CROSS JOIN range(8) r CROSS JOIN range(8) k
LEFT JOIN seen s ON s.city = c.city AND s.gi = r.range AND s.gj = k.range""",
        "zoom": f"""SELECT a.city, o.r AS zr, o.c AS zc,
  (1 - (o.r * 7 / 19.0E0 - {zoomed('o.r')})) * ((1 - (o.c * 7 / 19.0E0 - {zoomed('o.c')})) * a.pred + (o.c * 7 / 19.0E0 - {zoomed('o.c')}) * b.pred)
  + (o.r * 7 / 19.0E0 - {zoomed('o.r')}) * ((1 - (o.c * 7 / 19.0E0 - {zoomed('o.c')})) * c.pred + (o.c * 7 / 19.0E0 - {zoomed('o.c')}) * d.pred) AS v
FROM (SELECT CAST(r.range AS BIGINT) AS r, CAST(c.range AS BIGINT) AS c FROM range(20) r, range(20) c) o
JOIN cell a ON a.gi = {zoomed('o.r')} AND a.gj = {zoomed('o.c')}
JOIN cell b ON b.city = a.city AND b.gi = a.gi AND b.gj = least(a.gj + 1, 7)
JOIN cell c ON c.city = a.city AND c.gi = least(a.gi + 1, 7) AND c.gj = a.gj
JOIN cell d ON d.city = a.city AND d.gi = least(a.gi + 1, 7) AND d.gj = least(a.gj + 1, 7)"""}


@query("smooth_grid", *_smooth_sql())
def _smooth(b):
    cells = b.scene_pixel.groupBy("city", F.floor(F.col("prow") * 8 / 20).alias("gi"),
                                  F.floor(F.col("pcol") * 8 / 20).alias("gj")).agg((F.avg("red") * 30).alias("pred"))
    meta = raster_meta(b).select("city", "height", "width", F.lit(8).cast("bigint").alias("n_gi"), F.lit(8).cast("bigint").alias("n_gj"))
    return rounded(R.smooth_grid(cells, meta, SIGMA).select("city", "prow", "pcol", "pred"), 4, "pred")


# ---- attributions and separation -----------------------------------------------------------

_ATTR = {"attr": """SELECT vec_id, label % 5 AS cluster, CAST(i - 1 AS INT) AS idx, CAST(embedding[i] AS DOUBLE) AS value
FROM embeddings, (SELECT range AS i FROM range(1, 65)) r"""}


def attributions(b):
    vectors = b.base("embeddings").select(
        "vec_id", (F.col("label") % 5).alias("cluster"), F.col("embedding").cast("array<double>").alias("a"))
    return Z.long_attributions(vectors, "a", "vec_id", "cluster")


@query("attribution_summary", """
SELECT idx, round(avg(abs(value)), 9) AS mean_abs, round(avg(value), 9) AS mean_signed FROM attr GROUP BY idx""", _ATTR)
def _attr_summary(b):
    return rounded(Z.attribution_summary(attributions(b)), 9, "mean_abs", "mean_signed")


@query("top_features", """
SELECT rank, idx, round(mean_abs, 9) AS mean_abs FROM (SELECT idx, avg(abs(value)) AS mean_abs,
  row_number() OVER (ORDER BY avg(abs(value)) DESC, idx) AS rank FROM attr GROUP BY idx) WHERE rank <= 5""", _ATTR)
def _top(b):
    return rounded(P.top_features(Z.attribution_summary(attributions(b))).select("rank", "idx", "mean_abs"), 9, "mean_abs")


@query("attribution_by_cluster", """
SELECT CAST(rank AS INT) AS rank, idx, cluster, round(mean, 9) AS mean, round(spread, 9) AS spread FROM (
  SELECT idx, stddev_pop(mean) AS spread, row_number() OVER (ORDER BY stddev_pop(mean) DESC, idx) AS rank FROM filled GROUP BY idx)
JOIN filled USING (idx)""", {**_ATTR, "filled": """
SELECT f.idx, CAST(c.range AS INT) AS cluster, coalesce(avg(value), 0) AS mean
FROM (SELECT DISTINCT idx FROM attr) f CROSS JOIN (SELECT range FROM range(100)) c
LEFT JOIN attr a ON a.idx = f.idx AND a.cluster = c.range WHERE c.range <= (SELECT max(cluster) FROM attr) GROUP BY f.idx, c.range"""})
def _by_cluster(b):
    return rounded(Z.attribution_by_cluster(attributions(b)), 9, "mean", "spread")


@query("silhouette", """
SELECT coalesce(label, -1) AS label, round(avg(s), 6) AS silhouette, count(*) AS n FROM (
  SELECT i, label, CASE WHEN k > 1 THEN (b - a) / greatest(a, b) ELSE 0 END AS s FROM (
    SELECT i, label, max(CASE WHEN other = label THEN n END) AS k, max(CASE WHEN other = label THEN d / nullif(n - 1, 0) END) AS a,
           min(CASE WHEN other <> label THEN d / n END) AS b
    FROM (SELECT x.i, x.label, y.label AS other, count(*) AS n, sum(list_distance(x.e, y.e)) AS d FROM v x, v y GROUP BY ALL)
    GROUP BY i, label)) GROUP BY ROLLUP (label)""",
       {"v": "SELECT vec_id AS i, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"})
def _silhouette(b):
    out = rounded(Z.silhouette(b.base("embeddings")), 6, "silhouette")
    return out.withColumn("label", F.coalesce("label", F.lit(-1).cast("bigint")))


@query("silhouette_squared", """
SELECT coalesce(label, -1) AS label, round(avg(s), 6) AS silhouette, count(*) AS n FROM (
  SELECT i, label, CASE WHEN k > 1 THEN (b - a) / greatest(a, b) ELSE 0 END AS s FROM (
    SELECT i, label, max(CASE WHEN other = label THEN n END) AS k, max(CASE WHEN other = label THEN d / nullif(n - 1, 0) END) AS a,
           min(CASE WHEN other <> label THEN d / n END) AS b
    FROM (SELECT x.i, x.label, y.label AS other, count(*) AS n, sum(list_distance(x.e, y.e) * list_distance(x.e, y.e)) AS d
          FROM v x, v y GROUP BY ALL)
    GROUP BY i, label)) GROUP BY ROLLUP (label)""",
       {"v": "SELECT vec_id AS i, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"})
def _silhouette_squared(b):
    out = rounded(Z.silhouette_squared(b.base("embeddings")), 6, "silhouette")
    return out.withColumn("label", F.coalesce("label", F.lit(-1).cast("bigint")))


@query("adjusted_rand", """
SELECT round((both_ - a * b / total) / ((a + b) / 2 - a * b / total), 9) AS ari FROM (
SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS both_, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY a)) AS a,
       (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY b)) AS b, (SELECT sum(n) * (sum(n) - 1) / 2 FROM t) AS total)""",
       {"t": """SELECT label AS a, list_position(embedding, list_max(embedding)) AS b, CAST(count(*) AS DOUBLE) AS n
FROM embeddings GROUP BY ALL"""})
def _ari(b):
    pairs = b.base("embeddings").select("label", F.array_position("embedding", F.array_max("embedding")).alias("other"))
    return rounded(Z.adjusted_rand(pairs, "label", "other"), 9, "ari")
