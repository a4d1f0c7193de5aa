"""Queries of the scalar functions, grids and projections."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pavement.functions import projection as P
from pavement.functions import scaling as C
from pavement.functions import text as T
from pavement.operators import grid
from pavement.plans.registry import query


@query("city_key", r"""
SELECT doc_id, regexp_replace(strip_accents(replace(replace(lower(
  replace(replace(replace(replace(replace(replace(replace(replace(text,
  '.tif', ''), '.tiff', ''), '_LandUse', ''), 'LandUse', ''), '_DEM', ''), 'DEM', ''), '_10m', ''), '10m', '')),
  'ø', 'o'), 'æ', 'ae')), '[^\p{L}\p{N}]', '', 'g') AS city_key FROM documents""")
def _city_key(b):
    return b.base("documents").select("doc_id", T.city_key(F.col("text")).alias("city_key"))


@query("country_of", "SELECT pid, split_part(city, ', ', -1) AS country_of FROM b_point")
def _country(b):
    return b.point.select("pid", T.country_of(F.col("city")).alias("country_of"))


@query("slug", "SELECT pid, replace(replace(city, ', ', '_'), ' ', '_') AS slug FROM b_point")
def _slug(b):
    return b.point.select("pid", T.slug(F.col("city")).alias("slug"))


@query("extract_json_value", """
SELECT event_id, CASE WHEN json_valid(props) THEN coalesce(json_extract_string(props, '$.k'), '0') END AS k,
       CASE WHEN json_valid(props) THEN coalesce(json_extract_string(props, '$.v'), '0') END AS v FROM events""")
def _json(b):
    return b.base("events").select("event_id", T.extract_json_value(F.col("props"), "k").alias("k"),
                                   T.extract_json_value(F.col("props"), "v").alias("v"))


@query("log_clip", "SELECT sid, round(ln(1 + least(greatest(population, 0), 80000)), 6) AS log_pop FROM b_label WHERE population IS NOT NULL")
def _log_clip(b):
    labelled = b.label.where("population IS NOT NULL")
    return labelled.select("sid", F.round(C.log_clip(F.col("population")), 6).alias("log_pop"))


@query("dem_norm", """
SELECT city, scene_id, prow, pcol, round((least(greatest(dem, -50), 3000) + 50) / 3050, 9) AS dem FROM b_scene_pixel""")
def _dem(b):
    return b.scene_pixel.select("city", "scene_id", "prow", "pcol", F.round(C.dem_norm(F.col("dem")), 9).alias("dem"))


@query("one_hot_landuse", "SELECT city, scene_id, prow, pcol, " + ", ".join(
    f"CASE WHEN landuse = {k} THEN 1 ELSE 0 END AS lu{k}" for k in range(8)) + " FROM b_scene_pixel")
def _one_hot(b):
    hot = b.scene_pixel.withColumn("hot", C.one_hot_landuse(F.col("landuse")))
    return hot.select("city", "scene_id", "prow", "pcol",
                      *[F.col("hot")[k].cast("int").alias(f"lu{k}") for k in range(8)])


@query("reflectance_to_byte", """
SELECT city, scene_id, prow, pcol,
       CAST(floor(least(greatest(CAST(red AS DOUBLE), 0), 3000) / 3000 * 255) AS BIGINT) AS red,
       CAST(floor(least(greatest(CAST(green AS DOUBLE), 0), 3000) / 3000 * 255) AS BIGINT) AS green,
       CAST(floor(least(greatest(CAST(blue AS DOUBLE), 0), 3000) / 3000 * 255) AS BIGINT) AS blue
FROM b_scene_pixel""")
def _bytes(b):
    return b.scene_pixel.select("city", "scene_id", "prow", "pcol", *[
        C.reflectance_to_byte(F.col(c).cast("double")).alias(c) for c in C.CHANNELS])


@query("ndvi", """
SELECT city, scene_id, prow, pcol, coalesce(round((CAST(blue AS DOUBLE) - red) / nullif(blue + red, 0), 9), -9) AS ndvi
FROM b_scene_pixel""")
def _ndvi(b):
    index = C.ndvi(F.col("blue").cast("double"), F.col("red").cast("double"))
    return b.scene_pixel.select("city", "scene_id", "prow", "pcol",
                                F.coalesce(F.round(index, 9), F.lit(-9.0)).alias("ndvi"))


@query("imagenet_norm", """
SELECT city, scene_id, prow, pcol, round((red / 4000.0E0 - 0.485E0) / 0.229E0, 9) AS red,
       round((green / 4000.0E0 - 0.456E0) / 0.224E0, 9) AS green, round((blue / 4000.0E0 - 0.406E0) / 0.225E0, 9) AS blue,
       dem FROM b_scene_pixel""")
def _imagenet(b):
    return b.scene_pixel.select("city", "scene_id", "prow", "pcol", *[
        F.round(C.imagenet_norm(F.col(c) / 4000.0, c), 9).alias(c) for c in C.CHANNELS],
        C.imagenet_norm(F.col("dem"), "dem").alias("dem"))


@query("percent_error", "SELECT sid, round(100 * abs(pred - target) / greatest(target, 1), 6) AS pct FROM b_pred")
def _percent(b):
    return b.pred.select("sid", F.round(C.percent_error(F.col("pred"), F.col("target")), 6).alias("pct"))


@query("huber_loss", """
SELECT sid, round(CASE WHEN d <= 1 THEN d * d / 2 ELSE d - 0.5E0 END, 9) AS huber
FROM (SELECT sid, abs(pred - target) / 20000 AS d FROM b_pred)""")
def _huber(b):
    scaled = [F.col(c) / 20000 for c in ("pred", "target")]
    return b.pred.select("sid", F.round(C.huber_loss(*scaled), 9).alias("huber"))


@query("default_features", """
SELECT vec_id, CAST(i - 1 AS INT) AS idx, CASE WHEN label % 2 = 0 THEN round(CAST(embedding[i] AS DOUBLE), 9) ELSE 0 END AS value
FROM embeddings, (SELECT range AS i FROM range(1, 65)) r""")
def _defaults(b):
    # even labels have a complete list, odd ones are short or null
    vectors = b.base("embeddings").withColumn("d", F.col("embedding").cast("array<double>"))
    given = (F.when(F.col("label") % 2 == 0, F.col("d")).when(F.col("label") % 4 == 1, F.slice("d", 1, 7)))
    full = vectors.withColumn("f", C.default_features(given, 64))
    return full.select("vec_id", F.posexplode("f").alias("idx", "_v")).select("vec_id", "idx", F.round("_v", 9).alias("value"))


@query("web_mercator", f"""
SELECT pid, round(6378137.0E0 * radians(lon), 4) AS mx,
       round(6378137.0E0 * ln(tan({math.pi / 4!r} + radians(lat) / 2)), 4) AS my FROM b_point""")
def _mercator(b):
    mx, my = P.web_mercator(F.col("lon"), F.col("lat"))
    return b.point.select("pid", F.round(mx, 4).alias("mx"), F.round(my, 4).alias("my"))


def _utm_sql() -> str:
    radius, alpha = P.krueger_series()
    n = P.FLATTENING / (2 - P.FLATTENING)
    e = 2 * math.sqrt(n) / (1 + n)
    east = "eta" + "".join(f" + {a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    north = "xi" + "".join(f" + {a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    return f"""
SELECT pid, zone, round(500000 + 0.9996E0 * {radius!r} * ({east}), 4) AS easting,
       round(0.9996E0 * {radius!r} * ({north}), 4) AS northing
FROM (SELECT pid, zone, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta
FROM (SELECT pid, zone, radians(lon - (zone * 6 - 183)) AS dl,
             sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) AS t
FROM b_point JOIN (SELECT city, CAST(floor(((min(lon) + max(lon)) / 2 + 180) / 6) + 1 AS BIGINT) AS zone
                   FROM b_point GROUP BY city) z USING (city)))"""


@query("utm_project", _utm_sql())
def _utm(b):
    return grid.utm_project(b.point).select("pid", "zone", F.round("easting", 4).alias("easting"),
                                            F.round("northing", 4).alias("northing"))


META = "SELECT city, 20 AS height, 20 AS width FROM b_scene_pixel GROUP BY city"


def raster_size(pixels):
    """Size of each city raster, from its pixels, with a 500 m north-up affine."""
    return (pixels.groupBy("city")
            .agg((F.max("prow") + 1).cast("bigint").alias("height"), (F.max("pcol") + 1).cast("bigint").alias("width"))
            .select("city", "height", "width", F.lit(500.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"),
                    F.lit(0.0).alias("d"), F.lit(-500.0).alias("e"), F.lit(10000.0).alias("f")))


def raster_meta(b):
    return raster_size(b.scene_pixel)


_META = {"meta": """SELECT city, CAST(max(prow) + 1 AS BIGINT) AS height, CAST(max(pcol) + 1 AS BIGINT) AS width
FROM b_scene_pixel GROUP BY city"""}


@query("pixel_of", """
SELECT pid, prow, pcol, least(greatest(prow - 2, 0), height - 4) AS row_start,
       least(greatest(pcol - 2, 0), width - 4) AS col_start
FROM (SELECT pid, height, width, CAST(floor((10000 - y) / 500) AS BIGINT) AS prow,
             CAST(floor(x / 500) AS BIGINT) AS pcol FROM b_point JOIN meta USING (city))""", _META)
def _pixel_of(b):
    found = P.pixel_of(b.point.select("pid", "city", "x", "y"), raster_meta(b), 4)
    return found.select("pid", "prow", "pcol", "row_start", "col_start")


@query("sliding_windows", """
SELECT city, gi, gj, 2 + gi * 2 AS prow, 2 + gj * 2 AS pcol FROM meta,
  (SELECT range AS gi FROM range(100)) r, (SELECT range AS gj FROM range(100)) c
WHERE 2 + gi * 2 < height - 2 AND 2 + gj * 2 < width - 2""", _META)
def _windows(b):
    return grid.sliding_windows(raster_meta(b), 4, 2)


_BOUNDS = {"box": """SELECT city, min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat
FROM b_point GROUP BY city"""}


@query("total_bounds", """
SELECT city, round(min_lon, 9) AS min_lon, round(max_lon, 9) AS max_lon,
       round(min_lat, 9) AS min_lat, round(max_lat, 9) AS max_lat FROM box""", _BOUNDS)
def _bounds(b):
    return grid.total_bounds(b.point).select("city", *[
        F.round(c, 9).alias(c) for c in ("min_lon", "max_lon", "min_lat", "max_lat")])


@query("adaptive_grid", """
SELECT city, gi, gj, round(min_lon + gi * sx, 7) AS lon, round(min_lat + gj * sy, 7) AS lat
FROM (SELECT *, step / per_lon AS sx, step / 111320.0E0 AS sy FROM (
  SELECT *, CASE WHEN area / (450 * 450) < 2000 THEN sqrt(area / 2000) ELSE 450 END AS step FROM (
    SELECT *, (max_lon - min_lon) * per_lon * (max_lat - min_lat) * 111320.0E0 AS area FROM (
      SELECT *, cos(radians((min_lat + max_lat) / 2)) * 40075000.0E0 / 360 AS per_lon FROM box)))),
  (SELECT range AS gi FROM range(1000)) r, (SELECT range AS gj FROM range(1000)) c
WHERE gi < ceil((max_lon - min_lon) / sx) AND gj < ceil((max_lat - min_lat) / sy)""", _BOUNDS)
def _grid(b):
    cells = grid.adaptive_grid(grid.total_bounds(b.point))
    return cells.select("city", "gi", "gj", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query("tile_centres", """
SELECT city, gi, gj, round(min_lon + gi * sx, 7) AS lon, round(min_lat + gj * sy, 7) AS lat
FROM (SELECT *, 2900 / (cos(radians((min_lat + max_lat) / 2)) * 111320.0E0) AS sx, 2900 / 111320.0E0 AS sy FROM box),
  (SELECT range AS gi FROM range(1000)) r, (SELECT range AS gj FROM range(1000)) c
WHERE gi < ceil((max_lon - min_lon) / sx) AND gj < ceil((max_lat - min_lat) / sy)""", _BOUNDS)
def _tiles(b):
    tiles = grid.tile_centres(grid.total_bounds(b.point))
    return tiles.select("city", "gi", "gj", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))
