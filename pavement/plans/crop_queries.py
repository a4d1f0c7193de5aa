"""Queries of windows cut from rasters and of the channels a model sees."""

from __future__ import annotations

from pyspark.sql import functions as F

from pavement.functions import projection as P
from pavement.operators import crops as K
from pavement.operators import learning as L
from pavement.operators.resample import resample_raster
from pavement.plans.registry import query
from pavement.plans.scalar_queries import raster_meta, raster_size
from pavement.plans.storage import written

SIZE, TILE = 6, 5

# every pixel of a city's raster once; the window of a point, around its pixel and inside the raster; its pixels
_WINDOW = {
    "raster": """SELECT city, prow, pcol, CAST(max(red) % 256 AS DOUBLE) AS red, CAST(max(green) % 256 AS DOUBLE) AS green,
  CAST(max(blue) % 256 AS DOUBLE) AS blue, max(dem) AS dem, CAST(max(landuse) AS DOUBLE) AS landuse FROM b_scene_pixel GROUP BY city, prow, pcol""",
    "meta": "SELECT city, CAST(max(prow) + 1 AS BIGINT) AS height, CAST(max(pcol) + 1 AS BIGINT) AS width FROM b_scene_pixel GROUP BY city",
    "win": f"""SELECT pid, city, least(greatest(CAST(floor((10000 - y) / 500) AS BIGINT) - {SIZE // 2}, 0), height - {SIZE}) AS r0,
  least(greatest(CAST(floor(x / 500) AS BIGINT) - {SIZE // 2}, 0), width - {SIZE}) AS c0 FROM b_point JOIN meta USING (city)""",
    "px": f"""SELECT w.pid, i.range * {SIZE} + j.range AS cell, {", ".join(f"coalesce({b}, 0) AS {b}" for b in K.BANDS)}
FROM win w CROSS JOIN range({SIZE}) i CROSS JOIN range({SIZE}) j
LEFT JOIN raster r ON r.city = w.city AND r.prow = r0 + i.range AND r.pcol = c0 + j.range""",
}


def raster(b):
    """One value per pixel and band: the largest over all scenes; colours as bytes."""
    top = {c: (F.max(c) % 256) for c in ("red", "green", "blue")} | {c: F.max(c) for c in ("dem", "landuse")}
    return b.scene_pixel.groupBy("city", "prow", "pcol").agg(*[v.cast("double").alias(c) for c, v in top.items()])


def crops(b):
    # one scan of the scenes: the raster has the pixels of all of them, so its size is theirs
    pixels = written(raster(b))
    starts = P.pixel_of(b.point.select("pid", "city", "x", "y"), raster_size(pixels), SIZE)
    tiles = written(K.raster_tiles(pixels, TILE))
    return K.extract_crops(starts.select("pid", "city", "row_start", "col_start"), tiles, SIZE, TILE, id_="pid")


@query("extract_crops", "SELECT pid, " + ", ".join(
    f"string_agg(CAST(CAST({b} AS BIGINT) AS VARCHAR), ',' ORDER BY cell) AS {b}" for b in K.BANDS) + " FROM px GROUP BY pid", _WINDOW)
def _crops(b):
    return crops(b).select("pid", *[F.array_join(F.transform(F.flatten(c), lambda v: v.cast("long").cast("string")), ",").alias(c)
                                    for c in K.BANDS])


_SUMS = [f"round(sum({c} / 255), 6)" for c in ("red", "green", "blue")] + [
    "round(sum((least(greatest(dem, -50), 3000) + 50) / 3050), 6)"] + [
    f"CAST(count(*) FILTER (WHERE landuse = {k}) AS DOUBLE)" for k in range(8)]


@query("model_channels", "SELECT pid, " + ", ".join(f"{v} AS {c}" for c, v in zip(K.CHANNELS, _SUMS)) + " FROM px GROUP BY pid", _WINDOW)
def _channels(b):
    images = K.model_channels(crops(b))
    sums = images.select("pid", K.channel_sums(images, SIZE).alias("s"))
    return sums.select("pid", *[F.round(F.col("s")[k], 6).alias(c) for k, c in enumerate(K.CHANNELS)])


def bright_and_built():
    """A scoring function over whole tensors: mean colour plus the share of the last class in the middle of the window."""
    middle = slice(SIZE // 2 - 1, SIZE // 2 + 1)
    return lambda batch: batch[:, :3].mean(axis=(1, 2, 3)) + batch[:, -1, middle, middle].mean(axis=(1, 2))


@query("score_channels", f"""SELECT pid, round(sum(red + green + blue) / 255 / {3 * SIZE * SIZE}
  + count(*) FILTER (WHERE landuse = 7 AND cell // {SIZE} IN ({SIZE // 2 - 1}, {SIZE // 2}) AND cell % {SIZE} IN ({SIZE // 2 - 1}, {SIZE // 2})) / 4.0E0, 6) AS score
FROM px GROUP BY pid""", _WINDOW)
def _score(b):
    images = K.model_channels(crops(b)).select("pid", "image")
    return L.batch_score(images, bright_and_built, "image", K.channel_shape(SIZE), out="score").select("pid", F.round("score", 6).alias("score"))


FINE, FINE_SIDE = 200, 50

_FINER = {
    "raster": "SELECT city, prow, pcol, max(dem) AS dem FROM b_scene_pixel GROUP BY city, prow, pcol",
    "meta": "SELECT city, CAST(max(prow) + 1 AS BIGINT) AS height, CAST(max(pcol) + 1 AS BIGINT) AS width FROM b_scene_pixel GROUP BY city",
    "place": f"""SELECT city, height, width, i.range AS prow, j.range AS pcol, (i.range + 0.5E0) * {FINE} / 500 - 0.5E0 AS v0, (j.range + 0.5E0) * {FINE} / 500 - 0.5E0 AS u0
FROM meta CROSS JOIN range({FINE_SIDE}) i CROSS JOIN range({FINE_SIDE}) j""",
    "near": "SELECT *, least(greatest(v0, 0), height - 1) AS v, least(greatest(u0, 0), width - 1) AS u FROM place WHERE v0 <= height - 0.5E0 AND u0 <= width - 0.5E0",
    "corner": """SELECT n.city, n.prow, n.pcol, r.dem * (CASE di.range WHEN 0 THEN 1 - (v - floor(v)) ELSE v - floor(v) END)
  * (CASE dj.range WHEN 0 THEN 1 - (u - floor(u)) ELSE u - floor(u) END) AS part
FROM near n CROSS JOIN range(2) di CROSS JOIN range(2) dj
JOIN raster r ON r.city = n.city AND r.prow = least(floor(v) + di.range, height - 1) AND r.pcol = least(floor(u) + dj.range, width - 1)""",
    "summed": "SELECT city, prow, pcol, sum(part) AS dem FROM corner GROUP BY city, prow, pcol",
}


@query("resample_raster", "SELECT city, prow, pcol, round(coalesce(dem, 0), 4) AS dem FROM place LEFT JOIN summed USING (city, prow, pcol)", _FINER)
def _resample(b):
    """The heights of every city on a finer grid, from 500 m to 200 m."""
    meta = raster_meta(b)
    fine = meta.select("city", F.lit(float(FINE)).alias("a"), "c", F.lit(-float(FINE)).alias("e"), "f",
                       F.lit(FINE_SIDE).alias("height"), F.lit(FINE_SIDE).alias("width"))
    tiles = written(K.raster_tiles(raster(b).select("city", "prow", "pcol", "dem"), TILE, ("dem",)))
    made = resample_raster(tiles, meta, fine, TILE)
    values = (made.select("city", "ti", "tj", F.posexplode("dem").alias("i", "line"))
              .select("city", "tj", (F.col("ti") * TILE + F.col("i")).cast("long").alias("prow"), F.posexplode("line").alias("j", "dem")))
    return values.select("city", "prow", (F.col("tj") * TILE + F.col("j")).cast("long").alias("pcol"), F.round("dem", 4).alias("dem"))
