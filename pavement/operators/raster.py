"""Scene catalogue search, composites and pixel statistics over pixel tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavement.functions import scaling as C
from pavement.plans.storage import join_side, written

# Scene classes that hide the ground, the cloud limit, the imagery
# season per country and the default season, the dark-pixel rule.
MASKED_CLASSES = (0, 1, 3, 8, 9, 10, 11)
MAX_CLOUD = 95
COLLECTION = "sentinel-2-l2a"
SEASONS = {
    "Italy": "2023-06-01/2023-09-01", "Denmark": "2023-06-01/2023-09-01", "Norway": "2023-06-01/2023-09-01",
    "Finland": "2022-06-01/2022-09-01", "Netherlands": "2022-06-01/2022-09-01",
    "Austria": "2020-06-01/2020-09-01", "Belgium": "2020-06-01/2020-09-01", "France": "2020-06-01/2020-09-01",
    "Greece": "2020-06-01/2020-09-01", "Sweden": "2020-06-01/2020-09-01",
    "United Kingdom": "2020-06-01/2020-09-01",
    "Portugal": "2018-06-01/2018-09-01", "Switzerland": "2018-06-01/2018-09-01",
}
DEFAULT_SEASON = "2023-06-01/2023-09-01"
LIT_ABOVE, LIT_COUNT = 0.01, 100


def census_window(country: Column, seasons: dict[str, str] | None = None,
                  default: str = DEFAULT_SEASON) -> tuple[Column, Column]:
    """First and last day of the imagery season of a country (a literal map, no join)."""
    table = F.create_map(*[F.lit(v) for pair in (seasons or SEASONS).items() for v in pair])
    ends = F.split(F.coalesce(F.try_element_at(table, country), F.lit(default)), "/")
    return F.to_date(ends[0]), F.to_date(ends[1])


def _box_cells(df: DataFrame, side: float, tag: str) -> DataFrame:
    """One row per grid cell the box touches, with the box's first cell."""
    lo = [F.floor(F.col(f"{tag}min_{a}") / side) for a in ("lon", "lat")]
    hi = [F.floor(F.col(f"{tag}max_{a}") / side) for a in ("lon", "lat")]
    return (df.withColumns({f"{tag}i0": lo[0], f"{tag}j0": lo[1]})
            .withColumn("_ci", F.explode(F.sequence(lo[0], hi[0])))
            .withColumn("_cj", F.explode(F.sequence(lo[1], hi[1]))))


def scene_search(scenes: DataFrame, boxes: DataFrame, max_cloud: float = MAX_CLOUD,
                 collection: str = COLLECTION, key: str = "city", cell_deg: float = 1.0) -> DataFrame:
    """Scenes of the collection that overlap each box, in its season, under the cloud limit.

    Both sides meet on grid cells; a pair that shares several cells counts in the
    first of them only. ``boxes`` needs start and end dates; the first and last of
    all are looked up while the plan is built and bound the scan of the scenes.
    """
    edges = [f"{end}_{axis}" for end in ("min", "max") for axis in ("lon", "lat")]
    wanted = scenes.where((F.col("collection") == collection) & (F.col("cloud_cover") < max_cloud))
    first, last = boxes.agg(F.to_date(F.min("start")), F.date_add(F.to_date(F.max("end")), 1)).first()
    if first is not None and last is not None:
        kind = scenes.schema["ts"].dataType  # plain bounds on the stored column reach the files
        wanted = wanted.where((F.col("ts") >= F.lit(first).cast(kind)) & (F.col("ts") < F.lit(last).cast(kind)))
    left = _box_cells(wanted.select("scene_id", "ts", "cloud_cover", *[F.col(e).alias(f"s_{e}") for e in edges]), cell_deg, "s_")
    right = _box_cells(boxes.select(key, "start", "end", *[F.col(e).alias(f"b_{e}") for e in edges]), cell_deg, "b_")
    overlap = ((F.col("s_min_lon") <= F.col("b_max_lon")) & (F.col("s_max_lon") >= F.col("b_min_lon"))
               & (F.col("s_min_lat") <= F.col("b_max_lat")) & (F.col("s_max_lat") >= F.col("b_min_lat")))
    once = (F.col("_ci") == F.greatest("s_i0", "b_i0")) & (F.col("_cj") == F.greatest("s_j0", "b_j0"))
    # the end of a season is a day, and the whole of that day belongs to it
    dated = F.to_date("ts").between(F.col("start"), F.col("end"))
    return left.join(right, ["_ci", "_cj"]).where(overlap & once & dated).select(key, "scene_id", "ts", "cloud_cover")


def clear_pixels(df: DataFrame) -> DataFrame:
    return df.where(~F.col("scl").isin(*MASKED_CLASSES))


def solar_day(ts: Column, lon: Column) -> Column:
    """Calendar day in local solar time: fifteen degrees of longitude to the hour."""
    return F.to_date(F.timestamp_seconds(F.unix_timestamp(ts) + F.floor(lon * 240)))


def solar_day_mosaic(pixels: DataFrame, keys=("city",), bands=("red", "green", "blue", "scl")) -> DataFrame:
    """Scenes of one day merged into one layer: per band the first scene with a non-zero value."""
    first = [F.coalesce(F.min(F.when(F.col(b) != 0, F.struct("scene_id", F.col(b).alias("v"))))["v"],
                        F.lit(0).cast("bigint")).alias(b) for b in bands]
    return pixels.groupBy(*keys, "solar_day", "prow", "pcol").agg(*first)


def median_composite(layers: DataFrame, keys=("city",)) -> DataFrame:
    """Per pixel and band the median over clear layers; 0 where no layer is clear.

    ``median`` keeps counts per distinct value and the values are 16-bit codes, so
    its state is bounded however many layers a pixel has.
    """
    clear = ~F.col("scl").isin(*MASKED_CLASSES)
    return layers.groupBy(*keys, "prow", "pcol").agg(*[
        F.coalesce(F.median(F.when(clear, F.col(b))), F.lit(0.0)).alias(b) for b in C.CHANNELS])


def lit_pixels(pixels: DataFrame, key: str = "city", bands=C.CHANNELS) -> DataFrame:
    """Per city and channel: pixels, lit pixels, and mean and deviation over the lit ones,
    or over all when fewer than a hundred are lit. One pass, one row per city and channel."""
    aggs = []
    for b in bands:
        v = F.col(b)
        lit = v > LIT_ABOVE
        n_lit = F.count_if(lit)
        aggs.append(F.struct(
            F.lit(b).alias("channel"), F.count(v).alias("n"), n_lit.alias("n_lit"),
            F.when(n_lit >= LIT_COUNT, F.avg(F.when(lit, v))).otherwise(F.avg(v)).alias("mean"),
            F.when(n_lit >= LIT_COUNT, F.stddev_pop(F.when(lit, v))).otherwise(F.stddev_pop(v)).alias("std"),
        ).alias(f"_{b}"))
    wide = pixels.groupBy(key).agg(*aggs)
    return wide.select(key, F.inline(F.array(*[F.col(f"_{b}") for b in bands])))


def city_rgb_stats(pixels: DataFrame, cities: DataFrame, key: str = "city") -> DataFrame:
    """Colour statistics of every city; ImageNet constants for a city without pixels."""
    table = F.array(*[F.struct(F.lit(b).alias("channel"), F.lit(C.IMAGENET_MEAN[b]).alias("_m"),
                               F.lit(C.IMAGENET_STD[b]).alias("_s")) for b in C.CHANNELS])
    wanted = cities.select(key, F.inline(table))
    return join_side(wanted, lit_pixels(pixels, key), [key, "channel"]).select(
        key, "channel", F.coalesce("mean", "_m").alias("mean"),
        F.coalesce(F.greatest("std", F.lit(C.STD_FLOOR)), "_s").alias("std"))


def rgb_city_prewarp(pixels: DataFrame, stats: DataFrame, key: str = "city") -> DataFrame:
    """Colours in [0, 1] warped so that ImageNet normalisation becomes a z-score within the city."""
    wide = stats.groupBy(key).agg(*[
        F.max(F.when(F.col("channel") == b, F.col(v))).alias(f"_{b}_{v}") for b in C.CHANNELS for v in ("mean", "std")])
    return join_side(pixels, wide, [key]).select(*[
        C.city_prewarp(F.col(c), c, F.col(f"_{c}_mean"), F.col(f"_{c}_std")).alias(c) if c in C.CHANNELS else F.col(c)
        for c in pixels.columns])


def percentile_stretch(pixels: DataFrame, key: str = "city", bands=C.CHANNELS) -> DataFrame:
    """Each channel scaled between its 2nd and 98th percentile in the city and clipped to [0, 1].

    Pixel values are 8- or 16-bit codes, which bounds the state of the exact percentile.
    """
    cuts = pixels.groupBy(key).agg(*[F.percentile(b, F.array(F.lit(0.02), F.lit(0.98))).alias(f"_{b}") for b in bands])

    def stretched(b: str) -> Column:
        low, high = F.col(f"_{b}")[0], F.col(f"_{b}")[1]
        return C.clip((F.col(b) - low) / (high - low + 1e-8), 0.0, 1.0).alias(b)

    return join_side(pixels, cuts, [key]).select(*[stretched(c) if c in bands else F.col(c) for c in pixels.columns])


def downsample_mean(pixels: DataFrame, meta: DataFrame, target: int = 512, key: str = "city",
                    bands=C.CHANNELS) -> DataFrame:
    """Block means, so that the short side of each raster comes to about ``target`` pixels.

    Only whole blocks count: the rows and columns left over at the far edges are dropped.
    """
    scale = F.greatest(F.lit(1), F.floor(F.least("height", "width") / F.lit(target)))
    whole = [(F.floor(F.col(side) / scale) * scale).alias(f"_{side}") for side in ("height", "width")]
    sized = (join_side(pixels, meta.select(key, scale.alias("_k"), *whole), [key], "inner")
             .where((F.col("prow") < F.col("_height")) & (F.col("pcol") < F.col("_width"))))
    return sized.groupBy(key, F.floor(F.col("prow") / F.col("_k")).alias("prow"),
                         F.floor(F.col("pcol") / F.col("_k")).alias("pcol")).agg(*[F.avg(b).alias(b) for b in bands])


def quartile_mean_tile(pixels: DataFrame, pools: DataFrame, id_: str, bands=C.CHANNELS) -> DataFrame:
    """Pixelwise mean tile of each pool of samples. ``pixels`` is one row per (sample, row, col)."""
    return join_side(pixels, pools.select(id_, "pool"), [id_], "inner").groupBy("pool", "prow", "pcol").agg(
        *[F.avg(b).alias(b) for b in bands])


def _axis_weights(meta: DataFrame, key: str, length: str, cells: str, sigma: float, at: str, cell: str) -> DataFrame:
    """Weight of every grid line for every pixel line: bilinear zoom followed by Gaussian
    smoothing with mirrored borders, both of which act on one axis at a time."""
    reach = int(4 * sigma + 0.5)
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    weights = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w / sum(kernel)).alias("w"))
                        for k, w in zip(range(-reach, reach + 1), kernel)])
    period = F.pmod(F.col("_p") + F.col("_o.k"), 2 * F.col(length))
    mirrored = F.when(period >= F.col(length), 2 * F.col(length) - 1 - period).otherwise(period)
    position = mirrored * (F.col(cells) - 1) / F.greatest(F.col(length) - 1, F.lit(1))
    lower = F.least(F.floor("_z"), F.col(cells) - 1)
    sides = F.array(F.struct(lower.alias("c"), (1 - (F.col("_z") - lower)).alias("b")),
                    F.struct(F.least(lower + 1, F.col(cells) - 1).alias("c"), (F.col("_z") - lower).alias("b")))
    return (
        meta.select(key, length, cells)
        .withColumn("_p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(length) - 1)))
        .withColumn("_o", F.explode(weights)).withColumn("_z", position).withColumn("_s", F.explode(sides))
        .groupBy(key, F.col("_p").alias(at), F.col("_s.c").alias(cell))
        .agg(F.sum(F.col("_o.w") * F.col("_s.b")).alias("_w")).where(F.col("_w") != 0)
    )


def smooth_grid(grid: DataFrame, meta: DataFrame, sigma: float, key: str = "city", value: str = "pred",
                top: float = C.LABEL_MAX) -> DataFrame:
    """Prediction grid to full raster size: bilinear zoom, Gaussian smoothing, clip.

    Both act on rows and columns separately, so this is two sparse matrix products,
    each one equi-join and one sum: columns first, then rows. ``meta`` has height,
    width, and the grid size ``n_gi, n_gj``.
    """
    across = written(_axis_weights(meta, key, "width", "n_gj", sigma, "pcol", "gj"))
    down = written(_axis_weights(meta, key, "height", "n_gi", sigma, "prow", "gi"))
    wide = (grid.join(across, [key, "gj"]).groupBy(key, "gi", "pcol")
            .agg(F.sum(F.col(value) * F.col("_w")).alias("_v")))
    # every pixel has a zero, so that those out of reach of any grid cell are there as well
    lattice = (meta.select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("height") - 1)).alias("prow"), "width")
               .select(key, "prow", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("width") - 1)).alias("pcol"),
                       F.lit(0.0).alias("_v")))
    full = (wide.join(down, [key, "gi"]).select(key, "prow", "pcol", (F.col("_v") * F.col("_w")).alias("_v"))
            .unionByName(lattice).groupBy(key, "prow", "pcol").agg(F.sum("_v").alias("_v")))
    return full.select(key, "prow", "pcol", C.clip(F.col("_v"), 0.0, top).alias(value))


def augmented_tiles(tiles: DataFrame, crop: int, jitter: int, copies: int = 1, seed: int = 42,
                    id_: str = "sample_id", band: str = "tile") -> DataFrame:
    """Augmented copies of each padded tile: a jittered crop, flips and quarter turns.

    ``band`` is an array of rows. The draws are hashes of (id, copy, seed), so a
    rerun, or a lost executor, gives the same copies.
    """
    def chance(n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64(F.col(id_), F.col("copy"), F.lit(seed), F.lit(salt)), F.lit(n)).cast("int")

    def quarter(rows: Column) -> Column:  # anticlockwise: last column becomes the first row
        return F.transform(F.sequence(F.lit(1), F.lit(crop)), lambda i: F.transform(
            rows, lambda r: F.element_at(r, (F.lit(crop + 1) - i).cast("int"))))

    out = (tiles.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
           .withColumns({"_r": chance(2 * jitter + 1, 1), "_c": chance(2 * jitter + 1, 2), "_h": chance(2, 3),
                         "_v": chance(2, 4), "_k": chance(4, 5)})
           .withColumn(band, F.transform(F.slice(band, F.col("_r") + 1, F.lit(crop)),
                                         lambda row: F.slice(row, F.col("_c") + 1, F.lit(crop))))
           .withColumn(band, F.when(F.col("_h") == 1, F.transform(band, F.reverse)).otherwise(F.col(band)))
           .withColumn(band, F.when(F.col("_v") == 1, F.reverse(band)).otherwise(F.col(band))))
    for turns in (1, 2, 3):
        out = out.withColumn(band, F.when(F.col("_k") >= turns, quarter(F.col(band))).otherwise(F.col(band)))
    return out.withColumnsRenamed({"_r": "row_offset", "_c": "col_offset", "_h": "flipped_h",
                                   "_v": "flipped_v", "_k": "quarter_turns"})
