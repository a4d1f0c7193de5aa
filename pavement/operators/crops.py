"""Rasters as tables of square tiles, windows cut from them, and the model's image channels.

A raster is one row per tile: ``(city, ti, tj)`` and, per band, the tile as an array
of rows. A window that is no larger than a tile meets four tiles at most, so a
sample is joined with four rows and never with its pixels; what travels on to the
sample is only the part of each tile that lies in its window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavement.functions import scaling as C

#: The bands of a sample's window, and the channels a model sees: colours, height, one plane per class of land use.
BANDS = ("red", "green", "blue", "dem", "landuse")
CHANNELS = (*C.CHANNELS, "dem", *(f"landuse_{k}" for k in range(C.LANDUSE_CLASSES)))


def raster_tiles(pixels: DataFrame, tile: int, bands=BANDS, key: str = "city") -> DataFrame:
    """Tiles of ``tile`` x ``tile`` values from one row per pixel (``prow``, ``pcol``).

    Pixels that are not there are zero, as is a null value; a pixel that is there
    twice is an error. Tiles without any pixel have no row. The pixels of a tile are
    few (tile squared), and they are added up to an array per tile in one shuffle.
    """
    names = list(bands)

    @F.arrow_udf("struct<" + ",".join(f"{b}:array<array<double>>" for b in names) + ">")
    def filled(pixels_of_tile: pa.Array) -> pa.Array:
        out = {b: [] for b in names}
        for one in pixels_of_tile:
            values = one.values
            at = values.field("at").to_numpy(zero_copy_only=False)
            if len(np.unique(at)) != len(at):
                raise ValueError("a raster has the same pixel twice")
            for b in names:
                flat = np.zeros(tile * tile)
                flat[at] = np.nan_to_num(values.field(b).to_numpy(zero_copy_only=False).astype(float))
                out[b].append(flat.reshape(tile, tile).tolist())
        kind = pa.list_(pa.list_(pa.float64()))
        return pa.StructArray.from_arrays([pa.array(out[b], kind) for b in names], names=names)

    place = (F.pmod("prow", F.lit(tile)) * tile + F.pmod("pcol", F.lit(tile))).cast("int").alias("at")
    grouped = (pixels.groupBy(key, F.floor(F.col("prow") / tile).alias("ti"), F.floor(F.col("pcol") / tile).alias("tj"))
               .agg(F.collect_list(F.struct(place, *[F.col(b).cast("double").alias(b) for b in names])).alias("_pixels")))
    return grouped.select(key, "ti", "tj", filled("_pixels").alias("_tile")).select(key, "ti", "tj", "_tile.*")


def _ordered(pieces: Column, band: str, first: Column, last: Column) -> Column:
    """The window of one band: pieces side by side within a line of tiles, lines below each other."""
    def line(ti: Column) -> Column:
        parts = F.transform(F.filter(pieces, lambda p: p["ti"] == ti), lambda p: p[band])
        return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), parts[0],
                           lambda left, right: F.zip_with(left, right, lambda a, b: F.concat(a, b)))

    return F.flatten(F.transform(F.sequence(first, last), line))


def extract_crops(samples: DataFrame, tiles: DataFrame, size: int, tile: int, bands=BANDS, key: str = "city",
                  id_: str = "sid") -> DataFrame:
    """Each sample with its window of ``size`` x ``size`` values per band (arrays of rows), zero outside the raster.

    ``samples`` carry the first row and column of their window (``row_start``,
    ``col_start``, as ``pixel_of`` gives them; negative where the raster is smaller
    than the window); ``id_`` names a sample once. Windows may be larger than tiles.
    The join is by tile; a tile that very many samples meet is a skewed partition,
    which adaptive execution splits. A sample whose start is null has null windows.

    Windows are far larger than the rows they are cut for, so samples are dealt evenly
    by id first, whatever the files they come from. Where the tiles are few enough to
    be broadcast, that deal serves all steps and no window is shuffled.
    """
    names = list(bands)
    # a number of its own: adaptive execution would pack the narrow rows into a few tasks
    samples = samples.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_)
    lines = {"ti": "row_start", "tj": "col_start"}
    ends = {t: (F.floor(F.col(s) / tile), F.floor((F.col(s) + size - 1) / tile)) for t, s in lines.items()}
    wanted = (samples.where("row_start IS NOT NULL AND col_start IS NOT NULL")
              .select(id_, key, "row_start", "col_start", F.explode(F.sequence(*ends["ti"])).alias("ti"), F.lit(0).alias("_"))
              .select("*", F.explode(F.sequence(*ends["tj"])).alias("tj")).drop("_"))
    met = wanted.join(tiles.select(key, "ti", "tj", *names), [key, "ti", "tj"], "left")

    def stretch(t: str) -> tuple[Column, Column]:
        """First value of the tile that lies in the window (from 1), and how many do."""
        start = F.col(lines[t]) - F.col(t) * tile
        low, high = F.greatest(start, F.lit(0)), F.least(start + size, F.lit(tile))
        return (low + 1).cast("int"), (high - low).cast("int")

    (r, n_r), (c, n_c) = stretch("ti"), stretch("tj")
    pieces = met.select(id_, F.struct("ti", "tj", *[
        F.coalesce(F.transform(F.slice(F.col(b), r, n_r), lambda row: F.slice(row, c, n_c)),
                   F.array_repeat(F.array_repeat(F.lit(0.0), n_c), n_r)).alias(b) for b in names]).alias("_piece"))
    whole = pieces.groupBy(id_).agg(F.array_sort(F.collect_list("_piece")).alias("_pieces"))
    first, last = F.col("_pieces")[0]["ti"], F.element_at("_pieces", -1)["ti"]
    windows = whole.select(id_, *[_ordered(F.col("_pieces"), b, first, last).alias(b) for b in names])
    return samples.join(windows, id_, "left")


def channel_shape(size: int) -> list[int]:
    """Shape of what ``model_channels`` makes."""
    return [len(CHANNELS), size, size]


def model_channels(crops: DataFrame, normalise: bool = False, out: str = "image") -> DataFrame:
    """The windows as one flat array of shape ``channel_shape(size)``, channel by channel, row by row.

    Colours (bytes) come to [0, 1], with ``normalise`` also by the ImageNet means and
    deviations; heights to [0, 1] over their fixed range; land use as one plane of 0
    and 1 per class, all zero for other classes. Null windows give null.
    """
    def colour(c: str):
        return lambda v: C.imagenet_norm(v / 255.0, c) if normalise else v / 255.0

    def of_class(k: int):
        return lambda v: (v == F.lit(float(k))).cast("double")

    planes = [F.transform(F.flatten(c), colour(c)) for c in C.CHANNELS]
    planes.append(F.transform(F.flatten("dem"), C.dem_norm))
    planes += [F.transform(F.flatten("landuse"), of_class(k)) for k in range(C.LANDUSE_CLASSES)]
    return crops.withColumn(out, F.concat(*planes))


def channel_sums(images: DataFrame, size: int, image: str = "image") -> Column:
    """Sum of every channel of a flat image."""
    area = size * size
    return F.array(*[F.aggregate(F.slice(image, k * area + 1, area), F.lit(0.0), lambda a, v: a + v) for k in range(len(CHANNELS))])
