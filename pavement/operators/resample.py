"""Rasters brought to another grid by bilinear interpolation, tile by tile.

A tile of the target needs one window of the source, a pixel wider than what it
covers. Windows are put together from the source's tiles (``extract_crops``), so
neighbouring tiles see the same pixels along their seam and no pixel is ever a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavement.operators.crops import extract_crops
from pavement.plans.storage import join_side


def _along(window: np.ndarray, at: np.ndarray, start: int, extent: int) -> np.ndarray:
    """``window`` interpolated along its first axis at positions ``at`` of the whole raster, which has ``extent`` lines."""
    at = np.clip(at, 0, extent - 1)
    low = np.floor(at).astype(int)
    share = (at - low)[:, None]
    high = np.minimum(low + 1, extent - 1)
    return window[low - start] * (1 - share) + window[high - start] * share


def _interpolated(tile: int):
    @F.arrow_udf("array<array<double>>")
    def make(windows: pa.Array, rows: pa.Array, columns: pa.Array) -> pa.Array:
        out = []
        for window, row, column in zip(windows, rows.to_pylist(), columns.to_pylist()):
            values = np.array(window.as_py())
            lines = []
            for axis in (row, column):
                at = axis["at"] + np.arange(axis["n"]) * axis["step"]
                lines.append(at)
                values = _along(values, at, axis["start"], axis["extent"]).T
            # half a pixel around the outer centres still is the raster, what lies beyond is not
            known = [(at >= -0.5) & (at <= axis["extent"] - 0.5) for at, axis in zip(lines, (row, column))]
            whole = np.zeros((tile, tile))
            whole[:row["n"], :column["n"]] = np.where(known[0][:, None] & known[1], values, 0.0)
            out.append(whole.tolist())
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    return make


def resample_raster(tiles: DataFrame, source: DataFrame, target: DataFrame, tile: int, bands=("dem",), key: str = "city") -> DataFrame:
    """The tiles (key, ti, tj, bands) of the ``target`` grids, values bilinear between the centres of the source's pixels.

    ``tiles`` are those of ``raster_tiles`` with the same ``tile``; ``source`` and
    ``target`` hold one north-up affine per key (a, c, e, f) with height and width, in
    one coordinate system. Centres within half a pixel of the source's edge take the
    edge's values; what lies beyond the source is zero, as is what lies beyond the
    target in its last tiles. Keys without a source grid have no tiles. The largest
    ratio of pixel sizes is looked up while the plan is built; one that is far from
    1 should come in steps, as a window is that much larger than a tile.
    """
    grid = ["a", "c", "e", "f", "height", "width"]
    both = join_side(target.select(key, *grid), source.select(key, *[F.col(g).alias(f"s_{g}") for g in grid]), [key], "inner")
    ratio = both.agg(F.max(F.greatest(F.col("a") / F.col("s_a"), F.col("e") / F.col("s_e")))).first()[0]
    size = math.ceil((tile - 1) * (ratio or 1)) + 2
    count = lambda extent: F.ceil(F.col(extent) / tile).cast("int")
    wanted = (both.where("height > 0 AND width > 0 AND s_height > 0 AND s_width > 0")
              .withColumn("_ti", F.explode(F.sequence(F.lit(0), count("height") - 1)))
              .withColumn("_tj", F.explode(F.sequence(F.lit(0), count("width") - 1))))

    def axis(t: str, step: str, origin: str, extent: str) -> Column:
        """Where the tile's first centre lies among the source's, how far the next is, and which window that needs."""
        first = F.col(origin) + (F.col(t) * tile + 0.5) * F.col(step)
        at = (first - F.col(f"s_{origin}")) / F.col(f"s_{step}") - 0.5
        start = F.floor(F.least(F.greatest(at, F.lit(0.0)), F.col(f"s_{extent}") - F.lit(1.0))).cast("int")
        return F.struct(at.alias("at"), (F.col(step) / F.col(f"s_{step}")).alias("step"), start.alias("start"),
                        F.col(f"s_{extent}").cast("int").alias("extent"),
                        F.least(F.lit(tile), F.col(extent) - F.col(t) * tile).cast("int").alias("n"))

    wanted = wanted.select(key, "_ti", "_tj", F.to_json(F.struct(F.col(key), "_ti", "_tj")).alias("_tile"),
                           axis("_ti", "e", "f", "height").alias("_row"), axis("_tj", "a", "c", "width").alias("_column"))
    windows = extract_crops(wanted.withColumns({"row_start": F.col("_row.start"), "col_start": F.col("_column.start")}),
                            tiles, size, tile, bands, key, "_tile")
    make = _interpolated(tile)
    return windows.select(key, F.col("_ti").alias("ti"), F.col("_tj").alias("tj"), *[make(b, "_row", "_column").alias(b) for b in bands])
