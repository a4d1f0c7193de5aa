"""Polygons to raster classes by scan lines.

Every edge is dealt to the lines of pixel centres it crosses; the crossings of one
shape in one line, in order, bound the stretches that lie inside (even-odd rule). No
shape travels with its whole geometry and no pixel is tested against a shape: the work
is one row per edge and line, then one per covered pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavement.functions.geometry import polygon_edges
from pavement.plans.storage import join_side


def _steps(first: Column, last: Column, extent: Column) -> tuple[Column, Column]:
    """A range of lines or columns, one wider on both sides against rounding, inside the raster."""
    return F.greatest(first - 1, F.lit(0)).cast("int"), F.least(last + 1, extent - 1).cast("int")


def rasterise_polygons(shapes: DataFrame, grids: DataFrame, class_: str = "landuse", key: str = "city",
                       priority: str | None = None) -> DataFrame:
    """(key, prow, pcol, class): the class of every pixel whose centre lies in a shape; the others have no row.

    ``shapes`` are polygons with ``rings`` (outer first, then holes) or several ``parts``
    of rings; where both are there, ``parts`` count unless null. ``grids`` hold each
    raster's north-up affine (a, c, e, f), height and width. Centres on an edge belong to
    the shape on their right and above. Where shapes overlap the largest ``priority``
    wins, and of equal ones (or without a priority) the largest class. Copies of a shape
    count once; shapes without a class, rings or grid cover nothing.
    """
    rank = F.col(priority) if priority else F.lit(0)
    parts = F.array("rings")
    if "parts" in shapes.columns:
        parts = F.coalesce(F.col("parts"), parts) if "rings" in shapes.columns else F.col("parts")
    part = (shapes.where(F.col(class_).isNotNull())
            .select(key, F.col(class_).alias("_class"), rank.alias("_rank"), F.explode(parts).alias("_rings"))
            .withColumn("_shape", F.xxhash64("_rings")))
    edges = (part.select(key, "_class", "_rank", "_shape", F.posexplode(polygon_edges(F.col("_rings"))).alias("_i", "_e"))
             .select(key, "_class", "_rank", "_shape", "_i", "_e.*").where("y1 <> y2"))
    placed = join_side(edges, grids.select(key, "a", "c", "e", "f", "height", "width"), [key], "inner")

    line = lambda y: F.floor((y - F.col("f")) / F.col("e") - 0.5)
    low, high = _steps(line(F.greatest("y1", "y2")) + 1, line(F.least("y1", "y2")), F.col("height"))
    y = F.col("f") + (F.col("prow") + 0.5) * F.col("e")
    crossings = (placed.withColumns({"_low": low, "_high": high}).where("_low <= _high")
                 .withColumn("prow", F.explode(F.sequence("_low", "_high")))
                 .where((F.col("y1") > y) != (F.col("y2") > y))
                 .withColumn("_x", F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))))
    # the edge's number keeps two crossings at one place apart and lets those of copies fall together
    lines = (crossings.groupBy(key, "_class", "_rank", "_shape", "prow", "a", "c", "width")
             .agg(F.array_sort(F.collect_set(F.struct("_x", "_i"))).alias("_at")))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("_at") / 2).cast("int") - 1),
                        lambda k: F.struct(F.col("_at")[2 * k]["_x"].alias("x0"), F.col("_at")[2 * k + 1]["_x"].alias("x1")))
    stretches = (lines.where(F.size("_at") >= 2).select(key, "_class", "_rank", "prow", "a", "c", "width", F.explode(pairs).alias("_p"))
                 .select(key, "_class", "_rank", "prow", "a", "c", "width", "_p.*"))
    column = lambda x: F.ceil((x - F.col("c")) / F.col("a") - 0.5)
    low, high = _steps(column(F.col("x0")), column(F.col("x1")) - 1, F.col("width"))
    x = F.col("c") + (F.col("pcol") + 0.5) * F.col("a")
    covered = (stretches.withColumns({"_low": low, "_high": high}).where("_low <= _high")
               .withColumn("pcol", F.explode(F.sequence("_low", "_high"))).where((x >= F.col("x0")) & (x < F.col("x1"))))
    best = F.max("_class") if priority is None else F.max(F.struct("_rank", "_class"))["_class"]
    return covered.groupBy(key, "prow", "pcol").agg(best.alias(class_))
