"""Density metrics and neighbourhood features of sample points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavement.functions import geometry as G
from pavement.operators.spatial import disc_sums

# Radii in metres and the order of the neighbourhood features.
DENSITY_RADIUS = 250.0
FEATURE_RADIUS = 1120.0
POI_TAGS = ("amenity", "shop", "leisure", "tourism", "office")
POLYGON_TYPES = ("Polygon", "MultiPolygon")
FEATURES = (
    "road_length", "road_count", "road_density",
    "node_count", "intersection_count",
    "building_count", "building_area", "building_coverage",
    "poi_count", "amenity_count", "shop_count", "leisure_count", "tourism_count", "office_count",
    "stop_count",
)


def polygons_only(df: DataFrame, column: str = "geom_type") -> DataFrame:
    return df.where(F.col(column).isin(*POLYGON_TYPES))


def shaped(df: DataFrame) -> DataFrame:
    """Polygons with all their rings in ``rings`` and their area in ``_area``.

    A layer with multi-part polygons has them in ``parts`` (rings per part); the
    rings of all parts together bound the same points, the areas of parts add up.
    """
    area = G.polygon_area(F.col("rings"))
    if "parts" not in df.columns:
        return df.withColumn("_area", area)
    return df.withColumns({"rings": F.coalesce(F.flatten("parts"), F.col("rings")),
                           "_area": F.when(F.col("parts").isNull(), area).otherwise(G.parts_area(F.col("parts")))})


def _points_and_areas(df: DataFrame, keys, measures: dict[str, Column]) -> list[tuple]:
    """A layer of points, or of points and areas (where ``rings`` or ``parts`` is set), as layers of one kind each."""
    if "rings" not in df.columns and "parts" not in df.columns:
        return [(df, "points", ["x", "y"], measures)]
    whole = shaped(df if "rings" in df.columns else df.withColumn("rings", F.flatten("parts")))
    out = [(whole.where(F.size("rings") > 0), "polygons", ["rings"], measures)]
    if "x" in df.columns:
        out.append((whole.where(~F.coalesce(F.size("rings") > 0, F.lit(False))), "points", ["x", "y"], measures))
    return out


def _line_columns(df: DataFrame) -> list[str]:
    return ["path"] if "path" in df.columns else ["x1", "y1", "x2", "y2"]


def line_length(df: DataFrame) -> Column:
    """Recorded length if the layer has one (nulls add nothing), else the geometric length."""
    if "length_m" in df.columns:
        return F.col("length_m")
    if "path" in df.columns:
        return G.path_length(F.col("path"))
    return F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))


def density_metrics(centres: DataFrame, roads: DataFrame, buildings: DataFrame, pois: DataFrame,
                    r: float = DENSITY_RADIUS, keys=("city",), centre_id: str = "pid") -> DataFrame:
    """Road length and building area per square metre, and the number of POIs, within ``r``.

    Whole features count as soon as they meet the disc; the POI figure is a count.
    POIs are points, areas (``rings``, ``parts``) or both; empty geometries meet nothing.
    """
    sums = disc_sums(centres, [
        (roads, "lines", _line_columns(roads), {"_road": line_length(roads)}),
        (shaped(polygons_only(buildings)), "polygons", ["rings"], {"_built": F.col("_area")}),
        *_points_and_areas(pois, keys, {"_poi": F.lit(1)}),
    ], r, keys, centre_id)
    area = math.pi * r * r
    return sums.select(
        *keys, centre_id,
        (F.col("_road") / area).alias("road_density"),
        (F.col("_built") / area).alias("building_density"),
        F.col("_poi").alias("poi_density"),
    )


def _tag_flag(pois: DataFrame, tag: str) -> Column:
    """1 where the POI carries the tag: a column of that name, or a single ``tag`` column."""
    if tag in pois.columns:
        return F.col(tag).isNotNull().cast("int")
    if "tag" in pois.columns:
        return (F.col("tag") == tag).cast("int")
    return F.lit(0)


def osm_features_15(centres: DataFrame, layers: dict[str, DataFrame], r: float = FEATURE_RADIUS,
                    keys=("city",), centre_id: str = "pid") -> DataFrame:
    """The fifteen neighbourhood features of every centre, one column each, in fixed order.

    The three point layers share one join; a node layer without ``street_count``
    takes half its nodes as intersections.
    """
    roads, buildings = layers["road_edges"], layers["buildings"]
    nodes, pois, stops = layers["road_nodes"], layers["pois"], layers["transport"]
    junction = ((F.col("street_count") >= 3).cast("double") if "street_count" in nodes.columns
                else F.lit(0.5))
    flags = {
        "node_count": (nodes, F.lit(1.0)), "intersection_count": (nodes, junction),
        "poi_count": (pois, F.lit(1.0)),
        **{f"{t}_count": (pois, _tag_flag(pois, t).cast("double")) for t in POI_TAGS},
        "stop_count": (stops, F.lit(1.0)),
    }
    points = None
    areas = []
    for layer in (nodes, pois, stops):
        mine = {name: flag for name, (owner, flag) in flags.items() if owner is layer}
        *shapes, (plain, *_) = _points_and_areas(layer, keys, mine)
        areas += shapes
        if "x" not in layer.columns:
            areas.append((plain, "polygons", ["rings"], mine))
            continue
        part = plain.select(*keys, "x", "y", *[
            (flag if owner is layer else F.lit(0.0)).alias(name) for name, (owner, flag) in flags.items()])
        points = part if points is None else points.unionByName(part)
    built = F.when(F.col("geom_type").isin(*POLYGON_TYPES), F.col("_area")).otherwise(0.0)
    sums = disc_sums(centres, [
        (roads, "lines", _line_columns(roads), {"road_length": line_length(roads), "road_count": F.lit(1.0)}),
        (shaped(buildings), "polygons", ["rings"], {"building_count": F.lit(1.0), "building_area": built}),
        (points, "points", ["x", "y"], {name: F.col(name) for name in flags}),
        *areas,
    ], r, keys, centre_id)
    area = math.pi * r * r
    return (sums.withColumns({"road_density": F.col("road_length") / area,
                              "building_coverage": F.col("building_area") / area})
            .select(*keys, centre_id, *FEATURES))


def feature_array(df: DataFrame, out: str = "osm_features") -> DataFrame:
    """Pack the feature columns into one array in the fixed order."""
    rest = [c for c in df.columns if c not in FEATURES]
    return df.select(*rest, F.array(*FEATURES).alias(out))
