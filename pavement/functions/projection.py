"""Map projections and raster addressing as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavement.plans.storage import join_side

# WGS84 ellipsoid, spherical Mercator radius, UTM scale and offsets.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
FALSE_EASTING, FALSE_NORTHING = 500_000.0, 10_000_000.0


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude / latitude in degrees to EPSG:3857 metres."""
    return (SEMI_MAJOR * F.radians(lon),
            SEMI_MAJOR * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)))


def krueger_series() -> tuple[float, list[float]]:
    """Rectifying radius and the four series coefficients of the transverse Mercator projection."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    return radius, [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]


def utm_zone(lon: Column) -> Column:
    return F.least(F.floor((lon + 180) / 6) + 1, F.lit(60).cast("bigint"))


def utm_xy(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Easting and northing in a given zone (Krueger series, order four)."""
    radius, alpha = krueger_series()
    n = FLATTENING / (2 - FLATTENING)
    e = 2 * math.sqrt(n) / (1 + n)
    sin_lat = F.sin(F.radians(lat))
    from_axis = F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(sin_lat) - e * F.atanh(e * sin_lat))
    xi = F.atan2(t, F.cos(from_axis))
    eta = F.atanh(F.sin(from_axis) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    offset = F.when(south, FALSE_NORTHING).otherwise(0.0)
    return FALSE_EASTING + UTM_SCALE * radius * east, UTM_SCALE * radius * north + offset


def pixel_of(points: DataFrame, meta: DataFrame, size: int, key: str = "city") -> DataFrame:
    """Row and column of each point in its city's raster, and the start of a window around it.

    ``meta`` holds the affine (a, b, c, d, e, f), height and width; the points are in
    the raster's own coordinates. The window start is kept inside the raster.
    """
    det = F.col("a") * F.col("e") - F.col("b") * F.col("d")
    dx, dy = F.col("x") - F.col("c"), F.col("y") - F.col("f")
    half = size // 2

    def start(at: str, extent: str) -> Column:
        return F.least(F.greatest(F.col(at) - half, F.lit(0)), F.col(extent) - size)

    return (
        join_side(points, meta, [key], "inner")
        .withColumns({"pcol": F.floor((F.col("e") * dx - F.col("b") * dy) / det),
                      "prow": F.floor((F.col("a") * dy - F.col("d") * dx) / det)})
        .withColumns({"row_start": start("prow", "height"), "col_start": start("pcol", "width")})
        .select(*points.columns, "prow", "pcol", "row_start", "col_start")
    )
