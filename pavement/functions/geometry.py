"""Planar geometry as column expressions.

Points are two columns. A path is ``ARRAY<STRUCT<x, y>>``; a polygon is a list
of rings, the first one outer, the others holes; a multi-part polygon is a list
of polygons. All coordinates are metres.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _edge(a: Column, b: Column) -> Column:
    return F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def path_edges(path: Column) -> Column:
    """Consecutive vertex pairs; a lone vertex gives one edge of length zero."""
    n = F.size(path)
    follow = F.slice(path, F.lit(2), F.greatest(n - 1, F.lit(0)))
    lead = F.slice(path, F.lit(1), F.greatest(n - 1, F.lit(0)))
    pairs = F.zip_with(lead, follow, _edge)
    alone = F.transform(path, lambda v: _edge(v, v))
    return F.when(n == 1, alone).otherwise(pairs)


def ring_edges(ring: Column) -> Column:
    """Edges of a ring, closing it; a lone vertex gives one edge of length zero."""
    turned = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, _edge)


def polygon_edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, ring_edges))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def path_length(path: Column) -> Column:
    return _total(F.transform(path_edges(path), lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])))


def ring_area(ring: Column) -> Column:
    """Shoelace area, orientation ignored."""
    cross = F.transform(ring_edges(ring), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"])
    return F.abs(_total(cross)) / 2.0


def polygon_area(rings: Column) -> Column:
    """Area of the outer ring less the holes; null without a ring."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return ring_area(F.get(rings, F.lit(0))) - _total(F.transform(holes, ring_area))


def parts_area(parts: Column) -> Column:
    return _total(F.transform(parts, polygon_area))


def distance_sq(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return dx * dx + dy * dy


def segment_distance_sq(x, y, x1, y1, x2, y2) -> Column:
    """Squared distance from a point to a segment, which may be a single point."""
    dx, dy = x2 - x1, y2 - y1
    along = ((x - x1) * dx + (y - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.coalesce(F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return distance_sq(x, y, x1 + t * dx, y1 + t * dy)


def segment_hits(x, y, r: float, x1, y1, x2, y2) -> Column:
    return segment_distance_sq(x, y, x1, y1, x2, y2) <= F.lit(float(r) ** 2)


def edges_hit(x, y, r: float, edges: Column) -> Column:
    """Some edge comes within ``r`` of the point."""
    return F.exists(edges, lambda e: segment_hits(x, y, r, e["x1"], e["y1"], e["x2"], e["y2"]))


def inside(x, y, edges: Column) -> Column:
    """Even-odd rule over all rings, so a point in a hole is outside."""

    def crosses(e):
        at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < at)

    return F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def polygon_hits(x, y, r: float, edges: Column) -> Column:
    """The disc meets the polygon: an edge is within ``r`` or the centre is inside."""
    return edges_hit(x, y, r, edges) | inside(x, y, edges)


def reach(edges: Column, x: Column, y: Column) -> Column:
    """Largest distance from an anchor to any vertex of the edges."""
    far = F.transform(edges, lambda e: F.greatest(distance_sq(e["x1"], e["y1"], x, y),
                                                  distance_sq(e["x2"], e["y2"], x, y)))
    return F.sqrt(F.array_max(far))
