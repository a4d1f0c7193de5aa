"""Queries of the distance joins and of what is summed over them.

Their SQL is a plain brute-force join, so it shares no path with the cell join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavement.functions import geometry as G
from pavement.operators import density as D
from pavement.operators import spatial as S
from pavement.plans.bindings import Bindings
from pavement.plans.registry import query
from pavement.plans.storage import written

R, WIDE = 250, 1120


def buildings(b: Bindings) -> DataFrame:
    """The building layer with rings, stored: squares, or a lone vertex for point geometries."""
    cx, cy, h = F.col("cx"), F.col("cy"), F.col("half")
    square = F.array(G.vertex(cx - h, cy - h), G.vertex(cx + h, cy - h),
                     G.vertex(cx + h, cy + h), G.vertex(cx - h, cy + h))
    ring = F.when(F.col("geom_type") == "Point", F.array(G.vertex(cx, cy))).otherwise(square)
    return written(b.building.withColumn("rings", F.array(ring)))


def with_paths(roads: DataFrame) -> DataFrame:
    return roads.withColumn("path", F.array(
        G.vertex(F.col("x1"), F.col("y1")), G.vertex(F.col("x2"), F.col("y2"))))


def paths(b: Bindings) -> DataFrame:
    """The road layer as vertex lists."""
    return with_paths(b.edge)


def layers(b: Bindings) -> dict[str, DataFrame]:
    return {"road_edges": b.edge, "road_nodes": b.node, "buildings": buildings(b),
            "pois": b.poi, "transport": b.stop}


def _segment_sq(px: str, py: str) -> str:
    """SQL for the squared distance of (px, py) to the segment (x1, y1)-(x2, y2)."""
    t = (f"coalesce(least(greatest((({px} - x1) * (x2 - x1) + ({py} - y1) * (y2 - y1))"
         f" / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0), 1), 0)")
    return (f"(({px} - (x1 + {t} * (x2 - x1))) * ({px} - (x1 + {t} * (x2 - x1)))"
            f" + ({py} - (y1 + {t} * (y2 - y1))) * ({py} - (y1 + {t} * (y2 - y1))))")


def _square_sq(px: str, py: str) -> str:
    """SQL for the squared distance of (px, py) to a solid square; a point has half side 0."""
    half = "(CASE WHEN geom_type = 'Point' THEN 0 ELSE half END)"
    dx = f"greatest(abs({px} - cx) - {half}, 0)"
    dy = f"greatest(abs({py} - cy) - {half}, 0)"
    return f"({dx} * {dx} + {dy} * {dy})"


def _pairs(r: int) -> dict[str, str]:
    rr = r * r
    return {
        "lines": f"SELECT p.city, p.pid, f.oid, f.length_m FROM b_point p JOIN b_edge f ON p.city = f.city "
                 f"WHERE {_segment_sq('p.x', 'p.y')} <= {rr}",
        "areas": f"SELECT p.city, p.pid, f.oid, f.geom_type, 4 * f.half * f.half AS area FROM b_point p "
                 f"JOIN b_building f ON p.city = f.city WHERE {_square_sq('p.x', 'p.y')} <= {rr}",
        "spots": f"SELECT p.city, p.pid, f.oid, f.tag FROM b_point p JOIN b_poi f ON p.city = f.city "
                 f"WHERE (p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y) <= {rr}",
        "crossings": f"SELECT p.city, p.pid, f.oid, f.street_count FROM b_point p JOIN b_node f ON p.city = f.city "
                     f"WHERE (p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y) <= {rr}",
        "stops": f"SELECT p.city, p.pid, f.oid FROM b_point p JOIN b_stop f ON p.city = f.city "
                 f"WHERE (p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y) <= {rr}",
    }


def only(r: int, *names: str) -> dict[str, str]:
    return {n: _pairs(r)[n] for n in names}


@query("disc_join_points", "SELECT city, pid, oid, tag FROM spots", only(R, "spots"))
def _points(b):
    return S.disc_join_points(b.point, b.poi, R).select("city", "pid", "oid", "tag")


@query("disc_join_lines", "SELECT city, pid, oid FROM lines", only(WIDE, "lines"))
def _lines(b):
    return S.disc_join_lines(b.point, b.edge, WIDE).select("city", "pid", "oid")


@query("disc_join_polygons", "SELECT city, pid, oid, area FROM areas", only(WIDE, "areas"))
def _polygons(b):
    pairs = S.disc_join_polygons(b.point, buildings(b), WIDE)
    return pairs.select("city", "pid", "oid", (4 * F.col("half") * F.col("half")).alias("area"))


@query("box_candidates", f"""
SELECT p.city, p.pid, f.oid FROM b_point p JOIN b_building f ON p.city = f.city
WHERE f.cx - f.half <= p.x + {WIDE} AND f.cx + f.half >= p.x - {WIDE}
  AND f.cy - f.half <= p.y + {WIDE} AND f.cy + f.half >= p.y - {WIDE}""")
def _candidates(b):
    boxes = b.building.select("city", "oid", *[
        (F.col(f"c{axis}") + sign * F.col("half")).alias(f"{end}_{axis}")
        for axis in "xy" for end, sign in (("min", -1), ("max", 1))])
    return S.box_candidates(b.point, boxes, WIDE).select("city", "pid", "oid")


@query("disc_intersects", f"""
SELECT e.oid, p.pid, {_segment_sq('p.x', 'p.y')} <= {WIDE * WIDE} AS hit
FROM (SELECT *, CAST(split_part(oid, '-', 1) AS BIGINT) AS ord FROM b_edge) e
JOIN orders ON e.ord = o_orderkey JOIN b_point p ON o_custkey = p.pid""")
def _intersects(b):
    # each road segment against the point of the customer of its order
    # the narrow tables meet first and paths are made last, so each segment travels once, as four numbers
    orders = b.base("orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("pid"))
    places = orders.join(b.point.select("pid", "x", "y"), "pid")
    roads = b.edge.select("oid", "x1", "y1", "x2", "y2", F.split("oid", "-")[0].cast("bigint").alias("ord"))
    met = with_paths(roads.join(places, "ord")).select("oid", "pid", "x", "y", "path")
    return S.disc_intersects(met, "lines", "x", "y", WIDE).select("oid", "pid", "hit")


@query("polygons_only", "SELECT oid, city, geom_type FROM b_building WHERE geom_type IN ('Polygon', 'MultiPolygon')")
def _polygons_only(b):
    return D.polygons_only(b.building).select("oid", "city", "geom_type")


@query("line_length", """
SELECT oid, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) AS length FROM b_edge""")
def _length(b):
    return paths(b).select("oid", F.round(G.path_length(F.col("path")), 6).alias("length"))


@query("polygon_area", """
SELECT oid, CASE WHEN geom_type = 'Point' THEN 0 ELSE 4 * half * half END AS area FROM b_building""")
def _area(b):
    return buildings(b).select("oid", F.round(G.polygon_area(F.col("rings")), 4).alias("area"))


@query("zero_fill", """
SELECT p.city, p.pid, CAST(count(s.oid) AS BIGINT) AS n FROM b_point p
LEFT JOIN spots s ON p.pid = s.pid GROUP BY p.city, p.pid""", only(R, "spots"))
def _zero_fill(b):
    counts = S.disc_join_points(b.point, b.poi, R).groupBy("city", "pid").agg(F.count("*").alias("n"))
    return S.zero_fill(b.point.select("city", "pid"), counts, ["city", "pid"])


DENSITY = f"""
SELECT p.city, p.pid,
       coalesce(l.len, 0) / (pi() * {R} * {R}) AS road_density,
       coalesce(a.area, 0) / (pi() * {R} * {R}) AS building_density,
       CAST(coalesce(s.n, 0) AS DOUBLE) AS poi_density
FROM b_point p
LEFT JOIN (SELECT pid, sum(length_m) AS len FROM lines GROUP BY pid) l ON p.pid = l.pid
LEFT JOIN (SELECT pid, sum(area) AS area FROM areas WHERE geom_type = 'Polygon' GROUP BY pid) a ON p.pid = a.pid
LEFT JOIN (SELECT pid, count(*) AS n FROM spots GROUP BY pid) s ON p.pid = s.pid"""
DENSITY_CTES = only(R, "lines", "areas", "spots")


def densities(b: Bindings) -> DataFrame:
    return D.density_metrics(b.point, b.edge, buildings(b), b.poi)


@query("density_metrics", """
SELECT city, pid, round(road_density, 9) AS road_density,
       round(building_density, 9) AS building_density, poi_density FROM density""",
       {**DENSITY_CTES, "density": DENSITY})
def _density(b):
    return densities(b).select("city", "pid", F.round("road_density", 9).alias("road_density"),
                               F.round("building_density", 9).alias("building_density"), "poi_density")


_TAGS = ", ".join(f"count(*) FILTER (WHERE tag = '{t}') AS {t}_count" for t in D.POI_TAGS)
FEATURES_CTES = {
    **_pairs(WIDE),
    "feats": f"""
SELECT p.city, p.pid, coalesce(l.road_length, 0) AS road_length, coalesce(l.road_count, 0) AS road_count,
       coalesce(l.road_length, 0) / (pi() * {WIDE} * {WIDE}) AS road_density,
       coalesce(c.node_count, 0) AS node_count, coalesce(c.intersection_count, 0) AS intersection_count,
       coalesce(a.building_count, 0) AS building_count, coalesce(a.building_area, 0) AS building_area,
       coalesce(a.building_area, 0) / (pi() * {WIDE} * {WIDE}) AS building_coverage,
       coalesce(s.poi_count, 0) AS poi_count, {', '.join(f'coalesce(s.{t}_count, 0) AS {t}_count' for t in D.POI_TAGS)},
       coalesce(t.stop_count, 0) AS stop_count
FROM b_point p
LEFT JOIN (SELECT pid, sum(length_m) AS road_length, count(*) AS road_count FROM lines GROUP BY pid) l ON p.pid = l.pid
LEFT JOIN (SELECT pid, count(*) AS node_count, count(*) FILTER (WHERE street_count >= 3) AS intersection_count
           FROM crossings GROUP BY pid) c ON p.pid = c.pid
LEFT JOIN (SELECT pid, count(*) AS building_count, sum(CASE WHEN geom_type = 'Polygon' THEN area ELSE 0 END) AS building_area
           FROM areas GROUP BY pid) a ON p.pid = a.pid
LEFT JOIN (SELECT pid, count(*) AS poi_count, {_TAGS} FROM spots GROUP BY pid) s ON p.pid = s.pid
LEFT JOIN (SELECT pid, count(*) AS stop_count FROM stops GROUP BY pid) t ON p.pid = t.pid""",
}


def neighbourhoods(b: Bindings) -> DataFrame:
    return D.osm_features_15(b.point, layers(b))


@query("osm_features_15", "SELECT city, pid, " + ", ".join(
    f"round(CAST({f} AS DOUBLE), 6) AS {f}" for f in D.FEATURES) + " FROM feats", FEATURES_CTES)
def _features(b):
    return neighbourhoods(b).select("city", "pid", *[F.round(f, 6).alias(f) for f in D.FEATURES])
