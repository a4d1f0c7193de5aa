"""Queries of simplified street graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pavement.operators import streets as G
from pavement.plans.registry import query
from pavement.plans.sample_queries import rounded

# the orders as road pieces between 601 nodes a city; every third comes from a second tile, the other way round
_ROADS = """SELECT city, o_custkey * 7 % 601 AS u, o_orderkey * 31 % 601 AS v, o_orderkey AS way, CAST(o_totalprice AS DOUBLE) AS length_m
FROM orders JOIN b_city ON (o_orderkey + o_custkey) % 25 = city_id"""

#: Degree, chains from every junction, and rings, by walking edge by edge.
_WALKS = {
    "piece": f"SELECT city, least(u, v) AS a, greatest(u, v) AS b, way, min(length_m) AS len FROM ({_ROADS}) GROUP BY ALL",
    "half": "SELECT city, a AS s, b AS e, way, len, 0 AS d FROM piece UNION ALL SELECT city, b AS s, a AS e, way, len, 1 AS d FROM piece",
    "inner_": """SELECT city, s AS node FROM half GROUP BY city, s
HAVING count(*) = 2 AND count(DISTINCT CASE WHEN e <> s THEN e END) = 2""",
    "walk": """SELECT h.city, h.s AS f, h.way AS w0, h.d AS d0, h.e AS here, h.way AS w, h.d AS d, h.len AS len, CAST(1 AS BIGINT) AS n, h.e AS low,
  i.node IS NOT NULL AS ring FROM half h LEFT JOIN inner_ i ON i.city = h.city AND i.node = h.s
UNION ALL
SELECT k.city, k.f, k.w0, k.d0, h.e, h.way, h.d, k.len + h.len, k.n + 1, least(k.low, h.e), k.ring
FROM walk k JOIN inner_ i ON i.city = k.city AND i.node = k.here JOIN half h ON h.city = k.city AND h.s = k.here AND h.way <> k.w
WHERE NOT (k.ring AND k.here = k.f)""",
    "street": """SELECT k.city, k.f AS from_node, k.here AS to_node, k.len AS length_m, k.n AS n_edges FROM walk k
LEFT JOIN inner_ i ON i.city = k.city AND i.node = k.here
WHERE NOT k.ring AND i.node IS NULL AND (k.n > 1 OR k.d0 = 0) AND (k.n = 1 OR k.f < k.here OR (k.f = k.here AND k.w0 < k.w))
UNION ALL SELECT city, f, here, len / 2, n FROM (SELECT city, f, here, sum(len) AS len, min(n) AS n FROM walk WHERE ring AND here = f AND low = f GROUP BY city, f, here)""",
}


def roads(b):
    found = b.sql(_ROADS)
    second = found.where("way % 3 = 0").select("city", F.col("v").alias("u"), F.col("u").alias("v"), "way", "length_m")
    return found.unionByName(second)


@query("street_graph", """SELECT city, least(from_node, to_node) AS a, greatest(from_node, to_node) AS b, round(length_m, 2) AS length_m, n_edges
FROM street""", _WALKS)
def _streets(b):
    found = G.street_graph(roads(b))
    return rounded(found.select("city", F.least("from_node", "to_node").alias("a"), F.greatest("from_node", "to_node").alias("b"),
                                "length_m", "n_edges"), 2, "length_m")


@query("street_counts", """SELECT city, node, count(*) AS street_count FROM (
  SELECT city, from_node AS node FROM street UNION ALL SELECT city, to_node FROM street) GROUP BY city, node""", _WALKS)
def _counts(b):
    return G.street_counts(G.street_graph(roads(b)))
