"""Views that let the generic test tables stand in for city data.

The same SQL text runs on Spark (through :class:`Bindings`) and, as common
table expressions, in front of every check query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pavement.session import ship

from pavement.plans.storage import written

BASE = ("region nation customer supplier part orders lineitem events "
        "documents embeddings pages benchmark labels conversations").split()

VIEWS: dict[str, str] = {
    "b_city": """
SELECT n_nationkey AS city_id, concat(n_name, ', ', r_name) AS city, r_name AS country
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "b_point": """
SELECT c_custkey AS pid, city, country, CAST(c_custkey % 5 AS INT) AS cluster,
       CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x,
       CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y,
       9.0E0 + ((c_custkey * 7919) % 10007) / 78700.0E0 AS lon,
       45.0E0 + ((c_custkey * 104729) % 10009) / 111320.0E0 AS lat
FROM customer JOIN b_city ON c_nationkey = city_id""",
    "b_label": """
SELECT o_orderkey AS sid, p.city, p.country, CAST((o_orderkey * 31) % 5 AS INT) AS cluster, p.pid,
       CASE WHEN o_orderkey % 14 = 3 THEN NULL ELSE o_totalprice / 5 END AS population,
       CAST((o_orderkey * 17) % 400 AS DOUBLE) AS approximation_m
FROM orders JOIN b_point p ON o_custkey = p.pid""",
    "b_poi": """
SELECT event_id AS oid, city,
       CAST((event_id * 6007) % 10007 AS DOUBLE) AS x, CAST((event_id * 5003) % 10009 AS DOUBLE) AS y,
       CASE event_type WHEN 'click' THEN 'amenity' WHEN 'view' THEN 'shop' WHEN 'error' THEN 'leisure'
                       WHEN 'signup' THEN 'tourism' ELSE 'office' END AS tag
FROM events JOIN b_city ON user_id % 25 = city_id""",
    "b_edge": """
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(l_quantity AS INT), '-', CAST(floor(l_extendedprice) AS BIGINT)) AS oid, city,
       CAST((l_partkey * 6007 + l_orderkey * 31) % 10007 AS DOUBLE) AS x1,
       CAST((l_orderkey * 5003 + l_linenumber * 977) % 10009 AS DOUBLE) AS y1,
       (l_partkey * 6007 + l_orderkey * 31) % 10007 + (l_quantity - 25) * 8 AS x2,
       (l_orderkey * 5003 + l_linenumber * 977) % 10009 + (l_linenumber - 4) * 40E0 AS y2,
       CASE WHEN l_orderkey % 10 = 7 THEN NULL ELSE l_quantity * 9 END AS length_m
FROM lineitem JOIN b_city ON l_suppkey % 25 = city_id""",
    "b_node": """
SELECT o_orderkey AS oid, city, CAST((o_orderkey * 3571) % 10007 AS DOUBLE) AS x,
       CAST((o_orderkey * 9001) % 10009 AS DOUBLE) AS y, CAST(o_orderkey % 6 AS INT) AS street_count
FROM orders JOIN b_city ON o_custkey % 25 = city_id""",
    "b_building": """
SELECT p_partkey AS oid, city, CAST((p_partkey * 4231) % 10007 AS DOUBLE) AS cx,
       CAST((p_partkey * 7793) % 10009 AS DOUBLE) AS cy, CAST(p_size AS DOUBLE) AS half,
       CASE WHEN p_partkey % 9 = 4 THEN 'Point' ELSE 'Polygon' END AS geom_type
FROM part JOIN b_city ON p_partkey % 25 = city_id""",
    "b_stop": """
SELECT s_suppkey AS oid, city, CAST((s_suppkey * 4507) % 10007 AS DOUBLE) AS x,
       CAST((s_suppkey * 3607) % 10009 AS DOUBLE) AS y
FROM supplier JOIN b_city ON s_nationkey = city_id""",
    "b_scene": """
SELECT o_orderkey AS scene_id, country, o_orderdate AS ts, CAST(o_orderkey % 100 AS DOUBLE) AS cloud_cover,
       CASE o_orderstatus WHEN 'F' THEN 'sentinel-2-l2a' WHEN 'O' THEN 'sentinel-2-l1c' ELSE 'other' END AS collection,
       9.0E0 + (o_orderkey % 40) / 100.0E0 AS min_lon, 45.0E0 + (o_orderkey % 30) / 100.0E0 AS min_lat,
       9.1E0 + (o_orderkey % 40) / 100.0E0 AS max_lon, 45.1E0 + (o_orderkey % 30) / 100.0E0 AS max_lat
FROM orders JOIN b_point ON o_custkey = pid""",
    "b_scene_pixel": """
SELECT city, l_orderkey AS scene_id, CAST(l_partkey % 20 AS INT) AS prow,
       CAST((l_partkey * 7 + l_linenumber) % 20 AS INT) AS pcol,
       CAST(floor(l_extendedprice) AS BIGINT) % 4001 AS red, CAST(l_quantity AS BIGINT) * 60 AS green,
       (l_orderkey * 13 + l_partkey) % 3500 AS blue, CAST(l_orderkey % 12 AS INT) AS scl,
       CAST((l_partkey * 11 + l_linenumber) % 8 AS INT) AS landuse, CAST((l_partkey * 37) % 3300 - 120 AS DOUBLE) AS dem
FROM lineitem JOIN b_city ON l_suppkey % 25 = city_id""",
    "b_pred": """
SELECT sid, pid, city, country, cluster, population AS target,
       population * (0.8E0 + (sid % 7) / 15.0E0) + (sid % 11) * 100.0E0 AS pred
FROM b_label WHERE population IS NOT NULL""",
    "b_history": """
SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS epoch,
       value AS val_loss
FROM events""",
}

_WORD = re.compile(r"[A-Za-z_]\w*")


def needed(text: str) -> tuple[list[str], list[str]]:
    """Views and base tables a query text refers to, dependencies first."""
    views: list[str] = []
    base: list[str] = []

    def visit(sql: str) -> None:
        for word in _WORD.findall(sql):
            if word in VIEWS and word not in views:
                visit(VIEWS[word])
                views.append(word)
            elif word in BASE and word not in base:
                base.append(word)

    visit(text)
    return views, base


def with_views(sql: str, more: dict[str, str] | None = None, skip=frozenset()) -> str:
    """Put the views ``sql`` needs in front of it as common table expressions."""
    more = more or {}
    views, _ = needed(" ".join([*more.values(), sql]))
    parts = [f"{v} AS ({VIEWS[v].strip()})" for v in views if v not in skip]
    parts += [f"{name} AS ({text.strip()})" for name, text in more.items()]
    own = any(re.search(rf"\b{name}\b", text) for name, text in more.items())
    return f"WITH {'RECURSIVE ' if own else ''}{', '.join(parts)}\n{sql.strip()}" if parts else sql.strip()


# City tables already written, by application and folder.
_CITIES: dict[tuple[str, str], DataFrame] = {}


class Bindings:
    """The views over one folder of tables, as DataFrames: ``b.point``, ``b.label`` ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = ship(spark)
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def sql(self, text: str) -> DataFrame:
        """Run SQL over the views; the city table is written once, so that joins know its size."""
        views, base = needed(text)
        for name in base:
            self.base(name).createOrReplaceTempView(name)
        skip = set()
        if "b_city" in views:
            self.city.createOrReplaceTempView("b_city")
            skip = {"b_city"}
        return self.spark.sql(with_views(text, skip=skip))

    def base(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @property
    def city(self) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _CITIES:
            for name in ("nation", "region"):
                self.base(name).createOrReplaceTempView(name)
            _CITIES[key] = written(self.spark.sql(VIEWS["b_city"]))
        return _CITIES[key]

    def __getattr__(self, name: str) -> DataFrame:
        if f"b_{name}" not in VIEWS:
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM b_{name}")
