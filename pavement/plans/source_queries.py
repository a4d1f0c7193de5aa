"""Queries of readers, writers and the stream, over files made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pavement.operators import raster as A
from pavement.operators import statistics as S
from pavement.plans.registry import query
from pavement.plans.storage import shared_folder
from pavement.sources import readers, writers
from pavement.streaming import enrich as E


def _place(b) -> str:
    return f"{shared_folder(b.spark).rstrip('/')}/files/{uuid.uuid4().hex}"


def replies(b):
    """One isochrone reply per sample, built from its point: a walk area and, for labelled samples, a start point."""
    rows = b.label.join(b.point.select("pid", F.col("pid").alias("lng"), (F.col("pid") % 90).alias("lat")), "pid")
    area = F.concat(F.lit('{"properties": {"name": "isoline"}, "geometry": {"type": "Polygon", "coordinates": [[['),
                    "lng", F.lit(", "), "lat", F.lit("], ["), "sid", F.lit(", "), "lat", F.lit("]]]}}"))
    start = F.concat(F.lit(', {"properties": {"name": "start point", "approximation": '), "approximation_m",
                     F.lit('}, "geometry": {"type": "Point", "coordinates": ['), "lng", F.lit(", "), "lat", F.lit("]}}"))
    known = F.when(F.col("population").isNotNull(), start).otherwise(F.lit(""))
    return rows.withColumn("reply", F.concat(F.lit('{"features": ['), area, known, F.lit("]}")))


@query("parse_isochrone", """
SELECT sid, 'Polygon' AS kind, CASE WHEN population IS NULL THEN -1 ELSE approximation_m END AS approximation,
       CASE WHEN population IS NULL THEN -1 ELSE CAST(pid % 90 AS DOUBLE) END AS lat,
       CASE WHEN population IS NULL THEN -1 ELSE CAST(pid AS DOUBLE) END AS lng FROM b_label""")
def _parse(b):
    out = readers.parse_isochrone(replies(b), "reply")
    return out.select("sid", F.col("walking_isochrone.type").alias("kind"),
                      F.coalesce("approximation_meters", F.lit(-1.0)).alias("approximation"),
                      F.coalesce("start_point.lat", F.lit(-1.0)).alias("lat"),
                      F.coalesce("start_point.lng", F.lit(-1.0)).alias("lng"))


@query("polygon_to_text", """
SELECT sid, concat(pid % 90, ' ', pid, ',', pid % 90, ' ', sid) AS polygon FROM b_label""")
def _polygon(b):
    return readers.polygon_to_text(readers.parse_isochrone(replies(b), "reply")).select("sid", "polygon")


@query("sample_coords", """
SELECT sid, CASE WHEN l.population IS NULL THEN p.lat ELSE l.pid % 90 END AS lat,
       CASE WHEN l.population IS NULL THEN p.lon ELSE l.pid END AS lon FROM b_label l JOIN b_point p ON l.pid = p.pid""")
def _coords(b):
    placed = readers.parse_isochrone(replies(b), "reply").select("sid", "pid", "start_point")
    return S.sample_coords(placed.join(b.point.select("pid", "lat", "lon"), "pid")).select("sid", "lat", "lon")


@query("read_city_boxes", """
SELECT city, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM b_point GROUP BY city""")
def _boxes(b):
    path = _place(b)
    ends = b.point.groupBy("city").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    corners = F.array(*[F.array(y, x) for y, x in (("y0", "x0"), ("y0", "x1"), ("y1", "x1"), ("y1", "x0"))])
    # a document holds many cities; one document per country here
    boxes = ends.select("city", corners.alias("bbox"), F.element_at(F.split("city", ", "), -1).alias("country"))
    (boxes.groupBy("country").agg(F.collect_list(F.struct("city", "bbox")).alias("cities"))
     .repartition(8, "country").write.option("maxRecordsPerFile", 1).json(path))
    return readers.read_city_boxes(b.spark, path)


@query("read_samples", """
SELECT city, cluster, population AS population_15min_walk, approximation_m AS approximation_meters FROM b_label WHERE population IS NOT NULL""")
def _samples(b):
    path = _place(b)
    b.label.select("city", "cluster", F.col("population").alias("population_15min_walk"),
                   F.col("approximation_m").alias("approximation_meters")).write.json(path)
    return readers.read_samples(b.spark, path, layout="lines").select("city", "cluster", "population_15min_walk", "approximation_meters")


@query("write_samples", "SELECT sid, city, cluster FROM b_label")
def _write_samples(b):
    path = _place(b)
    rows = b.label.select("sid", "city", "cluster")
    writers.write_samples(rows, path)
    writers.write_samples(rows, path)  # a rerun must not duplicate a city
    return b.spark.read.schema(rows.schema).parquet(path).select("sid", "city", "cluster")


@query("read_layers", "SELECT oid, city, x, y FROM b_stop WHERE city = (SELECT min(city) FROM b_stop)")
def _layers(b):
    path = _place(b)
    writers.write_layer(b.stop.withColumn("oid", F.col("oid").cast("string")), path, "transport")
    first = b.stop.agg(F.min("city")).first()[0]
    return readers.read_layers(b.spark, path, first, "transport").select(
        F.col("oid").cast("bigint").alias("oid"), "city", "x", "y")


@query("write_training_table", """
SELECT sid, city, CASE cluster WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM b_label""")
def _write_training(b):
    path = _place(b)
    split = F.when(F.col("cluster") == 0, "val").when(F.col("cluster") == 1, "test").otherwise("train")
    writers.write_training_table(b.label.select("sid", "city", split.alias("split")),
                                 {"city_stats": S.city_target_stats(b.label)}, path)
    return b.spark.read.schema("sid long, city string, split string").parquet(f"{path}/samples")


@query("write_report", "SELECT city, count(*) AS n, round(sum(population), 2) AS total FROM b_label WHERE population IS NOT NULL GROUP BY city")
def _report(b):
    path = _place(b)
    writers.write_report(S.labelled_only(b.label).groupBy("city").agg(
        F.count("*").alias("n"), F.round(F.sum("population"), 2).alias("total")), path)
    return b.spark.read.schema("city string, n long, total double").json(path)


@query("incremental_enrich", """
SELECT event_id AS id, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_totalprice ELSE -1 END AS population,
       CASE WHEN o_orderstatus IN ('F', 'O') THEN '' ELSE 'Failed to get population' END AS error
FROM events LEFT JOIN orders ON event_id = o_orderkey""")
def _stream(b):
    """The events arrive as a stream of files and again when the label table has grown: failed ones are tried again."""
    path = _place(b)
    points = b.base("events").select(F.col("event_id").alias("id"))

    for known in (["F"], ["F", "O"]):
        labels = (b.base("orders").where(F.col("o_orderstatus").isin(known))
                  .select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("population")))

        def enrich(batch, labels=labels):
            joined = batch.join(labels, "id", "left")
            return joined.withColumn("error", F.when(F.col("population").isNull(), "Failed to get population"))

        points.write.mode("append").parquet(f"{path}/in")
        stream = b.spark.readStream.schema("id long").parquet(f"{path}/in")
        E.incremental_enrich(stream, enrich, f"{path}/out", f"{path}/state").awaitTermination()
    done = E.enriched(b.spark, f"{path}/out", "id long, population double, error string")
    return done.select("id", F.coalesce("population", F.lit(-1.0)).alias("population"), F.coalesce("error", F.lit("")).alias("error"))


@query("augmented_tiles")
def _tiles(b):
    """The 64 values of each vector as a padded 8 x 8 tile, two 4 x 4 copies each."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", (i * 8 + 1).cast("int"), F.lit(8)))
    tiles = b.base("embeddings").select(F.col("vec_id").alias("sample_id"), rows.alias("tile"))
    out = A.augmented_tiles(tiles, 4, 2, copies=2)
    return out.select("sample_id", "copy", F.posexplode(F.flatten("tile")).alias("pixel", "value"))
