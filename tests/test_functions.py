"""Scalar functions on edge-case rows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from pavement.functions import geometry as G
from pavement.functions import scaling as C
from pavement.functions import text as T
from pavement.functions.projection import utm_xy
from pavement.operators.raster import census_window
from pavement.operators.statistics import feature_table, sample_coords
from pavement.sources.readers import parse_isochrone, polygon_to_text


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize("name, key", [
    ("Malmö, Sweden", "malmosweden"), ("Malmö_Sweden_10m.tif", "malmosweden"),
    ("Tromsø_Norway_DEM.tif", "tromsonorway"), ("Liège_Belgium_LandUse.tif", "liegebelgium"),
    ("x.tiff", "xf"), ("Łódź", "łodz")])
def test_city_key(spark, name, key):
    assert one(spark.range(1).select(T.city_key(F.lit(name))))[0] == key


def test_country_and_slug(spark):
    row = one(spark.range(1).select(T.country_of(F.lit("Vila Nova de Gaia, Portugal")), T.country_of(F.lit("Oslo")),
                                    T.slug(F.lit("Vila Nova de Gaia, Portugal"))))
    assert tuple(row) == ("Portugal", "Oslo", "Vila_Nova_de_Gaia_Portugal")


def test_json_value(spark):
    rows = spark.createDataFrame([('{"v": 7}',), ('{"w": 7}',), ('{"v": null}',), ("oops",), ("[1]",), (None,)], "j string")
    assert [r[0] for r in rows.select(T.extract_json_value(F.col("j"), "v")).collect()] == ["7", "0", None, None, None, None]


def test_scaling(spark):
    hot = one(spark.range(1).select(C.one_hot_landuse(F.lit(8)), C.one_hot_landuse(F.lit(2))))
    assert hot[0] == [0] * 8 and hot[1] == [0, 0, 1, 0, 0, 0, 0, 0]
    dem = spark.createDataFrame([(-120.0,), (-50.0,), (3000.0,), (4000.0,)], "d double").select(C.dem_norm(F.col("d")))
    assert [r[0] for r in dem.collect()] == [0, 0, 1, 1]
    byte = spark.createDataFrame([(None,), (3000.0,), (2999.0,), (5000.0,)], "d double").select(C.reflectance_to_byte(F.col("d")))
    assert [r[0] for r in byte.collect()] == [0, 255, 254, 255]
    huber = one(spark.range(1).select(C.huber_loss(F.lit(1.0), F.lit(0.5)), C.huber_loss(F.lit(3.0), F.lit(0.0))))
    assert tuple(huber) == (0.125, 2.5)


def test_label_round_trip(spark):
    values = [0.0, 1.0, 17.5, 79_999.0, 80_000.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    z = C.zscore(C.log_clip(F.col("v")), F.lit(8.0), F.lit(1.7))
    back = [r[0] for r in df.select(C.inverse_target(z, F.lit(8.0), F.lit(1.7))).collect()]
    assert back == pytest.approx(values, rel=1e-9, abs=1e-9)


def test_default_features(spark):
    df = spark.createDataFrame([([1.0] * 15,), ([1.0] * 3,), (None,)], "f array<double>")
    got = [r[0] for r in df.select(C.default_features(F.col("f"))).collect()]
    assert got == [[1.0] * 15, [0.0] * 15, [0.0] * 15]


def test_feature_table(spark):
    named = spark.createDataFrame([(1, {"a": 1.0})], "id int, osm_features map<string,double>")
    assert [tuple(r) for r in feature_table(named, "id").collect()] == [(1, 0, "a", 1.0)]
    listed = spark.createDataFrame([(1, [5.0, 6.0])], "id int, osm_features array<double>")
    assert [r.name for r in feature_table(listed, "id").collect()] == ["osm_feat_00", "osm_feat_01"]


def test_sample_coords(spark):
    df = spark.createDataFrame([(1.0, 2.0, (3.0, 4.0)), (1.0, 2.0, None), (None, None, None)],
                               "lat double, lon double, start_point struct<lat:double,lng:double>")
    assert [(r.lat, r.lon) for r in sample_coords(df).collect()] == [(3.0, 4.0), (1.0, 2.0), (0.0, 0.0)]


def test_areas_and_lengths(spark):
    def ring(*points):
        return F.array(*[G.vertex(F.lit(float(x)), F.lit(float(y))) for x, y in points])

    outer, hole = ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((2, 2), (4, 2), (4, 4), (2, 4), (2, 2))
    row = one(spark.range(1).select(
        G.polygon_area(F.array(outer, hole)), G.parts_area(F.array(F.array(outer), F.array(hole))),
        G.path_length(ring((0, 0), (3, 4), (3, 10))), G.path_length(ring((1, 1)))))
    assert tuple(row) == (96.0, 104.0, 11.0, 0.0)


def test_hole_is_outside(spark):
    def ring(*points):
        return F.array(*[G.vertex(F.lit(float(x)), F.lit(float(y))) for x, y in points])

    rings = F.array(ring((0, 0), (100, 0), (100, 100), (0, 100)), ring((20, 20), (80, 20), (80, 80), (20, 80)))
    edges = G.polygon_edges(rings)
    row = one(spark.range(1).select(*[G.polygon_hits(F.lit(x), F.lit(y), 5, edges)
                                      for x, y in ((50.0, 50.0), (10.0, 10.0), (-4.0, 50.0), (-6.0, 50.0), (24.0, 50.0))]))
    assert tuple(row) == (False, True, True, False, True)


def test_utm_known_point(spark):
    # zone 32 central meridian, and a point east of it
    east, north = utm_xy(F.lit(9.0), F.lit(48.0), F.lit(32), F.lit(False))
    row = one(spark.range(1).select(east, north))
    assert row[0] == pytest.approx(500000.0, abs=1e-6)
    assert row[1] == pytest.approx(5316300, abs=400)
    step = one(spark.range(1).select(*[utm_xy(F.lit(9.0 + d), F.lit(48.0), F.lit(32), F.lit(False))[0] for d in (0.0, 0.001)]))
    metres = math.radians(0.001) * 6378137 / math.sqrt(1 - 0.00669438 * math.sin(math.radians(48)) ** 2) * math.cos(math.radians(48))
    assert step[1] - step[0] == pytest.approx(metres * 0.9996, rel=1e-6)


def test_census_window(spark):
    df = spark.createDataFrame([("Portugal",), ("Finland",), ("Spain",)], "c string")
    first, last = census_window(F.col("c"))
    got = [(str(r[0]), str(r[1])) for r in df.select(first, last).collect()]
    assert got == [("2018-06-01", "2018-09-01"), ("2022-06-01", "2022-09-01"), ("2023-06-01", "2023-09-01")]


def _reply(*features):
    return json.dumps({"features": list(features)})


def test_parse_isochrone_and_polygon_text(spark):
    area = {"properties": {"name": "isoline"}, "geometry": {"type": "Polygon", "coordinates": [[[1.5, 2.5], [3, 4], [1.5, 2.5]]]}}
    multi = {"properties": {"name": "isoline"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[9, 8], [7, 6]]], [[[0, 0]]]]}}
    start = {"properties": {"name": "start point", "approximation": 12.5}, "geometry": {"type": "Point", "coordinates": [10.1, 45.2]}}
    bare = {"properties": {"name": "start point", "approximation": 99.0}}
    rows = [(1, _reply(area, start)), (2, _reply(area, multi, start, bare)), (3, _reply(start)), (4, "not json"), (5, _reply(area))]
    out = polygon_to_text(parse_isochrone(spark.createDataFrame(rows, "i int, j string"), "j")).orderBy("i").collect()
    assert [r.polygon for r in out] == ["2.5 1.5,4 3,2.5 1.5", "8 9,6 7", None, None, "2.5 1.5,4 3,2.5 1.5"]
    assert [r.approximation_meters for r in out] == [12.5, 99.0, 12.5, None, None]
    assert [r.start_point and tuple(r.start_point) for r in out] == [(45.2, 10.1), (45.2, 10.1), (45.2, 10.1), None, None]


def test_polygon_text_other_type(spark):
    df = spark.createDataFrame([("Point", "[1,2]")], "t string, c string")
    assert one(df.select(T.coordinate_text(F.col("t"), F.col("c"))))[0] is None
