"""Declared schemas of all inputs; nothing is inferred."""

from __future__ import annotations

CITY_BOXES = "cities array<struct<city:string, bbox:array<array<double>>>>"

SAMPLES = """city string, cluster int, lat double, lon double, road_density double, building_density double,
poi_density double, walking_isochrone struct<type:string, coordinates:string>, population_15min_walk double,
approximation_meters double, start_point struct<lat:double, lng:double>, error string, osm_features string"""

_VERTICES = "array<struct<x:double, y:double>>"
LAYERS = {
    "road_edges": f"city string, oid string, path {_VERTICES}, length_m double",
    "road_nodes": "city string, oid string, x double, y double, street_count int",
    "buildings": f"city string, oid string, geom_type string, rings array<{_VERTICES}>, parts array<array<{_VERTICES}>>",
    "pois": "city string, oid string, x double, y double, amenity string, shop string, leisure string, "
            "tourism string, office string",
    "transport": "city string, oid string, x double, y double",
}

SCENES = ("scene_id string, collection string, min_lon double, min_lat double, max_lon double, max_lat double, "
          "ts timestamp, cloud_cover double")

# The reply of the isochrone service; nested geometry stays JSON text, its depth differs by type.
ISOCHRONE = ("features array<struct<properties:struct<name:string, approximation:double>, "
             "geometry:struct<type:string, coordinates:string>>>")

SPLITS = ("train", "val", "test")
_COUNTS = "struct<train:long, val:long, test:long>"
SPLIT = f"seed long, n_cities {_COUNTS}, n_samples {_COUNTS}, train array<string>, val array<string>, test array<string>"

RESULTS = "mae double, rmse double, r2 double, loss double"
