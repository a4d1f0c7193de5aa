"""Readers of city boxes, samples, map layers and service replies."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pavement.functions.text import coordinate_text
from pavement.operators.density import FEATURES
from pavement.sources import schemas


def read_city_boxes(spark: SparkSession, path: str) -> DataFrame:
    """City document to one row per city with its extent; corners are (lat, lon)."""
    cities = spark.read.schema(schemas.CITY_BOXES).json(path, multiLine=True).select(F.inline("cities"))
    lat, lon = F.transform("bbox", lambda corner: corner[0]), F.transform("bbox", lambda corner: corner[1])
    return cities.select("city", F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"),
                         F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat"))


def read_samples(spark: SparkSession, path: str, labelled: bool = True, cities: list[str] | None = None,
                 layout: str = "array", features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Sample records with optional label and city filters.

    ``layout`` says what every file of ``path`` is: one JSON ``array``, or
    ``lines`` with one record each. A record that does not parse, or a file of
    the other layout, stops the read. Features come as a list of numbers or as an
    object, whose values are taken by the names of ``features``, in that order and
    whatever the order in the file; a name that is not there gives null, and one
    that is not among them stops the read. One JSON array cannot be split and is one task; a large table should come as Parquet
    (``write_samples``) or as lines.
    """
    if layout not in ("array", "lines"):
        raise ValueError(f"layout is array or lines, not {layout}")
    rows = spark.read.schema(schemas.SAMPLES).json(path, multiLine=layout == "array", mode="FAILFAST")
    # the parser would keep the first record of a file of the other layout and skip the rest in silence
    begins = F.regexp_replace("value", r"^\s+", "").startswith("[")
    other = (spark.read.text(path, wholetext=True).where(~begins & (F.trim("value") != "")) if layout == "array"
             else spark.read.text(path).where(begins))
    if not other.limit(1).isEmpty():
        raise ValueError(f"{path} holds a file whose layout is not {layout}")
    text = F.col("osm_features")
    named = F.from_json(text, "map<string,double>")
    unknown = F.array_except(F.map_keys(named), F.array(*map(F.lit, features)))
    message = F.concat(F.lit("osm_features has names that are not among the features: "), F.array_join(unknown, ", "))
    by_name = F.when(F.size(unknown) > 0, F.raise_error(message).cast("array<double>")).otherwise(
        F.array(*[F.try_element_at(named, F.lit(n)) for n in features]))
    rows = rows.withColumn("osm_features", F.when(text.startswith("["), F.from_json(text, "array<double>"))
                           .when(text.startswith("{"), by_name))
    if labelled:
        rows = rows.where(F.col("population_15min_walk").isNotNull())
    if cities is not None:
        rows = rows.where(F.col("city").isin(*cities))
    return rows


def read_layers(spark: SparkSession, root: str, city: str, layer: str) -> DataFrame:
    """One map layer of one city; an absent layer or city is an empty frame with the right columns."""
    schema = schemas.LAYERS[layer]
    try:
        table = spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{layer}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], schema)
    return table.where(F.col("city") == city)


def _found(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """JSON documents, one per file; None if there is none."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """A split document to one row per city: (city, split, n_cities, n_samples), the counts being those of its split.

    A missing document is an error; a city that the document holds in two splits comes twice (``split_audit`` finds it).
    """
    document = spark.read.schema(schemas.SPLIT).json(path, multiLine=True, mode="FAILFAST")
    rows = F.flatten(F.array(*[F.transform(F.coalesce(F.col(s), F.array().cast("array<string>")), lambda c: F.struct(  # noqa: B023
        c.alias("city"), F.lit(s).alias("split"), F.col(f"n_cities.{s}").alias("n_cities"), F.col(f"n_samples.{s}").alias("n_samples")))
        for s in schemas.SPLITS]))
    return document.select(F.inline(rows))


def read_results(spark: SparkSession, root: str, files: str = "*/test_results.json") -> DataFrame:
    """(run, metric, value) of all finished runs below ``root``, for ``run_comparison``.

    A run is a folder (``name`` or ``run=name``) with one result document; metrics a
    document lacks have no row. Without any document the frame is empty.
    """
    documents = _found(spark, f"{root.rstrip('/')}/{files}", schemas.RESULTS)
    if documents is None:
        return spark.createDataFrame([], "run string, metric string, value double")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    run = F.regexp_replace(F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))), "^run=", "")
    metrics = documents.columns
    return (documents.select(run.alias("run"), *metrics).unpivot("run", metrics, "metric", "value")
            .where(F.col("value").isNotNull()))


def parse_isochrone(df: DataFrame, json_col: str) -> DataFrame:
    """Walk area, street distance and start point from a service reply; the last match of each wins.

    A bad reply, or one without the feature, gives nulls.
    """
    features = F.from_json(F.col(json_col), schemas.ISOCHRONE)["features"]

    def last(name: str, *also):
        def keep(f):
            test = f["properties"]["name"] == name
            for condition in also:
                test = test & condition(f)
            return test
        found = F.filter(features, keep)
        return F.get(found, F.size(found) - 1)

    area, start = last("isoline"), last("start point")
    placed = last("start point", lambda f: F.size(F.from_json(f["geometry"]["coordinates"], "array<double>")) > 1)
    at = F.from_json(placed["geometry"]["coordinates"], "array<double>")
    return df.withColumns({
        "walking_isochrone": area["geometry"],
        "approximation_meters": start["properties"]["approximation"],
        "start_point": F.when(at.isNotNull(), F.struct(F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lng"))),
    })


def polygon_to_text(df: DataFrame, geometry: str = "walking_isochrone", out: str = "polygon") -> DataFrame:
    return df.withColumn(out, coordinate_text(F.col(f"{geometry}.type"), F.col(f"{geometry}.coordinates")))
