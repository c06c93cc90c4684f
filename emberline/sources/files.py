"""Files: detection CSV, plant registries, map extracts (XML, PBF, JSON) and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from emberline.schemas import RAW_DETECTION, TAGS
from emberline.sources.pbf import read_pbf

# Columns of the two registries.
WRI_COLUMNS = ("country", "name", "gppd_idnr", "capacity_mw", "latitude", "longitude", "primary_fuel", "commissioning_year", "owner", "wepp_id", "url")
OSMPP_COLUMNS = ("id", "Name", "Country", "Fueltype", "Technology", "Capacity", "DateIn", "lat", "lon")


def detections_of_lines(lines: DataFrame) -> DataFrame:
    """Detections out of lines (value, path) of headed CSV files, all columns as text.

    Columns are found by the names in each line's own file, so files may differ in which they have and in
    what order. Lines of a file without a header have nulls everywhere: they are invalid, not lost.
    """
    width = 64
    text = F.regexp_replace("value", "^\ufeff|\r$", "")
    cells = F.from_csv(text, ", ".join(f"c{k} string" for k in range(width)))
    rows = lines.filter(F.trim(text) != "").select("path", F.array(*[F.trim(cells[f"c{k}"]) for k in range(width)]).alias("cells"))
    rows = rows.withColumn("head", F.arrays_overlap("cells", F.array(F.lit("acq_date"))) & F.array_contains("cells", "latitude") & F.array_contains("cells", "longitude"))
    heads = rows.filter("head").groupBy("path").agg(F.min("cells").alias("names"))
    named = rows.filter("NOT coalesce(head, false)").join(heads, "path", "left")
    return named.select(*[F.get("cells", F.nullif(F.array_position("names", f.name), F.lit(0)).cast("int") - 1).alias(f.name) for f in RAW_DETECTION])


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by the names in each file's header; a file of a header alone has no rows."""
    return detections_of_lines(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")))


def _registry(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8")
    plain = {c.lstrip("﻿"): c for c in raw.columns}
    return raw.select(*[(F.col(f"`{plain[c]}`").alias(c) if c in plain else F.lit(None).cast("string").alias(c)) for c in columns])


def read_wri(spark: SparkSession, path: str) -> DataFrame:
    return _registry(spark, path, WRI_COLUMNS)


def read_osm_powerplants(spark: SparkSession, path: str) -> DataFrame:
    return _registry(spark, path, OSMPP_COLUMNS)


def _attribute(name: str) -> str:
    return f"_{name}"


_TAG = ArrayType(StructType([StructField("_k", StringType()), StructField("_v", StringType())]))


def _tag_map(column: str = "tag"):
    pairs = F.transform(F.coalesce(F.col(column), F.array().cast(_TAG)), lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["key"].isNotNull()))


def read_osm_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, lat, lon, tags; ways: id, refs, tags). Nodes with unreadable places are left out."""
    node = StructType([StructField("_id", LongType()), StructField("_lat", StringType()), StructField("_lon", StringType()), StructField("tag", _TAG)])
    way = StructType([StructField("_id", LongType()), StructField("nd", ArrayType(StructType([StructField("_ref", LongType())]))), StructField("tag", _TAG)])
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    lat, lon = F.col("_lat").try_cast("double"), F.col("_lon").try_cast("double")
    nodes = read("node", node).filter(F.col("_id").isNotNull() & lat.isNotNull() & lon.isNotNull()).select(F.col("_id").alias("id"), lat.alias("lat"), lon.alias("lon"), _tag_map().alias("tags"))
    refs = F.transform(F.coalesce(F.col("nd"), F.array().cast(way["nd"].dataType)), lambda n: n["_ref"])
    ways = read("way", way).filter(F.col("_id").isNotNull()).select(F.col("_id").alias("id"), refs.alias("refs"), _tag_map().alias("tags"))
    return nodes, ways


def read_extract(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of a map extract by the end of its name."""
    if path.endswith(".pbf"):
        return read_pbf(spark, path)
    if path.endswith((".osm", ".xml")):
        return read_osm_xml(spark, path)
    raise ValueError(f"neither .pbf nor .osm nor .xml: {path}")


_POINT = StructType([StructField("lat", DoubleType()), StructField("lon", DoubleType())])
MAP_ANSWER = StructType([StructField("elements", ArrayType(StructType([
    StructField("type", StringType()), StructField("id", LongType()), StructField("lat", DoubleType()), StructField("lon", DoubleType()),
    StructField("geometry", ArrayType(_POINT)), StructField("tags", TAGS),
])))])


def map_elements(answers: DataFrame, column: str = "value") -> DataFrame:
    """(osm_type, osm_id, lat, lon, points, tags) of map-query answers as JSON text, one row an element."""
    e = answers.select(F.explode(F.from_json(F.col(column), MAP_ANSWER)["elements"]).alias("e"))
    points = F.transform("e.geometry", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    rows = e.select(F.col("e.type").alias("osm_type"), F.col("e.id").alias("osm_id"), "e.lat", "e.lon", points.alias("points"), F.coalesce("e.tags", F.create_map().cast(TAGS)).alias("tags"))
    return rows.dropDuplicates(["osm_type", "osm_id"])


def read_map_json(spark: SparkSession, path: str) -> DataFrame:
    return map_elements(spark.read.text(path, wholetext=True))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
