"""Candidates for enrichment and the pruning of detections: spatial semi- and anti-joins on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.config import KEEP_CLASSES
from emberline.functions.geo import cell_join, haversine
from emberline.operators.cover import inside_any


def near_ids(hotspots: DataFrame, facilities: DataFrame, metres: float) -> DataFrame:
    """Ids of detections within so many metres of a facility's point."""
    sites = facilities.filter("flat IS NOT NULL AND flon IS NOT NULL").select("flat", "flon")
    pairs = cell_join(hotspots.select("id", "latitude", "longitude"), sites, metres, ("latitude", "longitude"), ("flat", "flon"))
    return pairs.filter(haversine(F.col("latitude"), F.col("longitude"), F.col("flat"), F.col("flon")) <= metres).select("id").distinct()


def inside_ids(hotspots: DataFrame, facilities: DataFrame) -> DataFrame:
    """Ids of detections inside a facility's extent, polygon or box."""
    return inside_any(hotspots, facilities)


def _marked(hotspots: DataFrame, enrichment: DataFrame, facilities: DataFrame, metres: float) -> DataFrame:
    """(id, class, vision, inside, near)."""
    e = enrichment.select(F.col("hotspot_id").alias("id"), "class", "vision_industrial_prob")
    flags = (("inside", inside_ids(hotspots, facilities)), ("near", near_ids(hotspots, facilities, metres)))
    out = hotspots.select("id").join(e, "id", "left")
    for name, ids in flags:
        out = out.join(ids.withColumn(name, F.lit(True)), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.select("id", "class", F.coalesce(F.col("vision_industrial_prob") > 0.6, F.lit(False)).alias("vision"), "inside", "near")


def chosen(rows: DataFrame, ids: DataFrame | list[int] | None = None, after: int | None = None, upto: int | None = None) -> DataFrame:
    """The rows with one of these ids (None: all) and after < id <= upto; the bounds and a short list reach the scan.

    A frame of ids is one column of any size, met by a semi-join.
    """
    if after is not None:
        rows = rows.filter(F.col("id") > after)
    if upto is not None:
        rows = rows.filter(F.col("id") <= upto)
    if isinstance(ids, list):
        if len(ids) <= 1000:
            return rows.filter(F.col("id").isin(ids))
        ids = rows.sparkSession.createDataFrame([(i,) for i in ids], "id long")
    return rows if ids is None else rows.join(ids.toDF("id"), "id", "left_semi")


def candidates(hotspots: DataFrame, enrichment: DataFrame, facilities: DataFrame, metres: float = 5000.0, after: int | None = None, upto: int | None = None) -> DataFrame:
    """Ids worth enriching (of a range): near, inside or seen by vision, and not yet in a class that is kept."""
    rows = _marked(chosen(hotspots, None, after, upto), enrichment, facilities, metres)
    open_class = F.col("class").isNull() | ~F.col("class").isin(*KEEP_CLASSES)
    return rows.filter(open_class & (F.col("vision") | F.col("inside") | F.col("near"))).select("id")


def disposition(hotspots: DataFrame, enrichment: DataFrame, facilities: DataFrame, metres: float = 5000.0) -> DataFrame:
    """(id, disposition): keep_forever, keep_near, unclassified_near or delete."""
    rows = _marked(hotspots, enrichment, facilities, metres)
    around = F.col("vision") | F.col("inside") | F.col("near")
    kind = F.when(F.col("class").isin(*KEEP_CLASSES), "keep_forever").when(around & F.col("class").isNotNull(), "keep_near").when(around, "unclassified_near").otherwise("delete")
    return rows.select("id", kind.alias("disposition"))


def disposition_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("disposition").agg(F.count("*").alias("n"))


def id_range(hotspots: DataFrame) -> DataFrame:
    """One row: smallest and largest id and the count; an empty table gives nulls and 0."""
    return hotspots.agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count("*").alias("n"))


def of_days(rows: DataFrame, days: list) -> DataFrame:
    """The rows of some days; the days reach the scan."""
    return rows.filter(F.col("acq_date").isin(days))


def prune(hotspots: DataFrame, enrichment: DataFrame, facilities: DataFrame, metres: float = 5000.0) -> tuple[DataFrame, DataFrame]:
    """(detections, enrichment) without what is to be deleted; enrichment goes with its detection."""
    gone = disposition(hotspots, enrichment, facilities, metres).filter("disposition = 'delete'").select("id")
    return hotspots.join(gone, "id", "left_anti"), enrichment.join(gone.withColumnRenamed("id", "hotspot_id"), "hotspot_id", "left_anti")
