"""Coverage of the facility map around detections, land cover, and run telemetry."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import cell_join, haversine
from emberline.functions.values import land_cover
from emberline.schemas import RUN_LOG, SCREEN_LOG, WORKER_STATUS
from emberline.sources.land_cover import LandCover
from emberline.tables import materialize


def covered_ids(hotspots: DataFrame, cache: DataFrame, radius_m: float = 32_000.0) -> DataFrame:
    """Ids within a cached query's reach, which is at least radius_m."""
    centres = cache.select(F.col("center_lat").alias("c_lat"), F.col("center_lon").alias("c_lon"), F.greatest(F.col("radius_m"), F.lit(radius_m)).alias("_reach"))
    wide = centres.withColumn("_extra", F.col("_reach") - radius_m)
    pairs = cell_join(hotspots.select("id", "latitude", "longitude"), wide, radius_m, ("latitude", "longitude"), ("c_lat", "c_lon"), "_extra")
    return pairs.filter(haversine(F.col("latitude"), F.col("longitude"), F.col("c_lat"), F.col("c_lon")) <= F.col("_reach")).select("id").distinct()


def uncovered(hotspots: DataFrame, cache: DataFrame, radius_m: float = 32_000.0, limit: int = 50) -> DataFrame:
    """The newest detections that no cached query covers."""
    rest = hotspots.join(covered_ids(hotspots, cache, radius_m), "id", "left_anti")
    return rest.orderBy(F.desc("acq_date"), F.desc("acq_time"), "id").limit(limit).select("id", "latitude", "longitude")


def is_covered(spark, cache: DataFrame, lat: float, lon: float, radius_m: float = 32_000.0) -> bool:
    point = spark.createDataFrame([(0, lat, lon)], "id long, latitude double, longitude double")
    return not covered_ids(point, cache, radius_m).isEmpty()


def refresh_context(spark, hotspots: DataFrame, cache: DataFrame, query, radius_m: float = 32_000.0, limit: int = 50, most_failures: int = 3):
    """Ask ``query(lat, lon, radius)`` for the facilities around uncovered detections, one after another.

    Returns (rows for the cache, facilities found, failures). It stops after most_failures in all.
    """
    done, found, failures = [], [], 0
    for r in uncovered(hotspots, cache, radius_m, limit).collect():  # at most ``limit`` rows
        if any(_metres(r.latitude, r.longitude, a, b) <= radius_m for a, b, *_ in done):
            continue
        try:
            rows = query(r.latitude, r.longitude, radius_m)
        except RuntimeError:
            failures += 1
            if failures >= most_failures:
                break
            continue
        found += rows
        done.append((r.latitude, r.longitude, radius_m, len(rows)))
    return done, found, failures


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    from math import asin, cos, radians, sin, sqrt

    a = sin(radians(lat2 - lat1) / 2) ** 2 + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371000.0 * asin(min(1.0, sqrt(a)))


def land_cover_pending(enrichment: DataFrame, limit: int = 500) -> DataFrame:
    return enrichment.filter(F.col("landcover_class").isNull()).select("hotspot_id").orderBy("hotspot_id").limit(limit)


def put_land_cover(enrichment: DataFrame, answers: DataFrame) -> DataFrame:
    """enrichment with the provider's codes (hotspot_id, code, perhaps note) put in where no class is known.

    An answer without a code leaves its note, for instance why the provider failed.
    """
    failure = F.substring(F.col("note"), 1, 300) if "note" in answers.columns else F.lit(None).cast("string")
    got = answers.select("hotspot_id", land_cover(F.col("code")).alias("_c"), failure.alias("_failure"))
    both = enrichment.join(got, "hotspot_id", "left")
    fill = F.col("landcover_class").isNull() & F.col("_c").isNotNull()
    new = {c: F.coalesce(F.col("_failure"), F.col("_c")[c]) if c == "landcover_note" else F.col("_c")[c] for c in enrichment.columns if c.startswith("landcover_")}
    return both.select([F.when(fill, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in enrichment.columns])


def fill_land_cover(enrichment: DataFrame, hotspots: DataFrame, service: LandCover, limit: int = 500, tasks: int = 8) -> DataFrame:
    """enrichment with the land cover of at most ``limit`` detections that lack it; unchanged where the service is off.

    The answers are written once, so nothing is asked twice; ``tasks`` bounds the requests under way.
    """
    if not service.enabled:
        return enrichment
    places = hotspots.select(F.col("id").alias("hotspot_id"), "latitude", "longitude")
    points = places.join(F.broadcast(land_cover_pending(enrichment, limit)), "hotspot_id").repartition(tasks, "hotspot_id")
    return put_land_cover(enrichment, materialize(service.answers(points)))


def run_row(spark, **values) -> DataFrame:
    """A row for the run log; the error is cut to 500 characters and blank becomes null."""
    values["error"] = (values.get("error") or "")[:500] or None
    return spark.createDataFrame([tuple(values.get(f.name) for f in RUN_LOG)], RUN_LOG)


def screen_row(spark, **values) -> DataFrame:
    """A row for the screening log."""
    for name in ("percentile_pct", "frp_mw"):
        if values.get(name) is not None:
            values[name] = Decimal(str(values[name]))
    return spark.createDataFrame([tuple(values.get(f.name) for f in SCREEN_LOG)], SCREEN_LOG)


def heartbeat(stored: DataFrame, **values) -> DataFrame:
    """worker_status with this worker's row put in; started_at of a known worker stays."""
    values["last_error"] = (values.get("last_error") or "")[:400] or None
    row = stored.sparkSession.createDataFrame([tuple(values.get(f.name) for f in WORKER_STATUS)], WORKER_STATUS)
    known = stored.filter(F.col("worker_id") == values["worker_id"]).select("worker_id", F.col("started_at").alias("_old"))
    fresh = row.join(known, "worker_id", "left").withColumn("started_at", F.coalesce("_old", "started_at")).drop("_old")
    return stored.filter(F.col("worker_id") != values["worker_id"]).unionByName(fresh)


def run_totals(log: DataFrame) -> DataFrame:
    """One row: grand totals of runs."""
    return log.agg(F.count("*").alias("runs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("returned", "inserted", "duplicates", "invalid")], F.count_if(F.col("status") == "failed").alias("failed"))
