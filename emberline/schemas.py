"""One schema a table; nothing is inferred."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructField, StructType, TimestampType,
)


def _of(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


S, L, I, D, F, T, B, DT = StringType(), LongType(), IntegerType(), DoubleType(), FloatType(), TimestampType(), BooleanType(), DateType()
RINGS = ArrayType(ArrayType(_of(lon=D, lat=D)))
TAGS = MapType(S, S)

RAW_DETECTION = _of(**{c: S for c in "latitude longitude acq_date acq_time satellite instrument confidence version bright_ti4 bright_ti5 frp daynight scan track".split()})
HOTSPOTS = _of(
    id=L, source=S, satellite=S, instrument=S, confidence=S, version=S, latitude=D, longitude=D, acq_date=DT, acq_time=ShortType(),
    frp=F, bright_ti4=F, bright_ti5=F, scan=F, track=F, daynight=S, ingested_at=T,
)
FACILITIES = _of(osm_type=S, osm_id=L, name=S, facility_type=S, tags=TAGS, source=S, geometry=S, latitude=D, longitude=D, first_seen_at=T, updated_at=T)
ENRICHMENT = _of(
    hotspot_id=L, nearest_facility_id=L, nearest_facility_name=S, nearest_facility_type=S, distance_m=D, within_facility=B, detections_24h=L, detections_7d=L, detections_30d=L,
    days_active_30d=L, mean_frp_7d=D, mean_frp_30d=D, max_frp_30d=D, current_frp_vs_historical_mean=D, nighttime_detection_fraction=D, persistence_score=D, frp_vs_nearby=D,
    **{"class": S}, reasons=ArrayType(S), enriched_at=T, vision_industrial_prob=D, vision_fire_prob=D, vision_flare_prob=D, vision_facility_type=S, vision_model_version=S,
    landcover_class=S, landcover_fracs=TAGS, landcover_note=S, acq_date=DT,
)
RUN_LOG = _of(kind=S, source=S, bbox=S, date_from=DT, date_to=DT, days=I, returned=L, inserted=L, duplicates=L, invalid=L, status=S, error=S, started_at=T, finished_at=T)
SCREEN_LOG = _of(kind=S, source=S, bbox=S, date_from=DT, days=I, fetched=L, kept=L, dropped=L, in_day=L, prior=L, frp=L, percentile_pct=DecimalType(38, 6), frp_mw=DecimalType(38, 6), created_at=T)
WORKER_STATUS = _of(worker_id=S, started_at=T, last_heartbeat_at=T, cycle_count=L, last_cycle_status=S, last_error=S, last_inserted=L, version=S)
QUERY_CACHE = _of(center_lat=D, center_lon=D, radius_m=D, facility_count=L, queried_at=T)
#: Ids given to rows of a cycle: a row when they are reserved (state begun), one when the cycle is done.
ID_RANGES = _of(cycle=S, state=S, first_id=L, last_id=L, at=T)
OSM_NODE = _of(id=L, lat=D, lon=D, tags=TAGS)
OSM_WAY = _of(id=L, refs=ArrayType(L), tags=TAGS)

#: Columns that screening, pruning and serving of detections rely on.
NATURAL_KEY = ("source", "satellite", "lat4", "lon4", "acq_date", "acq_time")
