"""The registered queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.config import KEEP_CLASSES, Screen
from emberline.functions.geo import radius_box, tiles_of
from emberline.functions.values import facility_type, is_industrial, land_cover, rounded
from emberline.operators import classify as C
from emberline.operators import context, cover, facilities as fac, ingest, prune, serve
from emberline.operators.enrich import enrich, history_features, nearest_facility, upsert_enrichment, write_back
from emberline.plans import derived as D
from emberline.plans.derived import CLASS_SQL, EDGES_SQL, ENRICHMENT_SQL, FACILITIES_SQL, HISTORY_SQL, HOTSPOTS_SQL, NEAREST_SQL, SHAPES_SQL, metres_sql, round_sql
from emberline.tables import materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = "2024-01-25 00:00:00"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def classified(spark: SparkSession, sf_dir: str, reasons: bool = False) -> DataFrame:
    h = D.hotspots(spark, sf_dir)
    return C.classify(enrich(h, D.facilities(spark, sf_dir)), reasons=reasons)


def _known(spark, sf_dir):
    """(detections, enrichment): every fifth detection is not classified yet. The enrichment is a stored table, as it is where it is served from."""
    c = classified(spark, sf_dir)
    e = c.filter("id % 5 != 0").select(F.col("id").alias("hotspot_id"), "class", "nearest_facility_name", "nearest_facility_type", "distance_m", "within_facility", "detections_7d", "vision_industrial_prob")
    return D.hotspots(spark, sf_dir).drop("vision_industrial_prob"), materialize(e)


_ALL = _with(HOTSPOTS_SQL, FACILITIES_SQL, NEAREST_SQL, HISTORY_SQL, CLASS_SQL)
_KNOWN = _ALL[:-1] + ",\nk AS (SELECT h.id, h.source, h.acq_date, h.acq_time, h.latitude, h.longitude, h.frp, CASE WHEN h.id % 5 <> 0 THEN c.class END AS class, CASE WHEN h.id % 5 <> 0 THEN c.nearest_facility_name END AS nearest_facility_name FROM h JOIN c ON c.id = h.id)\n"


@query(_ALL + "SELECT class, count(*) AS n FROM c GROUP BY class")
def class_counts(spark, sf_dir):
    return serve.class_counts(classified(spark, sf_dir))


_NEAR_COLUMNS = "id, nearest_facility_id, nearest_facility_name, nearest_facility_type, distance_m, within_facility"


@query(_with(HOTSPOTS_SQL, FACILITIES_SQL, NEAREST_SQL) + f"SELECT {_NEAR_COLUMNS} FROM n")
def nearest(spark, sf_dir):
    return nearest_facility(D.hotspots(spark, sf_dir), D.facilities(spark, sf_dir))


@query(
    _with(HOTSPOTS_SQL, FACILITIES_SQL, NEAREST_SQL)
    + """SELECT id, CASE WHEN raw_m <= 5000 THEN nearest_facility_id END AS nearest_facility_id, CASE WHEN raw_m <= 5000 THEN nearest_facility_name END AS nearest_facility_name,
    CASE WHEN raw_m <= 5000 THEN nearest_facility_type END AS nearest_facility_type, CASE WHEN raw_m <= 5000 THEN distance_m END AS distance_m, raw_m <= 5000 AND within_facility AS within_facility FROM n"""
)
def nearest_within_5km(spark, sf_dir):
    return nearest_facility(D.hotspots(spark, sf_dir), D.facilities(spark, sf_dir), 5000.0)


@query(_with(HOTSPOTS_SQL, HISTORY_SQL) + "SELECT * FROM t")
def history(spark, sf_dir):
    return history_features(D.hotspots(spark, sf_dir))


@query(_ALL + "SELECT id, class FROM c")
def classify_labels(spark, sf_dir):
    return classified(spark, sf_dir).select("id", "class")


_REASONS = """, z AS (
  SELECT *, '"' || trim(nearest_facility_name) || '" (' || nearest_facility_type || ')' AS place, format('{:,.0f}', distance_m) AS metres, format('{:.1f}', frp) AS mw, coalesce(distance_m <= 5000, FALSE) AS close,
    format('{:.1f}', current_frp_vs_historical_mean) || 'x the 30-d mean' AS times, format('{:.1f}', current_frp_vs_historical_mean) AS ratio, coalesce(current_frp_vs_historical_mean >= 2.5, FALSE) AS surge,
    CASE WHEN frp >= 15 THEN 'FRP ' || format('{:.1f}', frp) || ' >= 15 (bright)' END AS bright, detections_7d || ' detections in 7 d, ' || days_active_30d || ' active days in 30 d' AS counts,
    'vision industrial probability ' || format('{:.2f}', vision_industrial_prob) AS seen FROM c),
w AS (SELECT *, CASE WHEN within_facility THEN 'hotspot lies inside ' || place || ' polygon' WHEN close THEN 'within ' || metres || ' m of ' || place END AS at_site,
    CASE WHEN surge THEN 'FRP ' || mw || ' is ' || times || ' (sudden event)' WHEN detections_7d <= 1 THEN 'new detection (' || detections_7d || ' prior detections in 7 d)' END AS sudden FROM z)
SELECT id, class, CASE class
  WHEN 'gas_flare' THEN concat_ws('; ', 'gas-flare candidate site ' || place, bright, CASE WHEN detections_7d >= 3 OR days_active_30d >= 3 THEN counts || ' (recurrent)' END,
    CASE WHEN nighttime_detection_fraction >= 0.6 THEN 'nighttime fraction ' || format('{:.2f}', nighttime_detection_fraction) || ' >= 0.6 (night recurrence)' END,
    CASE WHEN persistence_score >= 0.5 THEN 'persistence ' || format('{:.2f}', persistence_score) || ' (' || detections_7d || ' detections in 7 d)' END, CASE WHEN surge THEN 'FRP ' || mw || ' is ' || times || ' (burst)' END, seen)
  WHEN 'persistent_industrial_source' THEN concat_ws('; ', 'within ' || metres || ' m of ' || place, counts, 'FRP is steady relative to the historical mean' || coalesce(' (ratio ' || ratio || ')', ''), seen)
  WHEN 'industrial_fire' THEN concat_ws('; ', at_site, sudden, CASE WHEN at_site IS NULL AND sudden IS NULL AND vision_industrial_prob >= 0.8 THEN seen || ' >= 0.8' END, bright, seen)
  ELSE CASE WHEN NOT within_facility AND NOT close AND vision_industrial_prob IS NULL THEN 'nearest known industrial facility is ' || metres || ' m away' ELSE 'no rule produced a decision' END END AS reasons
FROM w"""


@query(_ALL[:-1] + _REASONS)
def classify_reasons(spark, sf_dir):
    return classified(spark, sf_dir, True).select("id", "class", F.array_join("reasons", "; ").alias("reasons"))


_RAW = _with(HOTSPOTS_SQL) + ", r AS (SELECT * FROM h UNION ALL SELECT * FROM h WHERE id % 10 = 0), g AS (SELECT *, id % 97 <> 0 AND id % 89 <> 0 AND id % 83 <> 0 AS ok FROM r)\n"


@query(_RAW + "SELECT ok AS valid, count(*) AS n FROM g GROUP BY ok")
def validate_rows(spark, sf_dir):
    raw = D.raw_rows(spark, sf_dir)
    return raw.groupBy(ingest.is_valid(raw).alias("valid")).agg(F.count("*").alias("n"))


_FIRST_KEYS = "SELECT DISTINCT source, satellite, round(CAST(latitude AS DECIMAL(18,8)), 4) AS la, round(CAST(longitude AS DECIMAL(18,8)), 4) AS lo, acq_date, acq_time FROM g WHERE ok"


@query(_RAW + f", k AS ({_FIRST_KEYS} AND dt >= TIMESTAMP '2024-01-20' EXCEPT {_FIRST_KEYS} AND dt < TIMESTAMP '2024-01-20') SELECT source, acq_date, count(*) AS n FROM k GROUP BY ALL")
def insert_new(spark, sf_dir):
    raw = D.raw_rows(spark, sf_dir)
    rows = ingest.parse(raw.filter(ingest.is_valid(raw)), F.col("source"))
    return ingest.new_rows(rows.filter("acq_date >= DATE'2024-01-20'"), rows.filter("acq_date < DATE'2024-01-20'")).groupBy("source", "acq_date").agg(F.count("*").alias("n"))


@query(_RAW + f", k AS ({_FIRST_KEYS}) SELECT (SELECT count(*) FROM g) AS returned, (SELECT count(*) FROM k) AS inserted, (SELECT count(*) FROM g WHERE ok) - (SELECT count(*) FROM k) AS duplicates, (SELECT count(*) FROM g WHERE NOT ok) AS invalid")
def ingest_counters(spark, sf_dir):
    raw = D.raw_rows(spark, sf_dir)
    rows = raw.limit(0)
    return ingest.ingest_counts(raw, ingest.parse(rows, F.col("source")), F.col("source"))


_CELL = lambda lat, lon: f"CAST(round(CAST({lat} * 100 AS DECIMAL(18,6))) AS INTEGER) AS la, CAST(round(CAST({lon} * 100 AS DECIMAL(18,6))) AS INTEGER) AS lo"
_SCREEN = _with(HOTSPOTS_SQL, FACILITIES_SQL) + f""",
fc AS (SELECT DISTINCT {_CELL("flat", "flon")} FROM f), hc AS (SELECT *, {_CELL("latitude", "longitude")} FROM h),
pc AS (SELECT DISTINCT source, la, lo FROM hc WHERE acq_date >= DATE '2024-01-10' AND acq_date < DATE '2024-01-20'), b AS (SELECT * FROM hc WHERE acq_date >= DATE '2024-01-20'),
s AS (SELECT id, EXISTS (SELECT 1 FROM fc WHERE fc.la BETWEEN b.la - 5 AND b.la + 5 AND fc.lo BETWEEN b.lo - 5 AND b.lo + 5) AS near, count(*) OVER (PARTITION BY la, lo) >= 2 AS in_day,
  EXISTS (SELECT 1 FROM pc WHERE pc.source = b.source AND pc.la = b.la AND pc.lo = b.lo) AS prior, frp >= (SELECT quantile_disc(frp, 0.9) FROM b) AS bright FROM b)
"""


def _screened(spark, sf_dir):
    h = D.hotspots(spark, sf_dir)
    batch, stored = h.filter("acq_date >= DATE'2024-01-20'"), h.filter("acq_date < DATE'2024-01-20'")
    return ingest.screen(batch.select("id", "source", "latitude", "longitude", "frp"), ingest.facility_cells(D.facilities(spark, sf_dir)), ingest.prior_cells(stored, F.lit("2024-01-10").cast("date")), Screen())


@query(_SCREEN + "SELECT id, near, in_day, prior, bright FROM s")
def screen_rows(spark, sf_dir):
    return _screened(spark, sf_dir).select("id", "near", "in_day", "prior", "bright")


@query(_SCREEN + "SELECT count(*) AS fetched, count(*) FILTER (near) AS kept, count(*) FILTER (NOT near) AS dropped, count(*) FILTER (in_day) AS in_day, count(*) FILTER (prior) AS prior, count(*) FILTER (bright) AS frp FROM s")
def screen_totals(spark, sf_dir):
    return ingest.screen_stats(_screened(spark, sf_dir))


@query(_SCREEN + "SELECT la, lo FROM fc")
def facility_cells(spark, sf_dir):
    return ingest.facility_cells(D.facilities(spark, sf_dir)).select("cell.la", "cell.lo")


@query(_SCREEN + "SELECT source, la, lo FROM pc")
def prior_cells(spark, sf_dir):
    return ingest.prior_cells(D.hotspots(spark, sf_dir).filter("acq_date < DATE'2024-01-20'"), F.lit("2024-01-10").cast("date")).select("source", "cell.la", "cell.lo")


@query(_with(HOTSPOTS_SQL) + "SELECT quantile_disc(frp, 0.9) AS threshold FROM h")
def frp_percentile(spark, sf_dir):
    return ingest.percentile_threshold(D.hotspots(spark, sf_dir), 90)


_PAGE = "id, source, acq_date, acq_time, class"


def _page(spark, sf_dir, limit=1000, after=None, **filters):
    h, e = _known(spark, sf_dir)
    return serve.page(serve.served(h, e), serve.Filters(**filters), limit, after).select("id", "source", "acq_date", "acq_time", "class")


_PAGE_ORDER = " ORDER BY class NULLS LAST, acq_date DESC, acq_time DESC, id LIMIT 1000"


@query(_KNOWN + f"SELECT {_PAGE} FROM k" + _PAGE_ORDER)
def hotspots_page(spark, sf_dir):
    return _page(spark, sf_dir)


@query(_KNOWN + f"SELECT {_PAGE} FROM k" + _PAGE_ORDER.replace("1000", "6000"))
def hotspots_large_page(spark, sf_dir):
    return _page(spark, sf_dir, limit=6000)


@query(_KNOWN + f"SELECT {_PAGE} FROM k WHERE class > 'industrial_fire' OR class IS NULL OR class = 'industrial_fire' AND (acq_date < DATE '2024-01-10' OR acq_date = DATE '2024-01-10' AND (acq_time < 600 OR acq_time = 600 AND id > 10))" + _PAGE_ORDER)
def hotspots_next_page(spark, sf_dir):
    return _page(spark, sf_dir, after=("industrial_fire", "2024-01-10", 600, 10))


@query(_KNOWN + f"SELECT {_PAGE} FROM k WHERE coalesce(class, 'unclassified') IN ('gas_flare', 'unclassified')" + _PAGE_ORDER)
def hotspots_by_class(spark, sf_dir):
    return _page(spark, sf_dir, classes=("gas_flare", "unclassified"))


@query(_KNOWN + f"SELECT {_PAGE} FROM k WHERE source = 'VIIRS_NOAA20_NRT' AND acq_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'" + _PAGE_ORDER)
def hotspots_by_source_and_date(spark, sf_dir):
    return _page(spark, sf_dir, sources=("VIIRS_NOAA20_NRT",), date_from="2024-01-05", date_to="2024-01-12")


@query(_KNOWN + f"SELECT {_PAGE} FROM k WHERE latitude BETWEEN 10 AND 25 AND longitude BETWEEN 70 AND 85" + _PAGE_ORDER)
def hotspots_in_box(spark, sf_dir):
    return _page(spark, sf_dir, bbox="70,10,85,25")


@query(
    _KNOWN + """SELECT CAST(floor(latitude / 0.5) AS INTEGER) AS cell_lat, CAST(floor(longitude / 0.5) AS INTEGER) AS cell_lon, count(*) AS cell_count,
    CAST(round(CAST(sum(CAST(frp AS DECIMAL(18,6))) / count(*) AS DECIMAL(18,10)), 2) AS DOUBLE) AS mean_frp, max(frp) AS max_frp, arg_max(id, (acq_date, acq_time, -id)) AS id
    FROM k GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 50000"""
)
def grid_aggregate(spark, sf_dir):
    h, e = _known(spark, sf_dir)
    return serve.grid(serve.served(h, e), 0.5).select("cell_lat", "cell_lon", "cell_count", "mean_frp", "max_frp", "id")


_NUMBERS = ("frp", "latitude", "longitude", "distance_m", "persistence_score", "current_frp_vs_historical_mean")


@query(
    _ALL + """SELECT id, 'Feature' AS type, 'Point' AS kind, longitude AS lon, latitude AS lat, source, class, strftime(acq_date, '%Y-%m-%d') AS acq_day, strftime(dt, '%Y-%m-%dT%H:%M:%SZ') AS acq_datetime, nearest_facility_name, within_facility,
    detections_24h, detections_30d, daynight, vision_industrial_prob IS NULL AS unseen, """ + ", ".join(f"{c} AS p_{c}" for c in _NUMBERS) + " FROM c"
)
def hotspot_features(spark, sf_dir):
    """The features, read back out of their JSON; a null property is written out, not left away."""
    found = serve.features(classified(spark, sf_dir, True))
    get = lambda path, kind="string": F.get_json_object("feature", f"$.{path}").cast(kind)
    of = lambda name, kind="string": get(f"properties.{name}", kind).alias(name)
    return found.select(
        "id", get("type").alias("type"), get("geometry.type").alias("kind"), get("geometry.coordinates[0]", "double").alias("lon"), get("geometry.coordinates[1]", "double").alias("lat"), of("source"), of("class"), get("properties.acq_date").alias("acq_day"), of("acq_datetime"),
        of("nearest_facility_name"), of("within_facility", "boolean"), of("detections_24h", "long"), of("detections_30d", "long"), of("daynight"), F.contains(F.col("feature"), F.lit('"vision_industrial_prob":null')).alias("unseen"),
        *[get(f"properties.{c}", "double").alias(f"p_{c}") for c in _NUMBERS],
    )


@query(_with(HOTSPOTS_SQL) + "SELECT id, latitude, longitude, strftime(dt, '%Y-%m-%dT%H:%M:%SZ') AS acq_datetime FROM h WHERE id = 42")
def hotspot_detail(spark, sf_dir):
    d = serve.detail(D.hotspots(spark, sf_dir), 42)
    get = lambda p: F.get_json_object("feature", f"$.properties.{p}")
    return d.select("id", get("latitude").cast("double").alias("latitude"), get("longitude").cast("double").alias("longitude"), get("acq_datetime").alias("acq_datetime"))


@query(_with(HOTSPOTS_SQL) + "SELECT count(*) AS total_hotspots, strftime(min(acq_date), '%Y-%m-%d') AS min_date, strftime(max(acq_date), '%Y-%m-%d') AS max_date, count(DISTINCT acq_date) AS days, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT source AS s FROM h)) AS sources, (SELECT count(*) FROM supplier) AS total_facilities FROM h")
def stats(spark, sf_dir):
    return serve.stats(D.hotspots(spark, sf_dir), D.facilities(spark, sf_dir))


_LOG = _with(HOTSPOTS_SQL) + ", l AS (SELECT source, acq_date AS date_from, count(*) AS inserted, CASE WHEN day(acq_date) % 7 = 0 THEN 'failed' ELSE 'success' END AS status, max(dt) AS finished_at FROM h GROUP BY ALL)\n"


@query(_LOG + "SELECT source, date_from, inserted, status FROM l ORDER BY finished_at DESC, source DESC LIMIT 1")
def run_log_latest(spark, sf_dir):
    return serve.last_run(D.run_log(spark, sf_dir)).select("source", "date_from", "inserted", "status")


@query(_LOG + "SELECT source, date_from, inserted, status FROM l QUALIFY row_number() OVER (PARTITION BY source ORDER BY finished_at DESC, date_from DESC) = 1")
def run_log_per_source(spark, sf_dir):
    return serve.last_run_per_source(D.run_log(spark, sf_dir)).select("source", "date_from", "inserted", "status")


@query(_LOG + f"SELECT CAST(coalesce(sum(inserted), 0) AS BIGINT) AS inserted_24h FROM l WHERE status = 'success' AND finished_at >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY")
def inserted_24h(spark, sf_dir):
    return serve.inserted_since(D.run_log(spark, sf_dir), F.lit(NOW).cast("timestamp") - F.make_dt_interval(F.lit(1)))


@query("SELECT count(*) > 0 AS configured, max(t) > TIMESTAMP '2024-01-30 23:59:00' - INTERVAL 45 MINUTE AS alive, max(event_type) AS worker_id, max(n) AS cycle_count FROM (SELECT event_type, max(ts) AS t, count(*) AS n FROM events GROUP BY 1)")
def worker_alive(spark, sf_dir):
    return serve.worker_state(D.workers(spark, sf_dir), F.lit("2024-01-30 23:59:00").cast("timestamp")).select("configured", "alive", "worker_id", "cycle_count")


@query(_LOG + f"SELECT coalesce(bool_or(status = 'failed' AND finished_at >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY), FALSE) AS degraded FROM (SELECT * FROM l ORDER BY finished_at DESC, source DESC LIMIT 1)")
def degraded(spark, sf_dir):
    return serve.degraded(D.run_log(spark, sf_dir), F.lit(NOW).cast("timestamp"))


_MARKS = _ALL[:-1] + f""",
m AS (SELECT h.id, CASE WHEN h.id % 5 <> 0 THEN c.class END AS class, coalesce(h.id % 5 <> 0 AND h.vision_industrial_prob > 0.6, FALSE) AS vision,
  EXISTS (SELECT 1 FROM f WHERE abs(h.latitude - flat) <= half_deg AND abs(h.longitude - flon) <= half_deg) AS inside,
  EXISTS (SELECT 1 FROM f WHERE {metres_sql("h.latitude", "h.longitude", "flat", "flon")} <= 5000) AS near FROM h JOIN c ON c.id = h.id),
q AS (SELECT *, CASE WHEN class IN ('gas_flare', 'persistent_industrial_source', 'industrial_fire') THEN 'keep_forever' WHEN (vision OR inside OR near) AND class IS NOT NULL THEN 'keep_near'
  WHEN vision OR inside OR near THEN 'unclassified_near' ELSE 'delete' END AS disposition FROM m)
"""


@query(_MARKS + "SELECT id FROM m WHERE (class IS NULL OR class NOT IN ('gas_flare', 'persistent_industrial_source', 'industrial_fire')) AND (vision OR inside OR near)")
def candidates(spark, sf_dir):
    h, e = _known(spark, sf_dir)
    return prune.candidates(h, e, D.facilities(spark, sf_dir))


@query(_MARKS + "SELECT disposition, count(*) AS n FROM q GROUP BY 1")
def prune_disposition(spark, sf_dir):
    h, e = _known(spark, sf_dir)
    return prune.disposition_counts(prune.disposition(h, e, D.facilities(spark, sf_dir)))


@query(_MARKS + "SELECT id FROM q WHERE disposition <> 'delete'")
def prune_survivors(spark, sf_dir):
    h, e = _known(spark, sf_dir)
    return prune.prune(h, e, D.facilities(spark, sf_dir))[0].select("id")


@query(_MARKS + "SELECT id FROM m WHERE inside")
def inside_extent(spark, sf_dir):
    return prune.inside_ids(D.hotspots(spark, sf_dir), D.facilities(spark, sf_dir))


@query(_with(HOTSPOTS_SQL) + "SELECT min(id) AS min_id, max(id) AS max_id, count(*) AS n FROM h")
def id_range(spark, sf_dir):
    return prune.id_range(D.hotspots(spark, sf_dir))


@query(_with(HOTSPOTS_SQL, "b AS (SELECT min(acq_date) AS first, max(acq_date) AS last FROM h)") + "SELECT CAST(d AS DATE) AS date_from, CAST(least(5, date_diff('day', CAST(d AS DATE), last) + 1) AS INTEGER) AS days FROM (SELECT last, unnest(generate_series(CAST(first AS TIMESTAMP), CAST(last AS TIMESTAMP), INTERVAL 5 DAY)) AS d FROM b)")
def backfill_windows(spark, sf_dir):
    """Windows over the days that have detections."""
    return ingest.windows_of(D.hotspots(spark, sf_dir).agg(F.min("acq_date").alias("first"), F.max("acq_date").alias("last")))


@query(_LOG + "SELECT s.source, CAST(d AS DATE) AS date_from, 1 AS days FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-03', INTERVAL 1 DAY) t(d), (SELECT DISTINCT source FROM h) s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.source = s.source AND l.date_from = CAST(d AS DATE) AND l.status = 'success')")
def backfill_pending(spark, sf_dir):
    log = D.run_log(spark, sf_dir).withColumn("kind", F.lit("backfill"))
    units = ingest.day_windows(spark, "2024-01-01", "2024-02-03", 1).crossJoin(F.broadcast(spark.createDataFrame([("VIIRS_NOAA20_NRT",), ("VIIRS_NOAA21_NRT",)], "source string")))
    return ingest.pending_units(units, log, "world").select("source", "date_from", "days")


@query(_LOG + "SELECT count(*) AS runs, CAST(sum(inserted) AS BIGINT) AS inserted, count(*) FILTER (status = 'failed') AS failed FROM l")
def run_totals(spark, sf_dir):
    return context.run_totals(D.run_log(spark, sf_dir)).select("runs", "inserted", "failed")


_PICK = lambda n, *v: f"(CASE p_partkey % {n} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(v)) + " END)"
_TAGS = f"""WITH g AS (SELECT p_partkey AS id, {_PICK(13, "refinery", "gas", "chemical", "steel", "mine", "lpg", "timber")} AS industrial, {_PICK(11, "industrial", "quarry", "forest")} AS landuse, {_PICK(7, "works")} AS works,
  {_PICK(5, "plant")} AS power, lower({_PICK(6, "Coal", "biogas", "hydro", "geothermal")}) AS src, lower({_PICK(17, "LNG", "steel")}) AS product FROM part)
"""


@query(
    _TAGS + """SELECT CASE WHEN power = 'plant' AND (src LIKE '%coal%' OR src LIKE '%gas%' OR src LIKE '%oil%' OR src LIKE '%thermal%' OR src LIKE '%nuclear%') THEN 'thermal_power_plant'
    WHEN industrial = 'refinery' THEN 'refinery' WHEN industrial IN ('oil', 'gas') THEN 'oil_gas_facility' WHEN industrial IN ('petrochemical', 'chemical', 'chemistry') THEN 'petrochemical'
    WHEN industrial IN ('steel', 'metal') THEN 'steel_or_metal' WHEN industrial IN ('mine', 'mining') OR landuse = 'quarry' THEN 'mining' WHEN product IN ('lng', 'lpg', 'gas') OR industrial IN ('lng', 'lpg', 'gas') THEN 'lng_or_storage_terminal'
    WHEN landuse = 'industrial' THEN 'industrial_area' WHEN works = 'works' THEN 'general_factory' WHEN power = 'plant' THEN 'thermal_power_plant' ELSE 'unknown_industrial' END AS facility_type, count(*) AS n FROM g GROUP BY 1"""
)
def facility_types(spark, sf_dir):
    return D.tagged(spark, sf_dir).groupBy(facility_type(F.col("tags")).alias("facility_type")).agg(F.count("*").alias("n"))


@query(_TAGS + "SELECT id FROM g WHERE industrial IS NOT NULL OR landuse IN ('industrial', 'quarry') OR works = 'works' OR power = 'plant'")
def selectors(spark, sf_dir):
    return D.tagged(spark, sf_dir).filter(is_industrial(F.col("tags"))).select("id")


_FUELS = lambda k: f"(CASE {k} % 8 WHEN 0 THEN 'Coal' WHEN 1 THEN 'Gas' WHEN 2 THEN 'Oil' WHEN 3 THEN 'Hydro' WHEN 4 THEN 'Biomass' WHEN 5 THEN 'Solar' WHEN 6 THEN 'Waste' ELSE 'Petcoke' END)"
_FAMILY = lambda f: f"(CASE {f} WHEN 'Coal' THEN 'coal' WHEN 'Gas' THEN 'gas' WHEN 'Oil' THEN 'oil' WHEN 'Biomass' THEN 'bio' WHEN 'Waste' THEN 'bio' WHEN 'Petcoke' THEN 'petcoke' END)"
_PLANTS = f"""WITH a AS (SELECT p_partkey AS osm_id, {_FUELS("p_partkey")} AS fuel, CAST(60000 + ((p_partkey % 150) * 7919) % 320000 + p_partkey % 5 AS DOUBLE) / 10000.0::DOUBLE AS lat, CAST(680000 + ((p_partkey % 150) * 104729) % 300000 + p_partkey % 3 AS DOUBLE) / 10000.0::DOUBLE AS lon FROM part),
b AS (SELECT s_suppkey AS dup_id, {_FUELS("s_suppkey")} AS b_fuel, CAST(60000 + (s_suppkey * 7919) % 320000 + s_suppkey % 50 AS DOUBLE) / 10000.0::DOUBLE AS b_lat, CAST(680000 + (s_suppkey * 104729) % 300000 + s_suppkey % 40 AS DOUBLE) / 10000.0::DOUBLE AS b_lon FROM supplier)
"""


@query(
    _PLANTS + f"""SELECT osm_id, dup_id FROM (SELECT osm_id, dup_id, {metres_sql("lat", "lon", "b_lat", "b_lon")} AS m, {_FAMILY("fuel")} AS x, {_FAMILY("b_fuel")} AS y FROM a, b
    WHERE abs(round(CAST(lat * 100 AS DECIMAL(18,6))) - round(CAST(b_lat * 100 AS DECIMAL(18,6)))) <= 1 AND abs(round(CAST(lon * 100 AS DECIMAL(18,6))) - round(CAST(b_lon * 100 AS DECIMAL(18,6)))) <= 1)
    WHERE m <= 1200 AND (x IS NULL OR y IS NULL OR x = y) QUALIFY row_number() OVER (PARTITION BY osm_id ORDER BY m, dup_id) = 1"""
)
def cross_source_duplicates(spark, sf_dir):
    a, b = D.registries(spark, sf_dir)
    return fac.cross_source_duplicates(a, b).select("osm_id", "dup_id")


@query(_PLANTS + "SELECT fuel AS value, count(*) AS n FROM a WHERE fuel NOT IN ('Hydro', 'Solar') GROUP BY 1 ORDER BY n DESC, value LIMIT 12")
def import_report(spark, sf_dir):
    a, _ = D.registries(spark, sf_dir)
    from emberline.functions.values import WRI_THERMAL

    return fac.import_report(a.filter(F.col("fuel").isin(*WRI_THERMAL)), "fuel", 12)


_MAP = """WITH nd AS (SELECT c_custkey AS id, CAST(60000 + (c_custkey * 7919) % 320000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lat, CAST(680000 + (c_custkey * 104729) % 300000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lon FROM customer),
ln AS (SELECT l_orderkey AS id, l_partkey % 1500 + 1 AS ref, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 1500 + 1) AS pos FROM lineitem),
rf AS (SELECT id, ref, pos FROM ln UNION ALL SELECT id, ref, 1000000 FROM ln WHERE pos = 1 AND id % 3 = 0),
pt AS (SELECT rf.id, count(*) AS n, count(*) FILTER (nd.id IS NULL) AS lost, list(lat ORDER BY pos) AS lats, list(lon ORDER BY pos) AS lons, string_agg(format('{:.7f} {:.7f}', lon, lat), ', ' ORDER BY pos) AS xy
  FROM rf LEFT JOIN nd ON nd.id = rf.ref GROUP BY rf.id),
wy AS (SELECT *, n >= 4 AND lats[1] = lats[n] AND lons[1] = lons[n] AS closed FROM pt),
wg AS (SELECT id, CASE WHEN lost = 0 AND closed THEN 'POLYGON((' || xy || '))' WHEN lost = 0 AND n >= 2 THEN 'LINESTRING(' || xy || ')' END AS geometry,
  CASE WHEN lost = 0 AND closed THEN list_reduce(lats, lambda a, b: a + b) / CAST(n AS DOUBLE) WHEN lost = 0 AND n >= 2 THEN lats[n // 2 + 1] END AS latitude,
  CASE WHEN lost = 0 AND closed THEN list_reduce(lons, lambda a, b: a + b) / CAST(n AS DOUBLE) WHEN lost = 0 AND n >= 2 THEN lons[n // 2 + 1] END AS longitude FROM wy)
"""


@query(_MAP + "SELECT id, geometry, latitude, longitude FROM wg")
def way_geometry(spark, sf_dir):
    nodes, ways = D.map_objects(spark, sf_dir)
    return fac.way_geometry(ways, nodes).drop("tags")


@query(
    _MAP + """SELECT 'node' AS osm_type, id AS osm_id, CAST(NULL AS VARCHAR) AS name, 'refinery' AS facility_type, 'osm' AS source, format('POINT({:.7f} {:.7f})', lon, lat) AS geometry, lat AS latitude, lon AS longitude FROM nd
    UNION ALL SELECT 'way', id, NULL, 'industrial_area', 'osm', geometry, latitude, longitude FROM wg WHERE geometry IS NOT NULL"""
)
def map_facilities(spark, sf_dir):
    nodes, ways = D.map_objects(spark, sf_dir)
    return fac.from_map(nodes, ways).drop("tags")


@query("SELECT s_suppkey AS osm_id, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' || s_name ELSE s_name END AS name, s_suppkey % 5 = 0 AS was_inserted FROM supplier")
def facility_upsert(spark, sf_dir):
    s = D.facilities(spark, sf_dir)
    rows = s.select(F.lit("node").alias("osm_type"), F.col("fid").alias("osm_id"), F.col("fname").alias("name"), F.lit("x").alias("facility_type"), F.lit(None).cast("timestamp").alias("first_seen_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    stored = rows.filter("osm_id % 5 != 0")
    batch = rows.filter("osm_id % 3 = 0 OR osm_id % 5 = 0").withColumn("name", F.when(F.col("osm_id") % 3 == 0, F.concat(F.lit("new "), "name")).otherwise(F.col("name"))).drop("first_seen_at", "updated_at")
    return fac.upsert(stored, batch, F.lit(NOW).cast("timestamp")).select("osm_id", "name", "was_inserted")


@query(_with(HOTSPOTS_SQL, FACILITIES_SQL) + f"SELECT id, latitude, longitude FROM h WHERE NOT EXISTS (SELECT 1 FROM f WHERE fid % 4 = 0 AND {metres_sql('h.latitude', 'h.longitude', 'flat', 'flon')} <= 32000) ORDER BY acq_date DESC, acq_time DESC, id LIMIT 50")
def uncovered_hotspots(spark, sf_dir):
    return context.uncovered(D.hotspots(spark, sf_dir), D.query_cache(spark, sf_dir))


@query(_with(FACILITIES_SQL) + f"SELECT fid, {round_sql('flon - 5000 / CAST(111320 AS DOUBLE) / greatest(0.2, cos(radians(flat)))', 5)} AS west, {round_sql('flat + 5000 / CAST(111320 AS DOUBLE)', 5)} AS north FROM f")
def radius_boxes(spark, sf_dir):
    box = radius_box(F.col("flat"), F.col("flon"), 5000.0)
    return D.facilities(spark, sf_dir).select("fid", rounded(box["west"], 5).alias("west"), rounded(box["north"], 5).alias("north"))


@query(_with(FACILITIES_SQL, "b AS (SELECT floor(min(flon)) AS w, floor(min(flat)) AS s, ceil(max(flon)) AS e, ceil(max(flat)) AS n FROM f)") + "SELECT format('{:.6f},{:.6f},{:.6f},{:.6f}', w + i * ((e - w) / 4), s + j * ((n - s) / 4), w + (i + 1) * ((e - w) / 4), s + (j + 1) * ((n - s) / 4)) AS tile FROM b, range(4) a(i), range(4) c(j)")
def area_tiles(spark, sf_dir):
    """Tiles of the box around all facilities."""
    whole = lambda f, agg, c: f(agg(c)).cast("double")
    box = D.facilities(spark, sf_dir).agg(whole(F.floor, F.min, "flon").alias("west"), whole(F.floor, F.min, "flat").alias("south"), whole(F.ceil, F.max, "flon").alias("east"), whole(F.ceil, F.max, "flat").alias("north"))
    return tiles_of(box, 4)


@query("SELECT p_partkey % 14 AS code, CASE p_partkey % 14 WHEN 1 THEN 'tree_cover' WHEN 2 THEN 'shrubland' WHEN 3 THEN 'grassland' WHEN 4 THEN 'cropland' WHEN 5 THEN 'built_up' WHEN 6 THEN 'bare' WHEN 7 THEN 'snow_ice' WHEN 8 THEN 'water' WHEN 9 THEN 'wetlands' WHEN 10 THEN 'mangroves' WHEN 11 THEN 'moss_lichen' END AS label, count(*) AS n FROM part GROUP BY ALL")
def land_cover_labels(spark, sf_dir):
    code = (F.col("p_partkey") % 14).alias("code")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(code, land_cover((F.col("p_partkey") % 14).cast("int"))["landcover_class"].alias("label"))
    return rows.groupBy("code", "label").agg(F.count("*").alias("n"))


_REF = "CASE WHEN within_facility THEN 'positive' WHEN distance_m <= 2500 AND nearest_facility_type IN ('thermal_power_plant', 'refinery', 'oil_gas_facility', 'petrochemical', 'steel_or_metal', 'mining', 'lng_or_storage_terminal') THEN 'positive' WHEN distance_m >= 5000 THEN 'negative' ELSE 'uncertain' END"


@query(_ALL + f"SELECT {_REF} AS reference, CASE WHEN class = 'unknown' THEN 'unknown' ELSE 'industrial' END AS predicted, count(*) AS n FROM c GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return C.confusion(classified(spark, sf_dir))


@query(_ALL + f", v AS (SELECT {_REF} AS ref, class FROM c) SELECT count(*) AS compared, count(*) FILTER ((ref = 'positive') = (class <> 'unknown')) AS agreeing, {round_sql('CAST(count(*) FILTER ((ref = $$positive$$) = (class <> $$unknown$$)) AS DOUBLE) / count(*)', 4)} AS accuracy FROM v WHERE ref <> 'uncertain'")
def agreement(spark, sf_dir):
    return C.agreement(classified(spark, sf_dir))


@query(_ALL + f"SELECT id, class, distance_m, nearest_facility_type FROM c WHERE ({_REF}) = 'positive' AND class = 'unknown' ORDER BY id LIMIT 10")
def false_negatives(spark, sf_dir):
    return C.disagreements(classified(spark, sf_dir), "fn")


@query(_ALL + f", z AS (SELECT * EXCLUDE (class), CASE WHEN id % 4 = 1 THEN 'unknown' ELSE class END AS class FROM c) SELECT id, class, distance_m, nearest_facility_type FROM z WHERE ({_REF}) = 'positive' AND class = 'unknown' ORDER BY id LIMIT 10")
def false_negatives_of_stored(spark, sf_dir):
    """Stored labels, of which every fourth is out of date, held against the map."""
    stored = F.when(F.col("id") % 4 == 1, "unknown").otherwise(F.col("class"))
    return C.disagreements(classified(spark, sf_dir).withColumn("class", stored), "fn")


@query(_ALL + f"SELECT id, class, distance_m, nearest_facility_type FROM c WHERE ({_REF}) = 'negative' AND class <> 'unknown' ORDER BY id LIMIT 10")
def false_positives(spark, sf_dir):
    return C.disagreements(classified(spark, sf_dir), "fp")


_SHAPES = _with(HOTSPOTS_SQL, FACILITIES_SQL, EDGES_SQL)


@query(_SHAPES + "SELECT DISTINCT id FROM s WHERE inside")
def polygon_cover(spark, sf_dir):
    return prune.inside_ids(D.hotspots(spark, sf_dir), D.polygon_sites(spark, sf_dir))


@query(
    _SHAPES + f"""SELECT id, fid AS nearest_facility_id, fname AS nearest_facility_name, ftype AS nearest_facility_type, {round_sql("CASE WHEN inside THEN 0 ELSE edge_m END", 1)} AS distance_m, inside AS within_facility
    FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN inside THEN 0 ELSE edge_m END, fid) = 1"""
)
def nearest_boundary(spark, sf_dir):
    return nearest_facility(D.hotspots(spark, sf_dir), D.polygon_sites(spark, sf_dir))


@query(_with(HOTSPOTS_SQL, FACILITIES_SQL, SHAPES_SQL) + "SELECT id, fid FROM s")
def polygon_cover_shapes(spark, sf_dir):
    return cover.containing(D.moved_hotspots(spark, sf_dir), D.shaped_sites(spark, sf_dir))


@query(
    _with(HOTSPOTS_SQL, FACILITIES_SQL, SHAPES_SQL) + f""", t AS (SELECT fid, (min(ay) + max(ay)) / 2 AS middle FROM e GROUP BY fid, g QUALIFY row_number() OVER (PARTITION BY fid ORDER BY round(max(ay) - min(ay), 9) DESC, g) = 1),
    v AS (SELECT fid, ay AS lat, middle FROM e JOIN t USING (fid)),
    p AS (SELECT fid, (max(lat) FILTER (lat <= middle) + min(lat) FILTER (lat > middle)) / 2 AS y FROM v GROUP BY fid),
    x AS (SELECT fid, y, x, row_number() OVER (PARTITION BY fid ORDER BY x) AS k FROM (SELECT fid, y, (bx - ax) * (y - ay) / (by_ - ay) + ax AS x FROM e JOIN p USING (fid) WHERE (ay > y) <> (by_ > y))),
    r AS (SELECT a.fid, a.y, a.k, round(b.x - a.x, 9) AS wide, (a.x + b.x) / 2 AS lon FROM x a JOIN x b ON b.fid = a.fid AND b.k = a.k + 1 WHERE a.k % 2 = 1),
    b AS (SELECT fid, y, lon FROM r QUALIFY row_number() OVER (PARTITION BY fid ORDER BY wide DESC, k) = 1)
    SELECT fid, {round_sql("y", 5)} AS latitude, {round_sql("lon + 97 - 360 * round((lon + 97) / 360)", 5)} AS longitude FROM b"""
)
def surface_points(spark, sf_dir):
    """A point inside each facility's polygons, over the date line too."""
    found = fac.on_surface(D.shaped_sites(spark, sf_dir))
    return found.select("fid", rounded(F.col("surface.lat"), 5).alias("latitude"), rounded(F.col("surface.lon"), 5).alias("longitude"))


@query(
    _with(HOTSPOTS_SQL, FACILITIES_SQL, SHAPES_SQL) + f"""SELECT id, CASE WHEN inside IS NULL THEN edge_m ELSE 0 END AS distance_m, inside IS NOT NULL AS within_facility FROM (SELECT id, {round_sql("min(edge_m)", 1)} AS edge_m FROM (
      SELECT id, {metres_sql("latitude", "longitude", "(ay + t * (by_ - ay))", "(ax + t * (bx - ax))")} AS edge_m FROM (SELECT *, greatest(0, least(1, -((ax - longitude) * cos(radians(latitude)) * dx + (ay - latitude) * dy) / (dx * dx + dy * dy))) AS t
      FROM (SELECT *, (bx - ax) * cos(radians(latitude)) AS dx, by_ - ay AS dy FROM h, e))) GROUP BY id) LEFT JOIN (SELECT DISTINCT id, TRUE AS inside FROM s) USING (id)"""
)
def nearest_shapes(spark, sf_dir):
    """Over the date line, with holes and parts. Which of several facilities a detection is inside of is in polygon_cover_shapes."""
    return nearest_facility(D.moved_hotspots(spark, sf_dir), D.shaped_sites(spark, sf_dir)).select("id", "distance_m", "within_facility")


@query(_with(HOTSPOTS_SQL) + "SELECT id AS hotspot_id, CASE WHEN id % 3 = 0 THEN frp ELSE -1 END AS distance_m, CASE WHEN id % 2 = 0 THEN 'unknown' END AS class FROM h WHERE id % 2 = 0 OR id % 3 = 0")
def enrichment_upsert(spark, sf_dir):
    h = D.hotspots(spark, sf_dir)
    stored = h.filter("id % 2 = 0").select(F.col("id").alias("hotspot_id"), F.lit(-1.0).alias("distance_m"), F.lit("unknown").alias("class"))
    fresh = h.filter("id % 3 = 0").select(F.col("id").alias("hotspot_id"), F.col("frp").alias("distance_m"))
    return upsert_enrichment(stored, fresh)


_STORED = _with(HOTSPOTS_SQL, ENRICHMENT_SQL)[:-1]


def _served(spark, sf_dir):
    """Detections with the stored enrichment."""
    h = D.hotspots(spark, sf_dir).drop("vision_industrial_prob")
    return serve.served(h, D.enrichment(spark, sf_dir).withColumn("nearest_facility_name", F.lit(None).cast("string")))


def _entries(found: DataFrame, properties: str) -> DataFrame:
    """The features of a document, numbered, with what stands around them."""
    get = lambda p, kind: F.get_json_object("document", f"$.{p}").cast(kind).alias(p)
    shape = f"array<struct<geometry:struct<coordinates:array<double>>,properties:struct<{properties}>>>"
    body = F.from_json(F.get_json_object("document", "$.features"), shape)
    rows = found.select(get("count", "long"), get("TotalFeatures", "long"), get("numberMatched", "long"), get("truncated", "boolean"), F.posexplode(body).alias("place", "f"))
    return rows.select("count", F.col("TotalFeatures").alias("total"), F.col("numberMatched").alias("matched"), "truncated", "place", "f.properties.*", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


_AROUND = "(SELECT count(*) FROM top) AS count, (SELECT count(*) FROM sv) AS total, (SELECT count(*) FROM sv) AS matched"


@query(
    _STORED + f""", sv AS (SELECT h.*, class FROM h LEFT JOIN en ON hotspot_id = id WHERE acq_date >= DATE '2024-01-05' AND coalesce(class, 'unclassified') <> 'gas_flare'),
    top AS (SELECT *, coalesce(class, 'unclassified') AS shown FROM sv ORDER BY class NULLS LAST, acq_date DESC, acq_time DESC, id LIMIT 500)
    SELECT {_AROUND}, (SELECT count(*) > 500 FROM sv) AS truncated, CAST(row_number() OVER (ORDER BY shown, dt DESC, id) - 1 AS INTEGER) AS place, id, source, shown AS class, strftime(dt, '%Y-%m-%dT%H:%M:%SZ') AS acq_datetime,
    frp, longitude AS lon, latitude AS lat FROM top"""
)
def hotspots_document(spark, sf_dir):
    kept = serve.Filters(classes=("unknown", "industrial_fire", "unclassified"), date_from="2024-01-05")
    return _entries(serve.page_document(_served(spark, sf_dir), kept, 500), "id:long,source:string,class:string,acq_datetime:string,frp:double")


@query(
    _STORED + f""", sv AS (SELECT h.*, coalesce(class, 'unclassified') AS class FROM h LEFT JOIN en ON hotspot_id = id),
    ce AS (SELECT CAST(floor(latitude / 2.5) AS INTEGER) AS la, CAST(floor(longitude / 2.5) AS INTEGER) AS lo, count(*) AS cell_count, max(frp) AS max_frp,
      CAST(round(CAST(sum(CAST(frp AS DECIMAL(18,6))) / count(*) AS DECIMAL(18,10)), 2) AS DOUBLE) AS mean_frp, arg_max(id, (acq_date, acq_time, -id)) AS id FROM sv GROUP BY 1, 2),
    top AS (SELECT * FROM ce ORDER BY la, lo LIMIT 50)
    SELECT {_AROUND}, (SELECT count(*) > 50 FROM sv) AS truncated, CAST(row_number() OVER (ORDER BY class, dt DESC, id) - 1 AS INTEGER) AS place, id, source, class, strftime(dt, '%Y-%m-%dT%H:%M:%SZ') AS acq_datetime,
    CAST(2.5 AS DOUBLE) AS resolution_deg, cell_count, mean_frp, max_frp, CAST((lo + 0.5) * 2.5 AS DOUBLE) AS lon, CAST((la + 0.5) * 2.5 AS DOUBLE) AS lat FROM top JOIN sv USING (id)"""
)
def grid_document(spark, sf_dir):
    found = serve.grid_document(_served(spark, sf_dir), 2.5, limit=50)
    return _entries(found, "id:long,source:string,class:string,acq_datetime:string,resolution_deg:double,cell_count:long,mean_frp:double,max_frp:double")


@query(
    _LOG[:-1] + f""", {ENRICHMENT_SQL}, z AS (SELECT * FROM l ORDER BY finished_at DESC, source DESC LIMIT 1), g AS (SELECT * FROM l WHERE status = 'success' ORDER BY finished_at DESC, source DESC LIMIT 1),
    ps AS (SELECT source, status, inserted FROM l QUALIFY row_number() OVER (PARTITION BY source ORDER BY finished_at DESC, date_from DESC) = 1),
    w AS (SELECT event_type, max(ts) AS t, count(*) AS n FROM events GROUP BY 1)
    SELECT (SELECT CASE WHEN status = 'failed' AND finished_at >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY THEN 'degraded' ELSE 'ok' END FROM z) AS status, (SELECT source || ' ' || status FROM z) AS last_run, (SELECT source || ' ' || inserted FROM g) AS last_good,
    (SELECT string_agg(source, ',' ORDER BY source) FROM ps) AS sources, (SELECT string_agg(source || ':' || status || ':' || inserted, ',' ORDER BY source) FROM ps) AS per_source,
    (SELECT CAST(coalesce(sum(inserted), 0) AS BIGINT) FROM l WHERE status = 'success' AND finished_at >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY) AS inserted_24h,
    (SELECT strftime(max(enriched_at), '%Y-%m-%dT%H:%M:%SZ') FROM en) AS last_enrichment, (SELECT count(class) FROM en) AS classified_count, (SELECT count(*) FROM h) AS total_hotspots, (SELECT count(*) FROM supplier) AS total_facilities,
    (SELECT max(t) > TIMESTAMP '{NOW}' - INTERVAL 45 MINUTE FROM w) AS alive, (SELECT max(n) FROM w) AS cycle_count, (SELECT max(event_type) FROM w) AS worker_id,
    (SELECT max(vision_model_version) FROM en) AS model_version, (SELECT count(vision_model_version) FROM en) AS inferred_count, (SELECT count(landcover_class) FROM en) AS landcover_count"""
)
def health_document(spark, sf_dir):
    h = D.hotspots(spark, sf_dir)
    found = serve.health_document(h, D.enrichment(spark, sf_dir), D.facilities(spark, sf_dir), D.run_log(spark, sf_dir), D.workers(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    runs = F.transform(F.map_entries("per_source"), lambda e: F.concat_ws(":", e["key"], e["value"]["status"], e["value"]["inserted"].cast("string")))
    return found.select(
        "status", F.concat_ws(" ", "last_run.source", "last_run.status").alias("last_run"), F.concat_ws(" ", "last_successful_ingestion.source", F.col("last_successful_ingestion.inserted").cast("string")).alias("last_good"),
        F.array_join("sources_used", ",").alias("sources"), F.array_join(runs, ",").alias("per_source"), "inserted_24h", F.date_format("last_enrichment_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_enrichment"),
        "classified_count", "total_hotspots", "total_facilities", "worker.alive", "worker.cycle_count", "worker.worker_id", "vision.model_version", "vision.inferred_count", F.col("landcover.enriched_count").alias("landcover_count"),
    )


@query(_STORED + " SELECT count(class) AS classified_count, strftime(max(enriched_at), '%Y-%m-%d %H:%M') AS last_enrichment, max(vision_model_version) AS model_version, count(vision_model_version) AS inferred_count, bool_or(landcover_class IS NOT NULL) AS landcover_configured, count(landcover_class) AS landcover_count FROM en")
def evidence(spark, sf_dir):
    found = serve.evidence(D.enrichment(spark, sf_dir))
    return found.withColumn("last_enrichment", F.date_format("last_enrichment_at", "yyyy-MM-dd HH:mm")).drop("last_enrichment_at")


@query(_STORED + " SELECT hotspot_id, CASE WHEN hotspot_id % 3 = 0 THEN 'unknown' ELSE class END AS class, CASE WHEN hotspot_id % 3 = 0 THEN 'new' ELSE 'old' END AS reason, distance_m, vision_model_version, landcover_class FROM en")
def class_write_back(spark, sf_dir):
    labelled = D.hotspots(spark, sf_dir).filter("id % 3 = 0").select(F.col("id").alias("hotspot_id"), F.lit("unknown").alias("class"), F.array(F.lit("new")).alias("reasons"))
    found = write_back(D.enrichment(spark, sf_dir), labelled)
    return found.select("hotspot_id", "class", F.array_join("reasons", "; ").alias("reason"), "distance_m", "vision_model_version", "landcover_class")


_COVER = "CASE hotspot_id % 3 WHEN 0 THEN 'cropland' WHEN 1 THEN 'built_up' END"


@query(_STORED + f" SELECT hotspot_id, coalesce(landcover_class, {_COVER}) AS landcover_class, CASE WHEN landcover_class IS NOT NULL THEN NULL WHEN hotspot_id % 3 = 2 THEN 'provider error' ELSE 'esri class ' || (4 + hotspot_id % 3) || ' (' || {_COVER} || ')' END AS landcover_note FROM en")
def land_cover_write_back(spark, sf_dir):
    e = D.enrichment(spark, sf_dir)
    i = F.col("hotspot_id")
    answers = e.select(i, F.when(i % 3 != 2, (4 + i % 3).cast("int")).alias("code"), F.when(i % 3 == 2, "provider error").alias("note"))
    return context.put_land_cover(e, answers).select("hotspot_id", "landcover_class", "landcover_note")


@query(_with(HOTSPOTS_SQL) + "SELECT id, source, acq_date FROM h WHERE id IN (SELECT o_orderkey FROM orders)")
def hotspots_by_ids(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return prune.chosen(D.hotspots(spark, sf_dir), ids).select("id", "source", "acq_date")


@query(_MARKS + "SELECT id FROM m WHERE (class IS NULL OR class NOT IN ('gas_flare', 'persistent_industrial_source', 'industrial_fire')) AND (vision OR inside OR near) AND id > 200 AND id <= 700")
def candidates_in_range(spark, sf_dir):
    h, e = _known(spark, sf_dir)
    return prune.candidates(h, e, D.facilities(spark, sf_dir), after=200, upto=700)


@query(
    _ALL + f""", v AS (SELECT {_REF} AS ref, class, (({_REF}) = 'positive' AND class <> 'unknown') OR (({_REF}) = 'negative' AND class = 'unknown') AS good FROM c)
    SELECT count(*) AS total_evaluated, count(*) FILTER (ref = 'positive') AS ref_positive, count(*) FILTER (ref = 'negative') AS ref_negative, count(*) FILTER (ref = 'uncertain') AS ref_uncertain, count(*) FILTER (good) AS agreement,
    {round_sql("CAST(count(*) FILTER (good) AS DOUBLE) / count(*) FILTER (ref <> $$uncertain$$)", 4)} AS accuracy_decided,
    (SELECT string_agg(ref || '/' || class || '=' || n, ', ' ORDER BY ref, class) FROM (SELECT ref, class, count(*) AS n FROM v GROUP BY ALL)) AS confusion, (SELECT string_agg(class || '=' || n, ', ' ORDER BY class) FROM (SELECT class, count(*) AS n FROM v GROUP BY ALL)) AS by_class,
    (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM c WHERE ({_REF}) = 'negative' AND class <> 'unknown' ORDER BY id LIMIT 10)) AS fp FROM v"""
)
def validation_report(spark, sf_dir):
    pair = lambda k, v: F.concat(k, F.lit("="), v.cast("string"))
    flat = F.flatten(F.transform(F.map_entries("confusion"), lambda r: F.transform(F.map_entries(r["value"]), lambda c: F.concat(r["key"], F.lit("/"), pair(c["key"], c["value"])))))
    counts = F.transform(F.map_entries("predicted_class_counts"), lambda c: pair(c["key"], c["value"]))
    ids = F.array_join(F.transform("false_positives_samples", lambda r: r["id"].cast("string")), ",")
    return C.report(classified(spark, sf_dir)).select(
        "total_evaluated", "ref_positive", "ref_negative", "ref_uncertain", "agreement", "accuracy_decided", F.array_join(flat, ", ").alias("confusion"), F.array_join(counts, ", ").alias("by_class"), F.nullif(ids, F.lit("")).alias("fp"),
    )


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
