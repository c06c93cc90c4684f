"""The domain's tables out of the driver's: detections from events, facilities from supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    i = F.col("event_id")
    who = F.when(i % 4 == 0, i).otherwise(F.col("user_id"))
    place = lambda base, factor, span, step: (F.lit(base) + (who * factor) % span + (i * step) % 120).cast("double") / F.lit(10000.0)
    return e.select(
        i.alias("id"), F.when(i % 2 == 0, "VIIRS_NOAA20_NRT").otherwise("VIIRS_NOAA21_NRT").alias("source"), F.lit("VIIRS").alias("satellite"),
        ts.cast("date").alias("acq_date"), (F.hour(ts) * 100 + F.minute(ts)).alias("acq_time"), F.date_trunc("minute", ts).alias("dt"), F.col("value").alias("frp"),
        F.when(i % 3 == 0, "N").otherwise("D").alias("daynight"), place(60000, 7919, 320000, 31).alias("latitude"), place(680000, 104729, 300000, 17).alias("longitude"),
        F.when(i % 11 == 0, (i % 100).cast("double") / F.lit(100.0)).alias("vision_industrial_prob"),
    )


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    kind = F.when(k % 5 == 0, "refinery").when(k % 5 == 1, "thermal_power_plant").when(k % 5 == 2, "steel_or_metal").when(k % 5 == 3, "industrial_area").otherwise("mining")
    lat = (F.lit(60000) + (k * 7919) % 320000 + (k % 7) * 90).cast("double") / F.lit(10000.0)
    lon = (F.lit(680000) + (k * 104729) % 300000).cast("double") / F.lit(10000.0)
    return _table(spark, sf_dir, "supplier").select(k.alias("fid"), F.col("s_name").alias("fname"), kind.alias("ftype"), F.when(k % 3 == 0, F.lit(0.02)).alias("half_deg"), lat.alias("flat"), lon.alias("flon"))


#: Corners of the polygons around facilities, in ten-thousandths of a degree (lon, lat): an L.
CORNERS = ((-4000, -4000), (4000, -4000), (4000, 0), (0, 0), (0, 4000), (-4000, 4000), (-4000, -4000))


def polygon_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facilities with a polygon each, out of its WKT."""
    from emberline.functions.geo import rings_of

    at = lambda c, d: F.format_string("%.4f", (F.round(F.col(c) * 10000) + d) / 10000)
    wkt = F.concat(F.lit("POLYGON(("), F.concat_ws(", ", *[F.concat_ws(" ", at("flon", x), at("flat", y)) for x, y in CORNERS]), F.lit("))"))
    return facilities(spark, sf_dir).drop("half_deg").withColumn("rings", rings_of(wkt))


#: Shapes by fid % 4, each a list of rings, in hundred-thousandths of a degree (lon, lat) around a facility: a square with a hole,
#: two parts of which one has a hole, a slanted ring, one of 300 km. The odd ends keep corners off the places of detections.
_RING = lambda *p: (*p, p[0])
SHAPES = (
    (_RING((-40005, -40005), (40005, -30005), (40005, 40005), (-40005, 40005)), _RING((-20005, -20005), (20005, -20005), (20005, 20005), (-20005, 20005))),
    (_RING((-60005, -10005), (-10005, -10005), (-10005, 50005), (-60005, 50005)), _RING((-40005, 5005), (-20005, 5005), (-20005, 30005)), _RING((20005, -50005), (80005, -40005), (30005, 20005))),
    (_RING((-90005, -30005), (10005, -50005), (95005, 5005), (0, 45005), (5, 15)),),
    (_RING((-135005, -135005), (135005, -125005), (120005, 135005), (15, 90005), (-135005, 130005)),),
)
#: Degrees by which detections and facilities are moved, so that they lie on both sides of the date line.
AHEAD = 97


def _moved(lon):
    """A longitude moved ahead and brought back to one turn, to five places."""
    return (F.pmod(F.round(lon * 100000).cast("long") + AHEAD * 100000 + 18000000, F.lit(36000000)) - 18000000).cast("double") / F.lit(100000.0)


def moved_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotspots(spark, sf_dir).withColumn("longitude", _moved(F.col("longitude")))


def shaped_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facilities around the date line, each with the polygon or polygons of its number, out of WKT."""
    from emberline.functions.geo import rings_of

    x, y = F.round(F.col("flon") * 100000).cast("long"), F.round(F.col("flat") * 100000).cast("long")
    lon = lambda d: F.format_string("%.5f", (F.pmod(x + d + AHEAD * 100000 + 18000000, F.lit(36000000)) - 18000000) / 100000.0)
    ring = lambda points: F.concat(F.lit("("), F.concat_ws(", ", *[F.concat_ws(" ", lon(a), F.format_string("%.5f", (y + b) / 100000.0)) for a, b in points]), F.lit(")"))
    polygon = lambda rings: F.concat(F.lit("("), F.concat_ws(", ", *map(ring, rings)), F.lit(")"))
    wkt = [
        F.concat(F.lit("POLYGON"), polygon(SHAPES[0])), F.concat(F.lit("MULTIPOLYGON("), polygon(SHAPES[1][:2]), F.lit(", "), polygon(SHAPES[1][2:]), F.lit(")")),
        F.concat(F.lit("POLYGON"), polygon(SHAPES[2])), F.concat(F.lit("POLYGON"), polygon(SHAPES[3])),
    ]
    chosen = F.element_at(F.array(*wkt), (F.col("fid") % 4 + 1).cast("int"))
    # Texts are made and read in many tasks, however few files the suppliers lie in.
    return facilities(spark, sf_dir).drop("half_deg").repartition(spark.sparkContext.defaultParallelism, "fid").withColumns({"rings": rings_of(chosen), "flon": _moved(F.col("flon"))})


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as the feed sends them: texts, some of them bad, every tenth twice."""
    h = hotspots(spark, sf_dir)
    i = F.col("id")
    rows = h.select(
        F.when(i % 97 == 0, "abc").otherwise(F.col("latitude").cast("string")).alias("latitude"), F.when(i % 83 == 0, "181").otherwise(F.col("longitude").cast("string")).alias("longitude"),
        F.date_format("acq_date", "yyyy-MM-dd").alias("acq_date"), F.when(i % 89 == 0, "2370").otherwise(F.col("acq_time").cast("string")).alias("acq_time"), "satellite",
        F.lit("").alias("instrument"), F.lit("n").alias("confidence"), F.lit("2.0NRT").alias("version"), F.col("frp").cast("string").alias("frp"), "daynight", "source", "id",
    )
    return rows.unionByName(rows.filter(i % 10 == 0))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each source and day."""
    h = hotspots(spark, sf_dir)
    return h.groupBy("source", F.col("acq_date").alias("date_from")).agg(F.count("*").alias("returned"), F.max("dt").alias("finished_at")).select(
        F.lit("firms").alias("kind"), "source", F.lit("world").alias("bbox"), "date_from", F.lit(1).alias("days"), "returned", F.col("returned").alias("inserted"), F.lit(0).cast("long").alias("duplicates"),
        F.lit(0).cast("long").alias("invalid"), F.when(F.day("date_from") % 7 == 0, "failed").otherwise("success").alias("status"), F.lit(None).cast("string").alias("error"), "finished_at",
    )


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("worker_id")).agg(F.max(F.col("ts").cast("timestamp")).alias("last_heartbeat_at"), F.count("*").alias("cycle_count"))


def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored enrichment of four in five detections: some with vision, some with land cover."""
    i = F.col("id")
    label = F.when(i % 4 == 0, "gas_flare").when(i % 4 == 1, "unknown").when(i % 4 == 2, "industrial_fire")
    return hotspots(spark, sf_dir).filter(i % 5 != 0).select(
        i.alias("hotspot_id"), label.alias("class"), F.array(F.lit("old")).alias("reasons"), F.col("dt").alias("enriched_at"), F.col("frp").alias("distance_m"), "vision_industrial_prob",
        F.when(i % 11 == 0, "v1").alias("vision_model_version"), F.when(i % 7 == 0, "cropland").alias("landcover_class"), F.lit(None).cast("map<string,string>").alias("landcover_fracs"), F.lit(None).cast("string").alias("landcover_note"),
    )


def query_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facilities(spark, sf_dir).filter(F.col("fid") % 4 == 0)
    return f.select(F.col("flat").alias("center_lat"), F.col("flon").alias("center_lon"), F.lit(32000.0).alias("radius_m"))


def registries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(plants of one registry from part, of the other from supplier a little aside), as parsed rows."""
    fuels = F.array(*[F.lit(x) for x in ("Coal", "Gas", "Oil", "Hydro", "Biomass", "Solar", "Waste", "Petcoke")])
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    place = lambda base, k, factor, span, extra: (F.lit(base) + (k * factor) % span + extra).cast("double") / F.lit(10000.0)
    a = _table(spark, sf_dir, "part").select(
        F.lit("wri").alias("osm_type"), p.alias("osm_id"), F.col("p_name").alias("name"), F.lit("thermal_power_plant").alias("facility_type"), F.get(fuels, (p % 8).cast("int")).alias("fuel"),
        place(60000, p % 150, 7919, 320000, p % 5).alias("latitude"), place(680000, p % 150, 104729, 300000, p % 3).alias("longitude"),
    )
    b = _table(spark, sf_dir, "supplier").select(
        F.lit("way").alias("osm_type"), s.alias("osm_id"), F.col("s_name").alias("name"), F.lit("thermal_power_plant").alias("facility_type"), F.get(fuels, (s % 8).cast("int")).alias("fuel"),
        place(60000, s, 7919, 320000, s % 50).alias("latitude"), place(680000, s, 104729, 300000, s % 40).alias("longitude"),
    )
    return a, b


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tags): map tags of every kind from part."""
    k = F.col("p_partkey")
    one = lambda key, n, *values: F.struct(F.lit(key).alias("key"), F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int")).alias("value"))
    pairs = F.array(
        one("industrial", 13, "refinery", "gas", "chemical", "steel", "mine", "lpg", "timber"), one("landuse", 11, "industrial", "quarry", "forest"), one("man_made", 7, "works"),
        one("power", 5, "plant"), one("plant:source", 6, "Coal", "biogas", "hydro", "geothermal"), one("product", 17, "LNG", "steel"),
    )
    return _table(spark, sf_dir, "part").select(k.alias("id"), F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("tags"))


def map_objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways): an order is a way, its lines point at customers' places; every third is closed."""
    c = F.col("c_custkey")
    nodes = _table(spark, sf_dir, "customer").select(c.alias("id"), ((F.lit(60000) + (c * 7919) % 320000).cast("double") / F.lit(10000.0)).alias("lat"), ((F.lit(680000) + (c * 104729) % 300000).cast("double") / F.lit(10000.0)).alias("lon"), F.create_map(F.lit("industrial"), F.lit("refinery")).alias("tags"))
    n = F.greatest(F.lit(1), F.max("l_linenumber"))
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 1500 + 1).alias("ref")))).alias("x"), n.alias("n"))
    refs = F.transform("x", lambda e: e["ref"])
    closed = F.when(F.col("id") % 3 == 0, F.concat(refs, F.array(F.get(refs, 0)))).otherwise(refs)
    return nodes, lines.select("id", closed.alias("refs"), F.create_map(F.lit("landuse"), F.lit("industrial")).alias("tags"))


HOTSPOTS_SQL = """h AS (
  SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'VIIRS_NOAA20_NRT' ELSE 'VIIRS_NOAA21_NRT' END AS source, 'VIIRS' AS satellite,
    CAST(ts AS DATE) AS acq_date, CAST(hour(ts) * 100 + minute(ts) AS INTEGER) AS acq_time, date_trunc('minute', ts) AS dt, value AS frp,
    CASE WHEN event_id % 3 = 0 THEN 'N' ELSE 'D' END AS daynight,
    CAST(60000 + ((CASE WHEN event_id % 4 = 0 THEN event_id ELSE user_id END) * 7919) % 320000 + (event_id * 31) % 120 AS DOUBLE) / CAST(10000 AS DOUBLE) AS latitude,
    CAST(680000 + ((CASE WHEN event_id % 4 = 0 THEN event_id ELSE user_id END) * 104729) % 300000 + (event_id * 17) % 120 AS DOUBLE) / CAST(10000 AS DOUBLE) AS longitude,
    CASE WHEN event_id % 11 = 0 THEN CAST(event_id % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END AS vision_industrial_prob
  FROM events)"""
FACILITIES_SQL = """f AS (
  SELECT s_suppkey AS fid, s_name AS fname,
    CASE s_suppkey % 5 WHEN 0 THEN 'refinery' WHEN 1 THEN 'thermal_power_plant' WHEN 2 THEN 'steel_or_metal' WHEN 3 THEN 'industrial_area' ELSE 'mining' END AS ftype,
    CASE WHEN s_suppkey % 3 = 0 THEN CAST(0.02 AS DOUBLE) END AS half_deg,
    CAST(60000 + (s_suppkey * 7919) % 320000 + (s_suppkey % 7) * 90 AS DOUBLE) / CAST(10000 AS DOUBLE) AS flat,
    CAST(680000 + (s_suppkey * 104729) % 300000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS flon
  FROM supplier)"""


def metres_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    half = lambda a, b: f"sin(radians({b} - {a}) / 2) * sin(radians({b} - {a}) / 2)"
    return f"(2 * 6371000.0 * asin(least(1.0, sqrt({half(lat1, lat2)} + cos(radians({lat1})) * cos(radians({lat2})) * {half(lon1, lon2)}))))"


def round_sql(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(18,6)), {n}) AS DOUBLE)"


ENRICHMENT_SQL = """en AS (
  SELECT id AS hotspot_id, CASE id % 4 WHEN 0 THEN 'gas_flare' WHEN 1 THEN 'unknown' WHEN 2 THEN 'industrial_fire' END AS class, dt AS enriched_at, frp AS distance_m,
    CASE WHEN id % 11 = 0 THEN 'v1' END AS vision_model_version, CASE WHEN id % 7 = 0 THEN 'cropland' END AS landcover_class
  FROM h WHERE id % 5 <> 0)"""
_CLAMP = lambda x, c: f"greatest({c} - coalesce(half_deg, 0), least({c} + coalesce(half_deg, 0), {x}))"
NEAREST_SQL = f"""d AS (
  SELECT h.id, f.fid, f.fname, f.ftype, {metres_sql("latitude", "longitude", _CLAMP("latitude", "flat"), _CLAMP("longitude", "flon"))} AS dist,
    coalesce(abs(latitude - flat) <= half_deg AND abs(longitude - flon) <= half_deg, FALSE) AS inside
  FROM h CROSS JOIN f),
n AS (
  SELECT id, fid AS nearest_facility_id, fname AS nearest_facility_name, ftype AS nearest_facility_type, dist AS raw_m, {round_sql("dist", 1)} AS distance_m, inside AS within_facility
  FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, fid) = 1)"""
_SINCE = lambda days: f"o.dt >= h.dt - INTERVAL {days} DAY"
_MEAN = lambda days: f"coalesce(CAST(sum(CAST(o.frp AS DECIMAL(18,6))) FILTER ({_SINCE(days)}) AS DOUBLE) / nullif(count(o.frp) FILTER ({_SINCE(days)}), 0), 0)"
HISTORY_SQL = f"""p AS (
  SELECT h.id, any_value(h.frp) AS frp, any_value(h.daynight) AS daynight,
    count(o.id) FILTER ({_SINCE(1)}) AS d24, count(o.id) FILTER ({_SINCE(7)}) AS d7, count(o.id) FILTER ({_SINCE(30)}) AS d30,
    count(DISTINCT o.acq_date) FILTER ({_SINCE(30)}) AS active30, {_MEAN(7)} AS mean7, {_MEAN(30)} AS mean30,
    coalesce(max(o.frp) FILTER ({_SINCE(30)}), 0) AS max30, count(o.id) FILTER ({_SINCE(30)} AND o.daynight = 'N') AS night30
  FROM h LEFT JOIN h o ON o.id <> h.id AND o.acq_date >= h.acq_date - 30 AND abs(o.latitude - h.latitude) < 0.01
    AND {metres_sql("h.latitude", "h.longitude", "o.latitude", "o.longitude")} <= 1000
  GROUP BY h.id),
t AS (
  SELECT id, d24 AS detections_24h, d7 AS detections_7d, d30 AS detections_30d, active30 AS days_active_30d, {round_sql("mean7", 2)} AS mean_frp_7d, {round_sql("mean30", 2)} AS mean_frp_30d,
    {round_sql("max30", 2)} AS max_frp_30d, {round_sql("frp / greatest(mean30, CAST(0.1 AS DOUBLE))", 2)} AS current_frp_vs_historical_mean,
    {round_sql("CAST(night30 + CASE WHEN daynight = 'N' THEN 1 ELSE 0 END AS DOUBLE) / CAST(d30 + 1 AS DOUBLE)", 3)} AS nighttime_detection_fraction,
    {round_sql("least(1.0, CAST(d7 AS DOUBLE) / CAST(5 AS DOUBLE))", 2)} AS persistence_score, {round_sql("frp / greatest(mean7, CAST(0.1 AS DOUBLE))", 2)} AS frp_vs_nearby
  FROM p)"""
_GAS = "('oil_gas_facility', 'lng_or_storage_terminal', 'petrochemical', 'refinery', 'thermal_power_plant')"
_SURGE = "current_frp_vs_historical_mean >= 2.5"
CLASS_SQL = f"""c AS (
  SELECT h.*, n.nearest_facility_id, n.nearest_facility_name, n.nearest_facility_type, n.distance_m, n.within_facility, t.* EXCLUDE (id),
    CASE
      WHEN (within_facility OR distance_m <= 1500) AND nearest_facility_type IN {_GAS}
        AND (frp >= 15 OR persistence_score >= 0.5 OR detections_7d >= 3 OR days_active_30d >= 3 OR nighttime_detection_fraction >= 0.6 OR {_SURGE}) THEN 'gas_flare'
      WHEN distance_m <= 5000 AND (detections_7d >= 5 OR days_active_30d >= 3 OR persistence_score >= 0.5) AND NOT ({_SURGE}) THEN 'persistent_industrial_source'
      WHEN (within_facility OR distance_m <= 5000 OR coalesce(vision_industrial_prob >= 0.8, FALSE)) AND (persistence_score < 0.5 OR {_SURGE}) THEN 'industrial_fire'
      ELSE 'unknown' END AS class
  FROM h JOIN n USING (id) JOIN t USING (id))"""

_EDGES = ", ".join(f"({ax}, {ay}, {bx}, {by})" for (ax, ay), (bx, by) in zip(CORNERS, CORNERS[1:]))
_DEGREES = lambda c, d: f"(CAST(round({c} * 10000) + {d} AS DOUBLE) / CAST(10000 AS DOUBLE))"
EDGES_SQL = f"""e AS (
  SELECT fid, fname, ftype, {_DEGREES("flon", "ax")} AS ax, {_DEGREES("flat", "ay")} AS ay, {_DEGREES("flon", "bx")} AS bx, {_DEGREES("flat", "by_")} AS by_
  FROM f, (VALUES {_EDGES}) t(ax, ay, bx, by_)),
x AS (
  SELECT id, fid, latitude, longitude, fname, ftype, ax, ay, bx, by_, (ax - longitude) * cos(radians(latitude)) AS px, ay - latitude AS py, (bx - ax) * cos(radians(latitude)) AS dx, by_ - ay AS dy,
    (ay > latitude) <> (by_ > latitude) AND longitude < (bx - ax) * (latitude - ay) / nullif(by_ - ay, 0) + ax AS crossed
  FROM h, e),
y AS (SELECT *, greatest(0, least(1, -(px * dx + py * dy) / (dx * dx + dy * dy))) AS t FROM x),
s AS (
  SELECT id, fid, any_value(fname) AS fname, any_value(ftype) AS ftype, count(*) FILTER (crossed) % 2 = 1 AS inside,
    min({metres_sql("latitude", "longitude", "(ay + t * dy)", "(ax + t * (bx - ax))")}) AS edge_m
  FROM y GROUP BY id, fid)"""

_SHAPE_EDGES = ", ".join(f"({k}, {g}, {ax}, {ay}, {bx}, {by})" for k, rings in enumerate(SHAPES) for g, r in enumerate(rings) for (ax, ay), (bx, by) in zip(r, r[1:]))
#: Edges before they are brought back to one turn: a plain plane, in which the date line is no place of its own.
SHAPES_SQL = f"""e AS (
  SELECT fid, g, fname, ftype, CAST(round(flon * 100000) + ax AS DOUBLE) / 100000 AS ax, CAST(round(flat * 100000) + ay AS DOUBLE) / 100000 AS ay,
    CAST(round(flon * 100000) + bx AS DOUBLE) / 100000 AS bx, CAST(round(flat * 100000) + by_ AS DOUBLE) / 100000 AS by_
  FROM f JOIN (VALUES {_SHAPE_EDGES}) t(k, g, ax, ay, bx, by_) ON k = fid % 4),
s AS (
  SELECT id, fid FROM h JOIN e ON (ay > latitude) <> (by_ > latitude) AND longitude < (bx - ax) * (latitude - ay) / nullif(by_ - ay, 0) + ax
  GROUP BY id, fid HAVING count(*) % 2 = 1)"""
