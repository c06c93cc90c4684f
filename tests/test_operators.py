import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberline import schemas
from emberline.config import History, Screen
from emberline.operators import classify as C
from emberline.operators import context, enrich, facilities, ingest, prune, serve

RAW = "latitude string, longitude string, acq_date string, acq_time string, satellite string, instrument string, confidence string, version string, bright_ti4 string, bright_ti5 string, frp string, daynight string"


def raw(spark, *rows):
    return spark.createDataFrame([(*r, "VIIRS", "750m", "n", "2.0NRT", "300", "290", "5.5", "D") for r in rows], RAW)


def test_row_validation(spark):
    rows = [("23.8", "78.3", "2026-09-06", "1235"), ("abc", "78.3", "2026-09-06", "1235"), ("23.8", "181", "2026-09-06", "1235"), ("23.8", "78.3", "2026-13-01", "1235"), ("23.8", "78.3", "2026-09-06", "2370"), ("oops", "no", "fields", "here"), ("nan", "0", "2026-9-6", "5"), ("1", "2", "2026-9-6", " 7 "), (None, "1", "2026-09-06", "1")]
    df = raw(spark, *rows)
    assert [r[0] for r in df.select(ingest.is_valid(df)).collect()] == [True, False, False, False, False, False, False, True, False]
    p = ingest.parse(df.withColumn("frp", F.lit("bad")).limit(1), "S").first()
    assert p.frp is None and p.acq_time == 1235 and p.acq_date == dt.date(2026, 9, 6) and p.source == "S" and p.scan is None


def test_insert_is_idempotent_and_null_safe(spark):
    rows = [("1.00001", "2", "2026-09-06", "1"), ("1.00002", "2", "2026-09-06", "1"), ("3", "4", "2026-09-06", "1")]
    batch = ingest.parse(raw(spark, *rows), "S").withColumn("satellite", F.lit(None).cast("string"))
    empty = spark.createDataFrame([], schemas.HOTSPOTS)
    fresh = ingest.with_ids(ingest.new_rows(batch, empty), empty)
    assert sorted(r.id for r in fresh.collect()) == [1, 2]
    assert ingest.new_rows(batch, fresh).count() == 0
    counts = ingest.ingest_counts(raw(spark, *rows, ("x", "1", "1", "1")), empty.limit(0), "S").first()
    assert tuple(counts) == (4, 2, 1, 1)


@pytest.mark.parametrize("rows, cells, cfg, want", [
    ([(10.0, 20.0, 1.0)] * 2 + [(1.0, 1.0, 1.0)], [], Screen(), {"kept": 0, "in_day": 2}),
    ([(10.0, 20.0, 100.0), (10.5, 20.0, 5.0)], [], Screen(frp_mw=50.0), {"frp": 1}),
    ([(10.0 + i, 20.0, float(i + 1)) for i in range(10)], [], Screen(), {"frp": 2}),
    ([(10.005, 20.005, 1.0), (80.0, 0.0, 1.0)], [(10.0, 20.0)], Screen(), {"kept": 1}),
    ([(10.5, 20.5, 1.0)] * 2, [(10.0, 20.0)], Screen(), {"kept": 0, "in_day": 2}),
    ([(10.03, 20.0, 1.0)], [(10.0, 20.0)], Screen(reach_m=5000), {"kept": 1}),
    ([(10.03, 20.0, 1.0)], [(10.0, 20.0)], Screen(reach_m=2000), {"kept": 0, "dropped": 1}),
])
def test_screening(spark, rows, cells, cfg, want):
    df = spark.createDataFrame([("S", *r) for r in rows], "source string, latitude double, longitude double, frp double")
    sites = ingest.facility_cells(spark.createDataFrame([(float(a), float(b)) for a, b in cells], "flat double, flon double"))
    prior = ingest.prior_cells(spark.createDataFrame([], "source string, acq_date date, latitude double, longitude double"), F.lit("2026-01-01").cast("date"))
    found = ingest.screen_stats(ingest.screen(df, sites, prior, cfg)).first()
    assert {k: found[k] for k in want} == want


VECTORS = [
    # frp, dist, within, type, persistence, d7, active30, ratio, night, vision (industrial, flare), label
    (40.0, 200.0, False, "oil_gas_facility", 0.8, 6, 5, None, None, None, None, "gas_flare"),
    (5.0, 200.0, False, "refinery", 0.0, 4, 0, 1.2, 0.85, None, None, "gas_flare"),
    (40.0, 0.0, True, "steel_or_metal", 0.1, 0, 0, 8.0, None, None, None, "industrial_fire"),
    (25.0, 0.0, True, "steel_or_metal", 0.8, 7, 6, 1.1, None, None, None, "persistent_industrial_source"),
    (8.0, 4000.0, False, "general_factory", 0.9, 8, 5, 1.0, None, None, None, "persistent_industrial_source"),
    (6.0, 2700.0, False, "mining", 0.0, 0, 0, None, None, None, None, "industrial_fire"),
    (12.0, 120000.0, False, None, 0.6, 4, 2, None, None, None, None, "unknown"),
    (10.0, None, False, None, 0.0, 0, 0, None, None, None, None, "unknown"),
    (10.0, None, False, None, 0.0, 0, 0, None, None, 0.92, None, "industrial_fire"),
    (2.0, 300.0, False, "oil_gas_facility", 0.1, 0, 0, None, None, None, 0.71, "gas_flare"),
    (12.0, 120000.0, False, None, 0.6, 4, 2, 1.3, 0.3, None, None, "unknown"),
    (5.0, None, False, None, None, None, None, None, None, None, None, "unknown"),
]


def test_rule_chain_and_reasons(spark):
    schema = "i int, frp double, distance_m double, within_facility boolean, nearest_facility_type string, persistence_score double, detections_7d long, days_active_30d long, current_frp_vs_historical_mean double, nighttime_detection_fraction double, vision_industrial_prob double, vision_flare_prob double"
    df = spark.createDataFrame([(i, *v[:-1]) for i, v in enumerate(VECTORS)], schema).withColumn("nearest_facility_name", F.when(F.col("i") == 0, " Site A "))
    found = C.classify(df).orderBy("i").collect()
    assert [r["class"] for r in found] == [v[-1] for v in VECTORS]
    assert found[0].reasons == ['gas-flare candidate site "Site A" (oil_gas_facility)', "FRP 40.0 >= 15 (bright)", "6 detections in 7 d, 5 active days in 30 d (recurrent)", "persistence 0.80 (6 detections in 7 d)"]
    assert found[2].reasons == ["hotspot lies inside steel_or_metal polygon", "FRP 40.0 is 8.0x the 30-d mean (sudden event)", "FRP 40.0 >= 15 (bright)"]
    assert found[4].reasons == ["within 4,000 m of general_factory", "8 detections in 7 d, 5 active days in 30 d", "FRP is steady relative to the historical mean (ratio 1.0)"]
    assert found[6].reasons == ["nearest known industrial facility is 120,000 m away"]
    assert found[8].reasons == ["new detection (0 prior detections in 7 d)", "vision industrial probability 0.92"]
    assert found[11].reasons == ["no known industrial facility within screening range of this hotspot"]


def hotspots(spark, *rows):
    base = dt.datetime(2026, 1, 20)
    data = [(i, la, lo, (base + dt.timedelta(hours=h)).date(), base + dt.timedelta(hours=h), frp, n) for i, (la, lo, h, frp, n) in enumerate(rows)]
    return spark.createDataFrame(data, "id long, latitude double, longitude double, acq_date date, dt timestamp, frp double, daynight string")


def test_history_counts_past_and_future_unless_causal(spark):
    h = hotspots(spark, (10.0, 20.0, 0, 4.0, "D"), (10.001, 20.0, 10, 2.0, "N"), (10.0, 20.001, -100, 3.0, "N"), (10.0, 20.0, -24 * 40, 9.0, "D"), (10.5, 20.0, 0, 1.0, "D"))
    by = {r.id: r for r in enrich.history_features(h).collect()}
    assert (by[0].detections_24h, by[0].detections_7d, by[0].detections_30d, by[0].days_active_30d) == (1, 2, 2, 2)
    assert by[0].mean_frp_30d == 2.5 and by[0].max_frp_30d == 3.0 and by[0].current_frp_vs_historical_mean == 1.6 and by[0].nighttime_detection_fraction == 0.667
    assert by[4].detections_30d == 0 and by[4].current_frp_vs_historical_mean == 10.0
    assert {r.id: r for r in enrich.history_features(h, cfg=History(causal=True)).collect()}[0].detections_24h == 0


def test_nearest_in_rings_of_search(spark):
    h = hotspots(spark, (10.0, 20.0, 0, 1.0, "D"), (10.0, 29.0, 0, 1.0, "D"), (-10.0, -160.0, 0, 1.0, "D"), (10.05, 20.05, 0, 1.0, "D"))
    ring = [[(20.0, 10.0), (20.1, 10.0), (20.1, 10.1), (20.0, 10.1), (20.0, 10.0)]]
    sites = spark.createDataFrame([(1, "a", "refinery", 10.0, 20.001, None), (2, "b", "mining", 10.05, 20.05, ring)], "fid long, fname string, ftype string, flat double, flon double, rings array<array<struct<lon:double,lat:double>>>")
    by = {r.id: r for r in enrich.nearest_facility(h, sites).collect()}
    assert by[0].nearest_facility_id in (1, 2) and by[1].nearest_facility_id == 2 and by[2].distance_m > 10_000_000 and by[3].within_facility and by[3].distance_m == 0
    capped = {r.id: r for r in enrich.nearest_facility(h, sites, 5000.0).collect()}
    assert capped[1].nearest_facility_id is None and capped[1].distance_m is None and not capped[1].within_facility
    assert all(r.distance_m is None for r in enrich.nearest_facility(h, sites.limit(0)).collect())


def test_large_pages_are_cut_by_counts(spark, monkeypatch):
    """Any limit gives what one sort of everything gives, page after page; no task sorts or numbers more than a minute."""
    import random

    rng = random.Random(6)
    data = [(i, rng.choice([None, "a", "b", "gas_flare"]), dt.date(2026, 1, rng.randrange(1, 4)), rng.choice([0, 5, 1200])) for i in range(400)]
    rows = spark.createDataFrame(data, "id long, class string, acq_date date, acq_time int")
    want = sorted(data, key=lambda r: (r[1] is None, r[1] or "", -r[2].toordinal(), -r[3], r[0]))
    monkeypatch.setattr(serve, "SMALL_PAGE", 0)
    for limit in (1, 37, 133, 399, 400, 1000):
        assert [tuple(r) for r in serve.page(rows, limit=limit).collect()] == want[:limit]
    got, key = [], None
    while batch := serve.page(rows, limit=90, after=key).collect():
        got += map(tuple, batch)
        key = (batch[-1]["class"], *batch[-1][2:4], batch[-1].id)
    assert got == want and serve.page(rows.limit(0), limit=90).count() == 0
    plan = serve.page(rows, limit=200)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "TakeOrdered" not in plan and "GlobalLimit" not in plan and "SinglePartition" not in plan


def test_prune_and_candidates(spark):
    h = hotspots(spark, (10.0, 20.0, 0, 1.0, "D"), (10.0, 20.01, 0, 1.0, "D"), (50.0, 20.0, 0, 1.0, "D"), (51.0, 20.0, 0, 1.0, "D"), (52.0, 20.0, 0, 1.0, "D"))
    e = spark.createDataFrame([(0, "unknown", None), (2, "gas_flare", None), (3, "unknown", 0.9)], "hotspot_id long, class string, vision_industrial_prob double")
    sites = spark.createDataFrame([(1, "a", "refinery", 10.0, 20.0)], "fid long, fname string, ftype string, flat double, flon double")
    assert {r.id: r.disposition for r in prune.disposition(h, e, sites).collect()} == {0: "keep_near", 1: "unclassified_near", 2: "keep_forever", 3: "keep_near", 4: "delete"}
    assert sorted(r.id for r in prune.candidates(h, e, sites).collect()) == [0, 1, 3]
    rows, known = prune.prune(h, e, sites)
    assert sorted(r.id for r in rows.collect()) == [0, 1, 2, 3] and known.count() == 3
    assert tuple(prune.id_range(h.limit(0)).first()) == (None, None, 0)


def test_serving(spark):
    rows = hotspots(spark, (10.0, 179.5, 0, 1.0, "D"), (10.0, -179.5, 30, 3.0, "D"), (10.1, 0.0, 0, 2.0, "D")).withColumns({"source": F.lit("S"), "acq_time": F.lit(5), "class": F.when(F.col("id") == 2, "gas_flare"), "nearest_facility_name": F.lit(None).cast("string")})
    assert [r.id for r in serve.page(rows).collect()] == [2, 1, 0]
    assert sorted(r.id for r in serve.page(rows, serve.Filters(bbox="170,0,-170,20")).collect()) == [0, 1]
    assert [r.id for r in serve.page(rows, serve.Filters(classes=("unclassified",), date_to="2026-01-20")).collect()] == [0]
    cells = serve.grid(rows.withColumn("longitude", F.lit(1.0)), 5.0).collect()
    assert [(r.cell_count, r.id, r.mean_frp, r.max_frp, r.lat, r.lon) for r in cells] == [(3, 1, 2.0, 3.0, 12.5, 2.5)]
    assert '"nearest_facility_name":null' in serve.detail(rows, 1).first().feature and serve.detail(rows, 77).count() == 0
    for bad in (lambda: serve.check_page(0), lambda: serve.check_page(1, 9.0), lambda: serve.Filters(date_from="2026-02-01", date_to="2026-01-01"), lambda: serve.Filters(bbox="1,2,3"), lambda: serve.Filters(date_from="x")):
        with pytest.raises(ValueError):
            bad()


def test_upsert_and_registries(spark):
    now = F.lit("2026-02-01 00:00:00").cast("timestamp")
    wri = spark.createDataFrame([("IND", "P1", "IND001", "10", "23.0", "78.0", "Coal", None, None, None, None), ("IND", "P2", "IND002", "10", "x", "78.0", "Coal", None, None, None, None), ("IND", "P3", "IND003", "1", "1", "2", "Solar", None, None, None, None)], "country string, name string, gppd_idnr string, capacity_mw string, latitude string, longitude string, primary_fuel string, commissioning_year string, owner string, wepp_id string, url string")
    osmpp = spark.createDataFrame([("way/5", "Q", "India", "Hard Coal", None, "9", None, "23.001", "78.001"), ("x", "R", "India", "Oil", None, "9", None, "23", "78")], "id string, Name string, Country string, Fueltype string, Technology string, Capacity string, DateIn string, lat string, lon string")
    both = facilities.registries(wri, osmpp)
    assert sorted(r.osm_type for r in both.collect()) == ["way", "wri"]
    a, b = facilities.from_wri(wri), facilities.from_osm_powerplants(osmpp)
    dup = facilities.cross_source_duplicates(a, b).collect()
    assert [(r.dup_type, r.dup_id) for r in dup] == [("way", 5)] and 100 < dup[0].dup_m < 200
    stored = spark.createDataFrame([], schemas.FACILITIES)
    batch = b.drop("fuel", "country").withColumn("geometry", F.lit(None).cast("string"))
    one = facilities.upsert(stored, batch, now)
    assert one.first().was_inserted and one.first().first_seen_at == dt.datetime(2026, 2, 1)
    later = facilities.upsert(one.drop("was_inserted"), batch.withColumn("name", F.lit(None).cast("string")), F.lit("2026-03-01 00:00:00").cast("timestamp")).first()
    assert not later.was_inserted and later.name == "Q" and later.first_seen_at == dt.datetime(2026, 2, 1) and later.updated_at == dt.datetime(2026, 3, 1)
    twice = batch.withColumn("o", F.lit(1)).unionByName(batch.withColumn("name", F.lit("last")).withColumn("o", F.lit(2)))
    assert [r.name for r in facilities.last_of_each(twice, "o").collect()] == ["last"]


def test_context_land_cover_and_telemetry(spark):
    h = hotspots(spark, (10.0, 20.0, 0, 1.0, "D"), (12.0, 20.0, 0, 1.0, "D"), (12.01, 20.0, 0, 1.0, "D")).withColumn("acq_time", F.lit(1))
    cache = spark.createDataFrame([(10.1, 20.0, 1000.0, 0, None)], schemas.QUERY_CACHE)
    assert [r.id for r in context.uncovered(h, cache).collect()] == [1, 2]
    assert context.is_covered(spark, cache, 10.0, 20.0) and not context.is_covered(spark, cache, 13.0, 20.0)
    done, found, failures = context.refresh_context(spark, h, cache, lambda *a: ["f"])
    assert len(done) == 1 and found == ["f"] and failures == 0

    def broken(*a):
        raise RuntimeError

    assert context.refresh_context(spark, h, cache, broken, radius_m=500.0, most_failures=2)[2] == 2
    e = spark.createDataFrame([(1, None, None, None), (2, "water", None, None)], "hotspot_id long, landcover_class string, landcover_fracs map<string,string>, landcover_note string")
    out = {r.hotspot_id: r for r in context.put_land_cover(e, spark.createDataFrame([(1, 4), (2, 4)], "hotspot_id long, code int")).collect()}
    assert out[1].landcover_class == "cropland" and out[2].landcover_class == "water"
    assert context.run_row(spark, kind="firms", error="x" * 900).first().error == "x" * 500 and context.run_row(spark, kind="firms", error="").first().error is None
    first = dt.datetime(2026, 1, 1)
    w = context.heartbeat(spark.createDataFrame([], schemas.WORKER_STATUS), worker_id="w", started_at=first, last_heartbeat_at=first, cycle_count=1)
    w = context.heartbeat(w, worker_id="w", started_at=dt.datetime(2026, 1, 2), last_heartbeat_at=dt.datetime(2026, 1, 2), cycle_count=2)
    assert [(r.started_at, r.cycle_count) for r in w.collect()] == [(first, 2)]


def test_nearest_equals_brute_force(spark):
    import math
    import random

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h)))

    dice = random.Random(5)
    somewhere = lambda: (math.degrees(math.asin(dice.uniform(-1, 1))), dice.uniform(-180, 180))
    centres = [(50.0, 8.0), (0.0, 0.0), (89.9, 10.0), (-89.99, 0.0), (10.0, 180.0), (0.0, 90.0)]
    around = lambda c: (max(-90.0, min(90.0, c[0] + dice.gauss(0, 0.4))), (c[1] + dice.gauss(0, 0.4) + 180) % 360 - 180)
    sites = [(k, *(around(dice.choice(centres)) if k % 4 else somewhere())) for k in range(150)]
    points = [(k, *(around(dice.choice(centres)) if k % 3 else somewhere())) for k in range(400)]
    h = spark.createDataFrame(points, "id long, latitude double, longitude double")
    f = spark.createDataFrame(sites, "fid long, flat double, flon double").withColumns({"fname": F.lit("x"), "ftype": F.lit("y")})
    for few in (f, f.filter("fid < 2"), f.filter("fid = 77")):
        kept = {r.fid for r in few.collect()}
        found = {r.id: r for r in enrich.nearest_facility(h, few).collect()}
        assert len(found) == 400
        for k, la, lo in points:
            best = min((metres(la, lo, a, b), fid) for fid, a, b in sites if fid in kept)
            assert found[k].nearest_facility_id == best[1] and abs(found[k].distance_m - best[0]) < 0.2


def test_percentile_is_nearest_rank(spark):
    for values in ([3.0], [1.0, 2.0], [0.0, -5.0, 7.5, 7.5, 100.0, 1e-9], [float(k % 37) / 7 for k in range(400)]):
        rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "frp double")
        for p in (0, 10, 50, 90, 99, 100):
            want = sorted(values)[max(1, -(-len(values) * p // 100)) - 1]
            assert ingest.percentile_threshold(rows, p).first().threshold == want
    assert ingest.percentile_threshold(spark.createDataFrame([], "frp double"), 90).first().threshold is None


def test_upsert_of_a_batch_with_repeated_keys(spark):
    old = spark.createDataFrame([("node", 1, "a", None, None)], "osm_type string, osm_id long, name string, first_seen_at timestamp, updated_at timestamp")
    batch = spark.createDataFrame([("node", 1, "b"), ("node", 1, "c"), ("node", 2, "d"), ("node", 2, "d")], "osm_type string, osm_id long, name string")
    found = facilities.upsert(old, batch, F.lit("2026-01-01").cast("timestamp")).collect()
    assert sorted((r.osm_id, r.name, r.was_inserted) for r in found) == [(1, "c", False), (2, "d", True)]
