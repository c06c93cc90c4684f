import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from emberline import __main__ as cli
from emberline import schemas
from emberline.operators import classify, context, enrich, prune, serve
from emberline.sources import land_cover as lc
from emberline.streaming import worker as W


@pytest.fixture
def service():
    """A land-cover and map service of its own: (address, answers by path)."""
    answers = {"/cover": {"value": 4}, "/odd": [1], "/none": {}, "/map": {"elements": [
        {"type": "node", "id": 1, "lat": 10.0, "lon": 20.0, "tags": {"industrial": "refinery", "name": "R"}},
        {"type": "way", "id": 2, "geometry": [{"lat": 10.0, "lon": 20.0}, {"lat": 10.2, "lon": 20.2}, {"lat": 10.4, "lon": 20.0}], "tags": {"landuse": "industrial"}},
        {"type": "node", "id": 3, "lat": 10.0, "lon": 20.0, "tags": {"shop": "x"}},
    ]}}
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200 if self.path in answers else 503)
            self.end_headers()
            self.wfile.write(json.dumps(answers.get(self.path)).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_land_cover_service(service, monkeypatch):
    base, seen = service
    on = lambda path, **k: lc.LandCover("esri", True, base + path, **k)
    assert on("/cover").identify(1.0, 2.0) == (4, None) and json.loads(seen[-1])["geometry"] == {"x": 2.0, "y": 1.0, "spatialReference": {"wkid": 4326}}
    assert on("/none").identify(1.0, 2.0) == (None, "no class value in response")
    assert on("/gone").identify(1.0, 2.0)[1].startswith("provider error: HTTPError") and on("/odd").identify(1.0, 2.0)[0] is None
    assert on("/cover").probe() == (True, "class 4 at 48.2, 11.5")
    assert not on("/odd").probe()[0] and not on("/gone").probe()[0]
    assert lc.LandCover().identify(1.0, 2.0) == (None, "land cover disabled") and lc.LandCover().status()["configured"] is False
    assert lc.LandCover("other", True).identify(1.0, 2.0) == (None, "unsupported provider other") and lc.LandCover("other", True).status()["ok"] is None
    asked = len(seen)
    assert on("/cover").status(lambda: 1000.0)["ok"] and on("/cover").status(lambda: 1299.0)["ok"] and len(seen) == asked + 1
    assert on("/cover").status(lambda: 1301.0)["ok"] and len(seen) == asked + 2
    monkeypatch.setenv("LAND_COVER", "1")
    assert not lc.LandCover.from_env().enabled
    monkeypatch.setenv("LAND_COVER_PROVIDER", "ESRI")
    assert lc.LandCover.from_env().enabled


def _filled(spark, tmp_path):
    s = W.Store(spark, str(tmp_path / "store"))
    raw = spark.createDataFrame([(str(10 + k), "20", "2026-09-06", str(k)) + ("x",) * 10 for k in range(3)], schemas.RAW_DETECTION)
    assert W.run_cycle(s, raw, "VIIRS_NOAA20_NRT")["inserted"] == 3
    return s


def test_land_cover_write_back(spark, tmp_path, service):
    s = _filled(spark, tmp_path)
    W.refresh_land_cover(s, lc.LandCover())
    assert s.read("enrichment").filter("landcover_class IS NOT NULL").isEmpty()
    W.refresh_land_cover(s, lc.LandCover("esri", True, service[0] + "/gone"), limit=1)
    assert [r.landcover_note[:14] for r in s.read("enrichment").filter("landcover_note IS NOT NULL").collect()] == ["provider error"]
    W.refresh_land_cover(s, lc.LandCover("esri", True, service[0] + "/cover"))
    assert {(r.landcover_class, r.landcover_note, r.landcover_fracs["dominant_class"]) for r in s.read("enrichment").collect()} == {("cropland", "esri class 4 (cropland)", "cropland")}
    assert s.read("enrichment").count() == 3


def test_map_refresh_and_commands(spark, tmp_path, service, monkeypatch):
    s = _filled(spark, tmp_path)
    run = lambda *a: cli.run(spark, [a[0], "--store", s.folder, *a[1:]])
    assert run("map", "--mirror", service[0] + "/map") == {"asked": 3, "facilities": 6, "failures": 0}
    assert {(r.osm_type, r.osm_id, r.facility_type) for r in s.read("facilities").collect()} == {("node", 1, "refinery"), ("way", 2, "industrial_area")}
    assert s.read("query_cache").count() == 3 and run("map", "--mirror", service[0] + "/map")["asked"] == 0
    files = tmp_path / "in.csv"
    files.write_text("acq_time,latitude,longitude,acq_date\n7,10,20,2026-09-07\n")
    found = run("ingest", "--files", str(files), "--source", "VIIRS_NOAA20_NRT")
    assert found["VIIRS_NOAA20_NRT"]["inserted"] == 1
    page = run("page", "--date-from", "2026-09-06", "--limit", "2")
    assert page["count"] == 2 and page["TotalFeatures"] == page["numberMatched"] == 4 and page["truncated"] and page["resolution"] is None
    assert page["features"][0]["properties"]["acq_date"] == "2026-09-07"
    grid = run("page", "--resolution", "5")
    assert grid["count"] == 1 and grid["features"][0]["properties"]["cell_count"] == 4 and grid["features"][0]["geometry"]["coordinates"] == [22.5, 12.5]
    assert run("page", "--class", "nothing")["features"] == []
    health = run("health")
    assert health["status"] == "ok" and health["total_hotspots"] == 4 and health["sources_used"] == ["VIIRS_NOAA20_NRT"] and not health["worker"]["configured"]
    assert run("report")["total_evaluated"] == 4 and run("report", "--out", str(tmp_path / "report")) == {"written": str(tmp_path / "report")}
    assert spark.read.json(str(tmp_path / "report")).first().total_evaluated == 4
    assert run("prune") == {k: v for k, v in run("prune").items()} and s.read("hotspots").count() == 4
    assert run("land-cover", "--probe")["configured"] is False
    units = run("backfill", "--source", "VIIRS_NOAA20_NRT", "--start", "2026-01-01", "--end", "2026-01-07", "--dry-run")["units"]
    assert units == [["VIIRS_NOAA20_NRT", "2026-01-01", 5, None], ["VIIRS_NOAA20_NRT", "2026-01-06", 2, None]]
    with pytest.raises(ValueError):
        run("ingest", "--source", "NO_SUCH")


def test_empty_tables(spark, tmp_path):
    s = W.Store(spark, str(tmp_path / "store"))
    run = lambda *a: cli.run(spark, [a[0], "--store", s.folder, *a[1:]])
    assert run("page")["features"] == [] and run("page", "--resolution", "1")["count"] == 0
    health = run("health")
    assert health["status"] == "ok" and health["inserted_24h"] == 0 and health["per_source"] == {} and "last_run" not in health
    assert run("report")["total_evaluated"] == 0


def test_failed_last_run_degrades(spark):
    import datetime as dt

    empty = lambda schema: spark.createDataFrame([], schema)
    at = dt.datetime(2026, 9, 6, 12)
    row = lambda source, status, hour: ("firms", source, None, None, None, 1, 2, 3, 0, 0, status, "boom" if status == "failed" else None, at, at.replace(hour=hour))
    log = spark.createDataFrame([row("A", "success", 1), row("B", "failed", 5), row("A", "success", 4), row(None, "success", 2)], schemas.RUN_LOG)
    doc = lambda now: serve.health_document(empty(schemas.HOTSPOTS), empty(schemas.ENRICHMENT), empty(schemas.FACILITIES), log, empty(schemas.WORKER_STATUS), F.lit(now)).first()
    found = doc(at)
    assert (found.status, found.pipeline_error, found.last_run.source, found.last_successful_ingestion.finished_at.hour, found.inserted_24h) == ("degraded", "boom", "B", 4, 9)
    assert found.sources_used == ["A", "B"] and found.per_source["A"].finished_at.hour == 4 and found.per_source["B"].status == "failed"
    assert doc(at + dt.timedelta(days=3)).status == "ok"


def test_choosing_and_write_back(spark):
    rows = spark.range(10)
    ids = lambda **k: sorted(r.id for r in prune.chosen(rows, **k).collect())
    assert ids() == list(range(10)) and ids(ids=[]) == [] and ids(ids=[3, 3, 99]) == [3] and ids(after=2, upto=4) == [3, 4]
    assert ids(ids=list(range(5, 2000))) == [5, 6, 7, 8, 9] and ids(ids=spark.createDataFrame([(1,), (1,), (None,)], "k long"), upto=5) == [1]
    stored = spark.createDataFrame([(1, "a", ["x"], 5.0), (2, None, None, 6.0)], "hotspot_id long, class string, reasons array<string>, distance_m double")
    found = enrich.write_back(stored, spark.createDataFrame([(2, "b", ["y"]), (3, "c", ["z"])], "hotspot_id long, class string, reasons array<string>"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a", ["x"], 5.0), (2, "b", ["y"], 6.0)]
