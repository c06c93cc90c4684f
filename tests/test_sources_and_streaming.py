import datetime as dt
import json
import struct
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from emberline import schemas
from emberline.operators import facilities
from emberline.sources import feeds, files, pbf
from emberline.streaming import worker as W
from emberline.tables import append, replace

HEAD = "latitude,longitude,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti4,bright_ti5,frp,daynight\n"
ROWS = HEAD + "".join(f"{10 + i / 10},{20 + i / 10},2026-09-06,1235,VIIRS,750m,h,2.0NRT,305.2,293.1,22.5,D\n" for i in range(4))


def test_detection_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(ROWS)
    (tmp_path / "b.csv").write_text(HEAD)
    assert files.read_detections(spark, str(tmp_path / "a.csv")).count() == 4 and files.read_detections(spark, str(tmp_path / "b.csv")).count() == 0
    assert files.read_detections(spark, str(tmp_path / "a.csv")).columns == schemas.RAW_DETECTION.names


def test_registry_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text('﻿country,name,gppd_idnr,capacity_mw,latitude,longitude,primary_fuel\nIND,"A, ""B""",I1,5,1.0,2.0,Coal\n', encoding="utf-8")
    r = files.read_wri(spark, str(tmp_path / "w.csv")).first()
    assert (r.country, r.name, r.owner) == ("IND", 'A, "B"', None)
    (tmp_path / "o.csv").write_text("id,Name,Country,Fueltype,lat,lon\nway/7,X,India,Oil,1,2\n")
    assert facilities.from_osm_powerplants(files.read_osm_powerplants(spark, str(tmp_path / "o.csv"))).first().osm_id == 7


OSM = """<?xml version="1.0"?><osm version="0.6">
<node id="1" lat="47.0" lon="9.0"/><node id="2" lat="47.0" lon="9.001"/><node id="3" lat="47.001" lon="9.001"/>
<node id="4" lat="47.002" lon="9.002"><tag k="industrial" v="refinery"/><tag k="name" v="R"/></node><node id="5" lat="bad" lon="1"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="landuse" v="industrial"/></way>
<way id="11"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary"/></way><way id="12"><nd ref="1"/><nd ref="99"/><tag k="man_made" v="works"/></way></osm>"""


def test_map_xml_to_facilities(spark, tmp_path):
    (tmp_path / "x.osm").write_text(OSM)
    found = {r.osm_id: r for r in facilities.from_map(*files.read_extract(spark, str(tmp_path / "x.osm"))).collect()}
    assert set(found) == {4, 10}
    assert found[4].facility_type == "refinery" and found[4].geometry == "POINT(9.0020000 47.0020000)" and found[4].name == "R"
    assert found[10].facility_type == "industrial_area" and found[10].geometry.startswith("POLYGON((9.0000000 47.0000000, 9.0010000 47.0000000")
    assert abs(found[10].latitude - (47.0 * 3 + 47.001) / 4) < 1e-9
    with pytest.raises(ValueError):
        files.read_extract(spark, "x.txt")


def v(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def z(n):
    return n << 1 if n >= 0 else (-n << 1) - 1


def field(number, value):
    return v(number << 3) + v(value) if isinstance(value, int) else v(number << 3 | 2) + v(len(value)) + value


def extract(lat_offset=0, lon_offset=0, raw=False):
    strings = [b"", b"industrial", b"refinery", b"landuse", b"industrial2"]
    table = b"".join(field(1, s) for s in strings)
    packed = lambda xs: b"".join(map(v, xs))
    dense = field(1, packed([z(1), z(1), z(1)])) + field(8, packed([z(1998), z(1006), z(-2)])) + field(9, packed([z(1001), z(0), z(-5000)])) + field(10, packed([0, 1, 2, 0, 0]))
    node = field(1, z(20)) + field(2, packed([1])) + field(3, packed([2])) + field(8, z(3002)) + field(9, z(-3998))
    way = field(1, 10) + field(2, packed([3])) + field(3, packed([1])) + field(8, packed([z(1), z(1), z(1), z(-2)]))
    block = field(1, table) + field(2, field(2, dense)) + field(2, field(1, node)) + field(2, field(3, way)) + field(17, 100) + field(19, lat_offset) + field(20, lon_offset)
    blob = field(1, block) if raw else field(2, len(block)) + field(3, zlib.compress(block))
    out = b""
    for kind, body in ((b"OSMHeader", field(1, b"x")), (b"OSMData", blob)):
        head = field(1, kind) + field(3, len(body))
        out += struct.pack(">i", len(head)) + head + body
    return out


@pytest.mark.parametrize("raw", [True, False])
def test_map_pbf(spark, tmp_path, raw):
    (tmp_path / "x.osm.pbf").write_bytes(extract(10**8, 2 * 10**8, raw))
    nodes, ways = files.read_extract(spark, str(tmp_path / "x.osm.pbf"))
    by = {r.id: r for r in nodes.collect()}
    assert set(by) == {1, 2, 3, 20} and by[2].tags == {"industrial": "refinery"} and by[1].tags == {}
    assert abs(by[1].lat - 0.1001998) < 1e-9 and abs(by[1].lon - 0.2001001) < 1e-9 and abs(by[20].lon - (0.2 - 0.0003998)) < 1e-9
    w = ways.first()
    assert (w.id, w.refs, w.tags) == (10, [1, 2, 3, 1], {"landuse": "industrial"})
    assert {r.osm_id for r in facilities.from_map(nodes, ways).collect()} == {2, 20, 10}


def test_wire_numbers():
    assert pbf.varint(bytes([0xAC, 2]), 0) == (300, 2) and [pbf.zigzag(n) for n in (0, 1, 2, 3)] == [0, -1, 1, -2]
    for bad in (b"\x80", b"\xff" * 12):
        with pytest.raises(ValueError):
            pbf.varint(bad, 0)


def test_map_json(spark, tmp_path):
    answer = {"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"industrial": "oil"}}, {"type": "way", "id": 2, "geometry": [{"lat": 0.0, "lon": 0.0}, {"lat": 1.0, "lon": 1.0}]}, {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"industrial": "oil"}}]}
    (tmp_path / "a.json").write_text(json.dumps(answer))
    rows = {r.osm_id: r for r in files.read_map_json(spark, str(tmp_path / "a.json")).collect()}
    assert set(rows) == {1, 2} and rows[1].tags == {"industrial": "oil"} and len(rows[2].points) == 2 and rows[2].tags == {}


@pytest.fixture()
def server():
    state = {"codes": [], "asked": []}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            state["asked"].append(self.path)
            code = state["codes"].pop(0) if state["codes"] else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write((ROWS if "N20" in self.path or "NOAA20" in self.path else HEAD).encode() if code == 200 else b"")

        def do_POST(self):
            code = state["codes"].pop(0) if state["codes"] else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(b'{"elements": []}' if code == 200 else b"")

        def log_message(self, *args):
            pass

    httpd = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{httpd.server_port}"
    yield state
    httpd.shutdown()


def test_feed_over_http(spark, server):
    spark.dataSource.register(feeds.DetectionFeed)
    read = spark.read.format("detections").options(base=server["url"], key="K", sources="VIIRS_NOAA20_NRT,VIIRS_NOAA21_NRT", bbox="68,6,98,38", days="2")
    assert {(r.feed, r["count"]) for r in read.load().groupBy("feed").count().collect()} == {("VIIRS_NOAA20_NRT", 4)}
    assert "/K/VIIRS_NOAA20_NRT/68,6,98,38/2" in server["asked"]


def test_retries(server):
    waits = []
    server["codes"] = [500, 429]
    assert feeds.fetch_text(server["url"] + "/NOAA20", sleep=waits.append).startswith("latitude") and waits == [1, 2]
    server["codes"] = [404]
    with pytest.raises(feeds.FeedError):
        feeds.fetch_text(server["url"], sleep=waits.append)
    with pytest.raises(feeds.FeedError):
        feeds.fetch_text("http://127.0.0.1:1/x", attempts=2, sleep=lambda s: None)
    with pytest.raises(ValueError):
        feeds.feed_url("b", "k", "s", "world", 6)
    server["codes"] = [429, 504]
    assert feeds.ask_map("q", [server["url"], server["url"]], sleep=waits.append) == {"elements": []} and waits[-1] == 5
    server["codes"] = [400]
    with pytest.raises(feeds.FeedError):
        feeds.ask_map("q", [server["url"]])
    assert feeds.map_query("1,2,3,4").count("(1,2,3,4)") == 15


def store(spark, tmp_path):
    s = W.Store(spark, str(tmp_path / "store"))
    rows = [("node", 1, "Plant", "refinery", {}, "osm", "POINT(20 10)", 10.0, 20.0, None, None)]
    append(spark.createDataFrame(rows, schemas.FACILITIES), s.path("facilities"))
    return s


def test_stream_is_idempotent_and_logs(spark, tmp_path):
    s = store(spark, tmp_path)
    feed = tmp_path / "in"
    feed.mkdir()
    (feed / "1.csv").write_text(ROWS)
    for k in range(2):
        W.stream_detections(s, str(feed), "VIIRS_NOAA20_NRT", str(tmp_path / "ck")).awaitTermination()
        assert s.read("hotspots").count() == 4 and s.read("enrichment").filter("class IS NOT NULL").count() == 4
        (feed / "2.csv").write_text(ROWS + "x,1,2026-09-06,1,a,b,c,d,1,1,1,D\n")
    log = {(r.returned, r.inserted, r.duplicates, r.invalid, r.status) for r in s.read("run_log").collect()}
    assert log == {(4, 4, 0, 0, "success"), (5, 0, 4, 1, "success")}
    w = s.read("worker_status").collect()
    assert len(w) == 1 and w[0].cycle_count == 2 and w[0].last_cycle_status == "success"
    assert s.read("enrichment").filter("distance_m = 0").first()["nearest_facility_name"] == "Plant"


def test_failed_source_leaves_others(spark, tmp_path):
    s = store(spark, tmp_path)
    good = spark.createDataFrame([("10", "20", "2026-09-06", "1") + ("x",) * 10], schemas.RAW_DETECTION)
    out = W.run_once(s, {"A": good.select("latitude"), "B": good})
    assert out["A"]["status"] == "failed" and out["B"] == {"returned": 1, "inserted": 1, "invalid": 0, "duplicates": 0, "status": "success"}
    assert {(r.source, r.status) for r in s.read("run_log").collect()} == {("A", "failed"), ("B", "success")}
    assert W.maintenance(s) == {"keep_forever": 1} or sum(W.maintenance(s).values()) == 1


def test_backfill_resumes(spark, tmp_path):
    s = store(spark, tmp_path)
    asked = []

    def fetch(source, day, days):
        asked.append((day, days))
        if day == dt.date(2026, 9, 6) and len(asked) < 3:
            raise RuntimeError("down")
        return spark.createDataFrame([("10", "20", str(day), "1") + ("x",) * 10], schemas.RAW_DETECTION)

    args = (s, ["VIIRS_NOAA20_NRT"], "2026-09-01", "2026-09-07", "world", fetch)
    assert [x[2:] for x in W.backfill(*args, dry_run=True)] == [(5, None), (2, None)] and asked == []
    assert [x[3] for x in W.backfill(*args)] == ["success", "failed"]
    assert [x[3] for x in W.backfill(*args)] == ["success"] and W.backfill(*args) == []
    assert s.read("hotspots").count() == 2 and len(W.backfill(*args, force=True)) == 2 and s.read("hotspots").count() == 2


def test_maintenance_deletes_far_rows(spark, tmp_path):
    s = store(spark, tmp_path)
    rows = spark.createDataFrame([(la, "20", "2026-09-06", "1") + ("x",) * 10 for la in ("10", "60")], schemas.RAW_DETECTION)
    W.run_cycle(s, rows, "A")
    assert W.maintenance(s, dry_run=True)["delete"] == 1 and s.read("hotspots").count() == 2
    W.maintenance(s, dry_run=False)
    assert s.read("hotspots").count() == 1 == s.read("enrichment").count()


def test_replace_reads_what_it_overwrites(spark, tmp_path):
    path = str(tmp_path / "t")
    append(spark.range(3).toDF("id"), path)
    replace(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_tokens():
    assert W.authorized("Bearer abc", "abc") and not W.authorized("abd", "abc") and not W.authorized("", None) and not W.authorized(None, "abc")


def shuffled(names, rows=ROWS):
    """The same rows with these columns, in this order."""
    head, *lines = [line.split(",") for line in rows.strip().split("\n")]
    return "\n".join(",".join(cells[head.index(n)] for n in names) for cells in [head, *lines]) + "\n"


def test_csv_columns_go_by_name(spark, tmp_path):
    names = HEAD.strip().split(",")
    (tmp_path / "1.csv").write_text(shuffled(names[::-1]))
    (tmp_path / "2.csv").write_text("﻿" + shuffled(["acq_time", "latitude", "longitude", "acq_date"]).replace("\n", "\r\n"))
    (tmp_path / "3.csv").write_text("1,2,3\n")
    (tmp_path / "4.csv").write_text(ROWS)
    rows = files.read_detections(spark, str(tmp_path)).collect()
    assert len(rows) == 13 and sum(r.latitude is None for r in rows) == 1
    assert sorted(r.latitude for r in rows if r.latitude) == sorted(["10.0", "10.1", "10.2", "10.3"] * 3)
    assert {(r.longitude, r.frp) for r in rows if r.latitude == "10.1"} == {("20.1", "22.5"), ("20.1", None)}


def test_failed_batch_is_stored_by_the_next_run(spark, tmp_path, monkeypatch):
    s, feed = store(spark, tmp_path), tmp_path / "in"
    feed.mkdir()
    (feed / "1.csv").write_text(shuffled(HEAD.strip().split(",")[::-1]))
    for where in ("new_rows", "enrich", None):
        if where:
            monkeypatch.setattr(W, where, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("broken")))
        run = W.stream_detections(s, str(feed), "A", str(tmp_path / "ck"))
        if where:
            with pytest.raises(Exception, match="broken"):
                run.awaitTermination()
            monkeypatch.undo()
        else:
            run.awaitTermination()
    assert s.read("hotspots").count() == 4 == s.read("hotspots").select("id").distinct().count()
    known = s.read("enrichment").filter("class IS NOT NULL")
    assert known.count() == 4 == known.select("hotspot_id").distinct().count() and W.unfinished(s) == []
    assert [r.status for r in s.read("run_log").orderBy("finished_at").collect()] == ["failed", "failed", "success"]
    assert s.read("worker_status").first().last_cycle_status == "success"


def test_cycle_that_dies_between_its_tables(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    raw = spark.createDataFrame([(str(10 + k), "20", "2026-09-06", "1") + ("x",) * 10 for k in range(3)], schemas.RAW_DETECTION)
    monkeypatch.setattr(W, "classify", lambda df: df.withColumn("class", F.raise_error(F.lit("gone"))))
    assert W.run_cycle(s, raw, "A")["status"] == "failed"
    monkeypatch.undo()
    assert s.read("hotspots").count() == 3 and s.read("enrichment").count() == 0 and len(W.unfinished(s)) == 1
    assert W.run_cycle(s, raw, "A") == {"returned": 3, "inserted": 0, "invalid": 0, "duplicates": 3, "status": "success"}
    assert s.read("hotspots").count() == 3 == s.read("enrichment").select("hotspot_id").distinct().count() == s.read("enrichment").count()
    assert W.run_cycle(s, raw.withColumn("latitude", F.lit("50")), "A")["inserted"] == 1 and s.read("hotspots").select("id").distinct().count() == 4
    assert (tmp_path / "store" / "hotspots" / "acq_date=2026-09-06").is_dir()


def test_scratch_tables_go(spark, tmp_path):
    import os

    from emberline.config import Screen
    from emberline.tables import shared_folder

    s = store(spark, tmp_path)
    before = set(os.listdir(shared_folder(spark)))
    raw = spark.createDataFrame([("10", "20", "2026-09-06", "1") + ("x",) * 10, ("60", "20", "2026-09-06", "1") + ("x",) * 10], schemas.RAW_DETECTION)
    assert W.run_cycle(s, raw, "A", screening=Screen())["inserted"] == 1
    log = s.read("screen_log").first()
    assert (log.fetched, log.kept, log.dropped, log.source) == (2, 1, 1, "A")
    assert set(os.listdir(shared_folder(spark))) == before


def test_broken_replace_is_undone(spark, tmp_path):
    from emberline.tables import read_or_empty

    path = tmp_path / "t"
    append(spark.range(3).toDF("id"), str(path))
    path.rename(tmp_path / "t.replaced")
    assert read_or_empty(spark, str(path), spark.range(1).schema).count() == 3
    path.rename(tmp_path / "t.replaced")
    append(spark.range(2).toDF("id"), str(path))
    assert spark.read.parquet(str(path)).count() == 5
    replace(spark.read.parquet(str(path)).limit(1), str(path))
    assert spark.read.parquet(str(path)).count() == 1 and sorted(x.name for x in tmp_path.iterdir()) == ["t"]
