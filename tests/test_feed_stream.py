import datetime as dt
import os
import signal
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.errors import StreamingQueryException

from emberline import schemas
from emberline.sources.feeds import _FeedStream
from emberline.streaming import worker as W
from emberline.tables import append

HEAD = "latitude,longitude,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti4,bright_ti5,frp,daynight\n"


def line(lat, day, time):
    return f"{lat},20.0,{day},{time},VIIRS,750m,n,2.0NRT,300,290,5.0,D\n"


@pytest.fixture
def feed():
    """A service that answers by day; state["rows"][day] are its lines so far, state["fail"] how many answers fail."""
    state = {"rows": {}, "fail": 0, "asked": [], "bad": set(), "now": 0, "most": 0, "slow": 0.0}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            day = self.path.rsplit("/", 1)[1]
            state["asked"].append(day)
            state["now"] += 1
            state["most"] = max(state["most"], state["now"])
            bad = state["fail"] > 0 or day in state["bad"]
            state["fail"] -= state["fail"] > 0
            time.sleep(state["slow"])
            state["now"] -= 1
            self.send_response(503 if bad else 200)
            self.end_headers()
            self.wfile.write(b"" if bad else (HEAD + "".join(state["rows"].get(day, []))).encode())

        def log_message(self, *args):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{httpd.server_port}"
    yield state
    httpd.shutdown()


def test_offsets_ask_for_the_last_days_and_for_what_was_missed():
    r = _FeedStream({"sources": "A,B", "days": "2", "every": "60", "today": "2026-09-06"})
    parts = lambda a, b: [(p.source, p.date) for p in r.partitions(a, b)]
    end = {"tick": 9, "until": "2026-09-06"}
    assert parts(r.initialOffset(), end) == [(s, d) for s in "AB" for d in ("2026-09-05", "2026-09-06")]
    assert [d for _, d in parts({"tick": 5, "until": "2026-09-03"}, end)][:4] == ["2026-09-03", "2026-09-04", "2026-09-05", "2026-09-06"]
    assert parts(end, end) == [] == parts(r.initialOffset(), r.initialOffset())
    assert r.latestOffset()["until"] == "2026-09-06" and r.latestOffset()["tick"] == int(time.time() / 60)
    assert _FeedStream({}).latestOffset()["until"] in {str((dt.datetime.now(dt.timezone.utc) + dt.timedelta(seconds=k)).date()) for k in (-5, 0)}


def wait(until, seconds=90):
    end = time.time() + seconds
    while not until():
        assert time.time() < end
        time.sleep(0.3)


def test_failures_and_late_rows_are_stored_once(spark, feed, tmp_path):
    s = W.Store(spark, str(tmp_path / "store"))
    append(spark.createDataFrame([("node", 1, "Plant", "refinery", {}, "osm", "POINT(20 10)", 10.0, 20.0, None, None)], schemas.FACILITIES), s.path("facilities"))
    options = {"base": feed["url"], "bbox": "world", "days": "2", "attempts": "1", "today": "2026-09-06"}
    start = lambda: W.stream_feed(s, options, "VIIRS_NOAA20_NRT", str(tmp_path / "ck"), minutes=0.02)
    feed["rows"] = {"2026-09-06": [line(10.0, "2026-09-06", 100)]}
    feed["fail"] = 1
    with pytest.raises(StreamingQueryException):
        start().awaitTermination(90)
    assert s.read("worker_status").first().last_cycle_status == "failed" and s.read("hotspots").count() == 0
    query = start()
    wait(lambda: s.read("run_log").filter("status = 'success'").count() >= 1)
    # Late: a row of the day before, and one more of today.
    feed["rows"]["2026-09-05"] = [line(10.0, "2026-09-05", 2300)]
    feed["rows"]["2026-09-06"].append(line(11.0, "2026-09-06", 200))
    known = len(feed["asked"])
    wait(lambda: len(feed["asked"]) >= known + 4)
    threading.Timer(0.2, os.kill, (os.getpid(), signal.SIGTERM)).start()
    before = signal.getsignal(signal.SIGTERM)
    try:
        assert W.until_stopped(s, [query]) == ["stopped"] and not query.isActive
    finally:
        signal.signal(signal.SIGTERM, before)
    rows = s.read("hotspots").collect()
    assert sorted((str(r.acq_date), r.acq_time) for r in rows) == [("2026-09-05", 2300), ("2026-09-06", 100), ("2026-09-06", 200)]
    assert s.read("enrichment").count() == 3 and W.unfinished(s) == []
    log = s.read("run_log").collect()
    assert sum(r.inserted for r in log) == 3 and {r.status for r in log} == {"success", "failed"}


def test_sixty_windows_four_at_a_time(spark, feed, tmp_path):
    """One job asks for all; windows that fail are logged and asked for again, the others never."""
    s = W.Store(spark, str(tmp_path / "store"))
    append(spark.createDataFrame([("node", 1, "Plant", "refinery", {}, "osm", "POINT(20 10)", 10.0, 20.0, None, None)], schemas.FACILITIES), s.path("facilities"))
    days = [str(dt.date(2026, 7, 1) + dt.timedelta(days=k)) for k in range(60)]
    feed["rows"] = {d: [line(10.0, d, 100), line(10.0, d, 100), line("x", d, 100)] for d in days[::10]}
    feed["bad"], feed["slow"] = set(days[25:35]), 0.02
    options = {"base": feed["url"], "bbox": "world", "attempts": "1"}
    take = lambda: W.backfill_feed(s, ["VIIRS_NOAA20_NRT"], days[0], days[-1], options, days=1)
    done = take()
    assert len(done) == 60 and sorted(feed["asked"]) == days and 2 <= feed["most"] <= 4
    assert {str(d) for _, d, _, status in done if status == "failed"} == feed["bad"]
    feed["bad"], feed["asked"] = set(), []
    assert [x[3] for x in take()] == ["success"] * 10 and sorted(feed["asked"]) == days[25:35] and take() == []
    log = s.read("run_log").filter("status = 'success'").collect()
    assert len(log) == 60 and sum(r.inserted for r in log) == 6 == s.read("hotspots").count() == s.read("enrichment").count()
    assert {(r.returned, r.inserted, r.duplicates, r.invalid) for r in log} == {(0, 0, 0, 0), (3, 1, 1, 1)}
