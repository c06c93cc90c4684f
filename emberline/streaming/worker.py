"""The worker: micro-batches of detection files into the store, and resumable backfill.

Tables lie under one folder: hotspots and enrichment (by acq_date), facilities, run_log, screen_log, query_cache,
id_ranges, worker_status. A batch is validated, made new against the stored rows of its own days (so
re-delivery inserts nothing), appended, enriched and classified by the same plans as a batch job
against the rows of the 30 days before. Nothing is ever too late: there is no watermark, the store
itself is the state.

A cycle writes to two tables and may die between. So it first reserves its ids in id_ranges; the next cycle
enriches what has an id of an unfinished range but no enrichment. Every row is stored and enriched
exactly once, wherever a cycle ends. Deletes and updates rewrite the days they touch only, of both tables in one
step that the next writer ends if it breaks off. One worker writes at a time.
"""

from __future__ import annotations

import datetime as dt
import hmac
import signal
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import schemas
from emberline.config import History, Screen
from emberline.operators.classify import classify
from emberline.operators.context import fill_land_cover, heartbeat, land_cover_pending, refresh_context, run_row, screen_row
from emberline.operators.enrich import enrich
from emberline.operators.facilities import located, upsert
from emberline.operators.ingest import day_windows, dt_of, facility_cells, is_valid, new_rows, parse, pending_units, prior_cells, screen, screen_stats, with_ids
from emberline.operators.prune import disposition, disposition_counts, of_days
from emberline.sources.feeds import DetectionFeed, ask_windows
from emberline.sources.files import detections_of_lines
from emberline.sources.land_cover import LandCover
from emberline.tables import append, file_counts, finish_swaps, materialize, read_or_empty, replace, scratch, swap

_SCHEMAS = {
    "hotspots": schemas.HOTSPOTS, "facilities": schemas.FACILITIES, "enrichment": schemas.ENRICHMENT, "run_log": schemas.RUN_LOG, "screen_log": schemas.SCREEN_LOG,
    "query_cache": schemas.QUERY_CACHE, "id_ranges": schemas.ID_RANGES, "worker_status": schemas.WORKER_STATUS,
}
#: Columns that tables are partitioned by.
_BY = {"hotspots": "acq_date", "enrichment": "acq_date"}


class Stopped(Exception):
    """A batch that was not begun, since its stream is to end; the next start gets it."""


class Store:
    """The tables under a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        #: Once set, streams into this store begin no other batch.
        self.stop = threading.Event()

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str) -> DataFrame:
        return read_or_empty(self.spark, self.path(name), _SCHEMAS[name])

    def append(self, name: str, rows: DataFrame) -> None:
        append(_conform(rows, _SCHEMAS[name]), self.path(name), _BY.get(name))

    def replace(self, name: str, rows: DataFrame) -> None:
        replace(_conform(rows, _SCHEMAS[name]), self.path(name), _BY.get(name))

    def swap(self, days: list, tables: dict[str, DataFrame]) -> None:
        """Put the rows of these days in the place of those that tables have, in one step."""
        swap(self.spark, self.folder, "acq_date", days, [(_conform(rows, _SCHEMAS[name]), self.path(name)) for name, rows in tables.items()])

    def finish(self) -> int:
        """End what a broken swap left."""
        return finish_swaps(self.spark, self.folder)

    def sites(self) -> DataFrame:
        """Facilities as enrichment takes them."""
        from emberline.functions.geo import rings_of

        f = self.read("facilities")
        shaped = F.col("geometry").startswith("POLYGON") | F.col("geometry").startswith("MULTIPOLYGON")
        out = [F.xxhash64("osm_type", "osm_id").alias("fid"), F.col("name").alias("fname"), F.col("facility_type").alias("ftype"), F.col("latitude").alias("flat"), F.col("longitude").alias("flon")]
        # Without any polygon none is looked for.
        return f.select(*out) if f.filter(shaped).isEmpty() else f.select(*out, F.when(shaped, rings_of(F.col("geometry"))).alias("rings"))


def _conform(df: DataFrame, schema) -> DataFrame:
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def _since(rows: DataFrame, days: int = 0):
    """The earliest day of rows less so many, and the latest; None without rows."""
    first, last = rows.agg(F.min("acq_date"), F.max("acq_date")).first()
    return (first - dt.timedelta(days=days), last) if first else None


def _put_enrichment(store: Store, rows: DataFrame, now: dt.datetime, history: History) -> None:
    """Enrich and classify stored detections; only the days that can hold neighbours are read."""
    since = _since(rows, 30)
    if since is None:
        return
    around = store.read("hotspots").filter(F.col("acq_date") >= F.lit(since[0]))
    found = enrich(dt_of(rows), store.sites(), dt_of(around), history)
    store.append("enrichment", classify(found).withColumnRenamed("id", "hotspot_id").withColumn("enriched_at", F.lit(now)))


def unfinished(store: Store) -> list[tuple[str, int, int]]:
    """(cycle, first id, last id) of cycles that reserved ids and did not end: seldom more than one."""
    ranges = store.read("id_ranges")
    rest = ranges.filter("state = 'begun'").join(ranges.filter("state = 'done'").select("cycle"), "cycle", "left_anti")
    return [(r.cycle, r.first_id, r.last_id) for r in rest.select("cycle", "first_id", "last_id").collect()]


def _mark(store: Store, cycle: str, state: str, first: int, last: int, now: dt.datetime) -> None:
    store.append("id_ranges", store.spark.createDataFrame([(cycle, state, first, last, now)], schemas.ID_RANGES))


def recover(store: Store, now: dt.datetime, history: History = History()) -> int:
    """Enrich the rows that unfinished cycles stored; how many there were. The id bounds reach the scans."""
    store.finish()
    total = 0
    for cycle, first, last in unfinished(store):
        known = store.read("enrichment").filter(F.col("hotspot_id").between(first, last)).select(F.col("hotspot_id").alias("id"))
        rest = materialize(store.read("hotspots").filter(F.col("id").between(first, last)).join(known, "id", "left_anti"))
        total += rest.count()
        _put_enrichment(store, rest, now, history)
        _mark(store, cycle, "done", first, last, now)
    return total


def _top_id(store: Store) -> int | None:
    """The largest id ever reserved, out of the small table of ranges; None where there is none yet."""
    return store.read("id_ranges").agg(F.max("last_id")).first()[0]


def _take_in(store: Store, raw: DataFrame, source: str, kind: str, now: dt.datetime, history: History, screening: Screen | None, unit: dict) -> dict:
    spark = store.spark
    recover(store, now, history)
    rows = materialize(raw)
    valid = parse(rows.filter(is_valid(rows)), source)
    if screening:
        day = F.lit(now).cast("date")
        prior = prior_cells(store.read("hotspots"), F.date_sub(day, screening.prior_days))
        marked = materialize(screen(valid, facility_cells(store.sites()), prior, screening))
        sums = screen_stats(marked).first().asDict()
        log = {"kind": kind, "source": source, "percentile_pct": screening.percentile, "frp_mw": screening.frp_mw, "created_at": now, **unit}
        store.append("screen_log", screen_row(spark, **log, **sums))
        valid = marked.filter("near").select(valid.columns)
    else:
        valid = materialize(valid)
    days = _since(valid)
    stored = store.read("hotspots")
    # Equal keys have equal days: no other partition is read.
    same_days = stored.filter(F.col("acq_date").between(F.lit(days[0]), F.lit(days[1]))) if days else stored.limit(0)
    fresh = materialize(with_ids(new_rows(valid, same_days), stored, _top_id(store)).withColumn("ingested_at", F.lit(now)))
    sums = rows.agg(F.count("*").alias("returned"), F.count_if(~is_valid(rows)).alias("invalid")).first()
    inserted, first, last = fresh.agg(F.count("*"), F.min("id"), F.max("id")).first()
    if inserted:
        cycle = uuid.uuid4().hex
        _mark(store, cycle, "begun", first, last, now)
        store.append("hotspots", fresh)
        _put_enrichment(store, fresh, now, history)
        _mark(store, cycle, "done", first, last, now)
    return {"returned": sums["returned"], "inserted": inserted, "invalid": sums["invalid"], "duplicates": sums["returned"] - sums["invalid"] - inserted}


def run_cycle(store: Store, raw: DataFrame, source: str, kind: str = "firms", now: dt.datetime | None = None, history: History = History(), screening: Screen | None = None, strict: bool = False, **unit) -> dict:
    """Take raw rows of a source in; returns the counts and logs the run, also a failed one.

    strict: a failure is raised once it is logged, for callers that deliver again what failed.
    duplicates counts what is stored already, comes twice or is screened away.
    """
    spark, now = store.spark, now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    log = {"kind": kind, "source": source, "started_at": now, "finished_at": now, **unit}
    with scratch(spark):
        try:
            counts = _take_in(store, raw, source, kind, now, history, screening, unit)
        except Exception as e:  # the failure is the log's to tell; other sources go on
            none = dict.fromkeys(("returned", "inserted", "invalid", "duplicates"), 0)
            store.append("run_log", run_row(spark, **log, **none, status="failed", error=f"{type(e).__name__}: {e}"))
            if strict:
                raise
            return {**none, "status": "failed"}
    store.append("run_log", run_row(spark, **log, **counts, status="success"))
    return {**counts, "status": "success"}


def beat(store: Store, worker_id: str, status: str, inserted: int, cycle: int, error: str | None = None, now: dt.datetime | None = None) -> None:
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = heartbeat(store.read("worker_status"), worker_id=worker_id, started_at=now, last_heartbeat_at=now, cycle_count=cycle, last_cycle_status=status, last_error=error, last_inserted=inserted, version="1")
    with scratch(store.spark):
        store.replace("worker_status", materialize(rows))


def _stream(store: Store, rows: DataFrame, take, source: str, checkpoint: str, once: bool, minutes: float, worker_id: str, **options):
    """Start a stream whose batches are taken in; take(batch) gives raw rows.

    A batch that fails is logged, ends the stream and is delivered again by the next start, since its checkpoint is not committed.
    """

    def batch(df: DataFrame, number: int) -> None:
        if store.stop.is_set():
            raise Stopped(f"before batch {number}")
        try:
            result = run_cycle(store, take(df), source, strict=True, **options)
        except Exception as e:
            beat(store, worker_id, "failed", 0, number + 1, f"{type(e).__name__}: {e}")
            raise
        beat(store, worker_id, result["status"], result["inserted"], number + 1)

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{round(minutes * 60_000)} milliseconds")).start()


def stream_detections(store: Store, folder: str, source: str, checkpoint: str, once: bool = True, minutes: float = 10, worker_id: str = "worker", files_per_batch: int = 1000, **options):
    """Start taking in the CSV files that arrive in a folder; once: what is there now, then end. Each file's columns are found by its own header."""
    lines = store.spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).select("value", F.col("_metadata.file_path").alias("path"))
    return _stream(store, lines, detections_of_lines, source, checkpoint, once, minutes, worker_id, **options)


def stream_feed(store: Store, feed: dict[str, str], source: str, checkpoint: str, minutes: float = 10, worker_id: str = "worker", **options):
    """Start asking the feed (options of ``DetectionFeed``) for one source every so many minutes, the last days each time.

    A stream a source: one whose service fails ends alone, and asks for all it missed when it is started again.
    """
    store.spark.dataSource.register(DetectionFeed)
    rows = store.spark.readStream.format("detections").options(**feed, sources=source, every=str(minutes * 60)).load().drop("feed")
    return _stream(store, rows, lambda df: df, source, checkpoint, False, minutes, worker_id, bbox=feed["bbox"], days=int(feed.get("days", "1")), **options)


def until_stopped(store: Store, queries: list, poll: float = 0.5) -> list[str]:
    """Wait for streams: on SIGTERM, or once ``store.stop`` is set, each ends after the batch that is under way. How each ended: stopped or failed."""
    if threading.current_thread() is threading.main_thread():
        signal.signal(signal.SIGTERM, lambda *_: store.stop.set())
    while running := [q for q in queries if q.isActive]:
        if store.stop.is_set():
            for q in running:
                if not q.status["isTriggerActive"]:
                    q.stop()
        time.sleep(poll)
    return ["failed" if (e := q.exception()) is not None and Stopped.__name__ not in str(e) else "stopped" for q in queries]


def run_once(store: Store, feeds: dict[str, DataFrame], **options) -> dict[str, dict]:
    """One cycle over several sources; one that fails leaves the others alone."""
    return {source: run_cycle(store, raw, source, **options) for source, raw in feeds.items()}


def backfill(store: Store, sources: list[str], start: str, end: str, bbox: str, fetch, days: int = 5, force: bool = False, dry_run: bool = False) -> list[tuple]:
    """Take in every window of every source that no successful run has done; fetch(source, date, days) gives raw rows."""
    spark = store.spark
    units = day_windows(spark, start, end, days).crossJoin(spark.createDataFrame([(s,) for s in sources], "source string"))
    todo = units if force else pending_units(units, store.read("run_log"), bbox)
    out = []
    for u in todo.orderBy("source", "date_from").collect():  # a handful of windows
        if dry_run:
            out.append((u.source, u.date_from, u.days, None))
            continue
        try:
            raw = fetch(u.source, u.date_from, u.days)
        except RuntimeError as e:
            store.append("run_log", run_row(spark, kind="backfill", source=u.source, bbox=bbox, date_from=u.date_from, days=u.days, status="failed", error=str(e)))
            out.append((u.source, u.date_from, u.days, "failed"))
            continue
        result = run_cycle(store, raw, u.source, kind="backfill", bbox=bbox, date_from=u.date_from, days=u.days)
        out.append((u.source, u.date_from, u.days, result["status"]))
    return out


def backfill_feed(store: Store, sources: list[str], start: str, end: str, feed: dict[str, str], days: int = 5, at_once: int = 4, per_job: int = 64, history: History = History(), force: bool = False) -> list[tuple]:
    """Like ``backfill``, many windows a job: ``per_job`` of them are asked for, ``at_once`` at a time, and what is answered is taken in by one cycle a source.

    Each window has its own row in the run log, so one that fails, or that a broken job left, is asked for again by the next call.
    """
    spark, bbox, out = store.spark, feed["bbox"], []
    units = day_windows(spark, start, end, days).crossJoin(spark.createDataFrame([(s,) for s in sources], "source string"))
    todo = (units if force else pending_units(units, store.read("run_log"), bbox)).orderBy("date_from", "source").collect()  # a few numbers a window
    for at in range(0, len(todo), per_job):
        part, now = todo[at : at + per_job], dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        with scratch(spark):
            got = materialize(ask_windows(spark.createDataFrame([(u.source, u.date_from, u.days) for u in part], "source string, date_from date, days int"), feed, at_once))
            errors = {(r.source, r.date_from): r.error for r in got.filter("asked").collect()}
            rows = got.filter("NOT asked")
            sent = {(r.source, r.date_from): r for r in rows.groupBy("source", "date_from").agg(F.count("*").alias("returned"), F.count_if(~is_valid(rows)).alias("invalid")).collect()}
            for source in sorted({u.source for u in part}):
                own = [u for u in part if u.source == source]
                good = [u for u in own if errors[source, u.date_from] is None]
                before, failure = _top_id(store) or 0, None
                if good:
                    try:
                        recover(store, now, history)
                        before = _top_id(store) or 0
                        _take_in(store, rows.filter(F.col("source") == source).drop("source", "date_from", "error", "asked"), source, "backfill", now, history, None, {})
                    except Exception as e:  # told by the log, as a cycle's failure is
                        failure = f"{type(e).__name__}: {e}"
                log = []
                fresh = {r.acq_date: r["count"] for r in store.read("hotspots").filter(F.col("id") > before).groupBy("acq_date").count().collect()}
                for u in own:
                    error = errors[source, u.date_from] or failure
                    inserted = sum(n for day, n in fresh.items() if 0 <= (day - u.date_from).days < u.days) if error is None else 0
                    found = sent.get((source, u.date_from)) if error is None else None
                    n, invalid = (found.returned, found.invalid) if found else (0, 0)
                    row = {"kind": "backfill", "source": source, "bbox": bbox, "date_from": u.date_from, "days": u.days, "returned": n, "inserted": inserted, "duplicates": n - invalid - inserted, "invalid": invalid, "started_at": now, "finished_at": now}
                    log.append(row | {"status": "failed" if error else "success", "error": (error or "")[:500] or None})
                    out.append((source, u.date_from, u.days, log[-1]["status"]))
                # The rows are stored: their windows are done, all by one append.
                store.append("run_log", spark.createDataFrame([tuple(row.get(f.name) for f in schemas.RUN_LOG) for row in log], schemas.RUN_LOG))
    return out


def refresh_map(store: Store, query, now: dt.datetime | None = None, radius_m: float = 32_000.0, limit: int = 50) -> dict[str, int]:
    """Put in the facilities around uncovered detections; each place asked goes to the query cache.

    query(lat, lon, radius) gives rows of the facilities' columns, as dicts, or raises RuntimeError.
    """
    spark, now = store.spark, now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    done, found, failures = refresh_context(spark, store.read("hotspots"), store.read("query_cache"), query, radius_m, limit)
    if found:
        batch = spark.createDataFrame([tuple(r.get(f.name) for f in schemas.FACILITIES) for r in found], schemas.FACILITIES).drop("first_seen_at", "updated_at")
        with scratch(spark):
            store.replace("facilities", materialize(upsert(store.read("facilities"), located(batch), F.lit(now))))
    # Last: a place counts as asked only once its facilities are stored.
    if done:
        store.append("query_cache", spark.createDataFrame([(*d, now) for d in done], schemas.QUERY_CACHE))
    return {"asked": len(done), "facilities": len(found), "failures": failures}


def refresh_land_cover(store: Store, service: LandCover, limit: int = 500) -> None:
    """Ask the land cover of detections that lack it and rewrite their days; nothing happens where the service is off."""
    if not service.enabled:
        return
    store.finish()
    known = store.read("enrichment")
    with scratch(store.spark):
        pending = materialize(land_cover_pending(known, limit))
        days = [r.acq_date for r in known.join(F.broadcast(pending), "hotspot_id").select("acq_date").distinct().collect()]
        if days:
            # The smallest ids that lack one are of these days, so the same are asked.
            store.swap(days, {"enrichment": fill_land_cover(of_days(known, days), of_days(store.read("hotspots"), days), service, limit)})


def authorized(given: str | None, secret: str | None) -> bool:
    """Whether a bearer token is the secret; without a secret nobody is."""
    return bool(secret) and hmac.compare_digest((given or "").removeprefix("Bearer ").encode(), secret.encode())


def maintenance(store: Store, dry_run: bool = True, metres: float = 5000.0) -> dict[str, int]:
    """Counts by disposition; unless dry_run, what is to be deleted goes from both tables, of which only its days are rewritten."""
    store.finish()
    hotspots, known = store.read("hotspots"), store.read("enrichment")
    with scratch(store.spark):
        found = materialize(disposition(hotspots, known, store.sites(), metres))
        counts = {r.disposition: r.n for r in disposition_counts(found).collect()}
        if not dry_run and counts.get("delete"):
            gone = materialize(hotspots.select("id", "acq_date").join(found.filter("disposition = 'delete'").select("id"), "id"))
            days = [r.acq_date for r in gone.select("acq_date").distinct().collect()]  # as many as days
            ids = gone.select("id")
            stay = of_days(known, days).join(ids.withColumnRenamed("id", "hotspot_id"), "hotspot_id", "left_anti")
            store.swap(days, {"enrichment": stay, "hotspots": of_days(hotspots, days).join(ids, "id", "left_anti")})
    return counts


def compact(store: Store, most: int = 16) -> dict[str, int]:
    """Write anew what lies in more than ``most`` files: days of the large tables, the logs, and the id ranges, of which only what is still needed stays.

    Returns how many files were taken together, by table.
    """
    store.finish()
    spark, out = store.spark, {}
    for name, by in _BY.items():
        many = {day: n for day, n in file_counts(spark, store.path(name)).items() if day and n > most}
        if many:
            days = [dt.date.fromisoformat(day.partition("=")[2]) for day in many]
            store.swap(days, {name: of_days(store.read(name), days)})
            out[name] = sum(many.values())
    for name in ("run_log", "screen_log", "query_cache", "id_ranges"):
        files = file_counts(spark, store.path(name)).get("", 0)
        if files <= most:
            continue
        rows = store.read(name)
        if name == "id_ranges":
            # The largest id ever given, and the ranges of cycles that have not ended.
            done = rows.filter("state = 'done'")
            rest = rows.join(done.select("cycle"), "cycle", "left_anti")
            rows = rest.unionByName(done.orderBy(F.desc("last_id"), "cycle").limit(1))
        with scratch(spark):
            store.replace(name, materialize(rows.hint("rebalance")))
        out[name] = files
    return out
