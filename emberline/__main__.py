"""The command line: ``python -m emberline COMMAND --store FOLDER ...``, also by spark-submit.

Commands: ingest, backfill, map, land-cover, prune, report, page, health. Every command runs the same plans
as the library; what it prints is counts, or one JSON document.
"""

from __future__ import annotations

import argparse
import json
import math
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.config import SOURCES, History, normalize_bbox, overpass_box, parse_sources
from emberline.operators import serve
from emberline.operators.classify import report, write_report
from emberline.operators.facilities import from_elements
from emberline.sources.feeds import DetectionFeed, ask_map, map_query
from emberline.sources.files import map_elements, read_detections
from emberline.sources.land_cover import LandCover
from emberline.streaming.worker import Store, backfill, backfill_feed, compact, maintenance, refresh_land_cover, refresh_map, run_cycle, stream_feed, until_stopped


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="emberline", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        p.add_argument("--store", required=True, help="folder of the tables")
        return p

    for name, text in (("ingest", "take in the newest detections, or files"), ("backfill", "take in every window not done yet")):
        p = command(name, text)
        p.add_argument("--source", action="append", help="a source; may be repeated (default: all)")
        p.add_argument("--bbox", default="world", help="west,south,east,north, or world")
        p.add_argument("--days", type=int, default=5 if name == "backfill" else 1, choices=range(1, 6))
        p.add_argument("--base", default=os.environ.get("FEED_URL", ""), help="address of the feed")
        p.add_argument("--key", default=os.environ.get("FEED_KEY", ""))
        if name == "ingest":
            p.add_argument("--date", help="first day of the window (default: the newest)")
            p.add_argument("--files", help="CSV files instead of the feed")
        else:
            p.add_argument("--start", required=True)
            p.add_argument("--end", required=True)
            p.add_argument("--force", action="store_true", help="also what is done")
            p.add_argument("--at-once", type=int, default=4, help="requests under way at most")
            p.add_argument("--dry-run", action="store_true")
    p = command("map", "ask the map around uncovered detections")
    p.add_argument("--mirror", action="append", required=True)
    p.add_argument("--limit", type=int, default=50)
    p = command("land-cover", "ask the land cover where it is not known")
    p.add_argument("--probe", action="store_true", help="only see whether the service answers")
    p.add_argument("--limit", type=int, default=500)
    p = command("prune", "count what would be deleted, or delete it")
    p.add_argument("--apply", action="store_true")
    p = command("watch", "ask the feed again and again, until SIGTERM")
    p.add_argument("--base", required=True)
    p.add_argument("--key", default="")
    p.add_argument("--bbox", default="world")
    p.add_argument("--source", action="append", default=[])
    p.add_argument("--days", type=int, default=1)
    p.add_argument("--minutes", type=float, default=10)
    p.add_argument("--checkpoint", required=True, help="folder for the streams' progress")
    p = command("compact", "take many small files together")
    p.add_argument("--most", type=int, default=16, help="files of a day, or of a log, that may stay")
    p = command("report", "hold the classes against labels from the map")
    p.add_argument("--out", help="folder for the JSON file (default: printed)")
    p = command("page", "a page of detections, or of grid cells, as GeoJSON")
    p.add_argument("--class", dest="classes", action="append", default=[])
    p.add_argument("--source", dest="sources", action="append", default=[])
    for name in ("--date-from", "--date-to", "--bbox"):
        p.add_argument(name)
    p.add_argument("--limit", type=int, default=50_000)
    p.add_argument("--resolution", type=float)
    command("health", "the health document")
    return top


def _feed(spark: SparkSession, o, source: str, days: int, date: str | None) -> DataFrame:
    spark.dataSource.register(DetectionFeed)
    reader = spark.read.format("detections").options(base=o.base, key=o.key, sources=source, bbox=o.bbox, days=str(days))
    return (reader.option("dates", date) if date else reader).load().drop("feed")


def _around(spark: SparkSession, mirrors: list[str]):
    """query(lat, lon, radius) for ``refresh_map``: the facilities of one box, few enough for a list."""

    def query(lat: float, lon: float, radius: float) -> list[dict]:
        high = radius / 111_320
        wide = high / max(0.2, math.cos(math.radians(lat)))
        box = (max(-180.0, lon - wide), max(-90.0, lat - high), min(180.0, lon + wide), min(90.0, lat + high))
        answer = ask_map(map_query(overpass_box(",".join(map(str, box)))), mirrors)
        found = from_elements(map_elements(spark.createDataFrame([(json.dumps(answer),)], "value string")))
        return [r.asDict() for r in found.collect()]

    return query


def run(spark: SparkSession, argv: list[str]) -> dict:
    """Do what the arguments say; returns what is printed."""
    o = parser().parse_args(argv)
    store = Store(spark, o.store)
    if o.command in ("ingest", "backfill"):
        o.bbox, sources = normalize_bbox(o.bbox), parse_sources(",".join(o.source or SOURCES))
    if o.command == "ingest":
        raw = lambda s: read_detections(spark, o.files) if o.files else _feed(spark, o, s, o.days, o.date)
        return {s: run_cycle(store, raw(s), s, history=History.from_env(), bbox=o.bbox, days=o.days) for s in sources}
    if o.command == "backfill":
        if o.dry_run:
            done = backfill(store, sources, o.start, o.end, o.bbox, None, o.days, o.force, True)
        else:
            done = backfill_feed(store, sources, o.start, o.end, {"base": o.base, "key": o.key, "bbox": o.bbox}, o.days, o.at_once, history=History.from_env(), force=o.force)
        return {"units": [[s, str(day), days, status] for s, day, days, status in done]}
    if o.command == "map":
        return refresh_map(store, _around(spark, o.mirror), limit=o.limit)
    if o.command == "land-cover":
        service = LandCover.from_env()
        if not o.probe:
            refresh_land_cover(store, service, o.limit)
        return service.status()
    if o.command == "prune":
        return maintenance(store, dry_run=not o.apply)
    if o.command == "watch":
        feed = {"base": o.base, "key": o.key, "bbox": normalize_bbox(o.bbox), "days": str(o.days)}
        sources = parse_sources(",".join(o.source or SOURCES))
        streams = [stream_feed(store, feed, s, f"{o.checkpoint}/{s}", o.minutes, worker_id=s) for s in sources]
        return {s: {"status": end} for s, end in zip(sources, until_stopped(store, streams))}
    if o.command == "compact":
        return {"files": compact(store, o.most)}
    rows = serve.served(store.read("hotspots"), store.read("enrichment"))
    if o.command == "report":
        found = report(rows)
        if o.out:
            write_report(found, o.out)
            return {"written": o.out}
        return json.loads(found.toJSON().first())
    if o.command == "page":
        filters = serve.Filters(tuple(o.classes), tuple(o.sources), o.date_from, o.date_to, o.bbox)
        found = serve.page_document(rows, filters, o.limit) if o.resolution is None else serve.grid_document(rows, o.resolution, filters, o.limit)
        return json.loads(found.first().document)
    found = serve.health_document(store.read("hotspots"), store.read("enrichment"), store.read("facilities"), store.read("run_log"), store.read("worker_status"), F.current_timestamp())
    return json.loads(found.toJSON().first())


def main() -> int:
    spark = SparkSession.builder.appName("emberline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = run(spark, sys.argv[1:])
    print(json.dumps(found, indent=2))
    failed = [x for x in found.values() if isinstance(x, dict) and x.get("status") == "failed"]
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
