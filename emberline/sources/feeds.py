"""Feeds over HTTP: the detection service as a Spark data source, and the map query service."""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from emberline.schemas import RAW_DETECTION


class FeedError(RuntimeError):
    """A feed could not be read; status is the HTTP code, if there was an answer."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def feed_url(base: str, key: str, source: str, bbox: str, days: int, date: str | None = None) -> str:
    if not 1 <= days <= 5:
        raise ValueError("days must be 1 to 5")
    return "/".join([base.rstrip("/"), key, source, bbox, str(days)] + ([date] if date else []))


def fetch_text(url: str, attempts: int = 3, timeout: float = 60.0, sleep=time.sleep) -> str:
    """The body; 429, 5xx and time-outs are tried again after 1, 2, 4 ... seconds, 20 at most."""
    last: FeedError | None = None
    for attempt in range(1, attempts + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return answer.read().decode("utf-8-sig")
        except urllib.error.HTTPError as e:
            last = FeedError(f"HTTP {e.code}", e.code)
            if e.code != 429 and e.code < 500:
                raise last from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            last = FeedError(f"no answer: {e}")
        if attempt < attempts:
            sleep(min(2 ** (attempt - 1), 20))
    raise last


def parse_csv(text: str) -> list[dict[str, str]]:
    return list(csv.DictReader(io.StringIO(text)))


@dataclass
class FeedPart(InputPartition):
    source: str
    date: str | None


class DetectionFeed(DataSource):
    """spark.read or readStream.format("detections"): options base, key, sources, bbox, days, dates (comma-separated; not of a stream).

    One partition a source and date. Every column is text, as sent; feed names the source.
    """

    @classmethod
    def name(cls) -> str:
        return "detections"

    def schema(self) -> str:
        return ", ".join(f"{f.name} string" for f in RAW_DETECTION) + ", feed string"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FeedStream(self.options)


def _split(options: dict, key: str) -> list[str]:
    return [x for x in options.get(key, "").split(",") if x]


def _rows(o: dict, source: str, days: int, date: str | None):
    """The rows of one request, every column as sent, and the source."""
    names = [f.name for f in RAW_DETECTION]
    url = feed_url(o["base"], o.get("key", ""), source, o["bbox"], days, date)
    for row in parse_csv(fetch_text(url, int(o.get("attempts", "3")), float(o.get("timeout", "60")))):
        yield tuple(row.get(n) for n in names) + (source,)


class _FeedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [FeedPart(s, d) for s in _split(self.options, "sources") for d in _split(self.options, "dates") or [None]]

    def read(self, partition):
        yield from _rows(self.options, partition.source, int(self.options.get("days", "1")), partition.date)


class _FeedStream(DataSourceStreamReader):
    """The feed asked again and again: option every (seconds, 600) and days (1), that each tick asks anew; today fixes the last day.

    An offset is a tick of the clock and the day it fell on. A batch asks, one partition a source and day, for the last ``days`` days,
    since rows come late, and for all days since the offset before, since the reader may have been away. Rows come again
    so; whoever stores them knows them by their key. A batch that is delivered again asks for the same days.
    """

    def __init__(self, options):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"tick": 0, "until": ""}

    def latestOffset(self) -> dict:
        now = time.time()
        today = self.options.get("today") or time.strftime("%Y-%m-%d", time.gmtime(now))
        return {"tick": int(now / float(self.options.get("every", "600"))), "until": today}

    def partitions(self, start: dict, end: dict) -> list[FeedPart]:
        if start == end or not end["until"]:
            return []
        last = dt.date.fromisoformat(end["until"])
        first = last - dt.timedelta(days=int(self.options.get("days", "1")) - 1)
        if start["until"]:
            first = min(first, dt.date.fromisoformat(start["until"]))
        days = [str(first + dt.timedelta(days=k)) for k in range((last - first).days + 1)]
        return [FeedPart(s, d) for s in _split(self.options, "sources") for d in days]

    def read(self, partition: FeedPart):
        yield from _rows(self.options, partition.source, 1, partition.date)


def ask_windows(units: DataFrame, options: dict[str, str], at_once: int = 4) -> DataFrame:
    """The feed's answers for units (source, date_from, days): raw columns, source, date_from, error and asked.

    As many tasks as requests may be under way, each asking for its units one after another. Each unit gives one row with
    asked set, whose error is null where it was answered, and the rows of the answer.
    """
    names = [f.name for f in RAW_DETECTION]
    out = ", ".join(f"{n} string" for n in names) + ", source string, date_from date, error string, asked boolean"

    def ask(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for source, day, days in zip(*(batch.column(i).to_pylist() for i in range(3))):
                error, rows = None, []
                try:
                    rows = list(_rows(options, source, days, str(day)))
                except FeedError as e:
                    error = str(e)
                n = len(rows) + 1
                columns = [pa.array([r[k] for r in rows] + [None], pa.string()) for k in range(len(names))]
                about = [pa.array([source] * n, pa.string()), pa.array([day] * n, pa.date32()), pa.array([error] * n, pa.string()), pa.array([False] * (n - 1) + [True], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns + about, names=[*names, "source", "date_from", "error", "asked"])

    numbered = units.select("source", "date_from", "days").repartitionByRange(at_once, "date_from", "source")
    return numbered.mapInArrow(ask, out)


# What the map query selects.
SELECTORS = ('["industrial"]', '["landuse"="industrial"]', '["man_made"="works"]', '["power"="plant"]', '["landuse"="quarry"]')


def map_query(box: str, timeout: int = 60) -> str:
    """Union of every selector over nodes, ways and relations of a south,west,north,east box."""
    parts = "".join(f"{kind}{s}({box});" for s in SELECTORS for kind in ("node", "way", "relation"))
    return f"[out:json][timeout:{timeout}];({parts});out body geom;"


def ask_map(text: str, mirrors: list[str], retries: int = 3, timeout: float = 60.0, sleep=time.sleep) -> dict:
    """The first good answer: a bad query (400) ends it, a busy mirror passes on to the next, then waits 5, 10, 20 ... s."""
    last = FeedError("no mirrors")
    for attempt in range(retries):
        for url in mirrors:
            try:
                body = urllib.parse.urlencode({"data": text}).encode()
                with urllib.request.urlopen(urllib.request.Request(url, body), timeout=timeout) as answer:
                    return json.loads(answer.read())
            except urllib.error.HTTPError as e:
                last = FeedError(f"HTTP {e.code}", e.code)
                if e.code == 400:
                    raise last from e
            except (urllib.error.URLError, TimeoutError, ConnectionError, json.JSONDecodeError) as e:
                last = FeedError(f"no answer: {e}")
        if attempt + 1 < retries:
            sleep(5 * 2**attempt)
    raise last
