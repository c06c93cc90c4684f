"""What readers ask for: filtered pages, grid cells, one detection, statistics and health."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.config import box_of
from emberline.functions.values import acq_datetime, iso

UNCLASSIFIED = "unclassified"


@dataclass(frozen=True)
class Filters:
    classes: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    bbox: str | None = None

    def __post_init__(self):
        for d in (self.date_from, self.date_to):
            if d is not None:
                dt.date.fromisoformat(d)
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("date_from is after date_to")
        if self.bbox is not None:
            box_of(self.bbox, ordered=False)

    def apply(self, rows: DataFrame) -> DataFrame:
        """Dates and sources reach the scan; a box that runs west over the date line wraps."""
        if self.sources:
            rows = rows.filter(F.col("source").isin(*self.sources))
        if self.date_from:
            rows = rows.filter(F.col("acq_date") >= F.lit(self.date_from).cast("date"))
        if self.date_to:
            rows = rows.filter(F.col("acq_date") <= F.lit(self.date_to).cast("date"))
        if self.bbox is not None:
            w, s, e, n = box_of(self.bbox, ordered=False)
            lon = F.col("longitude")
            across = lon.between(w, e) if w <= e else (lon >= w) | (lon <= e)
            rows = rows.filter(F.col("latitude").between(s, n) & across)
        if self.classes:
            rows = rows.filter(F.coalesce("class", F.lit(UNCLASSIFIED)).isin(*self.classes))
        return rows


def check_page(limit: int, resolution: float | None = None) -> None:
    if not 1 <= limit <= 200_000:
        raise ValueError("limit must be 1 to 200000")
    if resolution is not None and not 0.01 <= resolution <= 5.0:
        raise ValueError("resolution must be 0.01 to 5 degrees")


def served(hotspots: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Detections with what is known of them.

    Where both are cut by day the day is met too, so that a filter of days prunes either scan.
    """
    known = enrichment.withColumnRenamed("hotspot_id", "id")
    if "acq_date" not in known.columns:
        return hotspots.join(known, "id", "left")
    extra = [c for c in known.columns if c not in ("id", "acq_date")]
    return hotspots.join(known, ["id", "acq_date"], "left").select(*hotspots.columns, *extra)


#: The order of a page: by class (nulls last), newest first; ids break ties.
ORDER = ("class", "acq_date", "acq_time", "id")
#: Rows that a page may have to be found by one top-n; of larger ones the cut is found by counts.
SMALL_PAGE = 5_000


def _order() -> list[Column]:
    return [F.col("class").asc_nulls_last(), F.col("acq_date").desc(), F.col("acq_time").desc(), F.col("id")]


def _later_class(name: str | None) -> Column:
    return F.lit(False) if name is None else F.col("class").isNull() | (F.col("class") > name)


def after_key(rows: DataFrame, key: tuple) -> DataFrame:
    """The rows that come after (class, acq_date, acq_time, id) in the order of a page: the next page begins there."""
    name, day, time, number = key
    day = F.lit(day).cast("date")
    newer = (F.col("acq_date") < day) | (F.col("acq_date") == day) & ((F.col("acq_time") < time) | (F.col("acq_time") == time) & (F.col("id") > number))
    return rows.filter(_later_class(name) | F.col("class").eqNullSafe(F.lit(name).cast("string")) & newer)


def _cut(counts: list[tuple], limit: int) -> tuple | None:
    """(group, how many of it) where so many rows end, of (group, n) in order; None where they do not."""
    for group, n in counts:
        if n > limit:
            return group, limit
        limit -= n
    return None


def first_rows(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of a page's order, unsorted.

    Counts by class and day, then by the minutes of one day, find where the page ends: a few thousand numbers. All
    rows before that minute are filtered, and only those of the minute are numbered, so no task sees more than a minute.
    """
    found = [((r["class"], r.acq_date), r.n) for r in rows.groupBy("class", "acq_date").agg(F.count("*").alias("n")).collect()]
    cut = _cut(sorted(found, key=lambda x: (x[0][0] is None, x[0][0] or "", -x[0][1].toordinal())), limit)
    if cut is None:
        return rows
    (name, day), rest = cut
    own = F.col("class").eqNullSafe(F.lit(name).cast("string"))
    edge = rows.filter(own & (F.col("acq_date") == F.lit(day)))
    minutes = [(r.acq_time, r.n) for r in edge.groupBy("acq_time").agg(F.count("*").alias("n")).collect()]
    time, rest = _cut(sorted(minutes, key=lambda x: -x[0]), rest) or (None, 0)
    earlier = F.col("class").isNotNull() if name is None else F.col("class") < name
    whole = earlier | own & ((F.col("acq_date") > F.lit(day)) | (F.col("acq_date") == F.lit(day)) & (F.col("acq_time") > F.lit(time)))
    last = edge.filter(F.col("acq_time") == F.lit(time)).withColumn("_n", F.row_number().over(Window.partitionBy("acq_time").orderBy("id"))).filter(F.col("_n") <= rest).drop("_n")
    return rows.filter(F.coalesce(whole, F.lit(False))).unionByName(last)


def page(rows: DataFrame, filters: Filters = Filters(), limit: int = 50_000, after: tuple | None = None) -> DataFrame:
    """The first ``limit`` rows by class (nulls last), newest first; ids break ties.

    after is the key (class, acq_date, acq_time, id) of the last row of the page before. A large page is cut by counts and sorted by
    ranges, in as many tasks as its rows need.
    """
    check_page(limit)
    rows = filters.apply(rows)
    if after is not None:
        rows = after_key(rows, after)
    if limit <= SMALL_PAGE:
        return rows.orderBy(*_order()).limit(limit)
    return first_rows(rows, limit).orderBy(*_order())


def grid(rows: DataFrame, resolution: float, filters: Filters = Filters(), limit: int = 50_000) -> DataFrame:
    """One row a cell: its newest detection, its centre, and count, mean and largest FRP of all of it.

    A grouping, not windows: each cell is reduced before the shuffle, so a crowded cell is no one
    task's burden.
    """
    check_page(limit, resolution)
    cell = [F.floor(F.col(c) / F.lit(resolution)).cast("int").alias(n) for c, n in (("latitude", "cell_lat"), ("longitude", "cell_lon"))]
    newest = F.struct("acq_date", "acq_time", (-F.col("id")).alias("_id"), "id", "source", F.coalesce("class", F.lit(UNCLASSIFIED)).alias("class"), "nearest_facility_name")
    out = filters.apply(rows).groupBy(*cell).agg(
        F.count("*").alias("cell_count"), F.round(F.avg(F.col("frp").cast("decimal(18,6)")), 2).cast("double").alias("mean_frp"), F.max("frp").alias("max_frp"), F.max(newest).alias("n"),
    )
    centre = lambda c: (F.col(c).cast("decimal(18,6)") + F.lit(0.5).cast("decimal(18,6)")) * F.lit(resolution).cast("decimal(18,6)")
    return out.orderBy("cell_lat", "cell_lon").limit(limit).select(
        "cell_lat", "cell_lon", centre("cell_lat").cast("double").alias("lat"), centre("cell_lon").cast("double").alias("lon"), "n.id", "n.source", "n.class", "n.acq_date", "n.acq_time",
        "n.nearest_facility_name", "cell_count", "mean_frp", "max_frp", F.lit(resolution).alias("resolution_deg"),
    )


def _feature(columns: list[str]) -> Column:
    """The GeoJSON feature of a row, as text; nulls are written out."""
    skip = {"location", "ingested_at", "dt"}
    zero = {"detections_24h", "detections_7d", "detections_30d", "days_active_30d", "persistence_score"}
    props = []
    for c in columns:
        if c in skip:
            continue
        value = F.col(c)
        if c == "class":
            value = F.coalesce(value, F.lit(UNCLASSIFIED))
        elif c == "within_facility":
            value = F.coalesce(value, F.lit(False))
        elif c in zero:
            value = F.coalesce(value, F.lit(0))
        elif c == "acq_date":
            value = F.date_format(value, "yyyy-MM-dd")
        props.append(value.alias(c))
    props.append(iso(acq_datetime(F.col("acq_date"), F.col("acq_time"))).alias("acq_datetime"))
    return _json_feature(F.array("longitude", "latitude"), props)


def _json_feature(at: Column, props: list) -> Column:
    point = F.struct(F.lit("Point").alias("type"), at.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*props).alias("properties"))
    return F.to_json(feature, {"ignoreNullFields": "false"})


def features(rows: DataFrame) -> DataFrame:
    """(id, feature): one GeoJSON feature a row, as text."""
    return rows.select("id", _feature(rows.columns).alias("feature"))


def _collection(top: DataFrame, feature: Column, rows: DataFrame, filters: Filters, limit: int, resolution: float | None) -> DataFrame:
    """One row: the features of top, at most ``limit``, in order, with the count of all rows that match."""
    when = acq_datetime(F.col("acq_date"), F.col("acq_time"))
    entry = F.struct(F.coalesce("class", F.lit(UNCLASSIFIED)).alias("class"), (-F.unix_seconds(when)).alias("age"), "id", feature.alias("feature"))
    body = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["feature"]), ",").alias("features"), F.count("*").alias("count"))
    total = filters.apply(rows).agg(F.count("*").alias("total"))
    number = F.col("total").cast("string")
    text = F.concat(
        F.lit('{"type":"FeatureCollection","features":['), "features", F.lit('],"count":'), F.col("count").cast("string"), F.lit(',"TotalFeatures":'), number, F.lit(',"numberMatched":'), number,
        F.lit(',"truncated":'), (F.col("total") > limit).cast("string"), F.lit(f',"resolution":{"null" if resolution is None else resolution}}}'),
    )
    return body.join(F.broadcast(total)).select(text.alias("document"))


def page_document(rows: DataFrame, filters: Filters = Filters(), limit: int = 50_000) -> DataFrame:
    """One row with one text: the page as a FeatureCollection.

    The page is cut as ``page`` cuts it, then ordered by class as served, newest first, ids breaking ties.
    Only the page, at most 200,000 features, meets in a task.
    """
    top = page(rows, filters, limit)
    return _collection(top, _feature(top.columns), rows, filters, limit, None)


def grid_document(rows: DataFrame, resolution: float, filters: Filters = Filters(), limit: int = 50_000) -> DataFrame:
    """One row with one text: the grid as a FeatureCollection of cells, ordered as a page is."""
    cells = grid(rows, resolution, filters, limit)
    names = ("id", "source", "class", "nearest_facility_name", "resolution_deg", "cell_count", "mean_frp", "max_frp")
    props = [F.col(c) for c in names] + [iso(acq_datetime(F.col("acq_date"), F.col("acq_time"))).alias("acq_datetime")]
    return _collection(cells, _json_feature(F.array("lon", "lat"), props), rows, filters, limit, resolution)


def detail(rows: DataFrame, hotspot_id: int) -> DataFrame:
    """The one detection with this id, or no row."""
    return features(rows.filter(F.col("id") == hotspot_id))


def class_counts(rows: DataFrame) -> DataFrame:
    """(class, n), most frequent first."""
    return rows.groupBy(F.coalesce("class", F.lit(UNCLASSIFIED)).alias("class")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class")


def stats(hotspots: DataFrame, facilities: DataFrame) -> DataFrame:
    """One row: totals, the range of days, the sources."""
    own = hotspots.agg(
        F.count("*").alias("total_hotspots"), F.date_format(F.min("acq_date"), "yyyy-MM-dd").alias("min_date"), F.date_format(F.max("acq_date"), "yyyy-MM-dd").alias("max_date"),
        F.countDistinct("acq_date").alias("days"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"),
    )
    return own.join(F.broadcast(facilities.agg(F.count("*").alias("total_facilities"))))


def last_run(log: DataFrame, status: str | None = None) -> DataFrame:
    """The row of the latest run (of a status)."""
    rows = log if status is None else log.filter(F.col("status") == status)
    best = rows.agg(F.max_by(F.struct(*log.columns), F.struct("finished_at", "source")).alias("r")).filter(F.col("r").isNotNull())
    return best.select("r.*")


def last_run_per_source(log: DataFrame) -> DataFrame:
    """The row of the latest run of each source."""
    rest = [c for c in log.columns if c != "source"]
    return log.groupBy("source").agg(F.max_by(F.struct(*rest), F.struct("finished_at", "date_from")).alias("r")).select("source", *[F.col("r")[c].alias(c) for c in rest])


def inserted_since(log: DataFrame, since: Column) -> DataFrame:
    return log.filter((F.col("status") == "success") & (F.col("finished_at") >= since)).agg(F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted_24h"))


def worker_state(workers: DataFrame, now: Column) -> DataFrame:
    """One row: configured, alive (a heartbeat within 45 minutes) and the largest of each field."""
    names = ("worker_id", "last_heartbeat_at", "cycle_count", "last_cycle_status", "last_error", "version")
    fresh = F.coalesce(F.max("last_heartbeat_at") > now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(45)), F.lit(False))
    return workers.agg((F.count("*") > 0).alias("configured"), fresh.alias("alive"), *[F.max(c).alias(c) for c in names if c in workers.columns])


def evidence(enrichment: DataFrame) -> DataFrame:
    """One row: how much is classified, seen by vision, covered by land cover."""
    return enrichment.agg(
        F.count("class").alias("classified_count"), F.max("enriched_at").alias("last_enrichment_at"), F.max("vision_model_version").alias("model_version"), F.count("vision_model_version").alias("inferred_count"),
        F.coalesce(F.bool_or(F.col("landcover_class").isNotNull()), F.lit(False)).alias("landcover_configured"), F.count("landcover_class").alias("landcover_count"),
    )


def health_document(hotspots: DataFrame, enrichment: DataFrame, facilities: DataFrame, log: DataFrame, workers: DataFrame, now: Column) -> DataFrame:
    """The health document as one row.

    status is degraded where the last run failed within a day, whose error is then pipeline_error. The log is
    read once and reduced to a row a source before the shuffle; of every other table only counts move.
    """
    since = now - F.make_dt_interval(F.lit(1))
    names = ("source", "kind", "bbox", "date_from", "date_to", "days", "returned", "inserted", "duplicates", "invalid", "status", "error", "finished_at")
    run, at, good = F.struct(*[c for c in names if c in log.columns]), F.struct("finished_at", "date_from"), F.col("status") == "success"
    each = log.groupBy("source").agg(
        F.max_by(run, at).alias("last"), F.max_by(F.when(good, run), F.when(good, at)).alias("good"), F.sum(F.when(good & (F.col("finished_at") >= since), F.col("inserted"))).alias("fresh"),
    )
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(c)["finished_at"], "source")))
    named = F.when(F.col("source").isNotNull(), F.struct("source", "last"))
    runs = each.agg(
        latest("good").alias("last_successful_ingestion"), latest("last").alias("last_run"), F.sort_array(F.collect_list("source")).alias("sources_used"),
        F.map_from_entries(F.sort_array(F.collect_list(named))).alias("per_source"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("inserted_24h"),
    )
    seen = evidence(enrichment).select(
        "last_enrichment_at", "classified_count", F.struct(F.lit(False).alias("configured"), "model_version", "inferred_count").alias("vision"),
        F.struct(F.col("landcover_configured").alias("configured"), F.col("landcover_count").alias("enriched_count")).alias("landcover"),
    )
    worker = worker_state(workers, now)
    parts = (
        seen, hotspots.agg(F.count("*").alias("total_hotspots")), facilities.agg(F.count("*").alias("total_facilities")), worker.select(F.struct(*worker.columns).alias("worker")),
    )
    for part in parts:
        runs = runs.join(F.broadcast(part))
    failed = F.coalesce((F.col("last_run.status") == "failed") & (F.col("last_run.finished_at") >= since), F.lit(False))
    return runs.select(F.when(failed, "degraded").otherwise("ok").alias("status"), F.when(failed, F.col("last_run.error")).alias("pipeline_error"), *runs.columns)


def degraded(log: DataFrame, now: Column) -> DataFrame:
    """One row: whether the last run failed within a day."""
    last = last_run(log).select("status", "finished_at")
    return last.agg(F.coalesce(F.bool_or((F.col("status") == "failed") & (F.col("finished_at") >= now - F.make_dt_interval(F.lit(1)))), F.lit(False)).alias("degraded"))
