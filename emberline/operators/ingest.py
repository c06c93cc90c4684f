"""Validation, parsing, idempotent insertion and screening of detection rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.config import Screen
from emberline.functions.geo import grid_cell, grid_cells_near, reach_cells
from emberline.functions.values import acq_datetime, blank_to_null


def is_valid(raw: DataFrame) -> Column:
    """Numbers in range, a real date, a time of day."""
    lat, lon = (F.trim(c).try_cast("double") for c in ("latitude", "longitude"))
    date = F.try_to_date(F.trim("acq_date"), "yyyy-M-d")
    t = F.trim("acq_time").try_cast("int")
    ok = ~F.isnan(lat) & lat.between(-90, 90) & ~F.isnan(lon) & lon.between(-180, 180) & date.isNotNull() & t.between(0, 2359) & (t % 100 <= 59)
    return F.coalesce(ok, F.lit(False))


def parse(raw: DataFrame, source: str | Column) -> DataFrame:
    """Typed rows of valid raw ones; blanks and unreadable optional numbers become null."""
    text = {c: blank_to_null(F.col(c)) for c in ("satellite", "instrument", "confidence", "version", "daynight")}
    have = set(raw.columns)
    number = {c: (F.trim(c).try_cast("float") if c in have else F.lit(None).cast("float")) for c in ("frp", "bright_ti4", "bright_ti5", "scan", "track")}
    origin = F.lit(source) if isinstance(source, str) else source
    return raw.select(
        origin.alias("source"), text["satellite"].alias("satellite"), text["instrument"].alias("instrument"), text["confidence"].alias("confidence"), text["version"].alias("version"),
        F.trim("latitude").try_cast("double").alias("latitude"), F.trim("longitude").try_cast("double").alias("longitude"), F.try_to_date(F.trim("acq_date"), "yyyy-M-d").alias("acq_date"),
        F.trim("acq_time").try_cast("short").alias("acq_time"), *[number[c].alias(c) for c in number], F.substring(text["daynight"], 1, 1).alias("daynight"),
    )


def natural_key(df: DataFrame) -> list[Column]:
    """What makes two detections the same; nulls equal nulls."""
    place = [F.round(F.col(c).cast("decimal(18,8)"), 4).alias(n) for c, n in (("latitude", "lat4"), ("longitude", "lon4"))]
    texts = [F.coalesce(F.col(c), F.lit("\0")).alias(c) for c in ("source", "satellite")]
    return [*texts, *place, F.col("acq_date").alias("acq_date"), F.col("acq_time").alias("acq_time")]


def new_rows(batch: DataFrame, stored: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows of batch whose key is new: the first of each key by ``order``, not in stored already."""
    keyed = batch.withColumn("_key", F.struct(*natural_key(batch)))
    first = Window.partitionBy("_key").orderBy(*(order or batch.columns))
    once = keyed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    held = stored.select(F.struct(*natural_key(stored)).alias("_key"))
    return once.join(held, "_key", "left_anti").drop("_key")


def with_ids(rows: DataFrame, stored: DataFrame, top: int | None = None) -> DataFrame:
    """Ids after the largest stored one (top, where that is known), in the order of the natural key: the same on every run.

    Ids are the partition's offset plus the place in the sorted partition; only counts go to the driver.
    """
    spark = rows.sparkSession
    from emberline.tables import materialize

    key = [F.struct(*natural_key(rows)).alias("_key")]
    dealt = rows.select("*", *key).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_key")
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()))
    top = (stored.agg(F.max("id")).first()[0] or 0) if top is None else top
    counts = sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect())
    offsets, total = [], top
    for part, n in counts:
        offsets.append((part, total))
        total += n
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    start = F.broadcast(spark.createDataFrame(offsets, "_part int, _start long"))
    return dealt.withColumn("_n", place).join(start, "_part").withColumn("id", F.col("_start") + F.col("_n")).drop("_key", "_part", "_n", "_start")


def ingest_counts(raw: DataFrame, stored: DataFrame, source: str | Column) -> DataFrame:
    """One row: returned, inserted, duplicates, invalid."""
    good = raw.filter(is_valid(raw))
    fresh = new_rows(parse(good, source), stored)
    sums = raw.agg(F.count("*").alias("returned"), F.count_if(~is_valid(raw)).alias("invalid"))
    return sums.join(fresh.agg(F.count("*").alias("inserted"))).select("returned", "inserted", (F.col("returned") - F.col("invalid") - F.col("inserted")).alias("duplicates"), "invalid")


def dt_of(df: DataFrame) -> DataFrame:
    """df with dt, the time of each detection."""
    return df.withColumn("dt", acq_datetime(F.col("acq_date"), F.col("acq_time")))


# Screening: what is kept before storage.


def facility_cells(facilities: DataFrame) -> DataFrame:
    return facilities.filter("flat IS NOT NULL AND flon IS NOT NULL").select(grid_cell(F.col("flat"), F.col("flon")).alias("cell")).distinct()


def prior_cells(stored: DataFrame, since: Column) -> DataFrame:
    """(source, cell) that had detections from a day on."""
    return stored.filter(F.col("acq_date") >= since).select("source", grid_cell(F.col("latitude"), F.col("longitude")).alias("cell")).distinct()


def percentile_threshold(rows: DataFrame, percentile: float) -> DataFrame:
    """One row: threshold, the nearest-rank percentile of frp.

    Values are counted by bands of about one percent of their size first. Only the bands' counts, a few thousand
    at most, and the distinct values of the one band that holds the rank meet in a task.
    """
    frp = F.col("frp").cast("double")
    band = F.when(frp == 0, 0).otherwise((F.signum(frp) * (F.floor(F.log2(F.abs(frp)) * 64) + 100_000)).cast("long")).alias("band")
    values = rows.filter("frp IS NOT NULL").groupBy(band, F.col("frp").alias("threshold")).agg(F.count("*").alias("n"))
    ordered = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bands = values.groupBy("band").agg(F.sum("n").alias("in_band")).withColumns({"upto": F.sum("in_band").over(ordered), "all": F.sum("in_band").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    rank = F.greatest(F.lit(1), F.ceil(F.col("all") * F.lit(percentile / 100)))
    held = bands.filter((F.col("upto") >= rank) & (F.col("upto") - F.col("in_band") < rank)).select("band", (rank - F.col("upto") + F.col("in_band")).alias("rank"))
    inside = values.join(F.broadcast(held), "band").withColumn("upto", F.sum("n").over(Window.orderBy("threshold")))
    return inside.filter("upto >= rank").agg(F.min("threshold").alias("threshold"))


def screen(rows: DataFrame, cells: DataFrame, prior: DataFrame, cfg: Screen = Screen()) -> DataFrame:
    """rows (source, latitude, longitude, frp) with near, in_day, prior, bright; near alone decides what is kept.

    The facility cells are spread over the reach once and made distinct; the equi-join on cells then
    keeps its natural plan (broadcast where small, shuffled where not).
    """
    spread = cells.select(F.explode(grid_cells_near(F.col("cell"), reach_cells(cfg.reach_m))).alias("cell")).distinct().withColumn("_near", F.lit(True))
    celled = rows.withColumn("cell", grid_cell(F.col("latitude"), F.col("longitude")))
    per_cell = celled.groupBy("cell").agg(F.count("*").alias("_in_cell"))
    limit = rows.select(F.lit(float(cfg.frp_mw)).alias("threshold")).limit(1) if cfg.frp_mw else percentile_threshold(rows, cfg.percentile)
    marked = celled.join(spread, "cell", "left").join(prior.withColumn("_prior", F.lit(True)), ["source", "cell"], "left").join(per_cell, "cell", "left").join(F.broadcast(limit))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return marked.select(*rows.columns, flag(F.col("_near")).alias("near"), flag(F.col("_in_cell") >= 2).alias("in_day"), flag(F.col("_prior")).alias("prior"), flag(F.col("frp") >= F.col("threshold")).alias("bright"))


def screen_stats(marked: DataFrame) -> DataFrame:
    """One row: fetched, kept, dropped and how many rows each signal marks."""
    return marked.agg(F.count("*").alias("fetched"), F.count_if("near").alias("kept"), F.count_if(~F.col("near")).alias("dropped"), F.count_if("in_day").alias("in_day"), F.count_if("prior").alias("prior"), F.count_if("bright").alias("frp"))


def windows_of(spans: DataFrame, days: int = 5) -> DataFrame:
    """(date_from, days) windows that cover each span (first, last), the last cut short."""
    dates = spans.filter("first <= last").select("last", F.explode(F.sequence("first", "last", F.make_dt_interval(F.lit(days)))).alias("date_from"))
    return dates.withColumn("date_from", F.col("date_from").cast("date")).select("date_from", F.least(F.lit(days), F.date_diff("last", F.col("date_from")) + 1).cast("int").alias("days"))


def day_windows(spark, start: str, end: str, days: int = 5) -> DataFrame:
    """The windows of one span of days."""
    return windows_of(spark.range(1).select(F.lit(start).cast("date").alias("first"), F.lit(end).cast("date").alias("last")), days)


def pending_units(units: DataFrame, log: DataFrame, bbox: str) -> DataFrame:
    """Backfill units (source, date_from, days) that no successful run has done for this box."""
    done = log.filter((F.col("kind") == "backfill") & (F.col("status") == "success") & (F.col("bbox") == bbox)).select("source", "date_from", "days").distinct()
    return units.join(done, ["source", "date_from", "days"], "left_anti")
