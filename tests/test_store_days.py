import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from emberline import schemas, tables
from emberline.operators import serve
from emberline.sources.land_cover import LandCover
from emberline.streaming import worker as W

DAYS = ("2026-09-04", "2026-09-05", "2026-09-06")


def row(lat, day, time="1"):
    return (lat, "20", day, time) + ("x",) * 10


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    s = W.Store(spark, str(tmp_path_factory.mktemp("made") / "store"))
    tables.append(spark.createDataFrame([("node", 1, "Plant", "refinery", {}, "osm", "POINT(20 10)", 10.0, 20.0, None, None)], schemas.FACILITIES), s.path("facilities"))
    rows = [row("10", d) for d in DAYS] + [row("60", DAYS[1])]
    assert W.run_cycle(s, spark.createDataFrame(rows, schemas.RAW_DETECTION), "A")["inserted"] == 4
    return s.folder


@pytest.fixture
def store(spark, made, tmp_path):
    """Three days with a detection at a plant each, on the second a far one too."""
    shutil.copytree(made, tmp_path / "store")
    return W.Store(spark, str(tmp_path / "store"))


def files(store):
    return {os.path.relpath(p, store.folder) for name in ("hotspots", "enrichment") for p in glob.glob(f"{store.folder}/{name}/*/*.parquet")}


def ids(store, name, key):
    return sorted(r[0] for r in store.read(name).select(key).collect())


def test_a_prune_rewrites_the_days_it_touches(store):
    before = files(store)
    assert W.maintenance(store, dry_run=False)["delete"] == 1
    changed = before ^ files(store)
    assert changed and all(f"acq_date={DAYS[1]}" in f for f in changed)
    assert len(ids(store, "hotspots", "id")) == 3 == len(ids(store, "enrichment", "hotspot_id"))
    assert sorted(os.listdir(store.folder)) == sorted(set(os.listdir(store.folder)) - {x for x in os.listdir(store.folder) if ".fresh-" in x}) and not os.listdir(f"{store.folder}/_swaps")


@pytest.mark.parametrize("after", [0, 1])
def test_a_swap_that_breaks_off_is_ended_by_the_next_writer(store, spark, monkeypatch, after):
    """Between the two tables, and before the first: the plan is down, so both change in the end."""
    move, done = tables._move, []

    def broken(*args):
        if len(done) == after:
            raise OSError("gone")
        done.append(move(*args))

    monkeypatch.setattr(tables, "_move", broken)
    with pytest.raises(OSError):
        W.maintenance(store, dry_run=False)
    monkeypatch.undo()
    assert len(ids(store, "hotspots", "id")) == 4 and len(ids(store, "enrichment", "hotspot_id")) == 4 - after
    if after:
        again = W.run_cycle(store, spark.createDataFrame([row("10", DAYS[0])], schemas.RAW_DETECTION), "A")
        assert again == {"returned": 1, "inserted": 0, "invalid": 0, "duplicates": 1, "status": "success"}
    else:
        assert store.finish() == 1
    assert len(ids(store, "hotspots", "id")) == 3 == len(ids(store, "enrichment", "hotspot_id")) and store.finish() == 0


def test_before_the_plan_nothing_has_happened(store, monkeypatch):
    before = files(store)
    monkeypatch.setattr(tables, "finish_swaps", lambda *a: 1 / 0)
    real = tables.append

    def broken(df, path, by=None):
        if "/hotspots.fresh-" in path:
            raise OSError("gone")
        real(df, path, by)

    monkeypatch.setattr(tables, "append", broken)
    with pytest.raises(OSError):
        W.maintenance(store, dry_run=False)
    monkeypatch.undo()
    assert files(store) == before and store.finish() == 0


def test_a_day_without_rows_goes(store, spark):
    gone = store.read("hotspots").filter(F.col("acq_date") == DAYS[0])
    store.swap([DAYS[0]], {"hotspots": gone.limit(0), "enrichment": store.read("enrichment").limit(0)})
    assert not os.path.exists(f"{store.folder}/hotspots/acq_date={DAYS[0]}") and not os.path.exists(f"{store.folder}/enrichment/acq_date={DAYS[0]}")
    assert len(ids(store, "hotspots", "id")) == 3 == len(ids(store, "enrichment", "hotspot_id"))
    with pytest.raises(ValueError):
        store.swap(["2026-09-04"], {"hotspots": store.read("hotspots")})


def test_land_cover_rewrites_its_days(store, monkeypatch):
    first = store.read("enrichment").orderBy("hotspot_id").first()
    before = files(store)
    answer = lambda self, points: points.select("hotspot_id", F.lit(4).alias("code"), F.lit(None).cast("string").alias("note"))
    monkeypatch.setattr(LandCover, "answers", answer)
    W.refresh_land_cover(store, LandCover("esri", True, "http://nowhere"), limit=1)
    changed = before ^ files(store)
    assert changed and all(f"enrichment/acq_date={first.acq_date}" in f for f in changed)
    assert [r.hotspot_id for r in store.read("enrichment").filter("landcover_class = 'cropland'").collect()] == [first.hotspot_id]


def test_a_page_of_a_day_reads_that_day_of_both_tables(store):
    rows = serve.served(store.read("hotspots"), store.read("enrichment"))
    found = serve.page(rows, serve.Filters(date_from=DAYS[2], date_to=DAYS[2]))
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) >= 2 and all("acq_date" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)


def test_compaction_keeps_rows_and_ids(store, spark):
    for k in range(2):
        W.run_cycle(store, spark.createDataFrame([row("10", DAYS[0], str(100 + k))], schemas.RAW_DETECTION), "A")
    hot, known, top = ids(store, "hotspots", "id"), ids(store, "enrichment", "hotspot_id"), W._top_id(store)
    runs = store.read("run_log").count()
    assert tables.file_counts(spark, store.path("hotspots"))[f"acq_date={DAYS[0]}"] == 3
    done = W.compact(store, most=2)
    assert set(done) >= {"hotspots", "enrichment", "run_log", "id_ranges"} and done["hotspots"] == 3
    assert tables.file_counts(spark, store.path("hotspots"))[f"acq_date={DAYS[0]}"] == 1 == tables.file_counts(spark, store.path("id_ranges"))[""]
    assert (ids(store, "hotspots", "id"), ids(store, "enrichment", "hotspot_id"), W._top_id(store)) == (hot, known, top) and W.unfinished(store) == [] and store.read("run_log").count() == runs
    assert W.compact(store, most=30) == {}
