import math
import random

import pytest
from pyspark.sql import functions as F

from emberline import config
from emberline.functions import geo, values


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def metres(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(a)))


def test_cell_join_finds_every_near_pair_anywhere(spark):
    rng = random.Random(4)
    seeds = [(0, 0), (60, 179.99), (-60, -179.99), (89.99, 10), (89.995, -170), (-89.99, 0), (35, 135)]
    points = [(i, la, lo) for i, (la, lo) in enumerate((max(-90.0, min(90.0, a + rng.uniform(-0.02, 0.02))), (b + rng.uniform(-0.05, 0.05) + 540) % 360 - 180) for a, b in seeds for _ in range(25))]
    a = spark.createDataFrame(points, "i long, la double, lo double")
    b = a.toDF("j", "lb", "lob")
    near = geo.cell_join(a, b, 900.0, ("la", "lo"), ("lb", "lob")).filter(geo.haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("lob")) <= 900)
    found = sorted((r.i, r.j) for r in near.collect())
    assert found == sorted((i, j) for i, a1, o1 in points for j, a2, o2 in points if metres(a1, o1, a2, o2) <= 900)


def test_rings(spark):
    wkt = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
    inside = lambda la, lo: geo.in_rings(F.lit(float(la)), F.lit(float(lo)), geo.rings_of(F.lit(wkt)))
    assert tuple(one(spark, inside(2, 2), inside(5, 5), inside(11, 5))) == (True, False, False)
    far = geo.ring_distance(F.lit(0.0), F.lit(179.99), geo.rings_of(F.lit("LINESTRING(-179.99 -1, -179.99 1)")))
    assert abs(one(spark, far)[0] - metres(0, 179.99, 0, -179.99)) < 1
    box = geo.rings_of(F.lit("POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))"))
    assert abs(one(spark, geo.ring_distance(F.lit(0.5), F.lit(1.1), box))[0] - metres(0.5, 1.1, 0.5, 1.0)) < 20


def test_screening_cells(spark):
    r = one(spark, geo.grid_cell(F.lit(12.3456), F.lit(-5.6789)).alias("c"))
    assert (r.c.la, r.c.lo) == (1235, -568)
    assert [geo.reach_cells(m) for m in (-5, 0, 1, 2000, 5000)] == [0, 0, 1, 2, 5]
    assert one(spark, F.size(geo.grid_cells_near(geo.grid_cell(F.lit(10.0), F.lit(20.0)), 2)))[0] == 25


def test_radius_box_and_tiles(spark):
    b = one(spark, geo.radius_box(F.lit(89.0), F.lit(0.0), 11132.0).alias("b")).b
    assert abs(b.north - 89.1) < 1e-9 and abs(b.east - 0.5) < 1e-9
    box = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0)], "west double, south double, east double, north double")
    assert sorted(r.tile for r in geo.tiles_of(box, 2).collect()) == sorted(["0.000000,0.000000,1.000000,1.000000", "1.000000,0.000000,2.000000,1.000000", "0.000000,1.000000,1.000000,2.000000", "1.000000,1.000000,2.000000,2.000000"])


def test_hash_and_rounding(spark):
    h = [r[0] for r in spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "x string").select(values.fnv1a64("x")).collect()]
    want = [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    assert h == [x - (1 << 64) for x in want] + [None]
    assert tuple(one(spark, values.rounded(F.lit(0.145), 2), values.rounded(F.lit(-0.145), 2), values.fixed(F.lit(1234.5), 1))) == (0.15, -0.15, "1234.5")


def test_facility_types(spark):
    cases = [
        ({"power": "plant", "plant:source": "Coal;gas"}, "thermal_power_plant"), ({"industrial": "refinery"}, "refinery"), ({"industrial": "gas"}, "oil_gas_facility"), ({"industrial": "chemical"}, "petrochemical"),
        ({"industrial": "scrap_metal"}, "steel_or_metal"), ({"landuse": "quarry"}, "mining"), ({"product": "LNG", "industrial": "port"}, "lng_or_storage_terminal"), ({"landuse": "industrial"}, "industrial_area"),
        ({"man_made": "works"}, "general_factory"), ({"power": "plant", "plant:source": "solar"}, "thermal_power_plant"), ({"power": "plant", "plant:source": "geothermal"}, "thermal_power_plant"), ({}, "unknown_industrial"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, tags map<string,string>")
    assert [r[0] for r in df.orderBy("i").select(values.facility_type(F.col("tags"))).collect()] == [w for _, w in cases]
    assert [r[0] for r in df.orderBy("i").select(values.is_industrial(F.col("tags"))).collect()] == [True] * 11 + [False]


def test_land_cover(spark):
    df = spark.createDataFrame([(4,), (5,), (99,), (None,)], "c int").select(values.land_cover(F.col("c")).alias("x")).select("x.*")
    assert [(r.landcover_class, r.landcover_note) for r in df.collect()] == [("cropland", "esri class 4 (cropland)"), ("built_up", "esri class 5 (built_up)"), (None, "unknown class code 99"), (None, "no class value in response")]


@pytest.mark.parametrize("text", ["global", "68,6,98", "foo", "", None, "-200,-90,0,90", "98,6,68,38"])
def test_bad_boxes(text):
    with pytest.raises(ValueError):
        config.normalize_bbox(text)


def test_good_boxes_and_parameters():
    assert config.normalize_bbox(" WORLD ") == "world" and config.normalize_bbox("68,6,98,38") == "68,6,98,38"
    assert config.overpass_box("68,6,98,38") == "6.000000,68.000000,38.000000,98.000000"
    assert [config.retention_days(x) for x in (1, 30, 45)] == [30, 30, 45]
    assert config.parse_sources("VIIRS_NOAA20_NRT, VIIRS_NOAA21_NRT") == list(config.SOURCES)
    for bad in ("", "x", "VIIRS_NOAA20_NRT,x"):
        with pytest.raises(ValueError):
            config.parse_sources(bad)
