import random

from emberline.functions import geo
from emberline.operators import cover
from pyspark.sql import functions as F

SITES = "fid long, rings array<array<struct<lon:double,lat:double>>>"


def _tables(spark):
    """Many detections over eight wide shapes with holes and slants; a ninth lies where nothing was seen."""
    rng = random.Random(11)
    shape = lambda x, y: [[(x + a, y + b) for a, b in ring] for ring in (((-0.9, -0.9), (0.9, -0.8), (0.8, 0.9), (0.0, 0.6), (-0.9, 0.85), (-0.9, -0.9)), ((-0.2, -0.2), (0.2, -0.2), (0.1, 0.2), (-0.2, -0.2)))]
    places = [(rng.uniform(179.2, 180.2), rng.uniform(10.1, 10.9)) for _ in range(8)] + [(40.0, 10.0)]
    wrap = lambda x: (x + 180) % 360 - 180
    sites = spark.createDataFrame([(k, [[(wrap(x), y) for x, y in ring] for ring in shape(*p)]) for k, p in enumerate(places)], SITES)
    h = spark.createDataFrame([(i, rng.uniform(9.0, 12.0), wrap(rng.uniform(178.2, 181.2))) for i in range(24000)] + [(-1, None, 1.0), (-2, 1.0, None)], "id long, latitude double, longitude double")
    return h, sites


def test_geometry_is_left_to_detections_along_a_boundary(spark):
    """All pairs as of all edges, while most of them come of inner cells; where no detection lies cells stay wide."""
    h, sites = _tables(spark)
    lat, lon, rings = F.col("latitude"), F.col("longitude"), F.col("rings")
    want = {(r.id, r.fid) for r in h.crossJoin(sites).filter(geo.in_rings(lat, lon, rings)).select("id", "fid").collect()}
    found = [(r.id, r.fid) for r in cover.containing(h, sites).collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 20000
    edges = cover.edges_of(sites)
    own, fitted = (cover.materialize(cover.cells_of(e)) for e in (edges, cover._fitted(edges, h)))
    judged = lambda cells: cover._looked_up(h, cells).join(cells.filter(F.size("edges") > 0), ["level", "cell"]).count()
    assert judged(own) > len(want) / 2 > judged(fitted)
    lone = lambda cells: sorted(cells.filter("fid = 8").select("level", "cell").collect())
    assert lone(own) == lone(fitted)


def test_plain_columns_judge_like_the_edges(spark):
    """The compiled form of cells of few edges, of open and closed rings, against the form of any number."""
    h, sites = _tables(spark)
    line = spark.createDataFrame([(100, [[(179.0, 9.0), (179.4, 9.1), (179.2, 9.9), (179.1, 10.3)]]), (101, [[(179.0, 9.0), (179.4, 9.1), (179.2, 9.9), (179.0, 9.0)], [(179.1, 9.05), (179.3, 9.2)]])], SITES)
    cells = cover.materialize(cover.polygon_cells(sites.unionByName(line)).filter((F.size("edges") > 0) & (F.size("edges") <= cover.FEW)))
    at = cover._looked_up(h, cells)
    ids = lambda rows: sorted((r.id, r.fid) for r in rows.select("id", "fid").collect())
    plain = ids(at.join(cover._plain(cells), ["level", "cell"]).filter(cover._judged()))
    assert plain == ids(at.join(cells, ["level", "cell"]).filter(cover.in_cell(F.col("latitude"), F.col("longitude")))) and any(fid == 101 for _, fid in plain)


def test_the_extent_is_found_once_a_polygon(spark):
    """Not beside the explode, where it would be found again for every edge."""
    _, sites = _tables(spark)
    lines = cover.edges_of(sites.repartition(2, "fid"))._jdf.queryExecution().executedPlan().toString().splitlines()
    explode = next(k for k, line in enumerate(lines) if "Generate explode" in line)
    measured = [k for k, line in enumerate(lines) if "array_max" in line]
    assert measured and min(measured) > explode
