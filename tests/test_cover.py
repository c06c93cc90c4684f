import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.functions import geo
from emberline.operators import cover, enrich, facilities, prune

SITES = "fid long, fname string, ftype string, flat double, flon double, rings array<array<struct<lon:double,lat:double>>>"


def wrap(lon):
    return (lon + 180) % 360 - 180


def inside(lat, lon, rings):
    """Even-odd rule in a plane whose longitudes are counted on from the first vertex."""
    origin = rings[0][0][0]
    turn = lambda x: x - 360 * round((x - origin) / 360)
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]) if len(ring) > 3 and ring[0] == ring[-1] else ():
            ax, bx = turn(ax), turn(bx)
            if (ay > lat) != (by > lat) and turn(lon) < (bx - ax) * (lat - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def exchanged(df):
    """The columns that each exchange of a plan moves."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.initialPlan())
            continue
        if "Exchange" in node.nodeName():
            out.append(node.output().mkString(","))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def star(rng, lon, lat, size, n):
    angles = sorted(rng.random() * 2 * math.pi for _ in range(n))
    points = [(wrap(lon + size * (0.3 + rng.random()) * math.cos(a)), lat + 0.6 * size * (0.3 + rng.random()) * math.sin(a)) for a in angles]
    return points + points[:1]


@pytest.fixture(scope="module")
def shapes():
    """Rings of every kind: small and large, with holes and parts, over the date line, lines and points."""
    rng = random.Random(8)
    out = []
    for lon, lat, size, n in ((10, 5, 0.01, 5), (10, 5, 0.3, 40), (179.9, -20, 0.4, 12), (-179.99, 60, 3, 300), (20, 70, 30, 25), (0, 0, 1, 3), (-180, 10, 0.05, 6)):
        rings = [star(rng, lon, lat, size, n), star(rng, lon, lat, size / 3, 7)]
        if n > 10:
            rings += [star(rng, wrap(lon + 2 * size), lat, size / 2, 5), star(rng, lon, lat, size / 8, 4)]
        out.append(rings)
    out.append([[(10.0, 5.0), (10.2, 5.0), (10.2, 5.2), (10.0, 5.2), (10.0, 5.0)]])  # edges along the borders of cells
    out.append([[(10.0, 5.0), (10.2, 5.0), (10.1, 5.1), (10.0, 5.2)]])  # a line, not closed
    out.append([[(10.05, 5.05)]])
    return out


def table(spark, shapes):
    return spark.createDataFrame([(k, "n", "mining", r[0][0][1], r[0][0][0], r) for k, r in enumerate(shapes)], SITES)


def points_near(shapes, n=120):
    rng = random.Random(9)
    out = []
    for rings in shapes:
        ring = [p for r in rings for p in r]
        lon, lat = ring[0]
        reach = max(0.02, max(max(abs(wrap(p[0] - lon)), abs(p[1] - lat)) for p in ring) * 1.2)
        out += [(max(-89.0, min(89.0, lat + reach * rng.uniform(-1, 1))), wrap(lon + reach * rng.uniform(-1, 1))) for _ in range(n)]
        out += [(y + rng.uniform(-1e-4, 1e-4), wrap(x + rng.uniform(-1e-4, 1e-4))) for x, y in ring[:20]]
    return out + [(5.1, 180.0), (5.1, -180.0), (10.0, 180.0), (90.0, 0.0), (-90.0, 180.0)]


def test_inside_like_the_even_odd_rule(spark, shapes):
    points = points_near(shapes)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, latitude double, longitude double")
    found = {(r.id, r.fid) for r in cover.containing(df, table(spark, shapes)).collect()}
    want = {(i, k) for i, p in enumerate(points) for k, rings in enumerate(shapes) if inside(*p, rings)}
    assert found == want and len({k for _, k in want}) == 8
    # Each polygon by itself walks all edges, to the same end.
    own = df.filter("id % 7 = 0").join(table(spark, shapes)).filter(geo.in_rings(F.col("latitude"), F.col("longitude"), F.col("rings")))
    assert {(r.id, r.fid) for r in own.collect()} == {x for x in want if x[0] % 7 == 0}


def test_nearest_boundary_like_all_edges(spark, shapes):
    shapes = [s for k, s in enumerate(shapes) if k != 4]
    points = points_near(shapes, 25)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, latitude double, longitude double")
    sites = table(spark, shapes)
    lat, lon, rings = F.col("latitude"), F.col("longitude"), F.col("rings")
    every = df.join(sites).select("id", F.struct(F.when(geo.in_rings(lat, lon, rings), 0.0).otherwise(geo.ring_distance(lat, lon, rings)).alias("d"), "fid").alias("x"))
    want = {r.id: r.x for r in every.groupBy("id").agg(F.min("x").alias("x")).collect()}
    for far in (None, 5000.0):
        found = {r.id: r for r in enrich.nearest_facility(df, sites, far).collect()}
        assert set(found) == set(want)
        for i, w in want.items():
            near = far is None or w.d <= far
            assert found[i].nearest_facility_id == (w.fid if near else None), (i, points[i], w, found[i])
            assert not near or abs(found[i].distance_m - w.d) <= 0.06
            assert found[i].within_facility == (near and w.d == 0)


def test_the_date_line_as_one_place(spark):
    """Ring from 179.9 to -179.9, and a box over the line."""
    ring = [[(179.9, -1.0), (-179.9, -1.0), (-179.9, 1.0), (179.9, 1.0), (179.9, -1.0)]]
    sites = spark.createDataFrame([(1, "a", "mining", 0.0, 179.95, ring)], SITES)
    at = [(0.0, 179.95), (0.0, -179.95), (0.0, 180.0), (0.0, -180.0), (0.0, 179.5), (0.0, 0.0), (0.0, -179.85)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "id long, latitude double, longitude double")
    assert {r.id for r in prune.inside_ids(df, sites).collect()} == {0, 1, 2, 3}
    near = {r.id: r for r in enrich.nearest_facility(df, sites).collect()}
    assert [near[i].within_facility for i in range(7)] == [True] * 4 + [False] * 3 and abs(near[6].distance_m - 5559.8) < 3
    boxes = spark.createDataFrame([(1, "b", "mining", 0.0, 179.95, 0.15)], "fid long, fname string, ftype string, flat double, flon double, half_deg double")
    assert {r.id for r in prune.inside_ids(df, boxes).collect()} == {0, 1, 2, 3}
    assert [r.distance_m for r in enrich.nearest_facility(df, boxes).orderBy("id").collect()][:4] == [0.0] * 4


def test_a_point_on_the_surface_is_inside(spark, shapes):
    rng = random.Random(3)
    more = shapes + [[star(rng, rng.uniform(-180, 180), rng.uniform(-60, 60), 10 ** rng.uniform(-3, 1), rng.randrange(3, 30)) for _ in range(rng.randrange(1, 4))] for _ in range(40)]
    more = [[[(round(x, 7), round(y, 7)) for x, y in ring] for ring in rings] for rings in more]
    found = {r.fid: r.surface for r in facilities.on_surface(table(spark, more)).collect()}
    for k, rings in enumerate(more):
        areas = [r for r in rings if len(r) > 3 and r[0] == r[-1]]
        assert (found[k] is None) == (not areas)
        # All parts are counted on from the first vertex of the whole.
        assert not areas or inside(found[k].lat, found[k].lon, rings)
    text = lambda rings: "MULTIPOLYGON(((" + ")), ((".join(", ".join(f"{x} {y}" for x, y in r) for r in rings) + ")))"
    batch = spark.createDataFrame([(1, text(more[0]), 0.0, 0.0), (2, "POINT(3 4)", 4.0, 3.0), (3, None, 5.0, 6.0)], "osm_id long, geometry string, latitude double, longitude double")
    rows = {r.osm_id: r for r in facilities.located(batch).collect()}
    assert inside(rows[1].latitude, rows[1].longitude, more[0]) and (rows[2].latitude, rows[3].longitude) == (4.0, 6.0)


def test_pieces_are_small_and_few(spark):
    """300 km with 4,000 edges: cells of few edges, most cells without any, and no rings in an exchange."""
    rng = random.Random(1)
    ring = [(50 + 1.35 * (1 + 0.02 * rng.random()) * math.cos(2 * math.pi * k / 4000), 10 + 1.35 * (1 + 0.02 * rng.random()) * math.sin(2 * math.pi * k / 4000)) for k in range(4000)]
    sites = table(spark, [[ring + ring[:1]]])
    cells = cover.polygon_cells(sites).select(F.size("edges").alias("n"), "inside").collect()
    assert len(cells) < 900 and max(c.n for c in cells) < 150 and sum(c.n == 0 for c in cells) > 0.7 * len(cells)
    square = table(spark, [[[(48.0, 10.0), (51.0, 10.0), (51.0, 13.0), (48.0, 13.0), (48.0, 10.0)]]])
    assert cover.polygon_cells(square).count() <= 5 * 5
    df = spark.createDataFrame([(0, 10.0, 50.0)], "id long, latitude double, longitude double")
    for found in (prune.inside_ids(df, sites), enrich.nearest_facility(df, sites), enrich.nearest_facility(df, sites, 5000.0)):
        moved = exchanged(found)
        assert moved and not any("rings" in columns for columns in moved)


def test_empty(spark):
    df = spark.createDataFrame([(0, 10.0, 50.0)], "id long, latitude double, longitude double")
    sites = table(spark, [[[(48.0, 10.0), (51.0, 10.0), (51.0, 13.0), (48.0, 10.0)]]])
    assert cover.containing(df, sites.limit(0)).count() == 0 == cover.containing(df.limit(0), sites).count()
    bare = sites.withColumn("rings", F.expr("array(array(named_struct('lon', 1D, 'lat', 2D)))").cast("array<array<struct<lon:double,lat:double>>>")).withColumn("rings", F.filter("rings", lambda r: F.lit(False)))
    assert cover.containing(df, bare).count() == 0
