import random

from emberline.operators import cover, prune
from pyspark.sql import functions as F


def test_a_point_meets_few_of_many_polygons_over_it(spark):
    """Two hundred polygons over each other: each place keeps those that no smaller fid covers; results as of all pairs."""
    rng = random.Random(5)
    ring = lambda x, y: [[(x + a, y + b) for a, b in ((-0.4, -0.4), (0.4, -0.4), (0.4, 0.0), (0.0, 0.0), (0.0, 0.4), (-0.4, 0.4), (-0.4, -0.4))]]
    places = [(round(20 + rng.random(), 3), round(10 + rng.random(), 3)) for _ in range(200)]
    f = spark.createDataFrame([(i, f"F{i}", "mining", y, x, ring(x, y)) for i, (x, y) in enumerate(places)], "fid long, fname string, ftype string, flat double, flon double, rings array<array<struct<lon:double,lat:double>>>")
    h = spark.createDataFrame([(i, round(9.3 + rng.random() * 2.4, 3), round(19.3 + rng.random() * 2.4, 3)) for i in range(400)], "id long, latitude double, longitude double")
    cells = cover.polygon_cells(f)
    all_pairs = {r.id: r.fid for r in cover.within_cells(h, cells).groupBy("id").agg(F.min("fid").alias("fid")).collect()}
    few = cover.thinned(cells)
    assert {r.id: r.fid for r in cover.within_cells(h, few).groupBy("id").agg(F.min("fid").alias("fid")).collect()} == all_pairs
    assert {r.id for r in prune.inside_ids(h, f).collect()} == set(all_pairs)
    met = lambda c: cover._looked_up(h, c).join(c, ["level", "cell"]).count()
    assert met(few) < met(cells) / 5
