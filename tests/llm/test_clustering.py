import hashlib

import numpy as np
import pytest

from emberline.llm import clustering as op

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int"


def brute(rows, k=8, rounds=10, seed=3, d=64):
    """Lloyd's rounds in Python's whole numbers."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in kept[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), n) for n, w in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), n in zip(kept, of) if n == m] for m in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g)] if g else old for g, old in zip(groups, c)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(x[2] for x in last)
    name = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    return sorted(((i, n, dist, sum(x[2] for x in last if x[1] == n), total, name[n]) for i, n, dist in last), key=order)


def found(df, **options):
    rows = [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in op.cluster(df, **options).collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(5, 64)) * 2
    rows = [(i, (middle[i % 5] + rng.normal(size=64) * (1 + i % 3)).tolist()) for i in range(300)]
    assert found(table(spark, rows).repartition(5)) == brute(rows)


def test_ties_repeats_and_other_parameters(spark):
    # Whole steps on few axes: many vectors lie as far from one centroid as from another.
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) / 1024 for x in rng.integers(-1, 2, 4)]) for i in range(120)] + [(7, [0.0] * 4)] * 40
    for k in (1, 3, 30):
        assert found(table(spark, rows), k=k, rounds=4, seed=9, dimensions=4) == brute(rows, k, 4, 9, 4)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(None, [0.5, -0.25]), (None, [0.5, -0.25]), (1, [2.0, 3.0])]
    bad = [(2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [-inf, 0.0])]
    assert found(table(spark, good + bad), dimensions=2) == brute(good + bad, d=2)
    # Too long for a distance in a long.
    assert [r[0] for r in found(table(spark, [(1, [1e30, 0.0]), (2, [2.0**19, 0.0]), (3, [0.0, 0.0])]), dimensions=2)] == [2, 3]
    assert found(table(spark, bad), dimensions=2) == [] == found(table(spark, good).limit(0), dimensions=2)


@pytest.mark.parametrize("seed", [1, 2])
def test_bounds_hold_and_leave_most_vectors_out_of_the_scan(seed):
    """While centroids still leap every vector is scanned; once they drift little, few are."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(8, 64)) * 3
    x = np.floor(1024 * (middle[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 64)))).astype(np.int64)
    c, before = x[:8].copy(), None
    cluster, upper, lower = np.zeros(4000, dtype=np.int32), np.full(4000, np.inf), np.zeros(4000)
    scanned = []
    for _ in range(8):
        cluster, upper, lower, n = op.Movement(c, before).move(x, cluster, upper, lower)
        scanned.append(n)
        exact = np.sqrt(((x[:, None] - c[None]) ** 2).sum(axis=2).astype(float))
        own = exact[np.arange(4000), cluster]
        assert (cluster == exact.argmin(axis=1)).all() and (own <= upper).all()
        exact[np.arange(4000), cluster] = np.inf
        assert (exact.min(axis=1) >= lower).all()
        before, c = c, np.array([x[cluster == k].sum(axis=0) // max(1, (cluster == k).sum()) if (cluster == k).any() else c[k] for k in range(8)])
    assert sum(scanned[4:]) < 0.1 * 4000 * 4, scanned
