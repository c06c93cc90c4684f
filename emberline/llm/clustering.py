"""Centroid clustering: Lloyd's rounds with Hamerly's bounds, in exact integers.

A vector's components are floor(1024 x). Each vector keeps, in a table that is written once a round, the number of its
centroid, an upper bound of its distance to that centroid and a lower bound of the distance to any other. When centroids
move, the upper bound grows by the drift of the own one and the lower bound shrinks by the largest drift of another. While the upper bound stays
below the lower one, or below half the way from the own centroid to its nearest neighbour, the nearest centroid cannot
have changed. Else the distance to the own centroid is computed; where that does not decide either, all
distances are, as whole numbers. Bounds are doubles, rounded to the safe side by SLACK and compared strictly, so ties always get to the exact scan,
in which the smaller number wins.

Sums and counts of clusters follow from the vectors that have changed their cluster: tasks add them up, k x d
numbers each, before they meet. The driver holds the centroids, k x d whole numbers, and nothing that grows with
the table. Each round reads the table of the round before and writes the next; the older one is then removed,
so at most two lie in the shared folder. Nothing is shuffled but the sums.

Defined cases: vectors without exactly ``dimensions`` components, with a null or non-finite one, null vectors, and those whose squared integer
length exceeds 2^60 (distances would not fit a long) are left out; a null id is hashed as an empty string; equal hashes (repeated ids) go by
components; fewer vectors than ``k`` give fewer centroids; repeated rows count each; clusters without vectors keep
their centroid; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm._common import materialize
from emberline.tables import fresh_path, remove

SCALE = 1024
#: Beyond this squared length a distance might not fit a long.
LONGEST = 2.0**60
#: Relative error that a bound is widened by each time it is touched.
SLACK = 1e-12
#: Numbers that one block of distances holds at most.
BLOCK = 1 << 22
STATE = "vec_id long, v array<int>, was int, cluster int, upper double, lower double"


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = 64) -> DataFrame:
    """(vec_id, v): the kept vectors as whole numbers."""
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    sized = own.filter((F.size("e") == dimensions) & F.forall("e", finite))
    scaled = sized.withColumn("e", F.transform("e", lambda x: x * SCALE))
    length: Column = F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)
    return scaled.filter(length <= LONGEST).select("vec_id", F.transform("e", lambda x: F.floor(x).cast("int")).alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k kept vectors with the smallest hashes of their ids, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to the centroids, or of each row to its own where c has as many rows."""
    d = x - c
    return (d * d).sum(axis=-1)


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance, squared distance to the second) of each row, in blocks."""
    near, best, second = np.zeros(len(x), dtype=np.int32), np.zeros(len(x), dtype=np.int64), np.full(len(x), np.iinfo(np.int64).max)
    step = max(1, BLOCK // max(1, c.size))
    for at in range(0, len(x), step):
        d = squared(x[at : at + step, None, :], c[None])
        here = np.arange(len(d))
        near[at : at + step] = own = d.argmin(axis=1)
        best[at : at + step] = d[here, own]
        if len(c) > 1:
            d[here, own] = np.iinfo(np.int64).max
            second[at : at + step] = d.min(axis=1)
    return near, best, second


class Movement:
    """What one round knows of its centroids and of the way they came."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids, k = centroids, len(centroids)
        self.drift = np.zeros(k) if before is None else np.sqrt(squared(centroids, before).astype(float)) * (1 + SLACK)
        between = np.sqrt(squared(centroids[:, None], centroids[None]).astype(float))
        np.fill_diagonal(between, np.inf)
        self.half_gap = between.min(axis=1, initial=np.inf) / 2 * (1 - SLACK)
        largest = np.sort(self.drift)[::-1]
        other = np.where((self.drift == largest[0]) & (np.arange(k) == self.drift.argmax()), largest[1] if k > 1 else 0.0, largest[0])
        self.other_drift = other

    def move(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(cluster, upper, lower, rows scanned in full) after this round."""
        cluster = cluster.copy()
        upper = (upper + self.drift[cluster]) * (1 + SLACK)
        lower = (lower - self.other_drift[cluster]) * np.where(lower > self.other_drift[cluster], 1 - SLACK, 1 + SLACK)
        safe = np.maximum(lower, self.half_gap[cluster])
        unsure = np.flatnonzero(upper >= safe)
        upper[unsure] = np.sqrt(squared(x[unsure], self.centroids[cluster[unsure]]).astype(float)) * (1 + SLACK)
        unsure = unsure[upper[unsure] >= safe[unsure]]
        near, best, second = scan(x[unsure], self.centroids)
        cluster[unsure] = near
        upper[unsure] = np.sqrt(best.astype(float)) * (1 + SLACK)
        lower[unsure] = np.sqrt(second.astype(float)) * (1 - SLACK)
        return cluster, upper, lower, len(unsure)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def assign(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None, path: str | None = None) -> DataFrame:
    """The table after one assignment, written at path; a first one (before is None) knows no bounds yet."""
    held = state.sparkSession.sparkContext.broadcast(Movement(centroids, before))
    d = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x, was = _matrix(batch.column("v"), d), batch.column("cluster").to_numpy(zero_copy_only=False)
            cluster, upper, lower, _ = held.value.move(x, was.clip(min=0), batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(was, pa.int32()), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)], names=["vec_id", "v", "was", "cluster", "upper", "lower"])

    return materialize(state.mapInArrow(run, STATE), path)


def changes(state: DataFrame, k: int, d: int) -> list:
    """(cluster, place, what is to be added): of each cluster the change of its sums, and at place d that of its count."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((k, d + 1), dtype=np.int64)
        for batch in batches:
            x = np.c_[_matrix(batch.column("v"), d), np.ones(len(batch), dtype=np.int64)]
            was, now = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("was", "cluster"))
            np.add.at(total, now, x)
            np.add.at(total, was[was >= 0], -x[was >= 0])
        at = np.argwhere(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(total[at[:, 0], at[:, 1]])], names=["cluster", "place", "n"])

    moved = state.filter("was != cluster").select("v", "was", "cluster")
    return moved.mapInArrow(run, "cluster int, place int, n long").groupBy("cluster", "place").agg(F.sum(F.col("n").cast("decimal(30,0)")).alias("n")).collect()


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = 64) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    last = fresh_path(spark)
    kept = materialize(integer_vectors(vectors, vec_id, embedding, dimensions), last)
    centroids = first_centroids(kept, k, seed)
    out = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], out + ", cluster_inertia long, inertia long, centroid_sha256 string")
    # Nothing is known yet: the upper bound is endless, so all rows are scanned.
    state = kept.select("vec_id", "v", F.lit(-1).alias("was"), F.lit(-1).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    sums = [[0] * (dimensions + 1) for _ in centroids]
    before = None
    for step in range(rounds + 1):
        older, last = last, fresh_path(spark)
        state = assign(state, centroids, before, last)
        remove(spark, older)
        if step < rounds:
            for row in changes(state, len(centroids), dimensions):
                sums[row.cluster][row.place] += int(row.n)
            before = centroids
            centroids = np.array([[x // s[-1] for x in s[:-1]] if s[-1] else c.tolist() for s, c in zip(sums, before)], dtype=np.int64)
    held = spark.sparkContext.broadcast(centroids)

    def measure(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            own = batch.column("cluster").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(squared(_matrix(batch.column("v"), dimensions), held.value[own]))], names=["vec_id", "cluster", "distance"])

    measured = state.select("vec_id", "cluster", "v").mapInArrow(measure, out)
    # One row a cluster.
    inertia = {r.cluster: int(r.n) for r in measured.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(30,0)")).alias("n")).collect()}
    fits = lambda n: n if n < 2**63 else None
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(c, fits(n), fits(sum(inertia.values())), names[c]) for c, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return measured.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
