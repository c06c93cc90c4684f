import zlib
from collections import Counter, defaultdict

import numpy as np

from emberline.llm import sharding as op

SCHEMA = "doc_id long, text string, shard string, tokens int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def check(rows, found, shards=8):
    size = lambda t: len((t or "").encode()) + 1
    want = sorted(((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in found), key=str) == want
    slots, load = defaultdict(list), Counter()
    for r in found:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    return [load[k] for k in range(shards)], [len(slots[k]) for k in range(shards)]


def test_driver_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    for block_rows in (20_000, 60):
        found = op.assign_shards(frame(spark, rows), block_rows=block_rows).collect()
        sizes, counts = check(rows, found)
        assert max(sizes) - min(sizes) <= 0.1 * np.mean(sizes)
    by = defaultdict(set)
    text = dict(rows)
    for r in found:
        by[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in by.values())


def test_all_three_are_balanced_and_a_huge_group_is_split(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 200)) + str(i)) for i in range(3000)] + [(10_000 + i, "same words here " * 8) for i in range(2000)]
    found = op.assign_shards(frame(spark, rows), block_rows=500).collect()
    sizes, counts = check(rows, found)
    assert max(sizes) - min(sizes) <= 0.02 * np.mean(sizes)


def test_odd_cases(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "a"), (3, "b" * 1_000_000), (4, "é"), (4, "é")]
    check(rows, op.assign_shards(frame(spark, rows)).collect())
    assert op.assign_shards(frame(spark, rows).limit(0)).collect() == []


def test_placing_follows_the_highest_dot_product():
    vectors = np.array([[6.0, 1, 1], [3, 5, 1], [3, 5, 1], [6, 1, 1]])
    shards = op.place(vectors, np.tile(vectors.sum(axis=0) / 2, (2, 1)))
    assert sorted(shards[[0, 3]]) == [0, 1] and sorted(shards[[1, 2]]) == [0, 1]


def test_shards_are_written(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(100)]
    op.write_shards(frame(spark, rows), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows and back.select("_shard").distinct().count() == 8


def test_a_group_of_many_tiny_texts_is_dealt_out(spark):
    rng = np.random.default_rng(2)
    for tiny in (None, "", "ab"):
        rows = [(i, "w " * int(rng.integers(100, 200)) + str(i)) for i in range(3000)] + [(10_000 + i, tiny) for i in range(1500)]
        sizes, counts = check(rows, op.assign_shards(frame(spark, rows), block_rows=500).collect())
        assert max(sizes) - min(sizes) <= 0.02 * np.mean(sizes)
        assert max(counts) - min(counts) <= 0.1 * np.mean(counts), counts


def test_many_equal_rows_of_one_id_are_dealt_out(spark):
    frames = [spark.range(200_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'short' AS text"), spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")]
    found = op.assign_shards(frames[0].unionByName(frames[1]), block_rows=10_000)
    from pyspark.sql import functions as F

    rows = found.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"), F.sum("size").alias("bytes")).collect()
    assert len(rows) == 8 and all(r.n == r.slots == r["last"] + 1 for r in rows)
    for column in ("n", "bytes"):
        own = [r[column] for r in rows]
        assert max(own) - min(own) <= 0.05 * sum(own) / 8, own


def test_place_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        vectors = rng.integers(1, 30, (40, 3)).astype(float)
        capacity = np.tile(vectors.sum(axis=0) / 4, (4, 1))
        found = op.place(vectors, capacity)
        scale = 1 / capacity.sum(axis=0)
        left = [[c * t for c, t in zip(row, scale)] for row in capacity]
        for i in sorted(range(40), key=lambda k: (*(-vectors[k] * scale), k)):
            item = [x * t for x, t in zip(vectors[i], scale)]
            open_ = [k for k in range(4) if left[k][0] >= item[0]] or list(range(4))
            gains = {k: sum(a * b for a, b in zip(left[k], item)) for k in open_}
            assert found[i] in gains and gains[found[i]] >= max(gains.values()) - 1e-12
            left[found[i]] = [a - b for a, b in zip(left[found[i]], item)]
