"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group. Groups are placed longest first; each goes to the shard where the dot
product of its vector (bytes, tokens, rows, each as a share of the whole) with the shard's
residual capacity is highest, among the shards whose bytes still have room for it (among all, where none has).

At scale: a group of more than 1 / heavy_parts of a shard's bytes, tokens or rows is *heavy*. There are
fewer than 3 * shards * heavy_parts of them, whatever the corpus; they are placed first, by the driver.
A heavy group larger than half a shard in any of the three is split into about
sixteenths of a shard by a hash of the row's number, since no placement could balance it whole. All other groups are dealt by hash into blocks of about ``block_rows`` rows; each block is
placed by one task against its share of what the heavy groups left, so every block is
balanced by itself and so is the sum. Only ids and sizes are shuffled, never texts.

The law of the result is ``bytes``: the shards' sizes are near equal. slot numbers the rows of a
shard from 0 without gaps; each (shard, block) is numbered by itself and shifted by the counts
of the blocks before it.

Defined cases: a null text has size 1 and is a group with other nulls; repeated rows are placed
each; a null doc_id is placed like any other; fewer groups than shards leave shards empty; an
empty table gives no rows. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm._common import materialize

DIMENSIONS = ("bytes", "tokens", "rows")
_PLACED = "doc_id long, size long, text_crc32 long, block int, shard int"


def place(vectors: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The shard of each vector; capacity (shards x dimensions) is what each shard should get.

    Larger vectors go first. Where no shard has room for the bytes, all compete.
    """
    total = capacity.sum(axis=0)
    scale = np.where(total > 0, 1 / np.maximum(total, 1e-30), 0)
    residual = capacity * scale
    items = vectors * scale
    out = np.empty(len(items), dtype=np.int32)
    for i in np.lexsort((-items[:, 2], -items[:, 1], -items[:, 0])).tolist():
        gain = residual @ items[i]
        room = residual[:, 0] >= items[i, 0]
        if room.any():
            gain = np.where(room, gain, -np.inf)
        k = int(np.argmax(gain))
        out[i] = k
        residual[k] -= items[i]
    return out


def vectors_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, a number of its own, size, tokens, text_crc32 and two hashes that name its group."""
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), (F.octet_length(content) + 1).cast("long").alias("size"),
        F.size(F.filter(F.split(content, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long").alias("tokens"),
        F.crc32(content).alias("text_crc32"), F.xxhash64(content).alias("group_a"), F.hash(content).alias("group_b"),
    )


def assign_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 8, heavy_parts: int = 64, block_rows: int = 20_000) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    rows = materialize(vectors_of(docs, doc_id, text))
    sums = rows.agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    whole = np.array([sums[d] or 0 for d in DIMENSIONS], dtype=float)
    limits = {d: max(1, int(w / (shards * heavy_parts))) for d, w in zip(DIMENSIONS, whole)}
    # Fewer than shards * heavy_parts groups can have so many of each: they fit the driver and a broadcast.
    groups = rows.groupBy("group_a", "group_b").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    heavy = groups.filter((F.col("bytes") > limits["bytes"]) | (F.col("tokens") > limits["tokens"]) | (F.col("rows") > limits["rows"])).collect()
    half = {d: max(1, int(w / (2 * shards))) for d, w in zip(DIMENSIONS, whole)}
    # Sixteenths of a shard: halves of a group that holds the rows could not even them out.
    n_parts = lambda g: max(-(-8 * g[d] // half[d]) for d in DIMENSIONS) if any(g[d] > half[d] for d in DIMENSIONS) else 1
    spark = docs.sparkSession
    counts = spark.createDataFrame([(g["group_a"], g["group_b"], min(n_parts(g), g["rows"])) for g in heavy], "group_a long, group_b int, parts long")
    keyed = rows.join(F.broadcast(counts), ["group_a", "group_b"], "left").withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int"))
    is_heavy = F.col("parts").isNotNull()
    # Split by hash, the parts of a group differ a little: what is placed is what they hold.
    parts = keyed.filter(is_heavy).groupBy("group_a", "group_b", "part").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).collect()
    vectors = np.array([[p[d] for d in DIMENSIONS] for p in parts], dtype=float).reshape(-1, 3)
    capacity = np.tile(whole / shards, (shards, 1))
    own = place(vectors, capacity)
    for vector, k in zip(vectors, own.tolist()):
        capacity[k] -= vector
    capacity = np.maximum(capacity, 0)
    where = spark.createDataFrame([(p["group_a"], p["group_b"], p["part"], int(k)) for p, k in zip(parts, own)], "group_a long, group_b int, part int, heavy_shard int")
    blocks = max(1, -(-int(whole[2]) // block_rows))
    block = F.pmod(F.xxhash64("group_a", "group_b"), F.lit(blocks)).cast("int")
    # Rows of heavy groups only need slots: they are spread over the blocks by number, however often an id repeats.
    spread = F.pmod(F.xxhash64("row", "group_a"), F.lit(blocks)).cast("int")
    settled = keyed.filter(is_heavy).join(F.broadcast(where), ["group_a", "group_b", "part"]).select("doc_id", "size", "text_crc32", spread.alias("block"), F.col("heavy_shard").alias("shard"))

    def place_block(t: pa.Table) -> pa.Table:
        key = np.rec.fromarrays([t.column("group_a").to_numpy(), t.column("group_b").to_numpy()])
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        sizes = [t.column("size").to_numpy().astype(float), t.column("tokens").to_numpy().astype(float), np.ones(len(t))]
        vectors = np.column_stack([np.bincount(inverse, x) for x in sizes])
        own_sum = vectors.sum(axis=0)
        left = capacity.sum(axis=0)
        share = capacity * np.where(left > 0, own_sum / np.maximum(left, 1e-30), 0)
        shard = place(vectors, share)[inverse]
        return t.select(["doc_id", "size", "text_crc32", "block"]).append_column("shard", pa.array(shard, pa.int32()))

    light = keyed.filter(~is_heavy).withColumn("block", block).select("doc_id", "size", "text_crc32", "block", "group_a", "group_b", "tokens")
    placed = materialize(light.groupBy("block").applyInArrow(place_block, _PLACED).unionByName(settled))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy("shard", "block").agg(F.count("*").alias("n")).withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")
    numbered = placed.withColumn("at", F.row_number().over(within) - 1).join(shift.select("shard", "block", "shift"), ["shard", "block"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("shift") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", **options) -> None:
    """Write docs as one folder a shard (Parquet, partitioned by shard); ids must be unique."""
    found = assign_shards(docs, doc_id, **options).select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"))
    docs.join(found, F.col(doc_id).eqNullSafe(F.col("_id"))).drop("_id").write.partitionBy("_shard").parquet(path)
