"""Sum-of-squares packing of token sequences into sequences of fixed length.

Documents become token ids and one end id; only a document longer than a sequence is cut, its
first piece being the odd one. A piece that fills a sequence is one by itself. The others are placed so that the sum of
squared counts of open bins per residual gap stays smallest. They are dealt at random, by a number of their own, into
blocks of about ``block_pieces``, and each block is packed by one task. The bins that blocks leave partly filled are
packed again as wholes by the same rule, round after round, until one block holds all that are left; once a round
joins few of them, only bins at most half full go on, of which every two fit together. So at most one bin of the
whole result is at most half full. A task's memory is bounded by its block, and only lengths, never ids, are shuffled.

Defined cases: a null text is empty and gives one piece of the end id alone; repeated rows are
packed each on its own; an empty table gives no pieces. Columns besides the id and the text
are not read. Texts holding a special token's string are tokenized exactly as the tokenizers
library does.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from emberline.llm._common import materialize

CAPACITY = 2048
END_ID = 0
#: Texts with a longer run of characters without white space go through the slower library.
_LONG_RUN = re.compile(r"\S{1500}")


class ByteBpe:
    """Ids of a byte-level BPE file; the same vocabulary as ranks does the work where both agree.

    ``tokenizers`` is the reference: it takes texts with special tokens' strings or very long
    runs. ``ranks_path`` (the vocabulary in tiktoken's format) is optional.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        self.path, self.ranks_path, self.pattern = path, ranks_path, pattern
        self._slow = self._fast = None

    def __getstate__(self):
        return {"path": self.path, "ranks_path": self.ranks_path, "pattern": self.pattern, "_slow": None, "_fast": None}

    def _open(self) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(self.path)
        special = [t.content for t in self._slow.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        if self.ranks_path:
            import base64

            import tiktoken

            with open(self.ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding("emberline", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self._slow is None:
            self._open()
        if self._fast is None or _LONG_RUN.search(text) or self._special and self._special.search(text):
            return self._slow.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


def public_byte_bpe() -> ByteBpe:
    """The 50k byte-level BPE of the installed public tokenizer files."""
    import public_tokenizers as P

    return ByteBpe(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


_PIECE = [
    StructField("doc_id", LongType()), StructField("piece", IntegerType()), StructField("start", LongType()),
    StructField("length", LongType()), StructField("ids_crc32", LongType()),
]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first piece may be the shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: ByteBpe, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (little-endian ids) and, if asked for, ids."""
    schema = StructType(_PIECE + [StructField("ids", ArrayType(IntegerType()))] * with_ids)

    def tokenize(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                out: list[list] = [[] for _ in schema.names]
                for key, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array([*tokenizer.encode(content or ""), end_id], dtype="<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + length]
                        for column, value in zip(out, (key, k, start, length, zlib.crc32(own.tobytes()), own.astype(np.int32))):
                            column.append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=schema.names)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(tokenize, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, placed longest first.

    Among the open bins that an item fits it goes where the sum of squared counts of open bins
    per gap becomes smallest (of equal choices into the smallest gap); a bin is opened when the
    item fits none, so that as few as possible are.
    """
    never = np.iinfo(np.int64).max
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        have = count[size:capacity]
        gap = capacity
        if have.any():
            # From gap g to g - size: (count[g - size] + 1)^2 + (count[g] - 1)^2, less what they were.
            change = 2 * (count[: capacity - size] - have) + 2
            change[0] = 1 - 2 * have[0]  # a full bin is closed and no longer counted
            change[have == 0] = never
            gap = int(np.argmin(change)) + size
        if gap < capacity:
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            b, used = used, used + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > size:
            count[gap - size] += 1
            open_bins[gap - size].append(b)
    return bins, offsets


def _pack_blocks(table: pa.Table, capacity: int, names: list[str]) -> pa.Table:
    """Add bin, offset and the bin's fill to the rows of a block."""
    lengths = table.column("length").to_numpy()
    bins, offsets = sum_of_squares(lengths, capacity)
    fill = np.bincount(bins, weights=lengths).astype(np.int64) if len(bins) else np.zeros(0, np.int64)
    for name, values in (("bin", bins), ("offset", offsets), ("fill", fill[bins])):
        table = table.append_column(name, pa.array(values, pa.int64()))
    return table.select(names)


_BIN = [StructField("block", LongType()), StructField("bin", LongType()), StructField("offset", LongType()), StructField("fill", LongType())]
_PLACED = StructType([*_PIECE, *_BIN])


def pack(found: DataFrame, capacity: int = CAPACITY, block_pieces: int = 8192) -> DataFrame:
    """Add sequence_id and offset to pieces; see the module's docstring."""
    numbered = materialize(found.withColumn("row", F.monotonically_increasing_id()))
    rest = numbered.filter(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // block_pieces))
    keyed = rest.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    placed = materialize(keyed.groupBy("block").applyInArrow(lambda t: _pack_blocks(t, capacity, _PLACED.names), _PLACED))
    # Bins are known by (level, block, bin) in one number: level below 15, bins below 2^28.
    named = lambda level: F.shiftleft(F.shiftleft(F.col("block"), 28) + F.col("bin"), 4) + level
    placed = placed.withColumn("id", named(0))
    moves = _repack(placed.filter((F.col("fill") < capacity) & (F.col("offset") == 0)).select("id", F.col("fill").alias("length")), capacity, block_pieces, named)
    if moves is not None:
        placed = placed.join(moves, "id", "left")
        number, offset = F.coalesce("to", "id"), F.col("offset") + F.coalesce("at", F.lit(0))
    else:
        number, offset = F.col("id"), F.col("offset")
    out = [f.name for f in _PIECE]
    whole = numbered.filter(F.col("length") == capacity).select(*out, (F.shiftleft("row", 4) + 15).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.select(*out, number.alias("sequence_id"), offset.cast("long").alias("offset")).unionByName(whole)


def _repack(level: DataFrame, capacity: int, block_pieces: int, named) -> DataFrame | None:
    """(id, to, at): the bin that each open bin ends in, and where; None where nothing is open.

    A round shrinks what goes on at least by a tenth, or leaves bins at most half full, of which the next halves
    the number: the rounds are few.
    """
    schema = StructType([StructField("id", LongType()), StructField("length", LongType()), *_BIN])
    moves = None
    for number in range(1, 15):
        n = level.count()
        if not n:
            break
        blocks = -(-n // block_pieces)
        keyed = level.withColumn("block", F.pmod(F.xxhash64("id", F.lit(number)), F.lit(blocks)))
        round_ = materialize(keyed.groupBy("block").applyInArrow(lambda t: _pack_blocks(t, capacity, schema.names), schema).withColumn("to", named(number)))
        step = round_.select(F.col("id").alias("from"), F.col("to").alias("next"), F.col("offset").alias("step"))
        if moves is None:
            moves = step.select(F.col("from").alias("id"), F.col("next").alias("to"), F.col("step").alias("at"))
        else:
            joined = moves.join(step, F.col("to") == F.col("from"), "left")
            moves = materialize(joined.select("id", F.coalesce("next", "to").alias("to"), (F.col("at") + F.coalesce("step", F.lit(0))).alias("at")))
        if blocks == 1:
            break
        bins = round_.filter("offset = 0").select(F.col("to").alias("id"), F.col("fill").alias("length"))
        level = bins.filter(F.col("length") < capacity) if bins.count() <= 0.9 * n else bins.filter(F.col("length") <= capacity // 2)
    return moves


def best_fit_pack(docs: DataFrame, tokenizer: ByteBpe | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, block_pieces: int = 8192) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = pieces(docs, tokenizer or public_byte_bpe(), doc_id, text, capacity, end_id)
    return pack(found, capacity, block_pieces)


def sequences(docs: DataFrame, tokenizer: ByteBpe | None = None, capacity: int = CAPACITY, pad_id: int = 0, **options) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (padded), the doc_ids and their offsets.

    A sequence holds at most ``capacity`` ids, so the lists it gathers are bounded.
    """
    tokenizer = tokenizer or public_byte_bpe()
    placed = best_fit_pack(docs, tokenizer, capacity=capacity, **options).select("doc_id", "piece", "ids_crc32", "sequence_id", "offset")
    placed = placed.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "piece", "ids_crc32").orderBy("sequence_id", "offset")))
    own = pieces(docs, tokenizer, capacity=capacity, with_ids=True)
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "piece", "ids_crc32").orderBy("start")))
    same = own["doc_id"].eqNullSafe(placed["doc_id"])
    for name in ("piece", "ids_crc32", "n"):
        same &= own[name] == placed[name]
    joined = own.join(placed, same).select(placed["sequence_id"], placed["offset"], own["doc_id"], own["ids"])
    rows = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return rows.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.size(ids))).alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), F.transform("parts", lambda p: p["offset"]).alias("offsets"))
