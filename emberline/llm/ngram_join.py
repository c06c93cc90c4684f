"""N-gram Jaccard join: size-banded tiles of hashed bitmap signatures before exact intersection.

A document is its set of distinct 5-word shingles (63-bit hashes; two shingles with one hash
are taken as equal). Documents link when 100 * |A and B| >= 80 * |A or B|.

1. Documents with equal sets form one class, whose smallest doc_id stands for it.
2. Two linked sets of sizes n and m share a hash among their ceil-complement prefixes, the
   n - ceil(0.8 n) + 1 smallest in one fixed order. The hashes of all prefixes are dealt by hash;
   those that two or more classes hold are the *places* where classes can meet.
3. The classes at one place, sorted by size, are cut into tiles of at most ``tile`` rows. Within a
   tile and between tiles whose size bands overlap, parity bitmaps are compared: sets whose bitmaps
   differ in more bits than linked sets of their sizes can differ in members are no pair. A
   bitmap's width follows its size band. What is left are possible links; a place keeps a
   spanning forest of them, never all pairs.
4. The components of possible links hold all links. Their members' shingles are read again and
   intersected exactly, tile against tile; pairs already connected are skipped.
5. The components of the true links, joined with the classes, are the answer.

Defined cases: null and empty texts have no shingles, link with nothing and are their own
component; a text of fewer words than a shingle has one; repeated rows (equal doc_id and text)
each get a row; rows of one doc_id with different texts have the components of their own
texts, and where one doc_id stands for several classes these are joined; a null doc_id is its own component, null; empty tables give no rows. Columns
besides the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from emberline.llm._common import ASCII_LOWER, TMP, WordHash, materialize, n_shuffle, text_of, utf8
from emberline.llm.components import connected_components

WORDS = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A component with more members than this is intersected tile by tile.
TILE = 2048


def shingles(text: str | None, memo: WordHash, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    h = memo.of(utf8(text).translate(ASCII_LOWER).split()).astype(np.uint64)
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    size = min(words, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            out = (out ^ (out >> np.uint64(29))) * _MIX + h[k : len(h) - size + 1 + k]
        out = (out ^ (out >> np.uint64(32))) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique((out >> np.uint64(1)).astype(np.int64))


def prefix_length(n: np.ndarray | int, percent: int):
    """Hashes of which a linked set of size n must share one: n - ceil(n * percent / 100) + 1."""
    return n - -(-n * percent // 100) + 1


def bitmap_bits(n: int) -> int:
    """Width of the parity bitmap of the size band of n: the power of two from n on, 64 at least."""
    return max(64, 1 << (n - 1).bit_length())


def fold(bitmap: np.ndarray, bits: int) -> np.ndarray:
    """A wider parity bitmap's (rows of uint64) equivalent of fewer bits."""
    while bitmap.shape[-1] * 64 > bits:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


def parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit k is the parity of the number of hashes whose low bits are k."""
    odd = np.bincount(hashes & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64)


def most_different(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Largest symmetric difference of linked sets of sizes n and m.

    With s = n + m and intersection i >= percent * s / (100 + percent): s - 2 * ceil of that.
    """
    s = n + m
    return s - 2 * -(-percent * s // (100 + percent))


class Forest:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        up = self.up
        while not np.array_equal(up, up[up]):
            up = up[up]
        self.up = up
        return up


_SETS = StructType([
    StructField("doc_id", LongType()), StructField("n", IntegerType()), StructField("key_a", LongType()),
    StructField("key_b", LongType()), StructField("bitmap", BinaryType()), StructField("prefix", BinaryType()), StructField("text_hash", LongType()),
])


def _signatures(words: int, percent: int):
    def sign(batches: Iterator[pa.RecordBatch]):
        memo = WordHash()
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                out: list[list] = [[] for _ in _SETS.names]
                for key, text, text_hash in zip(*(c.to_pylist() for c in part.columns)):
                    own = shingles(text, memo, words)
                    n = len(own)
                    digest = xxhash.xxh3_128_intdigest(own.tobytes())
                    a, b = digest >> 65, digest & ((1 << 63) - 1)
                    bitmap = parity(own, bitmap_bits(n)).tobytes() if n else b""
                    prefix = own[: prefix_length(n, percent)].tobytes() if n else b""
                    for column, value in zip(out, (key, n, a, b, bitmap, prefix, text_hash)):
                        column.append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=_SETS.names)

    return sign


def band_tiles(n: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """(begin, stop, bitmap bits) of runs of at most ``tile`` sorted sizes inside one size band."""
    out, begin = [], 0
    while begin < len(n):
        bits = bitmap_bits(int(n[begin]))
        stop = min(begin + tile, int(np.searchsorted(n, bits, side="right")))
        out.append((begin, stop, bits))
        begin = stop
    return out


def possible_pairs(n: np.ndarray, bitmaps: list[np.ndarray], percent: int, tile: int = TILE) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that sizes and bitmaps allow; rows are sorted by size."""
    forest, out = Forest(len(n)), []
    tiles = band_tiles(n, tile)
    for begin, stop, bits in tiles:
        left = np.stack([fold(b, bits) for b in bitmaps[begin:stop]])
        for first_col, end, _ in tiles:
            # A row meets later rows up to the largest size that its own still allows.
            if first_col < begin or n[first_col] * percent > n[stop - 1] * 100:
                continue
            right = left if first_col == begin else np.stack([fold(b, bits) for b in bitmaps[first_col:end]])
            for k in range(len(left)):
                i = begin + k
                roots = forest.roots()
                first = max(first_col, i + 1)
                js = np.flatnonzero(roots[first:end] != roots[i]) + first
                js = js[n[js] * percent <= n[i] * 100]
                if not len(js):
                    continue
                apart = np.bitwise_count(right[js - first_col] ^ left[k]).sum(axis=1, dtype=np.int64)
                for j in js[apart <= most_different(n[i], n[js], percent)].tolist():
                    if forest.join(i, j):
                        out.append((i, j))
    return out


def exact_links(sets: list[np.ndarray], n_left: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs that have a side among the first n_left sets.

    A row is counted against all sets at once through the postings of its sorted hashes, so it
    costs as many steps as its hashes occur. It ends once all sets are connected.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    forest, out = Forest(len(sets)), []
    for i in range(n_left):
        roots = forest.roots()
        if i and (roots == roots[0]).all():
            break
        begin, end = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        counts = end - begin
        places = np.repeat(begin - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        shared = np.bincount(owner[places], minlength=len(sets))
        ok = (100 * shared >= percent * (sizes + sizes[i] - shared)) & (roots != roots[i])
        for j in np.flatnonzero(ok).tolist():
            if forest.join(i, j):
                out.append((i, j))
    return out


def set_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = 80) -> DataFrame:
    """The written signature table: doc_id, n, the set's 128-bit key, bitmap, prefix, the text's hash."""
    return materialize(docs.select(F.col(doc_id).cast("long"), F.col(text), F.xxhash64(text_of(text))).mapInArrow(_signatures(words, percent), _SETS))


def candidate_links(reps: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b): the ends of every true link of two classes are connected by these possible links."""
    every = reps.select("rep", "n", "prefix").mapInArrow(_prefixes, "hash long, rep long, n int")
    dealt = every.repartition(n_shuffle(reps.sparkSession), "hash").sortWithinPartitions("hash", "n")
    met = materialize(dealt.mapInArrow(_meet(percent), "place long, rep long").distinct())
    cells = into_cells(met.withColumnRenamed("place", "group"), "rep")
    full = cells.join(reps.select("rep", "n", "bitmap"), "rep")
    full = full.repartition(n_shuffle(reps.sparkSession), "group", "cell").sortWithinPartitions("group", "cell", "n", "rep")
    return full.select("group", "cell", "rep", "n", "bitmap").mapInArrow(_tiles(percent), "a long, b long").distinct()


def into_cells(rows: DataFrame, member: str, most: int = TILE) -> DataFrame:
    """Deal the rows of groups of more than ``most`` into cells, so that every two rows of a group
    meet in a cell and no cell has many more than twice ``most``. Adds cell and left.

    A group in s parts has s * (s + 1) / 2 cells, one for each pair of parts; a row goes to s of
    them. Other groups are one cell. The table of large groups, seldom more than a few rows, is
    written, so that its join is planned by its size.
    """
    large = materialize(rows.groupBy("group").agg(F.count("*").alias("size")).filter(F.col("size") > most))
    rows = rows.join(large, "group", "left")
    parts = F.coalesce(F.ceil(F.col("size") / F.lit(most)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(member), parts).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return dealt.withColumn("cell", low * F.col("parts") + high).withColumn("left", F.col("own") == low).drop("parts", "own", "other", "size")


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys of sorted batches, each as a table."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(len(table) - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        ends = [*(np.flatnonzero(change) + 1).tolist(), len(table)]
        begin = 0
        for end in ends:
            part = table.slice(begin, end - begin)
            if held and any(held[0].column(k)[0].as_py() != part.column(k)[0].as_py() for k in keys):
                yield pa.concat_tables(held)
                held = []
            held.append(part)
            begin = end
    if held:
        yield pa.concat_tables(held)


def _prefixes(batches: Iterator[pa.RecordBatch]):
    """(hash, rep, n) of every prefix hash."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 200):
            part = batch.slice(begin, 200)
            prefixes = [np.frombuffer(x, dtype=np.int64) for x in part.column("prefix").to_pylist()]
            lengths = [len(x) for x in prefixes]
            if sum(lengths):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(prefixes)), pa.array(np.repeat(part.column("rep").to_numpy(), lengths)), pa.array(np.repeat(part.column("n").to_numpy(), lengths))],
                    names=["hash", "rep", "n"],
                )


def _meet(percent: int, most: int = TILE):
    """(place, rep) of the rows that share a hash with another of a size within reach.

    Rows come sorted by hash and size. A run of one hash is cut where a size is out of reach of
    the next. A place is named by a sum over its members, so that the many hashes which the same
    classes share become one place. Of a run longer than ``most``, which is not held, the hash
    itself is the name.
    """

    def named(h: np.ndarray, rep: np.ndarray, n: np.ndarray):
        if not len(h):
            return
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (n[1:] * percent > n[:-1] * 100)
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        keep = size[run] > 1
        if not keep.any():
            return
        rep, run = rep[keep], run[keep]
        with np.errstate(over="ignore"):
            mixed = rep.astype(np.uint64) * _MIX
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            place = (np.add.reduceat(mixed, start) >> np.uint64(1)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(place, np.diff([*start, len(run)]))), pa.array(rep)], names=["place", "rep"])

    def meet(batches: Iterator[pa.RecordBatch]):
        held = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        long_run = None
        for batch in batches:
            h, rep, n = (np.concatenate([old, batch.column(k).to_numpy().astype(np.int64)]) for k, old in enumerate(held))
            if long_run is not None:
                end = int(np.searchsorted(h, long_run, side="right"))
                yield pa.RecordBatch.from_arrays([pa.array(h[:end]), pa.array(rep[:end])], names=["place", "rep"])
                h, rep, n = h[end:], rep[end:], n[end:]
                held = h, rep, n
                if not len(h):
                    continue
                long_run = None
            if not len(h):
                continue
            last = int(np.searchsorted(h, h[-1], side="left"))
            yield from named(h[:last], rep[:last], n[:last])
            held = h[last:], rep[last:], n[last:]
            if len(held[0]) > most:
                long_run = int(h[-1])
                yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["place", "rep"])
                held = tuple(x[:0] for x in held)
        yield from named(*held)

    return meet


def _tiles(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]):
        for table in by_key(batches, ["group", "cell"]):
            n, reps = table.column("n").to_numpy().astype(np.int64), table.column("rep").to_numpy()
            pairs = possible_pairs(n, [np.frombuffer(b, dtype=np.uint64) for b in table.column("bitmap").to_pylist()], percent)
            if pairs:
                left, right = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(reps[left]), pa.array(reps[right])], names=["a", "b"])

    return compare


def _verify(percent: int, words: int):
    def verify(batches: Iterator[pa.RecordBatch]):
        memo = WordHash()
        for table in by_key(batches, ["group", "cell"]):
            order = np.flatnonzero(~table.column("left").to_numpy(zero_copy_only=False))
            left = np.flatnonzero(table.column("left").to_numpy(zero_copy_only=False))
            order = np.concatenate([left, order])
            reps, texts = table.column("rep").to_numpy()[order], table.column("text").to_pylist()
            sets = [shingles(texts[i], memo, words) for i in order.tolist()]
            pairs = exact_links(sets, len(left), percent)
            if pairs:
                a, b = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(reps[a]), pa.array(reps[b])], names=["a", "b"])

    return verify


def true_links(docs: DataFrame, groups: DataFrame, percent: int = 80, words: int = WORDS, most_broadcast: int = 1_000_000) -> DataFrame:
    """(a, b): a spanning forest of the links inside each group(node, component).

    Members' texts are read again; the table of members is broadcast up to most_broadcast rows
    (16 bytes each) and joined by shuffle beyond.
    """
    members = groups.select(F.col("component").alias("group"), F.col("node").alias("rep"))
    cells = materialize(into_cells(members, "rep"))
    small = cells.count() <= most_broadcast
    rows = docs.select(F.col("doc_id").alias("rep"), "text").join(F.broadcast(cells) if small else cells, "rep")
    dealt = rows.repartition(n_shuffle(docs.sparkSession), "group", "cell").sortWithinPartitions("group", "cell")
    return dealt.select("group", "cell", "rep", "text", "left").mapInArrow(_verify(percent, words), "a long, b long")


def _components(docs: DataFrame, doc_id: str, text: str, words: int, percent: int, most_broadcast: int) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, text_hash."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = set_classes(rows, words=words, percent=percent)
    keys = sets.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "key_a", "key_b")
    classes = materialize(keys.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep")))
    # Signatures stay where they are: the copies, ids and keys only, are what is taken out.
    copies = materialize(keys.join(classes, ["key_a", "key_b"]).filter("doc_id != rep").select("doc_id", "key_a", "key_b"))
    small = copies.count() <= most_broadcast
    reps = sets.filter("n > 0 AND doc_id IS NOT NULL").join(F.broadcast(copies) if small else copies, ["doc_id", "key_a", "key_b"], "left_anti")
    reps = reps.select(F.col("doc_id").alias("rep"), "n", "bitmap", "prefix")
    possible = connected_components(candidate_links(reps, percent))
    linked = connected_components(true_links(rows, possible, percent, words, most_broadcast))
    named = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("key_a", "key_b", F.coalesce("component", "rep").alias("class_component"))
    out = sets.select("doc_id", "n", "key_a", "key_b", "text_hash").join(named, ["key_a", "key_b"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("class_component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = 80, most_broadcast: int = 1_000_000) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    Tables of ids are broadcast up to most_broadcast rows (at most 24 bytes each) and joined by
    shuffle beyond.
    """
    return _components(docs, doc_id, text, words, percent, most_broadcast).drop("text_hash")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = 80, most_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of docs that stay: the smallest doc_id of each component, with all columns.

    Dropped rows, by id and hash of the text, are broadcast up to most_broadcast rows and joined by shuffle beyond.
    """
    found = _components(docs, doc_id, text, words, percent, most_broadcast)
    gone = materialize(found.filter("component_id != doc_id").select(F.col("doc_id").alias(TMP + "id"), F.col("text_hash").alias(TMP + "text")).distinct())
    small = gone.count() <= most_broadcast
    same = (F.col(doc_id) == F.col(TMP + "id")) & (F.xxhash64(text_of(text)) == F.col(TMP + "text"))
    return docs.join(F.broadcast(gone) if small else gone, same, "left_anti").select(docs.columns)
