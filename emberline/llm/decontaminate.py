"""Benchmark decontamination: a broadcast hash set of normalised item n-grams, scanned over
every window of every document; each hash hit is verified word by word.

Words are runs of ASCII letters (lower-cased), ASCII digits and non-ASCII characters. A window
is ``n`` consecutive words of an item; an item of fewer words, but not none, is one window. A
document word inside any occurrence of a window is hit.

The windows are broadcast as sorted hashes with their places in one buffer of words, of ``max_bytes`` at most. A
larger benchmark's windows stay a table: a bitmap of their hashes (``filter_bits`` bits) is broadcast instead,
every document is scanned once for windows that pass it, and those alone, with their words, meet
the table by a shuffle. Both ways give the same rows.

Defined cases: null or empty texts have no words and are never hit; items without words match
nothing; a null item_id reports its hits without a name; repeated items and documents are
each reported; empty tables give empty results or clean documents. Other columns pass through by name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from emberline.llm._common import ALNUM_LOWER, TMP, WordHash, materialize, utf8

_MIX = 0x2545F4914F6CDD1D
_WORD = re.compile(rb"[^ ]+")
#: Rows are scanned together until they have this many words.
_CHUNK_WORDS = 500_000


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(ALNUM_LOWER).split()


def rolling(hashes: np.ndarray, lengths: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(L, hash of the L words that begin at each place) for the wanted lengths, in order."""
    h = hashes.astype(np.uint64)
    out = np.zeros(len(h), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for length in range(1, max(lengths, default=0) + 1):
            if length > len(h):
                return
            out = out[: len(h) - length + 1] * np.uint64(_MIX) + h[length - 1 :]
            if length in lengths:
                yield length, out


def windows_of(words: list[bytes], n: int, memo: WordHash) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(length, hashes, begins, ends): the windows of an item, and their places in its words joined by blanks."""
    size = min(n, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    hashes = next((h for _, h in rolling(memo.of(words), {size})), np.zeros(0, dtype=np.uint64)) if size else np.zeros(0, dtype=np.uint64)
    return size, hashes, (ends - lengths)[: len(hashes)], ends[size - 1 :] if size else ends


class ItemWindows:
    """The windows of items: by length, sorted hashes, and of each the place of its words in one buffer and its item."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        memo, parts, buffer, at = WordHash(), {}, [], 0
        self.items = [item_id for item_id, _ in items]
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            size, hashes, begins, ends = windows_of(words, n, memo)
            if size:
                parts.setdefault(size, []).append((hashes, begins + at, ends + at, np.full(len(hashes), k)))
                buffer.append(b" ".join(words))
                at += len(buffer[-1])
        self.words = b"".join(buffer)
        self.by_length = {}
        for size, found in parts.items():
            hashes, begins, ends, owner = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(hashes, kind="stable")
            self.by_length[size] = (hashes[order], begins[order], (ends - begins)[order].astype(np.int32), owner[order].astype(np.int32))

    @property
    def nbytes(self) -> int:
        return len(self.words) + sum(a.nbytes for arrays in self.by_length.values() for a in arrays) + 64 * len(self.items)

    def scan(self, docs: list[list[bytes]], memo: WordHash) -> list[list[tuple[int, int, tuple]]]:
        """For each document its verified hits: (first word, past the last word, item ids)."""
        out: list[list[tuple[int, int, tuple]]] = [[] for _ in docs]
        for size, k, start, h, window in candidates(docs, memo, set(self.by_length), lambda size, hashes: in_sorted(self.by_length[size][0], hashes)):
            known, begins, lengths, owner = self.by_length[size]
            low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            ids = {self.items[owner[i]] for i in range(low, high) if self.words[begins[i] : begins[i] + lengths[i]] == window}
            if ids:
                out[k].append((start, start + size, tuple(ids)))
        return out


def in_sorted(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return known[at] == hashes


def candidates(docs: list[list[bytes]], memo: WordHash, sizes: set[int], passes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(length, document, first word, hash, words) of the windows whose hashes pass."""
    if not sizes or not docs:
        return
    flat = memo.of([w for d in docs for w in d])
    ends = np.cumsum([len(d) for d in docs])
    for size, hashes in rolling(flat, sizes):
        for place in np.flatnonzero(passes(size, hashes)).tolist():
            k = int(np.searchsorted(ends, place, side="right"))
            start = place - (int(ends[k - 1]) if k else 0)
            if start + size <= len(docs[k]):
                yield size, k, start, int(hashes[place]), b" ".join(docs[k][start : start + size])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order that cover the same words."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(index of the first, words of each) of runs of texts."""
    begin, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(words := words_of(text))
        size += len(words)
        if size >= _CHUNK_WORDS:
            yield begin, held
            begin, held, size = i + 1, [], 0
    if held:
        yield begin, held


def windows_size(benchmark: DataFrame, text: str) -> int:
    """About the bytes of the windows: the words, and 24 for each."""
    content = F.coalesce(F.col(text), F.lit(""))
    n_words = F.size(F.split(content, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    return benchmark.agg(F.sum(F.octet_length(content) + 24 * n_words + 64)).first()[0] or 0


def _held(benchmark: DataFrame, item_id: str, text: str, n: int) -> ItemWindows:
    """The windows of a benchmark of bounded size."""
    return ItemWindows([(r[0], r[1]) for r in benchmark.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator()], n)


_LISTS = [StructField("n_words", LongType()), StructField("starts", ArrayType(LongType())), StructField("ends", ArrayType(LongType())), StructField("items", ArrayType(StringType()))]


def _found(rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, n: int, max_bytes: int, filter_bits: int) -> DataFrame:
    """rows with n_words, disjoint hit spans in words (starts, ends) and sorted items in place of their last column, the text."""
    keys = [StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]]
    schema = StructType([*keys, *_LISTS])
    if windows_size(benchmark, item_text) > max_bytes:
        return _found_by_table(rows, benchmark, item_id, item_text, n, filter_bits, schema)
    held = rows.sparkSession.sparkContext.broadcast(_held(benchmark, item_id, item_text, n))

    def scan(batches):
        memo = WordHash()
        for batch in batches:
            n_words, starts, ends, items = [], [], [], []
            for _, words in _chunks(batch.column(len(keys)).to_pylist()):
                n_words += [len(w) for w in words]
                for hits in held.value.scan(words, memo):
                    spans = merged([(a, b) for a, b, _ in hits])
                    starts.append([a for a, _ in spans])
                    ends.append([b for _, b in spans])
                    items.append(sorted({i for _, _, found in hits for i in found if i is not None}))
            lists = [pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *lists], names=schema.names)

    return rows.mapInArrow(scan, schema)


def _found_by_table(rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, n: int, filter_bits: int, schema: StructType) -> DataFrame:
    keys = [StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]]

    def list_windows(batches):
        memo = WordHash()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                size, hashes, begins, ends = windows_of(words, n, memo)
                joined = b" ".join(words)
                if size:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(hashes), size, dtype=np.int32)), pa.array(hashes.view(np.int64)), pa.array([joined[a:b] for a, b in zip(begins.tolist(), ends.tolist())], pa.binary()), pa.array([name] * len(hashes), pa.string())],
                        names=["size", "hash", "words", "item"],
                    )

    windows = materialize(benchmark.select(F.col(item_id).cast("string"), F.col(item_text)).mapInArrow(list_windows, "size int, hash long, words binary, item string").distinct())
    sizes = {r["size"] for r in windows.select("size").distinct().collect()}  # n at most
    n_bits = filter_bits.bit_length() - 1
    bit = F.shiftrightunsigned("hash", 64 - n_bits)
    lines = windows.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, CAST(shiftrightunsigned(hash, {64 - n_bits}) & 63 AS INT)))").alias("bits")).toArrow()
    bitmap = np.zeros(max(1, filter_bits // 64), dtype=np.int64)
    bitmap[lines.column("at").to_numpy()] = lines.column("bits").to_numpy()  # bounded by filter_bits
    held = rows.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def passes(size, hashes):
        at = hashes >> np.uint64(64 - n_bits)
        return (held.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0

    seen = StructType([StructField("row", LongType()), *keys, StructField("n_words", LongType()), StructField("size", IntegerType()), StructField("hash", LongType()), StructField("words", BinaryType()), StructField("start", LongType())])

    def scan(batches):
        memo, row = WordHash(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for begin, words in _chunks(batch.column(len(keys)).to_pylist()):
                own = batch.slice(begin, len(words)).columns[: len(keys)]
                ids = np.arange(row, row + len(words))
                row += len(words)
                none = lambda kind: pa.nulls(len(words), kind)
                yield pa.RecordBatch.from_arrays([pa.array(ids), *own, pa.array([len(w) for w in words], pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.binary()), none(pa.int64())], names=seen.names)
                found = list(candidates(words, memo, sizes, passes))
                for part in range(0, len(found), 50_000):
                    size, k, start, h, window = zip(*found[part : part + 50_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[list(k)]), *(pa.nulls(len(k), c.type) for c in own), pa.nulls(len(k), pa.int64()), pa.array(size, pa.int32()), pa.array(np.array(h, dtype=np.uint64).view(np.int64)), pa.array(window, pa.binary()), pa.array(start, pa.int64())],
                        names=seen.names,
                    )

    # Written once: the numbers of rows then are the same for both uses.
    every = materialize(rows.mapInArrow(scan, seen))
    hits = every.filter("size IS NOT NULL").select("row", "size", "hash", "words", "start").join(windows, ["size", "hash", "words"])
    lists = hits.groupBy("row").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    out = every.filter("size IS NULL").select("row", *[f.name for f in keys], "n_words").join(lists, "row", "left").select(*[f.name for f in keys], "n_words", "spans", "items")

    def merge(batches):
        for batch in batches:
            spans = [merged([(x["start"], x["end"]) for x in own or ()]) for own in batch.column(len(keys) + 1).to_pylist()]
            items = [x or [] for x in batch.column(len(keys) + 2).to_pylist()]
            lists = [pa.array([[a for a, _ in x] for x in spans], pa.list_(pa.int64())), pa.array([[b for _, b in x] for x in spans], pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], *lists], names=schema.names)

    return out.mapInArrow(merge, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, max_bytes: int = 64 << 20, filter_bits: int = 1 << 27) -> DataFrame:
    """Per document: doc_id, n_words, disjoint hit spans in words (starts, ends), sorted items."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _found(rows, benchmark, item_id, item_text, n, max_bytes, filter_bits)


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given spans of words."""
    raw = utf8(text)
    places = [m.span() for m in _WORD.finditer(raw.translate(ALNUM_LOWER))]
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, mode: str = "documents", max_bytes: int = 64 << 20, filter_bits: int = 1 << 27) -> DataFrame:
    """docs without its contaminated rows (mode "documents") or without all hit words ("spans").

    With the windows broadcast, every row is judged where it lies and nothing is shuffled. With a larger benchmark the
    spans of hit texts come back to their rows by 128 bits of their texts' hashes.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode: {mode}")
    at = docs.columns.index(text)
    if windows_size(benchmark, item_text) > max_bytes:
        return _decontaminate_by_table(docs, benchmark, text, item_id, item_text, n, mode, filter_bits)
    held = docs.sparkSession.sparkContext.broadcast(_held(benchmark, item_id, item_text, n))

    def judge(batches):
        memo = WordHash()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep, new = [], list(texts)
            for begin, words in _chunks(texts):
                for i, (hits, own) in enumerate(zip(held.value.scan(words, memo), words)):
                    spans = merged([(a, b) for a, b, _ in hits])
                    keep.append(not is_contaminated(sum(b - a for a, b in spans), len(own)))
                    if spans and mode == "spans":
                        new[begin + i] = cut_words(texts[begin + i], spans)
            if mode == "documents":
                yield batch.filter(pa.array(keep, pa.bool_()))
            else:
                yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(judge, docs.schema)


def _decontaminate_by_table(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, n: int, mode: str, filter_bits: int) -> DataFrame:
    a, b, starts, ends = (TMP + x for x in ("a", "b", "starts", "ends"))
    hashes = [F.xxhash64(F.col(text)).alias(a), F.xxhash64(F.lit(1), F.col(text)).alias(b)]
    found = _found(docs.select(*hashes, F.col(text)), benchmark, item_id, item_text, n, 0, filter_bits).filter(F.size("starts") > 0)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda x, y: y - x), F.lit(0).cast("long"), lambda s, x: s + x)
    if mode == "documents":
        found = found.filter(20 * n_hit >= F.col("n_words"))
    marks = materialize(found.groupBy(F.col(a).alias(a + "m"), F.col(b).alias(b + "m")).agg(F.first("starts").alias(starts), F.first("ends").alias(ends)))
    small = (marks.agg(F.sum(16 * F.size(starts) + 32)).first()[0] or 0) <= 32 << 20
    same = (F.col(a) == F.col(a + "m")) & (F.col(b) == F.col(b + "m"))
    joined = docs.select("*", *hashes).join(F.broadcast(marks) if small else marks, same, "left_anti" if mode == "documents" else "left")
    if mode == "documents":
        return joined.select(docs.columns)
    at, width = docs.columns.index(text), len(docs.columns)

    def cut(batches):
        for batch in batches:
            own = zip(*(batch.column(k).to_pylist() for k in (at, width, width + 1)))
            new = pa.array([t if x is None else cut_words(t, list(zip(x, y))) for t, x, y in own], batch.schema.field(at).type)
            yield batch.select(list(range(width))).set_column(at, batch.schema.field(at), new)

    return joined.select(*docs.columns, starts, ends).mapInArrow(cut, docs.schema)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def contamination_digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, benchmark, **options)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
