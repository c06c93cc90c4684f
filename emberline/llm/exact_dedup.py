"""Exact deduplication by two passes over a Bloom filter, in DataFrame functions only.

Texts are read once, for a written table of keys: ids and hashes. Pass one sets a few bits per hash in a blocked
Bloom filter and keeps the bits that were set at least twice. Pass two probes every key: one whose
bits were all set twice is possibly repeated and is grouped by its SHA-256; every other is
certainly unique and passes straight through, unshuffled.

The filter has ``bits_per_row`` bits a row. Up to ``max_words`` 64-bit words it is broadcast
(16 bytes a word, 32 MB at the default); a larger one meets the keys by a shuffle. No text is ever
shuffled for the verdicts. ``exact_dedup`` takes the rows that go out of the table where they lie: their keys are
broadcast up to ``max_broadcast`` rows (24 bytes each); only beyond that does a join move the rows, once.

Defined cases: a null text counts as empty; a null doc_id sorts below all others; of rows equal
in text and in the largest doc_id exactly one is kept; an empty table gives an empty result;
other columns are carried through untouched, whatever their names. Texts with equal SHA-256
are taken as equal, and in ``exact_dedup`` rows with equal ids and equal 128 bits of xxHash64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm._common import TMP, materialize, text_of

#: Bits that one text sets inside its word.
BITS = 2
ID, H, H2, SHA, WORD, TWICE, MARK, ALIKE = (TMP + x for x in ("id", "h", "h2", "sha", "word", "twice", "mark", "alike"))


def _bits(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, 40 + 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(BITS)]


def mask_of(h: Column) -> Column:
    """The word with the bits of a hash."""
    out = F.lit(0).cast("long")
    for bit in _bits(h):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def filter_words(n_rows: int, bits_per_row: int) -> int:
    """Words of the filter: a power of two with at least bits_per_row bits for each row."""
    return max(16, 1 << max(0, (max(1, n_rows) * bits_per_row // 64 - 1).bit_length()))


def text_hashes(text: str) -> list[Column]:
    return [F.xxhash64(text_of(text)).alias(H), F.xxhash64(F.lit(1), text_of(text)).alias(H2)]


def keys_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The written table of keys: id, two hashes, SHA-256."""
    return materialize(docs.select(F.col(doc_id).alias(ID), *text_hashes(text), F.unhex(F.sha2(text_of(text), 256)).alias(SHA)))


def repeated_bits(hashes: DataFrame, words: int) -> DataFrame:
    """(word, bits set by two or more rows) from the column H."""
    set_twice = (
        hashes.select(F.pmod(F.col(H), F.lit(words)).alias(WORD), F.explode(F.array_distinct(F.array(*_bits(F.col(H))))).alias("bit"))
        .groupBy(WORD, "bit").agg(F.count("*").alias("n")).filter("n > 1")
    )
    return set_twice.groupBy(WORD).agg(F.expr("bit_or(shiftleft(1L, bit))").alias(TWICE))


def split_by_filter(keys: DataFrame, bits_per_row: int = 16, max_words: int = 1 << 21) -> tuple[DataFrame, DataFrame]:
    """(possibly repeated, certainly unique) keys."""
    words = filter_words(keys.count(), bits_per_row)
    bits = materialize(repeated_bits(keys.select(H), words))
    probe = keys.withColumn(WORD, F.pmod(F.col(H), F.lit(words))).join(F.broadcast(bits) if words <= max_words else bits, WORD, "left")
    mask = mask_of(F.col(H))
    maybe = F.coalesce(F.col(TWICE).bitwiseAND(mask) == mask, F.lit(False))
    return probe.filter(maybe).drop(WORD, TWICE), probe.filter(~maybe).drop(WORD, TWICE)


def _groups(maybe: DataFrame) -> DataFrame:
    """The written table of groups of equal texts: SHA, keep_id, group_size, n_keep (rows with that id).

    By (text, id) first: the ids of a very large group are spread before they meet. The table is written, so
    that the joins with it read plain shuffles and adaptive execution can split a large group.
    """
    by_id = maybe.groupBy(SHA, ID).agg(F.count("*").alias("n"))
    return materialize(by_id.groupBy(SHA).agg(F.max(ID).alias("keep_id"), F.sum("n").alias("group_size"), F.max_by("n", F.struct(ID)).alias("n_keep")))


def copy_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **filter_options) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    maybe, unique = split_by_filter(keys_of(docs, doc_id, text), **filter_options)
    groups = _groups(maybe)
    is_keep = F.col(ID).eqNullSafe(F.col("keep_id"))
    found = maybe.join(groups, SHA).filter(~is_keep | (F.col("n_keep") == 1)).withColumn("kept", is_keep)
    # Rows equal in text and id are alike here, so those of the id that stays come from their count.
    tied = groups.filter("n_keep > 1").select(SHA, F.col("keep_id").alias(ID), "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_keep"))).alias("i")).withColumn("kept", F.col("i") == 1)
    alone = unique.withColumns({"keep_id": F.col(ID), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    out = [F.col(ID).alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex(SHA)).alias("text_sha256")]
    return found.select(out).unionByName(tied.select(out)).unionByName(alone.select(out))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_broadcast: int = 1_000_000, **filter_options) -> DataFrame:
    """The rows of docs that stay, with all their columns; unless very many go, none is shuffled."""
    maybe, _ = split_by_filter(keys_of(docs, doc_id, text), **filter_options)
    joined = maybe.join(_groups(maybe), SHA)
    is_keep = F.col(ID).eqNullSafe(F.col("keep_id"))
    # Rows that go, and those of which one of several alike stays.
    marks = joined.filter(~is_keep | (F.col("n_keep") > 1)).select(F.col(ID).alias(MARK), H, H2, is_keep.alias(ALIKE)).distinct()
    marks = materialize(marks.select(MARK, F.col(H).alias(H + "m"), F.col(H2).alias(H2 + "m"), ALIKE))
    hashed = docs.select("*", *text_hashes(text))
    same = F.col(doc_id).eqNullSafe(F.col(MARK)) & (F.col(H) == F.col(H + "m")) & (F.col(H2) == F.col(H2 + "m"))
    judged = hashed.join(F.broadcast(marks) if marks.count() <= max_broadcast else marks, same, "left")
    alike = judged.filter(ALIKE).dropDuplicates([H, H2])
    return judged.filter(F.col(ALIKE).isNull()).select(docs.columns).unionByName(alike.select(docs.columns))
