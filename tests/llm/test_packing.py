import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import packing as op

SCHEMA = "doc_id long, text string, piece string, bin int"


def expected_pieces(rows):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = []
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for k, (a, b) in enumerate([(0, first), *((s, s + 2048) for s in range(first, len(ids), 2048))]):
            out.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=str)


def check(rows, found):
    assert sorted((tuple(r)[:5] for r in found), key=str) == expected_pieces(rows)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in found)
    return len(bins), -(-total // 2048)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_driver_documents_and_rounds(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    used, least = check(rows, op.best_fit_pack(frame(spark, rows)).collect())
    assert used <= least + 2
    found = op.best_fit_pack(frame(spark, rows), block_pieces=16).collect()
    used, least = check(rows, found)
    assert used <= 1.1 * least + 2
    fill = defaultdict(int)
    for r in found:
        fill[r.sequence_id] += r.length
    assert sum(n <= 1024 for n in fill.values()) <= 1


def test_odd_cases(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b"), (4, "<|endoftext|> and <|endoftext|>"), (5, "x" * 4000), (6, "é漢😀   tab\t\n" * 3000), (7, " " * 5000)]
    df = frame(spark, rows)
    check(rows, op.best_fit_pack(df).collect())
    assert op.best_fit_pack(df.limit(0)).count() == 0


def test_sequences_round_trip(spark):
    rows = [(i, f"some words {i} " * (i * 37 % 400)) for i in range(40)]
    tokenizer = op.public_byte_bpe()
    got = defaultdict(list)
    for r in op.sequences(frame(spark, rows), tokenizer).collect():
        assert len(r.ids) == 2048
        for doc_id, at, end in zip(r.doc_ids, r.offsets, [*r.offsets[1:], None]):
            got[doc_id].append(r.ids[at:end])
    for doc_id, text in rows:
        want = [*tokenizer.encode(text), 0]
        have = sorted(got[doc_id], key=len)
        assert sum(map(len, have)) >= len(want) and any(part[: min(len(want), len(part))] == want[: len(part)] for part in have)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_bins_are_sound(lengths):
    lengths = np.array(lengths, dtype=np.int64)
    bins, offsets = op.sum_of_squares(lengths, 64)
    by = defaultdict(list)
    for b, o, n in zip(bins, offsets, lengths):
        by[b].append((o, n))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 64
    assert len(by) <= max(1, 2 * -(-int(lengths.sum()) // 64))


def test_one_row_repeated_very_often(spark):
    from pyspark.sql import functions as F

    rows = spark.range(50_000).selectExpr("7L AS doc_id", "'one two three' AS text")
    found = op.best_fit_pack(rows, block_pieces=1000)
    each = found.select("length").first().length
    by = found.groupBy("sequence_id").agg(F.count("*").alias("n"), F.countDistinct("offset").alias("d"), F.sum("length").alias("fill")).collect()
    assert sum(r.n for r in by) == 50_000 and all(r.n == r.d and r.fill <= 2048 for r in by)
    assert len(by) <= 50_000 // (2048 // each) + 2 + 50
    placed = op.materialize(rows.withColumn("row", F.monotonically_increasing_id())).groupBy(F.pmod(F.xxhash64("row"), F.lit(50))).count().agg(F.max("count")).first()[0]
    assert placed < 1500


def naive(lengths, capacity):
    """The rule by its definition: every placement's sum of squares is counted anew."""
    from collections import Counter

    bins, where = [], []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        choices = []
        for gap in sorted({g for g in bins if lengths[i] <= g < capacity}):
            after = list(bins)
            after[after.index(gap)] -= lengths[i]
            choices.append((sum(n * n for g, n in Counter(after).items() if 0 < g), gap))
        if choices:
            bins[bins.index(min(choices)[1])] -= lengths[i]
            where.append(min(choices)[1])
        else:
            bins.append(capacity - lengths[i])
            where.append(capacity)
    return sorted(bins), where


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_rule_equals_brute_force(lengths):
    bins, offsets = op.sum_of_squares(np.array(lengths, dtype=np.int64), 20)
    gaps, where = naive(lengths, 20)
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    assert [20 - int(offsets[i]) for i in order] == where
    left = defaultdict(lambda: 20)
    for b, n in zip(bins.tolist(), lengths):
        left[b] -= n
    assert sorted(left.values()) == gaps
