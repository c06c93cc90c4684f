import hashlib
from collections import defaultdict

from emberline.llm import exact_dedup as op

SCHEMA = "doc_id long, text string, word string, kept string"


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return sorted((d, max(groups[t or ""]), len(groups[t or ""]), d == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)


def test_same_as_brute_force_with_a_crowded_filter(spark):
    rows = [(i, None if i % 50 == 7 else f"text {i % 37 if i % 3 else i}") for i in range(600)] + [(9999, "")]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    for options in ({}, {"bits_per_row": 1}, {"max_words": 1}, {"max_words": 1, "bits_per_row": 1}):
        found = sorted(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in op.copy_groups(df, **options).collect())
        assert found == brute(rows)
        stay = op.exact_dedup(df, max_broadcast=0 if options else 1000, **options)
        assert stay.columns == df.columns
        assert sorted(r.doc_id for r in stay.collect()) == sorted(d for d, *_, kept, _ in brute(rows) if kept)


def test_only_possible_repeats_are_flagged(spark):
    df = spark.createDataFrame([(i, f"t{i}", "", "") for i in range(2000)] + [(5000, "t7", "", "")], SCHEMA)
    maybe, unique = op.split_by_filter(op.keys_of(df))
    assert {7, 5000} <= {r[op.ID] for r in maybe.collect()} and maybe.count() < 200
    assert maybe.count() + unique.count() == 2001


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a", "", "")], SCHEMA)
    plan = op.copy_groups(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_cases(spark):
    df = spark.createDataFrame([(3, "same", "a", "b"), (3, "same", "a", "b"), (None, "same", "c", "d"), (None, "lone", "", "")], SCHEMA)
    found = op.copy_groups(df).collect()
    assert len(found) == 4 and sum(r.kept for r in found) == 2
    assert {(r.keep_id, r.group_size) for r in found} == {(3, 3), (None, 1)}
    assert len(op.exact_dedup(df).collect()) == 2
    assert op.copy_groups(df.limit(0)).count() == 0 == op.exact_dedup(df.limit(0)).count()
    nulls = spark.createDataFrame([(None, "x", "", "")] * 3, SCHEMA)
    assert sum(r.kept for r in op.copy_groups(nulls).collect()) == 1 == op.exact_dedup(nulls).count()
    long = spark.createDataFrame([(1, "y" * 2_000_000, "", ""), (2, "y" * 2_000_000, "", "")], SCHEMA)
    assert [r.doc_id for r in op.exact_dedup(long).collect()] == [2]


def test_no_text_is_shuffled_for_the_verdicts(spark):
    df = spark.createDataFrame([(i, f"t{i % 50}", "", "") for i in range(200)], SCHEMA)
    for options in ({}, {"max_words": 1}):
        for plan in (op.copy_groups(df, **options), *op.split_by_filter(op.keys_of(df), **options)):
            moved = [line for line in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line or "Aggregate" in line or "Relation" in line]
            assert moved and not any("text#" in line for line in moved)
    # The rows that stay are read where they lie.
    final = op.exact_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in final.split("Union")[0] and "hashpartitioning(word" not in final
