import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import ngram_join as op

SCHEMA = "doc_id long, text string, n string, rep int"


def brute(rows):
    sets = {}
    for doc_id, text, *_ in rows:
        words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        k = min(5, len(words))
        sets[doc_id] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in op.jaccard_components(df).collect()}


def near_copies(seed, n_docs=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    for i in range(n_docs):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 8, 20, 60, 150]))]
            if rng.random() < 0.3:
                words += passage
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rows = near_copies(seed)
    assert run(spark, rows) == brute(rows)


def test_one_large_group_is_dealt_into_cells(spark, monkeypatch):
    rows = near_copies(3, 120)
    base = " ".join(f"v{i}" for i in range(100))
    rows += [(1000 + i, base.replace(f"v{i}", "zz", 1)) for i in range(60)]
    monkeypatch.setattr(op, "TILE", 7)
    for name in ("into_cells", "_meet", "possible_pairs"):
        monkeypatch.setattr(op, name, lambda *a, f=getattr(op, name): f(*a, 7))
    assert run(spark, rows) == brute(rows)


def test_driver_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_odd_cases(spark):
    rows = [(1, None), (2, ""), (3, "  \t"), (4, "A b"), (5, "a  B"), (6, "x " * 30_000), (7, "x x x x x"), (8, "é É"), (9, "a b c")]
    found = run(spark, rows)
    assert found == brute(rows)
    assert found[1] == (0, 1) and found[5] == (1, 4) and found[6] == (1, 6)
    df = spark.createDataFrame([(1, "a b c d e f", "x", 1)] * 3 + [(None, "a b c d e f", "x", 1)], SCHEMA)
    assert sorted((tuple(r) for r in op.jaccard_components(df).collect()), key=str) == [(1, 2, 1)] * 3 + [(None, 2, 1)]
    assert op.jaccard_components(df.limit(0)).collect() == []
    assert [r.doc_id for r in op.near_dedup(df.filter("doc_id = 1").union(df.selectExpr("9L", "text", "n", "rep"))).collect()] == [1] * 3
    assert op.near_dedup(df).columns == ["doc_id", "text", "n", "rep"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 400), min_size=1, max_size=120), min_size=2, max_size=25))
def test_bitmaps_lose_no_link(sets):
    sets = sorted((np.array(sorted(s), dtype=np.int64) * 7919 % 65537 for s in sets), key=len)
    sets = [np.unique(s) for s in sets]
    n = np.array([len(s) for s in sets])
    pairs = op.possible_pairs(n, [op.parity(s, op.bitmap_bits(len(s))) for s in sets], 80, 4)
    forest = op.Forest(len(sets))
    for a, b in pairs:
        forest.join(a, b)
    exact = op.Forest(len(sets))
    for a, b in op.exact_links(sets, len(sets), 80):
        exact.join(a, b)
    for i, j in itertools.combinations(range(len(sets)), 2):
        linked = 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
        if linked:
            assert forest.find(i) == forest.find(j) and exact.find(i) == exact.find(j)
        first_i, first_j = (set(s[: op.prefix_length(len(s), 80)].tolist()) for s in (sets[i], sets[j]))
        assert not linked or first_i & first_j


def test_components_of_a_long_path(spark):
    from emberline.llm.components import connected_components

    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_texts_of_one_id_fare_by_themselves(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "x", 1), (2, long, "x", 1), (2, "quite another text of six words", "x", 1), (3, "quite another text of six words", "x", 1), (4, "alone", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.doc_id, r.component_id) for r in op.jaccard_components(df).collect()} == {(1, 1), (2, 1), (2, 2), (3, 2), (4, 4)}
    for most in (1_000_000, 0):
        assert sorted((r.doc_id, r.text[:5]) for r in op.near_dedup(df, most_broadcast=most).collect()) == [(1, "w0 w1"), (2, "quite"), (4, "alone")]


def test_families_that_share_a_passage_in_one_large_group(spark, monkeypatch):
    rng = random.Random(5)
    rows, passage = [], [f"p{i}" for i in range(70)]
    # Three families share a passage without linking; each drifts, so that its ends do not link.
    for family, members in enumerate((40, 25, 8)):
        words = passage + [f"f{family}x{i}" for i in range(60)]
        for i in range(members):
            words[rng.randrange(len(words))] = f"new{family}y{i}"
            rows.append((family * 100 + i, " ".join(words)))
    # Rows that link with few or none of them.
    rows += [(1000 + i, " ".join(passage + [f"s{i}y{j}" for j in range(rng.choice([10, 30, 60]))])) for i in range(12)]
    want = brute(rows)
    assert len({c for _, c in want.values()}) > 3
    monkeypatch.setattr(op, "TILE", 7)
    monkeypatch.setattr(op.into_cells, "__defaults__", (7,))
    assert run(spark, rows) == want
