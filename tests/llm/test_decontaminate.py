import hashlib
import random
import re

import pytest

from emberline.llm import decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, n_words string, items int"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            k = min(13, len(v))
            for at in range(len(v) - k + 1) if k else ():
                for i in range(len(w) - k + 1):
                    if w[i : i + k] == v[at : at + k]:
                        hit.update(range(i, i + k))
                        found.add(str(item_id))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA),
        spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string"),
    )


def case(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice("abcdefg") + rng.choice("éxyz") for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 30])))) for i in range(25)]
    items += [(99, None), (98, items[3][1])]
    docs = []
    for i in range(60):
        text = [" ".join(rng.choice("abcdefg") + rng.choice("éxyz") for _ in range(rng.randrange(80)))]
        for _ in range(rng.randrange(3)):
            text.insert(rng.randrange(len(text) + 1), rng.choice(items)[1] or "")
        docs.append((i, rng.choice([" ", ". ", "--"]).join(text).replace("a", rng.choice("aA"))))
    return [*docs, (100, None), (101, ""), (102, "?!")], items


@pytest.mark.parametrize("options", [{}, {"max_bytes": 0}, {"max_bytes": 0, "filter_bits": 64}])
def test_same_as_brute_force(spark, options):
    docs, items = case(5)
    docs += docs[:20] + [(None, docs[3][1])] * 2
    found = op.contamination_digest(*tables(spark, docs, items), **options)
    docs = [(-1 if d is None else d, t) for d, t in docs]
    found = found.fillna(-1, ["doc_id"])
    assert sorted(tuple(r) for r in found.collect()) == brute(docs, items)


def test_driver_documents(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = sorted(tuple(r) for r in op.contamination_digest(docs, items).collect())
    some = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    hit = {r[0] for r in found if r[2]}
    picked = [d for d in some if d[0] in hit or d[0] % 10 == 0]
    ids = {d[0] for d in picked}
    assert hit and [r for r in found if r[0] in ids] == brute(picked, [tuple(r) for r in items.collect()])


def test_rows_and_spans_go(spark):
    docs, items = case(6)
    df, bench = tables(spark, docs, items)
    bad = {r[0] for r in brute(docs, items) if r[5]}
    assert bad
    for max_bytes in (1 << 24, 0):
        kept = op.decontaminate(df, bench, max_bytes=max_bytes)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in bad)
    cut = op.decontaminate(df, bench, mode="spans")
    assert cut.count() == len(docs)
    assert sorted(map(str, cut.collect())) == sorted(map(str, op.decontaminate(df, bench, mode="spans", max_bytes=0).collect()))
    before = {r[0]: r for r in brute(docs, items)}
    for r in cut.collect():
        assert len(words(r.text)) == before[r.doc_id][1] - before[r.doc_id][2]


def test_odd_cases(spark):
    docs = [(1, "a b"), (1, "a b"), (None, "a b"), (2, "z " * 200_000)]
    df, bench = tables(spark, docs, [(7, "a b"), (None, "b")])
    found = sorted((tuple(r)[:4] for r in op.contamination_digest(df, bench).collect()), key=str)
    assert found == sorted([(1, 2, 2, 1), (1, 2, 2, 1), (None, 2, 2, 1), (2, 200_000, 0, 0)], key=str)
    assert op.contamination_digest(df.limit(0), bench).count() == 0
    assert op.contamination_digest(df, bench.limit(0)).filter("contaminated").count() == 0
    assert op.decontaminate(df, bench.limit(0)).count() == 4


def test_windows_are_small_and_their_size_is_bounded(spark):
    import pickle

    rng = random.Random(3)
    items = [(f"item {k}", " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 200)))) for k in range(2000)]
    held = op.ItemWindows(items, 13)
    bound = op.windows_size(spark.createDataFrame(items, "item_id string, text string"), "text")
    n_windows = sum(len(h) for h, *_ in held.by_length.values())
    assert held.nbytes <= bound <= 1.3 * held.nbytes and len(pickle.dumps(held)) <= 1.1 * held.nbytes and n_windows > 150_000
