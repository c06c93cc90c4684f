import hashlib
import random
from collections import defaultdict

from emberline.llm import line_dedup as op
from emberline.llm.queries import queries

SCHEMA = "doc_id long, text string, h string, content int"


def brute(spark, rows, divisor=4):
    """Chunks by plain loops; hashes from Spark's own function."""
    lines = sorted({x for _, t in rows if t is not None for x in t.split("\n")})
    h = dict(zip(lines, (r[0] for r in spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "x string, i int").orderBy("i").selectExpr("xxhash64(x)").collect()))) if lines else {}
    pairs = sorted({(h[b], h[a] if i else 0) for _, t in rows if t is not None for i, (a, b) in enumerate(zip(["", *t.split("\n")], t.split("\n")))})
    rolled = dict(zip(pairs, (r[0] for r in spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "a long, b long, i int").orderBy("i").selectExpr(f"pmod(xxhash64(a, b), {divisor})").collect()))) if pairs else {}
    where, docs = defaultdict(list), {}
    for key in {(d, t) for d, t in rows if t is not None}:
        own = key[1].split("\n")
        start, units = 0, []
        for i, x in enumerate(own):
            if i + 1 == len(own) or rolled[(h[x], h[own[i - 1]] if i else 0)] == 0:
                if i > start and any(y.strip(" ") for y in own[start : i + 1]):
                    units.append((start, i))
                start = i + 1
        docs[key] = own, units
        for a, b in units:
            where[tuple(own[a : b + 1])] += [((key[0] is not None, key[0] or 0), key[1], a)] * rows.count(key)
    gone = {}
    for key, (own, units) in docs.items():
        gone[key] = set()
        for a, b in units:
            places = where[tuple(own[a : b + 1])]
            if len(places) > 1 and ((key[0] is not None, key[0] or 0), a) != min((p[0], p[2]) for p in places):
                gone[key].update(range(a, b + 1))
    out = []
    for d, t in rows:
        own = [] if t is None else t.split("\n")
        bad = gone.get((d, t), set())
        left = "\n".join(x for i, x in enumerate(own) if i not in bad)
        out.append((d, len(own), len(bad), ",".join(map(str, sorted(bad))), hashlib.sha256(left.encode()).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 14)))
    common = [line() for _ in range(12)] + ["", "w " * 60]
    passage = [line() + f" p{i} " + line() for i in range(8)]
    rows = []
    for i in range(80):
        own = [rng.choice(common) if rng.random() < 0.3 else line() for _ in range(rng.randrange(0, 12))]
        if rng.random() < 0.4:
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage
        rows.append((i, "\n".join(own)))
    return rows, passage


def test_same_as_brute_force(spark):
    for seed in (1, 2):
        rows, passage = corpus(seed)
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
        found = sorted(tuple(r) for r in op.line_digest(df).collect())
        assert found == sorted(brute(spark, rows))
        clean = {r.doc_id: r.text for r in op.dedup_lines(df, bits_per_hash=1, max_words=1, max_bytes=0).collect()}
        assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in clean.items()} == {r[0]: r[4] for r in found}
        assert any(r[2] for r in found)
        for options in ({}, {"max_words": 1, "max_bytes": 0}):
            clean = {r.doc_id: r.text for r in op.dedup_lines(df, passage_words=50, **options).collect()}
            holders = [d for d, t in rows if "\n".join(passage) in t]
            assert len(holders) > 10 and sum(passage[3] in clean[d].split("\n") for d in holders) == 1


def test_driver_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    assert sorted(tuple(r) for r in op.line_digest(df).collect()) == sorted(brute(spark, rows))


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a\nb", "", 1)], SCHEMA)
    plan = op.line_digest(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_cases(spark):
    block = "one two three four five six\nseven eight nine ten eleven twelve"
    rows = [(1, None), (2, ""), (3, block), (3, block), (None, block), (4, "\n" * 5000), (5, "y " * 100_000), (6, "y " * 100_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = op.line_digest(df).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert by[6].n_removed == 0 == by[5].n_removed == by[4].n_removed == by[None].n_removed and by[1].n_lines == 0
    runs = {r.doc_id: r.n_removed for r in op.line_digest(df, passage_words=50).collect()}
    assert runs[6] == 1 and runs[5] == 0 and runs[4] > 4000
    assert op.dedup_lines(df).columns == df.columns and op.dedup_lines(df).filter("text IS NULL").count() == 1
    assert op.line_digest(df.limit(0)).collect() == [] == op.dedup_lines(df.limit(0)).collect()


def passages(rows, least=50):
    """By (doc_id, text), the lines inside any passage of so many words that stands earlier too: every passage is tried."""
    where, inside = defaultdict(list), defaultdict(set)
    for d, t in rows:
        own = t.split("\n")
        for a in range(len(own)):
            for b in range(a + 1, min(a + 51, len(own) + 1)):
                if sum(x.count(" ") + 1 for x in own[a:b]) >= least:
                    where[tuple(own[a:b])].append((d, a, b))
    for places in where.values():
        for d, a, b in sorted(places)[1:]:
            inside[d].update(range(a, b))
    return inside


def test_short_lines_that_make_a_long_passage(spark):
    rng = random.Random(5)
    count = iter(range(10**6))
    line = lambda n: " ".join(f"w{next(count)}" for _ in range(n))
    shared = [[line(n) for n in sizes] for sizes in ((26, 26), (25, 26), (40, 12, 5), (5, 12, 40), (17, 17, 17), (13, 13, 13, 13), (11, 11, 11, 11, 11), (10, 10, 10, 10, 9), (49,), (20, 20))]
    often = [line(3) for _ in range(4)] + [""]
    rows = []
    for i in range(150):
        own = [line(rng.randrange(2, 30)) for _ in range(rng.randrange(1, 4))]
        for passage in rng.sample(shared, 2):
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage
        own += [rng.choice(often) for _ in range(rng.randrange(0, 6))]
        rows.append((i, "\n".join(own)))
    # Lines and pairs of lines of other texts, no passage of them: what is stitched together stays.
    stitched = [x for k in range(16) for x in (often[k % 4], "")]
    rows.append((200, "\n".join(stitched[:16])))
    inside = passages(rows)
    found = {r.doc_id: set(map(int, filter(None, r.removed.split(",")))) for r in op.line_digest(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), passage_words=50).collect()}
    by_chunks = {r[0]: set(map(int, filter(None, r[3].split(",")))) for r in brute(spark, rows)}
    assert found == {d: by_chunks[d] | inside[d] for d, _ in rows}
    assert sum(map(len, inside.values())) > 300 and any(inside[d] - by_chunks[d] for d, _ in rows)


def test_the_query_leaves_no_long_passage_twice(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if r.text is not None]
    inside = passages(rows)
    found = {r.doc_id: set(map(int, filter(None, r.removed.split(",")))) for r in queries()["op9_line_dedup"](spark, sf_dir).collect()}
    assert any(inside.values()) and all(inside[d] <= found[d] for d, _ in rows)
