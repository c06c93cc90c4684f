import re
from collections import Counter, defaultdict

from emberline.llm import divergence as op

SCHEMA = "doc_id long, text string, lang string, source string, term string, value string"


def brute(rows, least=10, top=10):
    docs = [(a or "", s or "", [m.translate(LOWER) for m in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]) for t, a, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = sorted((w for w in df if df[w] >= least), key=lambda w: w.encode())
        counts = defaultdict(Counter)
        for _, s, words in own:
            counts[s].update(w for w in words if df[w] >= least)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        rank = lambda items: sorted(items, key=lambda x: (-x[1], x[0].encode()))
        for s in p:
            terms = rank((w, f(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w])
            out += [(lang, s, "term", w, v, k) for k, (w, v) in enumerate(terms[:top], 1)]
            out += [(lang, s, "pair", o, v, k) for k, (o, v) in enumerate(rank((o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in p if o != s), 1)]
    return sorted(out)


LOWER = {c: c + 32 for c in range(65, 91)}


def found(df, **options):
    out = op.source_divergence(df, **options)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in out.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], SCHEMA)


def test_same_as_brute_force(spark):
    import random

    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("wé", "Ab", "zz", "ÄX", "q") for b in ("one", "TWO", "three", "四", "")]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", ".", "7", "!\n"]) for _ in range(rng.randrange(1, 40))), rng.choice(["en", "de", "fr"]), rng.choice(["a", "b", "c", "d"])) for _ in range(150)]
    for least, top in ((10, 10), (25, 2), (10_000, 3)):
        assert found(table(spark, rows), min_docs=least, top=top) == brute(rows, least, top)


def test_odd_rows(spark):
    rows = [(None, None, None), ("", "en", "a"), ("123 ...", "en", "b"), (None, "en", None)] + [("word Word", None, "b")] * 12 + [("same same", "en", "a")] * 10 + [("x" * 300_000 + " y", "en", "c")]
    assert found(table(spark, rows)) == brute(rows)
    assert found(table(spark, rows).limit(0)) == []


def test_hot_group_and_large_counts(spark):
    rows = [("hot word and word", "en", "big")] * 400 + [("cold word", "en", f"s{i}") for i in range(12)]
    assert found(table(spark, rows)) == brute(rows)
    from pyspark.sql import functions as F

    big = spark.range(1).select(op.share(F.lit(9 * 10**17), F.lit(9 * 10**18), F.lit(5)).alias("p")).collect()[0].p
    assert big == 1 + 10**9 * (9 * 10**17 + 2) // (9 * 10**18 + 10)


def test_no_python_in_the_plan(spark):
    plan = op.source_divergence(table(spark, [("a b", "en", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))
