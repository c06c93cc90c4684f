import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from emberline.llm import lm_score as op

SCHEMA = "doc_id long, text string, score string, n int"


def tokens(text):
    return [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + [0]


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def grams(rows, n):
    out = Counter()
    for _, text in rows:
        t = [1] * (n - 1) + tokens(text)
        for k in range(1, n + 1):
            for i in range(len(t) - k + 1):
                out[tuple(t[i : i + k])] += 1
    return out


def brute(rows, order=2):
    """The same mixture, with EM on unquantised estimates."""

    def model(train):
        c = grams(train, order)
        n = sum(len(tokens(t)) for _, t in train)
        v = len({x for x in c if len(x) == 1 and x != (1,)})

        def f(history, w):
            out, seen = [1 / (v + 1), c[(w,)] / max(n, 1)], n
            for k in range(1, order):
                h = tuple(history[-k:])
                seen = c[h]
                out.append(c[(*h, w)] / seen if seen else 0)
            return out, (1 + int(math.log2(seen)) if seen else 0)

        return f, c, n, v

    f, *_ = model([r for r in rows if fold(r[0]) not in (0, 1)])
    cells = []
    for doc_id, text in rows:
        if fold(doc_id) == 0:
            t = [1] * (order - 1) + tokens(text)
            for i in range(order - 1, len(t)):
                e, b = f(t[:i], t[i])
                cells.append((b, 1, e))
    weights = op.learn_weights(cells, order)
    f, c, n, v = model([r for r in rows if fold(r[0]) != 1])
    out = []
    for doc_id, text in rows:
        t = [1] * (order - 1) + tokens(text)
        score = 0
        for i in range(order - 1, len(t)):
            e, b = f(t[:i], t[i])
            score += math.log10(np.dot(weights[b], e))
        own = tokens(text)
        base = sum(math.log10((c[(w,)] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out.append((doc_id, fold(doc_id) == 1, len(own), sum(c[(w,)] > 0 for w in own), n, base, score))
    return out


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    vocabulary = [f"W{int(rng.paretovariate(0.7))}" for _ in range(300)]
    rows = []
    for i in range(n):
        words, w = [], rng.randrange(300)
        for _ in range(rng.choice([0, 2, 20, 60])):
            w = (w * 7 + rng.randrange(3)) % 300
            words.append(vocabulary[w])
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows


def compare(found, want, tolerance):
    found, want = sorted(map(tuple, found), key=str), sorted(want, key=str)
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(a[6], b[6], rel_tol=tolerance, abs_tol=1e-6)


def test_same_as_brute_force_in_many_chunks(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    for order, chunk in ((2, 200), (3, 500), (1, 10**6)):
        compare(op.lm_scores(df, order=order, chunk_tokens=chunk).collect(), brute(rows, order), 2e-3)


def test_driver_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = op.lm_scores(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    compare(found, brute(rows), 2e-3)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_cases(spark):
    rows = [(1, None), (2, ""), (3, "a " * 100_000), (4, "a"), (4, "a"), (None, "b"), (5, " \n "), (9, "é É a")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    compare(op.lm_scores(df, chunk_tokens=50).collect(), brute(rows), 1e-2)
    assert op.lm_scores(df.limit(0)).collect() == []
    alone = [i for i in range(100) if fold(i) == 1][:3]
    only_test = spark.createDataFrame([(i, "a b", "", 1) for i in alone], SCHEMA)
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in op.lm_scores(only_test).collect())


def test_counts_round_trip():
    for values in ([], [0, 1, 254, 255, 256, 10**12], [7] * 1000):
        values = np.array(values, dtype=np.int64)
        assert (op.counts_in(op.counts_out(values), len(values)) == values).all()
