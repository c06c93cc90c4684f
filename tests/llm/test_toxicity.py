import random
import zlib

import pytest
from pyspark.sql import functions as F

from emberline.llm import toxicity as op

SCHEMA = "doc_id long, text string, score string, predicted int, toxic string"
LABELS = "doc_id long, quality int, toxic int"
BAD = ["grunx", "blorfen", "snarvel", "kruddy"]


def held(i, folds=5):
    return zlib.crc32(str(i).encode()) % folds == 0


def corpus(n=1500, seed=1):
    """Invented words; toxic texts have a few of BAD or of a stem, clean ones never."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(2500)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 300))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randrange(3, 9)):
                words[rng.randrange(len(words))] = rng.choice(BAD) if i % 2 else "quoz" + rng.choice(vocabulary)
        docs.append((i, " ".join(words).capitalize()))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(*d, "x", 7, "y") for d in docs], SCHEMA)
    return df, {i: t for i, _, t in labels}, labels, op.learn(df, spark.createDataFrame(labels, LABELS))


def test_held_out_accuracy(learned):
    df, truth, _, model = learned
    found = op.score(df, model)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == len(truth) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    out = [r for r in rows if r.held_out]
    wrong = [r for r in out if r.predicted != truth[r.doc_id]]
    assert len(out) > 200 and len(wrong) <= 0.02 * len(out), wrong[:5]
    assert sum((r.score - truth[r.doc_id]) ** 2 for r in out) / len(out) < 0.02


def test_held_out_labels_teach_nothing(spark, learned):
    df, _, labels, model = learned
    other = [(i, q, 1 - t if held(i) else t) for i, q, t in labels]
    again = op.learn(df, spark.createDataFrame(other, LABELS))
    assert again.terms == model.terms and again.trees.toDebugString.split("\n", 1)[1] == model.trees.toDebugString.split("\n", 1)[1]


def test_disguises_and_addresses_are_seen(learned):
    model = learned[3]
    flags = op.Flags(model.terms)
    value = lambda text: dict(zip(op.FEATURES, op.measure(text.encode(), flags)))
    assert "grunx" in model.terms["w"] and "quoz" in model.terms["s"]
    assert value("you are g.r.u.n.x")["disguised hits"] > 0 and value("gr*unx")["disguised hits"] > 0 and value("g r u n x here")["disguised hits"] > 0
    assert value("such a grunx you are")["addressed hits"] == 0.5 and value("such a grunx " + "word " * 20 + "you")["addressed hits"] == 0
    assert value("GRUNX grunx quozal")["densest window"] >= 2 and value("AB cd")["capital runs"] > 0
    assert op.undisguised(b"st.up1d s t u p i d $tupid 12 a.b end.") == [b"stupid", b"stupid", b"ab", b"stupid"]


def test_measures_against_a_plain_count():
    rng = random.Random(2)
    terms = {"w": frozenset(BAD), "s": frozenset(["quoz"]), "e": frozenset(["rvel"])}
    for _ in range(60):
        words = [rng.choice(["grunx", "snarvel", "quozzy", "marvel", "you", "plain", "Über", "x"]) for _ in range(rng.randrange(0, 160))]
        got = dict(zip(op.FEATURES, op.measure(" ".join(words).encode(), op.Flags(terms))))
        kinds = [((w in BAD), w.startswith("quoz") and len(w) > 4, w.endswith("rvel") and len(w) > 4) for w in words]
        agree = [i for i, k in enumerate(kinds) if sum(k) > 1]
        hit = [i for i, k in enumerate(kinds) if any(k)]
        assert got["hit density"] == len(hit) / (len(words) + op.PRIOR)
        assert got["densest window"] == max((sum(1 for j in agree if i <= j < i + op.WINDOW) for i in agree), default=0)
        assert got["addressed hits"] == sum(any(words[j] == "you" for j in range(max(0, i - op.NEAR), min(len(words), i + op.NEAR + 1))) for i in hit) / (len(hit) + 1)


def test_odd_rows(spark, learned):
    model = learned[3]
    rows = [(1, None), (2, ""), (3, "..."), (3, "grunx grunx blorfen you"), (None, "grunx"), (4, "a" * 2_000_000), (5, "a.1" * 300_000), (6, "x " * 500_000)]
    df = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA)
    found = op.score(df, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found) and not [r for r in found if r.doc_id is None][0].held_out
    assert op.score(df.limit(0), model).count() == 0
    none = spark.createDataFrame([], LABELS)
    for labels, share in ((none, 0.0), (spark.createDataFrame([(1, 1, 1), (2, 0, 1), (3, None, 1), (None, 1, 0), (4, 1, None)], LABELS), 1.0)):
        one = op.score(df, op.learn(df, labels)).collect()
        assert {r.score for r in one} == {share}
    assert op.score(df.limit(0), op.learn(df.limit(0), none)).count() == 0


def test_repeated_labels_count_once(spark):
    df = spark.createDataFrame([(i, "w", "", 0, "") for i in (1, 1, 2, 3)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 1, 0), (2, 1, 0), (9, 1, 1)], LABELS)
    rows = op._sample(df, labels, "doc_id", "text", 100, 5, 0).groupBy("toxic").count().orderBy("toxic").collect()
    assert [tuple(r) for r in rows] == [(0, 1 - held(2)), (1, 2)][held(2) :]
    assert op._sample(df, labels, "doc_id", "text", 1, 5, 0).select(F.max("part")).first()[0] < op.PARTS
