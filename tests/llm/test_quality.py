import random

import numpy as np
import pytest

from emberline.llm import quality as op

SCHEMA = "doc_id long, text string, accepted string, quality int"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    bad_words = ["grunx", "blorf", "snarvel", "kruddy"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 200))]
        junk, toxic = rng.random() < 0.12, rng.random() < 0.12
        if toxic and not junk:
            for _ in range(rng.randrange(3, 8)):
                words[rng.randrange(len(words))] = rng.choice(bad_words) + rng.choice(["", "", "ish", "ers"])
        toxic &= not junk
        if junk:
            words = rng.choice([lambda: [w + "%%%" for w in words], lambda: [w.upper() + "!!" for w in words], lambda: " | ".join(words).split(), lambda: [w for w in words[:8] for _ in range(12)]])()
        docs.append((i, " ".join(words).capitalize() if not junk else " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(*d, "x", 7) for d in docs], SCHEMA)
    seen = [x for x in labels if x[0] % 3]
    marks = spark.createDataFrame(seen, LABELS)
    return df, dict((d, (q, t)) for d, q, t in labels), op.learn(df, marks)


def test_held_out_accuracy(learned):
    df, truth, model = learned
    found = {r.doc_id: r for r in op.score(df, model).collect()}
    held = [d for d in truth if d % 3 == 0]
    wrong = [d for d in held if found[d].accepted != (truth[d] == (1, 0))]
    assert len(wrong) <= 0.02 * len(held), wrong[:5]
    kept = op.keep_accepted(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d in truth if found[d].accepted}


def test_accuracies_are_estimated(learned):
    *_, model = learned
    assert 0.08 < model.accuracies["junk"]["share"] < 0.16
    faulty, sound = model.accuracies["toxic"]["two words"]
    assert faulty > 0.7 and sound < 0.02


def test_heuristics_alone_find_junk(spark):
    docs, labels = corpus(600, 2)
    df = spark.createDataFrame([(*d, "x", 7) for d in docs], SCHEMA)
    model = op.learn(df, spark.createDataFrame([], LABELS))
    found = {r.doc_id: r.accepted for r in op.score(df, model).collect()}
    assert sum(found[d] == bool(q) for d, q, _ in labels) >= 0.97 * len(labels)


def test_em_finds_known_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.2
    real = [(0.9, 0.02), (0.6, 0.01), (0.3, 0.03)]
    counts = {}
    for t in truth:
        key = "".join("-" if rng.random() < 0.1 else "1" if rng.random() < (p if t else q) else "0" for p, q in real)
        counts[key] = counts.get(key, 0) + 1
    _, share, found = op.estimate(counts)
    assert abs(share - 0.2) < 0.03 and all(abs(a - b) < 0.07 for x, y in zip(found, real) for a, b in zip(x, y))


def test_odd_cases(spark, learned):
    *_, model = learned
    rows = [(1, None), (2, ""), (1, None), (None, "a b c"), (3, "x " * 300_000), (4, " \n ")]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    found = op.score(df, model).collect()
    assert len(found) == 6 and all(r.accepted for r in found if r.doc_id in (1, 2, 4))
    assert op.score(df.limit(0), model).collect() == [] == op.keep_accepted(df.limit(0), model).collect()
    labels = spark.createDataFrame([(1, None, 0), (1, 1, 0), (None, 0, 1), (77, 0, 1)], LABELS)
    for some in (df, df.limit(0)):
        again = op.learn(some, labels)
        assert len(op.score(df, again).collect()) == 6


def test_every_label_votes_however_small_the_sample(spark):
    docs, labels = corpus(400, 4)
    df = spark.createDataFrame([(*d, "x", 7) for d in docs] + [(None, "no id", "x", 7)] * 3, SCHEMA)
    for marks in (labels, [x for x in labels if x[0] % 2]):
        model = op.learn(df, spark.createDataFrame(marks + marks[:5], LABELS), max_labelled=20, max_unlabelled=5)
        curated, table = {d: (1 - q, t) for d, q, t in marks}, op.WordTable(model.rows())
        for k, fault in enumerate(op.FAULTS):
            counts = {}
            for r in df.collect():
                measures = model.judge([r.text], table)[0][1]
                vote = curated[r.doc_id][k] if r.doc_id in curated else None
                pattern = op.votes(fault, measures, vote)
                counts[pattern] = counts.get(pattern, 0) + 1
                counts.setdefault(op.votes(fault, measures, None), 0)
            post, share, _ = op.estimate(counts, [below == "-" for *_, below in op.LABELLERS[fault]])
            assert model.posteriors[fault].keys() == post.keys()
            assert all(abs(model.posteriors[fault][p] - v) < 1e-6 for p, v in post.items()) and abs(model.accuracies[fault]["share"] - share) < 1e-6
            # Where all are labelled, a document's own votes still have a posterior.
            assert all(op.votes(fault, model.judge([t], table)[0][1], None) in post for _, t in docs)


def test_em_equals_plain_loops():
    from math import exp, log

    rng = random.Random(8)
    for sided in (None, [False, True, False, True]):
        counts = {}
        for _ in range(3000):
            bad = rng.random() < 0.2
            pattern = "".join("-" if s and rng.random() > (0.4 if bad else 0.02) or rng.random() < 0.2 else "1" if s or rng.random() < (0.7 if bad else 0.03) else "0" for s in (sided or [False] * 4))
            counts[pattern] = counts.get(pattern, 0) + 1
        found, share, rates = op.estimate(counts, sided, rounds=7)
        one_sided = sided or [False] * 4
        post = {p: 0.9 if "1" in p else 0.02 for p in counts}
        for _ in range(7):
            bad, total = sum(n * post[p] for p, n in counts.items()), sum(counts.values())
            want = min(max(bad / total, 1e-6), 1 - 1e-6)
            p_, q_ = [], []
            for k in range(4):
                given = [x for x in counts if x[k] != "-" or one_sided[k]]
                ones = [x for x in counts if x[k] == "1"]
                p_.append(min(max((sum(counts[x] * post[x] for x in ones) + 0.5) / (sum(counts[x] * post[x] for x in given) + 1), op.FLOOR), 1 - 1e-3))
                q_.append(min(max((sum(counts[x] * (1 - post[x]) for x in ones) + 0.01) / (sum(counts[x] * (1 - post[x]) for x in given) + 1), 1e-4), op.CEILING))
            for x in counts:
                odds = log(want / (1 - want))
                for k, c in enumerate(x):
                    odds += log(p_[k] / q_[k]) if c == "1" else log((1 - p_[k]) / (1 - q_[k])) if c == "0" and not one_sided[k] else 0.0
                post[x] = 1 / (1 + exp(-max(-50, min(50, odds))))
        assert abs(share - want) < 1e-9 and all(abs(found[x] - post[x]) < 1e-9 for x in counts)
        assert all(abs(a - c) < 1e-9 and abs(b - d) < 1e-9 for (a, b), c, d in zip(rates, p_, q_))


def test_scorer_equals_plain_sums(spark, learned):
    from collections import Counter
    from math import exp

    df, _, model = learned
    weights = {i: w for i, w in zip(model.ids.tolist(), model.weights.tolist())}
    lexicon = set(model.lexicon.tolist())
    rows = df.limit(200).collect() + spark.createDataFrame([(1, " ".join(f"w{k % 300}" for k in range(5000)), "x", 7), (2, "a b", "x", 7)], SCHEMA).collect()
    found = model.judge([r.text for r in rows], op.WordTable(model.rows()))
    for r, (scores, measures) in zip(rows, found):
        words = r.text.encode().split()
        n, repeats = len(words), sum(len(w) - len(set(w)) for w in (words[k : k + op.SAME_WINDOW] for k in range(0, len(words), op.SAME_WINDOW)))
        assert abs(measures["sameness"] - repeats / (n + op.PRIOR)) < 1e-12
        assert abs(measures["stutter"] - sum(a == b for a, b in zip(words, words[1:])) / (n + op.PRIOR)) < 1e-12
        assert measures["words"] == sum(c for w, c in Counter(words).items() if op.word_features(w)[0] in lexicon)
        features = [f for w in set(words) for f in op.word_features(w)] + op.steps_of(measures) + op.vote_features(measures)
        for k in range(2):
            logit = model.bias[k] + sum(weights[f][k] for f in features if f in weights)
            assert abs(scores[k] - 1 / (1 + exp(-max(-30, min(30, logit))))) < 1e-9
