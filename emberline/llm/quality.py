"""Quality classifier: a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers vote on each document, for two faults: *junk* (symbol noise,
shouting, tables of words, stuttering) and *toxic* (words that the labelled sample ties to
toxicity). A labeller votes 1, 0 or abstains. Expectation-maximisation over the counts of vote
patterns in all documents estimates the share of faulty documents and each labeller's accuracy on
faulty and on sound ones; it gives each pattern a posterior. The posteriors of a bounded sample
(``max_labelled`` labelled rows and ``max_unlabelled`` others, the smallest hashes of doc_id) train
a logistic scorer over hashed word features, the measures and the labellers' votes, which alone then judges every document.

The curated labels are labellers too, in the counts of all documents: they abstain where a document
has none. Their votes join the documents' by id after the texts are read.

Bounds: the sample and its distinct word features go to the driver (about 6 KB a document); vote
patterns number at most 3 ** labellers; the scorer has at most ``max_features`` weights and is
broadcast. The judging pass reads each document where it lies: nothing is shuffled. The voting pass
shuffles ids and vote patterns, to meet the labels.

Defined cases: null and empty texts have no words, so no labeller votes 1 and they are accepted;
repeated rows are judged each; repeated labels count once, the larger value winning; empty or
missing labels leave the heuristics alone; an empty documents table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm._common import MEMO_LIMIT, TMP, utf8

FAULTS = ("junk", "toxic")
#: Feature ids lie in 0 .. 2 ** 24; the first RESERVED are the dense measures' steps and the labellers' votes.
DIMENSIONS, RESERVED = 1 << 24, 80
#: Words of a window of sameness, and what stands in for evidence where a text is short.
SAME_WINDOW, PRIOR = 200, 5.0
_SPAN = DIMENSIONS - RESERVED - 1
#: Runs of these are noise: for each, the table that makes them # and all else a blank.
_MARKS = {chars: bytes(35 if c in chars else 32 for c in range(256)) for chars in (b"#$%&*@^~=<>\\_", b"!", b"?")}
_EDGES = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())

#: Labellers of each fault: (name, measure, votes 1 from here on, what it says below: 0 or nothing).
#: Most junk labellers know one kind only, so their silence says nothing; the last is the curated one.
LABELLERS = {
    "junk": (("unlike prose", "unlike", 0.5, "0"), ("symbols", "symbols", 0.2, "-"), ("shouting", "capitals", 0.4, "-"), ("table", "bars", 0.15, "-"), ("stutter", "stutter", 0.25, "-"), ("sameness", "sameness", 0.75, "-"), ("curated", "quality", 0.5, "0")),
    "toxic": (("a word", "words", 1, "0"), ("two words", "words", 2, "0"), ("two stems", "stems", 2, "0"), ("four stems", "stems", 4, "0"), ("curated", "toxicity", 0.5, "0")),
}
FLOOR, CEILING = 0.1, 0.05
DENSE = ("symbols", "capitals", "bars", "stutter", "sameness")


def word_features(word: bytes) -> tuple[int, int, int, int]:
    """Ids of the bare word, its stems of four and five bytes, and its tail of symbols."""
    bare = word.strip(_EDGES).lower()
    tail = word[len(word.rstrip(_EDGES)) :] if bare else word
    return (
        RESERVED + 1 + crc32(bare, 1) % _SPAN if bare else RESERVED, RESERVED + 1 + crc32(bare[:4], 4) % _SPAN if len(bare) > 4 else RESERVED,
        RESERVED + 1 + crc32(bare[:5], 5) % _SPAN if len(bare) > 5 else RESERVED, RESERVED + 1 + crc32(tail[-3:], 9) % _SPAN if len(tail) > 1 else RESERVED,
    )


class WordTable(dict):
    """Memo: word -> row of a table with one row of four numbers a distinct word."""

    def __init__(self, row_of):
        super().__init__()
        self.flat, self.row_of = array("d"), row_of

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        self.flat.extend(self.row_of(word))
        return k

    def of(self, words: list[bytes]) -> np.ndarray:
        """The index of each word."""
        if len(self) > MEMO_LIMIT:
            self.clear()
            self.flat = array("d")
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def rows(self, index: np.ndarray) -> np.ndarray:
        """A copy of rows: a view would keep the table from growing."""
        return np.frombuffer(self.flat).reshape(-1, 4)[index] if len(index) else np.zeros((0, 4))


def _runs(raw: bytes, chars: bytes) -> int:
    """How many runs of two or more of these characters there are."""
    marks = b" " + raw.translate(_MARKS[chars])
    return marks.count(b" ##")


def dense(raw: bytes, words: list[bytes]) -> dict[str, float]:
    """Rates, of any length alike: PRIOR sound words stand beside each text's own, so that few words prove little."""
    n = len(words)
    if not n:
        return dict.fromkeys((*DENSE, "unlike"), 0.0)
    letters = sum(map(raw.count, (b"e", b"n", b"r", b"a", b"i"))), sum(map(raw.count, (b"E", b"N", b"R", b"A", b"I")))
    repeats = n - sum(len(set(words[k : k + SAME_WINDOW])) for k in range(0, n, SAME_WINDOW))
    out = {
        "symbols": min(1.0, sum(_runs(raw, chars) for chars in _MARKS) / n),
        "capitals": letters[1] / (sum(letters) + PRIOR),
        "bars": raw.count(b" | ") / n,
        "stutter": sum(map(eq, words, words[1:])) / (n + PRIOR),
        "sameness": repeats / (n + PRIOR),
    }
    # How far the worst measure has come to its labeller's limit.
    out["unlike"] = max(out[m] / least for _, m, least, _ in LABELLERS["junk"][1:-1])
    return out


def steps_of(measures: dict[str, float]) -> list[int]:
    """The dense measures as features: one id for each measure's tenth."""
    return [11 * k + min(10, int(10 * measures[name])) for k, name in enumerate(DENSE)]


def vote_features(measures: dict[str, float]) -> list[int]:
    """The labellers' own votes for a fault as features: one id for each but the curated ones."""
    base = 11 * len(DENSE)
    limits = [(m, least) for fault in FAULTS for _, m, least, _ in LABELLERS[fault][:-1]]
    return [base + k for k, (m, least) in enumerate(limits) if measures[m] >= least]


@dataclass
class Model:
    """What the sample and the vote counts taught."""

    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    bias: np.ndarray = field(default_factory=lambda: np.full(2, -4.0))
    posteriors: dict = field(default_factory=dict)
    accuracies: dict = field(default_factory=dict)

    def rows(self):
        """row_of(word) -> (junk weight, toxic weight, in the lexicon, stem in the lexicon)."""
        weights = {i: w for i, w in zip(self.ids.tolist(), self.weights.tolist())}
        lexicon, none = set(self.lexicon.tolist()), (0.0, 0.0)

        def row_of(word: bytes) -> tuple[float, float, bool, bool]:
            a, b, c, d = word_features(word)
            (j1, t1), (j2, t2), (j3, t3), (j4, t4) = weights.get(a, none), weights.get(b, none), weights.get(c, none), weights.get(d, none)
            return j1 + j2 + j3 + j4, t1 + t2 + t3 + t4, a in lexicon, b in lexicon or c in lexicon

        return row_of

    def judge(self, texts: list[str | None], table: WordTable) -> list[tuple[np.ndarray, dict[str, float]]]:
        """For each text the two scores and the measures."""
        fixed = {i: w for i, w in zip(self.ids.tolist(), self.weights) if i < RESERVED}
        out = []
        for text in texts:
            raw = utf8(text)
            words = raw.split()
            measures, counts = dense(raw, words), Counter(words)
            rows = table.rows(table.of(list(counts)))
            logit = (np.ones(len(rows)) @ rows)[:2] + self.bias
            # A word that comes twice counts twice.
            measures["words"], measures["stems"] = (np.fromiter(counts.values(), dtype=float, count=len(counts)) @ rows)[2:].tolist()
            if words:
                for step in steps_of(measures) + vote_features(measures):
                    logit = logit + fixed.get(step, 0.0)
            out.append((1 / (1 + np.exp(-np.clip(logit, -30, 30))), measures))
        return out

    def weak(self, measures: dict[str, float]) -> list[float]:
        """The posteriors of the document's own votes, without a curated one."""
        return [self.posteriors.get(f, {}).get(votes(f, measures, None), 0.0) for f in FAULTS]


def model_accepts(scores, threshold: float) -> bool:
    """The scorer finds neither fault."""
    return max(scores) < threshold


def votes(fault: str, measures: dict[str, float], curated: float | None) -> str:
    """One character a labeller: 1, 0, or - where it abstains."""
    value = {**measures, "quality": curated, "toxicity": curated}
    return "".join("-" if (v := value[m]) is None else "1" if v >= least else below for _, m, least, below in LABELLERS[fault])


def estimate(counts: dict[str, float], one_sided: list[bool] | None = None, rounds: int = 50) -> tuple[dict[str, float], float, list[tuple[float, float]]]:
    """(posterior of each pattern, share of faulty, (P(1 | faulty), P(1 | sound)) of each labeller) by EM.

    Of a one-sided labeller, which votes 1 or not at all, only a vote is evidence; its rates are
    over all documents. A labeller is held to FLOOR at least on faulty and to CEILING at most on sound documents. So
    the classes keep their places, and a kind of fault that one labeller alone sees still counts,
    though the others stay silent on it.
    """
    if not counts:
        return {}, 0.0, []
    patterns = list(counts)
    n = np.array([counts[p] for p in patterns], dtype=float)
    v = np.array([[{"1": 1.0, "0": 0.0, "-": np.nan}[c] for c in p] for p in patterns])
    one = np.nan_to_num(v)
    sided = np.array(one_sided if one_sided is not None else [False] * v.shape[1])
    given = ~np.isnan(v) | sided
    post = np.where((one.sum(axis=1) > 0), 0.9, 0.02)
    for _ in range(rounds):
        bad, good = n * post, n * (1 - post)
        share = np.clip(bad.sum() / n.sum(), 1e-6, 1 - 1e-6)
        p = (one.T @ bad + 0.5) / (given.T @ bad + 1)
        q = (one.T @ good + 0.01) / (given.T @ good + 1)
        p, q = np.clip(p, FLOOR, 1 - 1e-3), np.clip(q, 1e-4, CEILING)
        like = lambda r: (given * (one * np.log(r) + ~sided * (1 - one) * np.log(1 - r))).sum(axis=1)
        odds = np.log(share / (1 - share)) + like(p) - like(q)
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return dict(zip(patterns, post.tolist())), float(share), list(zip(p.tolist(), q.tolist()))


@dataclass
class Sample:
    """Feature ids of the sampled rows: flat ids with counts, and the row of each."""

    ids: np.ndarray
    index: np.ndarray
    times: np.ndarray
    row: np.ndarray
    n_rows: int

    @staticmethod
    def of(rows: list[np.ndarray]) -> Sample:
        own = [np.unique(r[r != RESERVED], return_counts=True) for r in rows]
        flat = np.concatenate([u for u, _ in own] or [np.zeros(0, np.int32)]).astype(np.int32)
        times = np.concatenate([c for _, c in own] or [np.zeros(0, np.int64)]).astype(np.float32)
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(u) for u, _ in own])
        ids = np.unique(flat)
        return Sample(ids, np.searchsorted(ids, flat).astype(np.int32), times, row, len(rows))


def train(sample: Sample, target: np.ndarray, max_features: int, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature ids, weights, bias) of a logistic scorer of soft targets.

    Only features whose share differs clearly between faulty and sound rows have a weight, so
    that the many neutral words of a long document add up to nothing.
    """
    ids, n = sample.ids, sample.n_rows
    bad = np.bincount(sample.index, target[sample.row], len(ids))
    seen = np.bincount(sample.index, minlength=len(ids))
    total_bad, total = target.sum(), len(target)
    log_odds = np.log((bad + 0.2) / (total_bad + 0.4)) - np.log((seen - bad + 0.2) / (total - total_bad + 0.4))
    strength = np.where(seen >= 3, np.abs(log_odds) * np.sqrt(np.minimum(bad, 50) + 1), 0)
    chosen = np.flatnonzero((log_odds >= 2.5) & (bad >= 2.5) & (seen >= 3) | (ids < RESERVED))
    if len(chosen) > max_features:
        chosen = np.sort(chosen[np.argsort(-strength[chosen], kind="stable")[:max_features]])
    place = np.full(len(ids), -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    keep = place[sample.index] >= 0
    column, row, times = place[sample.index[keep]], sample.row[keep], sample.times[keep].astype(float)
    w, bias = np.zeros(len(chosen)), -2.0
    g2, b2 = np.full(len(chosen), 1e-3), 1e-3
    for _ in range(rounds):
        z = np.bincount(row, times * w[column], n) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.bincount(column, times * error[row], len(chosen)) + 0.05 * w
        g2 += grad**2
        w -= 0.5 * grad / np.sqrt(g2)
        b2 += error.sum() ** 2
        bias -= 0.5 * error.sum() / np.sqrt(b2)
    return ids[chosen], w, float(bias)


def learn_lexicon(sample: Sample, toxic: np.ndarray, most: int = 4096) -> np.ndarray:
    """Ids of words and stems that labelled toxic rows have and other labelled rows almost never."""
    known = ~np.isnan(toxic)
    toxic = np.where(known, toxic, 0.0)
    if not toxic.sum():
        return np.zeros(0, dtype=np.int64)
    given = known[sample.row] & (sample.ids[sample.index] > RESERVED)
    ids, index, owner = sample.ids, sample.index[given], toxic[sample.row[given]]
    toxic = toxic[known]
    bad, seen = np.bincount(index, owner, len(ids)), np.bincount(index, minlength=len(ids))
    rate, other = bad / toxic.sum(), (seen - bad + 0.1) / (len(toxic) - toxic.sum() + 1)
    # So many toxic rows that chance alone would give about twenty such words of all.
    share = np.clip(toxic.mean(), 1e-3, 0.5)
    least = max(2, int(np.ceil(np.log(max((seen > 0).sum() / 20, 1)) / np.log(1 / share))))
    ok = np.flatnonzero((bad >= least) & (rate >= 25 * other))
    return np.sort(ids[ok[np.argsort(-bad[ok], kind="stable")[:most]]])


def _marked(labels: DataFrame) -> DataFrame:
    """(id, quality, toxic): one row a labelled id."""
    return labels.groupBy(F.col("doc_id").cast("long").alias(TMP + "id")).agg(F.max("quality").cast("double").alias("quality"), F.max("toxic").cast("double").alias("toxic")).filter(F.col(TMP + "id").isNotNull())


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, max_labelled: int, max_unlabelled: int) -> DataFrame:
    """(id, quality, toxic) of the sampled documents: a bounded table."""
    marked = _marked(labels)
    ids = docs.select(F.col(doc_id).cast("long").alias(TMP + "id")).filter(F.col(TMP + "id").isNotNull()).distinct()
    order = [F.xxhash64(TMP + "id"), F.col(TMP + "id")]
    first = marked.join(ids, TMP + "id", "left_semi").orderBy(*order).limit(max_labelled)
    other = ids.join(marked, TMP + "id", "left_anti").orderBy(*order).limit(max_unlabelled)
    return first.unionByName(other.withColumns({"quality": F.lit(None).cast("double"), "toxic": F.lit(None).cast("double")}))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_labelled: int = 3500, max_unlabelled: int = 2000, max_features: int = 20_000) -> Model:
    """The model of docs; labels(doc_id, quality 0/1, toxic 0/1) may be empty."""
    spark = docs.sparkSession
    few = F.broadcast(_sample(docs, labels, doc_id, max_labelled, max_unlabelled))
    own = docs.select(F.col(doc_id).cast("long").alias(TMP + "id"), F.col(text).alias("text")).join(few, TMP + "id").select("text", "quality", "toxic")

    def features(batches: Iterator[pa.RecordBatch]):
        table = WordTable(word_features)
        for batch in batches:
            found, measured, times = [], [], []
            for value in batch.column(0).to_pylist():
                raw = utf8(value)
                words = raw.split()
                measures, counts = dense(raw, words), Counter(words)
                ids = table.rows(table.of(list(counts))).astype(np.int64)
                measured.append([measures[d] for d in (*DENSE, "unlike")])
                found.append(np.concatenate([steps_of(measures) if words else [], ids.ravel()]).astype("<i4").tobytes())
                times.append(np.fromiter(counts.values(), dtype="<u4", count=len(counts)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary()), pa.array(measured, pa.list_(pa.float64())), pa.array(times, pa.binary())], names=["quality", "toxic", "features", "measures", "times"])

    sample = own.mapInArrow(features, "quality double, toxic double, features binary, measures array<double>, times binary").toArrow()
    quality, toxic = (np.array(sample.column(c).to_pylist(), dtype=float) for c in ("quality", "toxic"))
    raw = [np.frombuffer(b, dtype="<i4") for b in sample.column("features").to_pylist()]
    times = [np.frombuffer(b, dtype="<u4").astype(float) for b in sample.column("times").to_pylist()]
    dense_rows = [dict(zip((*DENSE, "unlike"), m)) for m in sample.column("measures").to_pylist()]
    del sample
    features_of = Sample.of(raw)
    lexicon = learn_lexicon(features_of, toxic).astype(np.int64)
    model = Model(lexicon=lexicon)
    held = spark.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]):
        table = WordTable(held.value.rows())
        for batch in batches:
            found = held.value.judge(batch.column(1).to_pylist(), table)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([votes(f, m, None) for _, m in found], pa.string()) for f in FAULTS)], names=[TMP + "id", *FAULTS])

    every = docs.select(F.col(doc_id).cast("long").alias(TMP + "id"), F.col(text).alias("text"))
    # Counted before the join, rows without an id are few, however many they were.
    voted = every.mapInArrow(vote, f"{TMP}id long, junk string, toxic string").groupBy(TMP + "id", *FAULTS).count()
    says = lambda v: F.when(v.isNull() | F.isnan(v), "-").when(v >= 0.5, "1").otherwise("0")
    voted = voted.join(_marked(labels).withColumnRenamed("toxic", "toxic_label"), TMP + "id", "left").select(*FAULTS, "count", says(1 - F.col("quality")).alias("curated_junk"), says(F.col("toxic_label")).alias("curated_toxic"))
    counted = voted.groupBy(*FAULTS, "curated_junk", "curated_toxic").agg(F.sum("count").alias("count")).collect()
    for k, fault in enumerate(FAULTS):
        counts: dict[str, float] = {}
        for row in counted:
            # The curated labeller is the last. A pattern without its vote has a posterior even where every such document is labelled.
            pattern = row[fault][:-1] + row[f"curated_{fault}"]
            counts[pattern] = counts.get(pattern, 0) + row["count"]
            counts.setdefault(row[fault], 0)
        post, share, accuracy = estimate(counts, [below == "-" for *_, below in LABELLERS[fault]])
        model.posteriors[fault] = post
        model.accuracies[fault] = {"share": share, **{name: a for (name, *_), a in zip(LABELLERS[fault], accuracy)}}
    if not raw:
        return model
    for i, (f, m) in enumerate(zip(raw, dense_rows)):
        ids = f[len(DENSE) :].reshape(-1, 4) if len(f) else f.reshape(0, 4)
        known = np.isin(ids, lexicon)
        m["words"], m["stems"] = float(times[i] @ known[:, 0]), float(times[i] @ (known[:, 1] | known[:, 2]))
        raw[i] = np.concatenate([f, np.array(vote_features(m), dtype=np.int32)]) if len(f) else f
    features_of = Sample.of(raw)
    found = []
    for k, fault in enumerate(FAULTS):
        label = (quality, toxic)[k]
        curated = [None if np.isnan(x) else abs(x - (k == 0)) for x in label]
        target = np.array([model.posteriors[fault].get(votes(fault, m, c), 0.0) for m, c in zip(dense_rows, curated)])
        found.append(train(features_of, target, max_features))
    ids = np.union1d(found[0][0], found[1][0])
    weights = np.zeros((len(ids), 2))
    for k, (own_ids, w, b) in enumerate(found):
        weights[np.searchsorted(ids, own_ids), k] = w
        model.bias[k] = b
    model.ids, model.weights = ids, weights
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, junk and toxic scores, weak-label posteriors (no curated vote), accepted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        table = WordTable(held.value.rows())
        for batch in batches:
            found = held.value.judge(batch.column(1).to_pylist(), table)
            weak = [[w[k] for w in map(held.value.weak, (m for _, m in found))] for k in range(len(FAULTS))]
            scores = np.array([s for s, _ in found]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores[:, 0]), pa.array(scores[:, 1]), pa.array(weak[0], pa.float64()), pa.array(weak[1], pa.float64()), pa.array([model_accepts(s, threshold) for s in scores], pa.bool_())],
                names=["doc_id", "junk_score", "toxic_score", "weak_junk", "weak_toxic", "accepted"],
            )

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, junk_score double, toxic_score double, weak_junk double, weak_toxic double, accepted boolean")


def keep_accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the scorer accepts, with all columns."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]):
        table = WordTable(held.value.rows())
        for batch in batches:
            found = held.value.judge(batch.column(at).to_pylist(), table)
            yield batch.filter(pa.array([model_accepts(s, threshold) for s, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
