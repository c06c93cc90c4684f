"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Labels teach a lexicon (words, stems and endings that toxic texts have and others almost never); each text is then
described by a few dense measures: how many and how dense its lexicon hits are, how many come together in a window of words, how
often someone is addressed beside them, capitals, punctuation, and words that are disguised by signs and digits. Boosted trees
judge the measures, and an isotonic fit on rows that the trees have not seen turns their margin into a probability.

Only labelled rows whose crc32(doc_id as text) mod ``folds`` is not ``held_out`` teach anything. Of these at most
``max_labelled`` are taken, the smallest hashes of doc_id, in four parts: a row's hits are counted by a lexicon of the
other three parts, so that the trees meet hits as they are in unseen texts. Trees learn from parts 0 to 2, the isotonic fit from
part 3. Labels, language, source and id of a document are no inputs of its score.

Bounds: texts of the sample stay on the executors; the driver sees at most ``max_terms`` lexicon
terms, and the trees. Scoring reads each text where it lies; nothing of it is shuffled. Lexicon and trees are broadcast: 20,000
terms, 20 trees of depth 3.

Defined cases: null and empty texts are scored like a text without words; a null id is not held out and learns nothing; repeated rows are
scored each; repeated labels count once, the larger value winning; without labels of both kinds every score is the share of
toxic ones (0 without any); texts of any length are read whole, in time linear in their length; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm._common import ALNUM_LOWER, MEMO_LIMIT, TMP, materialize, utf8

PARTS = 4
#: What a word can be, as bits: in the lexicon as a whole, by its stem, by its ending; one that addresses somebody.
WORD, STEM, ENDING, ADDRESS = 1, 2, 4, 8
#: Words that address somebody, in four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch tu toi te ton ta tes vous votre tú ti usted ustedes vos".split()
)
#: Words between a hit and an address; words of the densest window; sound words that stand beside each text's own in a rate.
NEAR, WINDOW, PRIOR = 5, 50, 20.0
FEATURES = (
    "hits", "hit density", "words", "stems", "endings", "agreeing", "agreeing density", "densest window", "distinct",
    "addressed hits", "address density", "capitals", "capital runs", "exclamation", "punctuation", "disguise rate", "disguised hits",
)

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_SIGNS = b"@$!*#|+.-_0123456789"
_CAPITALS = bytes(range(65, 91))
_MARK_CAPITALS = bytes(65 if c in _CAPITALS else 32 for c in range(256))
_MARK_SIGNS = bytes(97 if c in _LETTERS else 35 if c in _SIGNS else 32 for c in range(256))
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Letters with signs before or between them; single letters set apart.
_DISGUISED = re.compile(rb"(?<![A-Za-z\x80-\xff@$0-9])(?:[@$0-9]++[A-Za-z\x80-\xff]++(?:[@$!*#|+.\-_0-9]++[A-Za-z\x80-\xff]++)*|[A-Za-z\x80-\xff]++(?:[@$!*#|+.\-_0-9]++[A-Za-z\x80-\xff]++)+)")
_APART = re.compile(rb"(?<![^\s])(?:[A-Za-z][ .*_\-]){3,}[A-Za-z](?![^\s])")
#: What a sign or digit stands for; the others are left out.
_PLAIN = bytes.maketrans(b"@$!013457", b"asioieast")
_OTHERS = b"*#|+.-_ 2689"


class Flags(dict):
    """Memo: word -> its bits, by the lexicon's terms."""

    def __init__(self, terms: dict[str, frozenset[str]]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: bytes) -> int:
        flags = 0
        for kind, term in terms_of(word):
            if term in self.terms[kind]:
                flags |= {"w": WORD, "s": STEM, "e": ENDING}[kind]
        if word.decode("utf-8", "replace") in SECOND_PERSON:
            flags |= ADDRESS
        if len(self) > MEMO_LIMIT:
            self.clear()
        self[word] = flags
        return flags


def terms_of(word: bytes) -> list[tuple[str, str]]:
    """(kind, term) of a word: itself, its first four and five characters, its last four."""
    w = word.decode("utf-8", "replace")
    out = [("w", w)]
    if len(w) > 4:
        out += [("s", w[:4]), ("e", w[-4:])]
    if len(w) > 5:
        out.append(("s", w[:5]))
    return out


def words_of(raw: bytes) -> list[bytes]:
    """Runs of letters and digits, A-Z in lower case."""
    return raw.translate(ALNUM_LOWER).split()


def undisguised(raw: bytes) -> list[bytes]:
    """Words as they read without the signs and digits put in, A-Z in lower case."""
    found = _DISGUISED.findall(raw) if b"#a" in raw.translate(_MARK_SIGNS) else []
    return [x.translate(_PLAIN, _OTHERS).lower() for x in found + _APART.findall(raw)]


def measure(raw: bytes, flags: Flags) -> list[float]:
    """The FEATURES of a text."""
    words = words_of(raw)
    n = len(words) + PRIOR
    of = np.fromiter(map(flags.__getitem__, words), dtype=np.uint8, count=len(words))
    hidden = undisguised(raw)
    disguised = sum(1 for w in hidden if flags[w] & (WORD | STEM))
    at = np.flatnonzero(of & (WORD | STEM | ENDING))
    hits = of[at]
    word, stem, ending = hits & WORD, (hits & STEM) // STEM, (hits & ENDING) // ENDING
    agree = at[word + stem + ending >= 2]
    together = int((np.searchsorted(agree, agree + WINDOW) - np.arange(len(agree))).max(initial=0))
    address = np.flatnonzero(of & ADDRESS)
    beside = np.searchsorted(address, at + NEAR, "right") - np.searchsorted(address, at - NEAR) if len(at) else at
    size = len(raw) + PRIOR
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return [
        log(1 + len(at) + disguised), len(at) / n, log(1 + int(word.sum())), log(1 + int(stem.sum())), log(1 + int(ending.sum())), log(1 + len(agree) + disguised), (len(agree) + disguised) / n,
        float(together), log(1 + len({words[i] for i in agree})), float((beside > 0).sum()) / (len(at) + 1), len(address) / n, without(_CAPITALS) / (without(_LETTERS) + PRIOR),
        raw.translate(_MARK_CAPITALS).count(b"AA") / n, (raw.count(b"!") + raw.count(b"?")) / n, without(_PUNCTUATION) / size, len(hidden) / n, log(1 + disguised),
    ]


@dataclass
class Model:
    """What the sample taught; without trees every text has the same score."""

    terms: dict[str, frozenset[str]] = field(default_factory=lambda: {"w": frozenset(), "s": frozenset(), "e": frozenset()})
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None
    share: float = 0.0


def is_held_out(doc_id: Column, folds: int, held_out: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == held_out, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, max_labelled: int, folds: int, held_out: int) -> DataFrame:
    """(text, toxic 0/1, part) of the rows that teach, a written table of texts bounded in rows."""
    own = F.col(TMP + "id")
    marked = labels.select(F.col("doc_id").cast("long").alias(TMP + "id"), F.col("toxic").cast("int").alias("toxic")).filter(own.isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(own, folds, held_out))
    marked = marked.groupBy(TMP + "id").agg(F.max("toxic").alias("toxic"))
    known = docs.select(F.col(doc_id).cast("long").alias(TMP + "id")).filter(own.isNotNull()).distinct()
    few = marked.join(known, TMP + "id", "left_semi").orderBy(F.xxhash64(own), own).limit(max_labelled)
    texts = docs.select(F.col(doc_id).cast("long").alias(TMP + "id"), F.col(text).alias("text")).join(F.broadcast(few), TMP + "id")
    return materialize(texts.select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), F.pmod(F.xxhash64(F.lit(1), own), F.lit(PARTS)).cast("int").alias("part")))


def count_terms(sample: DataFrame) -> DataFrame:
    """(kind, term, bad0.., all0..): texts with the term, by part, toxic ones and all; added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]):
        rows: Counter = Counter()
        for batch in batches:
            for text, toxic, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for key in {t for w in set(words_of(utf8(text))) for t in terms_of(w)}:
                    rows[(*key, part, toxic)] += 1
            if len(rows) > MEMO_LIMIT:
                yield out(rows)
                rows.clear()
        yield out(rows)

    def out(rows: Counter) -> pa.RecordBatch:
        kind, term, part, toxic = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(term, pa.string()), pa.array(part, pa.int32()), pa.array(toxic, pa.int32()), pa.array(list(rows.values()), pa.int64())], names=["kind", "term", "part", "toxic", "n"])

    each = sample.select("text", "toxic", "part").mapInArrow(run, "kind string, term string, part int, toxic int, n long")
    total = lambda p, bad: F.sum(F.when((F.col("part") == p) & (F.col("toxic") >= bad), F.col("n")).otherwise(0))
    return each.groupBy("kind", "term").agg(*[total(p, 1).alias(f"bad{p}") for p in range(PARTS)], *[total(p, 0).alias(f"all{p}") for p in range(PARTS)])


def lexicon(rows: list, n_terms: dict[str, int], bad: np.ndarray, every: np.ndarray, without: int | None) -> dict[str, frozenset[str]]:
    """The terms of each kind by all parts but one: in so many toxic texts that chance would give twenty of all terms, and 25 times as often as in others."""
    use = [p for p in range(PARTS) if p != without]
    n_bad, n = int(bad[use].sum()), int(every[use].sum())
    share = min(0.5, max(1e-3, n_bad / max(1, n)))
    found = defaultdict(set)
    for kind, term, *counts in rows:
        have, of = sum(counts[p] for p in use), sum(counts[PARTS + p] for p in use)
        least = max(2, ceil(log(max(1.0, n_terms[kind] / 20)) / log(1 / share)))
        if have >= least and have / n_bad >= 25 * (of - have + 0.1) / (n - n_bad + 1):
            found[kind].add(term)
    return {kind: frozenset(found[kind]) for kind in "wse"}


def learn(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_labelled: int = 8000, max_terms: int = 20_000,
    folds: int = 5, held_out: int = 0, trees: int = 20, depth: int = 3,
) -> Model:
    """The model that labels(doc_id, toxic 0/1) of docs teach."""
    spark = docs.sparkSession
    sample = _sample(docs, labels, doc_id, text, max_labelled, folds, held_out)
    bad, every = np.zeros(PARTS, dtype=int), np.zeros(PARTS, dtype=int)
    for row in sample.groupBy("part").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).collect():
        bad[row.part], every[row.part] = row.bad, row.n
    share = float(bad.sum() / max(1, every.sum()))
    if not 0 < bad[:3].sum() < every[:3].sum():
        return Model(share=share)
    counted = materialize(count_terms(sample))
    n_terms = {r.kind: r["count"] for r in counted.groupBy("kind").count().collect()}
    total = lambda name: sum((F.col(f"{name}{p}") for p in range(1, PARTS)), F.col(f"{name}0"))
    often = (total("bad") >= 2) & (total("bad") / int(bad.sum()) >= 10 * (total("all") - total("bad")) / int(every.sum()))
    rows = counted.filter(often).orderBy(total("bad").desc(), "kind", "term").limit(max_terms).collect()
    by_part = [lexicon(rows, n_terms, bad, every, p) for p in range(PARTS)]
    model = Model(lexicon(rows, n_terms, bad, every, None), share=share)
    held = spark.sparkContext.broadcast(by_part)

    def run(batches: Iterator[pa.RecordBatch]):
        flags = [Flags(terms) for terms in held.value]
        for batch in batches:
            found = [measure(utf8(t), flags[p]) for t, p in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "part", "measures"])

    described = materialize(sample.select("text", "toxic", "part").mapInArrow(run, "toxic int, part int, measures array<double>")).select("toxic", "part", array_to_vector("measures").alias("measures"))
    boosted = GBTClassifier(featuresCol="measures", labelCol="toxic", maxIter=trees, maxDepth=depth, stepSize=0.3, minInstancesPerNode=3, seed=11)
    model.trees = boosted.fit(described.filter("part < 3"))
    if 0 < bad[3] < every[3]:
        rest = model.trees.transform(described.filter("part = 3")).select(_margin().alias("margin"), F.col("toxic").cast("double").alias("toxic"))
        model.calibration = IsotonicRegression(featuresCol="margin", labelCol="toxic").fit(rest)
    return model


def _margin() -> Column:
    return vector_to_array("probability")[1]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", folds: int = 5, held_out: int = 0, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = ["doc_id", is_held_out(F.col("doc_id"), folds, held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")]
    if model.trees is None:
        return own.withColumn("score", F.lit(model.share)).select(out)
    held = docs.sparkSession.sparkContext.broadcast(model.terms)

    def run(batches: Iterator[pa.RecordBatch]):
        flags = Flags(held.value)
        for batch in batches:
            found = [measure(utf8(t), flags) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "measures"])

    described = own.mapInArrow(run, "doc_id long, measures array<double>").select("doc_id", array_to_vector("measures").alias("measures"))
    judged = model.trees.transform(described).select("doc_id", _margin().alias("margin"))
    if model.calibration is None:
        return judged.withColumn("score", F.col("margin")).select(out)
    return model.calibration.transform(judged).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction"))).select(out)
