"""Language-model scoring by deleted interpolation.

The probability of a token is a mixture of the maximum-likelihood estimates of all orders and
of a uniform one over the known tokens and one unknown:

    P(w | u) = l2 * c(u w) / c(u) + l1 * c(w) / N + l0 / (V + 1)        (order 2)

The weights depend on the bucket of the context's frequency and are learned by expectation-
maximisation on counts held out of the training documents (the *deleted* part): there, the
estimates come from the other training documents only. The final counts use all of them.

Everything is gathered from the whole corpus and nothing per corpus is held by one task or the
driver. Documents are tokenized once into chunks of about ``chunk_tokens`` tokens, written to the
shared folder. Each chunk asks for the counts of its distinct n-grams: one message per bucket of
hashes with keys and own counts, so a frequent n-gram moves once a chunk however often it
occurs. A bucket adds the counts up and answers each chunk with the totals of its own keys. The
driver sees N, V and a table of quantised estimates of bounded size, on which it runs EM.

n-grams are known by 63-bit hashes; two with one hash are taken as one.

Defined cases: a null text is empty and has the end token alone; a null doc_id hashes as empty
text to its fold; repeated rows are scored and counted each; without training documents the
model is uniform; an empty table gives no rows. Columns besides id and text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm._common import ASCII_LOWER, WordHash, materialize, n_shuffle, utf8

#: These hold a space, so no word has their hash by content.
END = xxhash.xxh64_intdigest(b" end ") >> 1
START = xxhash.xxh64_intdigest(b" start ") >> 1
FOLDS, TEST, DELETED = 5, 1, 0
#: Steps per decade in the table of quantised estimates that EM runs on.
STEPS = 8
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_CHUNKS = "chunk long, deleted boolean, doc_ids array<long>, folds binary, lengths binary, words binary, tokens binary"


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


def _squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _open(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def counts_out(values: np.ndarray) -> bytes:
    """Counts in few bytes: a byte each, 255 for those that follow as 8 bytes."""
    large = values[values >= 255]
    return _squeeze(np.concatenate([np.minimum(values, 255).astype(np.uint8), large.astype("<i8").view(np.uint8)]))


def counts_in(blob: bytes, n: int) -> np.ndarray:
    raw = _open(blob, np.uint8)
    out = raw[:n].astype(np.int64)
    out[out == 255] = np.frombuffer(raw[n:].tobytes(), dtype="<i8")
    return out


def sorted_out(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, byte by byte."""
    gaps = np.diff(keys.astype("<u8"), prepend=np.uint64(0))
    return _squeeze(gaps.view(np.uint8).reshape(-1, 8).T)


def sorted_in(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_open(blob, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def chunks(docs: DataFrame, chunk_tokens: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The written table of tokenized chunks; deleted training documents have chunks of their own."""

    def rows(held) -> pa.RecordBatch:
        deleted, docs_ = held
        words, tokens = np.unique(np.concatenate([h for _, _, h in docs_]), return_inverse=True)
        values = [
            pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([deleted]), pa.array([[d for d, _, _ in docs_]], pa.list_(pa.int64())),
            pa.array([_squeeze(np.array([f for _, f, _ in docs_], dtype=np.uint8))], pa.binary()), pa.array([_squeeze(np.array([len(h) for _, _, h in docs_], dtype="<i4"))], pa.binary()),
            pa.array([sorted_out(words)], pa.binary()), pa.array([_squeeze(tokens.astype("<i4").view(np.uint8).reshape(-1, 4).T)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(values, names=["chunk", "deleted", "doc_ids", "folds", "lengths", "words", "tokens"])

    def tokenize(batches: Iterator[pa.RecordBatch]):
        memo = WordHash()
        held: dict[bool, list] = {True: [], False: []}
        size = {True: 0, False: 0}
        for batch in batches:
            for key, fold, content in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.append(memo.of(utf8(content).translate(ASCII_LOWER).split()), END)
                kind = fold == DELETED
                held[kind].append((key, fold, own))
                size[kind] += len(own)
                if size[kind] >= chunk_tokens:
                    yield rows((kind, held[kind]))
                    held[kind], size[kind] = [], 0
        for kind, rest in held.items():
            if rest:
                yield rows((kind, rest))

    fold = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(FOLDS)).cast("int")
    return materialize(docs.select(F.col(doc_id).cast("long"), fold, F.col(text)).mapInArrow(tokenize, _CHUNKS))


@dataclass
class Grams:
    """The n-grams of a chunk: sorted distinct keys, and per order the key of each place.

    Each document is preceded by order - 1 start marks. Of a key the lowest bit says that it is
    a token of the vocabulary. ``at[k - 1][p]`` is the index of the k-gram that ends at place p,
    or -1 where there are not so many tokens; ``real`` are the places that hold tokens.
    """

    keys: np.ndarray
    at: list[np.ndarray]
    real: np.ndarray
    lengths: np.ndarray
    folds: np.ndarray

    @staticmethod
    def of(folds: bytes, lengths: bytes, words: bytes, tokens: bytes, order: int) -> Grams:
        lengths, folds = _open(lengths, "<i4").astype(np.int64), _open(folds, np.uint8)
        own = sorted_in(words)
        index = np.ascontiguousarray(_open(tokens, np.uint8).reshape(4, -1).T).view("<i4").ravel()
        total = int(lengths.sum()) + (order - 1) * len(lengths)
        stream = np.full(total, START, dtype=np.uint64)
        begin = np.cumsum(lengths + order - 1) - lengths - (order - 1)
        place = np.arange(total) - np.repeat(begin, lengths + order - 1)
        real = np.flatnonzero(place >= order - 1)
        stream[real] = own[index]
        mixed = _mix(stream)
        whole = [(mixed & ~np.uint64(1)) >> np.uint64(1)]
        whole[0] = (whole[0] | np.uint64(1)) if order == 1 else np.where(place >= order - 1, whole[0] | np.uint64(1), whole[0] & ~np.uint64(1))
        with np.errstate(over="ignore"):
            for _ in range(1, order):
                longer = np.zeros(total, dtype=np.uint64)
                longer[1:] = _mix(whole[-1][:-1] * _A + mixed[1:]) >> np.uint64(1) & ~np.uint64(1)
                whole.append(longer)
        valid = [place >= k for k in range(order)]
        keys, inverse = np.unique(np.concatenate([w[v] for w, v in zip(whole, valid)]), return_inverse=True)
        at, used = [], 0
        for v in valid:
            a = np.full(total, -1, dtype=np.int64)
            n = int(v.sum())
            a[v] = inverse[used : used + n]
            used += n
            at.append(a)
        return Grams(keys, at, real, lengths, folds)

    def training_counts(self) -> np.ndarray:
        """Of each key, over the documents not of the test fold."""
        train = np.repeat(self.folds != TEST, self.lengths + (len(self.at) - 1))
        out = np.zeros(len(self.keys), dtype=np.int64)
        for a in self.at:
            out += np.bincount(a[train & (a >= 0)], minlength=len(self.keys))
        return out

    def cuts(self, buckets: int) -> np.ndarray:
        """Where each bucket of keys begins, and the end."""
        bucket = (self.keys >> np.uint64(31)) * np.uint64(buckets) >> np.uint64(32)
        return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def _requests(order: int, buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams.of(row["folds"], row["lengths"], row["words"], row["tokens"], order)
                counts, cut = grams.training_counts(), grams.cuts(buckets)
                used = np.flatnonzero(np.diff(cut))
                for part in np.array_split(used, max(1, len(grams.keys) // 250_000)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part.astype(np.int32)), pa.array(np.full(len(part), row["chunk"])), pa.array(np.full(len(part), row["deleted"])),
                            pa.array([sorted_out(grams.keys[cut[b] : cut[b + 1]]) for b in part], pa.binary()),
                            pa.array([counts_out(counts[cut[b] : cut[b + 1]]) for b in part], pa.binary()),
                        ],
                        names=["bucket", "chunk", "deleted", "keys", "counts"],
                    )

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """Totals of a bucket's keys for each chunk that asked; types: the bucket's training vocabulary."""
    keys = [sorted_in(k) for k in table.column("keys").to_pylist()]
    counts = [counts_in(c, len(k)) for c, k in zip(table.column("counts").to_pylist(), keys)]
    deleted = table.column("deleted").to_numpy(zero_copy_only=False)
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    weights = np.concatenate(counts)
    every = np.bincount(inverse, weights, len(distinct)).astype(np.int64)
    kept = np.bincount(inverse, weights * ~np.repeat(deleted, [len(k) for k in keys]), len(distinct)).astype(np.int64)
    places = np.split(inverse, np.cumsum([len(k) for k in keys])[:-1])
    vocabulary = (distinct & np.uint64(1)).astype(bool)
    types = [int((vocabulary & (x > 0)).sum()) for x in (every, kept)]
    first = np.zeros(len(table), dtype=np.int64)
    first[0] = 1
    return pa.table({
        "bucket": table.column("bucket"), "chunk": table.column("chunk"), "deleted": table.column("deleted"),
        "every": pa.array([counts_out(every[p]) for p in places], pa.binary()),
        "kept": pa.array([counts_out(kept[p]) if d else b"" for p, d in zip(places, deleted)], pa.binary()),
        "types": pa.array(first * types[0]), "kept_types": pa.array(first * types[1]),
    })


def _totals(replies: pa.Table, column: str, grams: Grams, buckets: int) -> np.ndarray:
    """The answers put together in the order of the chunk's keys."""
    cut = grams.cuts(buckets)
    out = np.zeros(len(grams.keys), dtype=np.int64)
    for b, blob in zip(replies.column("bucket").to_pylist(), replies.column(column).to_pylist()):
        out[cut[b] : cut[b + 1]] = counts_in(blob, int(cut[b + 1] - cut[b]))
    return out


def estimates(grams: Grams, totals: np.ndarray, n: int, types: int) -> tuple[np.ndarray, np.ndarray]:
    """(places x orders of maximum-likelihood estimates, uniform first; bucket of each context)."""
    order, real = len(grams.at), grams.real
    out = np.empty((len(real), order + 1))
    out[:, 0] = 1 / (types + 1)
    out[:, 1] = totals[grams.at[0][real]] / max(n, 1)
    context = np.full(len(real), n, dtype=np.int64)
    for k in range(1, order):
        seen = totals[grams.at[k - 1][real - 1]]
        out[:, k + 1] = np.divide(totals[grams.at[k][real]], seen, out=np.zeros(len(real)), where=seen > 0)
        context = seen
    return out, bucket_of(context)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2 of its frequency)."""
    return np.where(context > 0, 1 + np.log2(np.maximum(context, 1)).astype(np.int64), 0)


def learn_weights(cells: list[tuple[int, float, list[float]]], order: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (bucket x order + 1) by EM; cells: (bucket, tokens, their mean estimates)."""
    weights = np.tile([0.1, *[0.9 / order] * order], (64, 1))
    if not cells:
        return weights
    buckets, n = np.array([c[0] for c in cells]), np.array([c[1] for c in cells], dtype=float)
    f = np.array([c[2] for c in cells])
    for _ in range(rounds):
        share = weights[buckets] * f
        share *= (n / share.sum(axis=1))[:, None]
        total = np.zeros_like(weights)
        np.add.at(total, buckets, share)
        total += np.array([0.1, *[0.9 / order] * order])  # one token's worth keeps every weight above 0
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = 2, chunk_tokens: int = 400_000, bucket_tokens: int = 2_000_000) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A task holds one chunk, or the distinct keys that all chunks have in one bucket (at most as many
    as bucket_tokens tokens have); larger buckets make fewer messages between the two.
    """
    spark = docs.sparkSession
    table = chunks(docs, chunk_tokens, doc_id, text)

    def sizes(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths, train = _open(row["lengths"], "<i4"), _open(row["folds"], np.uint8) != TEST
                n = int(lengths[train].sum())
                yield pa.RecordBatch.from_pydict({"tokens": [int(lengths.sum())], "n": [n], "kept": [0 if row["deleted"] else n]})

    total = table.select("deleted", "folds", "lengths").mapInArrow(sizes, "tokens long, n long, kept long").agg(F.sum("tokens"), F.sum("n"), F.sum("kept")).first()
    tokens, n, n_kept = (x or 0 for x in total)
    buckets = max(n_shuffle(spark), -(-tokens // bucket_tokens))
    asked = table.select("chunk", "deleted", "folds", "lengths", "words", "tokens").mapInArrow(_requests(order, buckets), "bucket int, chunk long, deleted boolean, keys binary, counts binary")
    answers = materialize(asked.groupBy("bucket").applyInArrow(_answer, "bucket int, chunk long, deleted boolean, every binary, kept binary, types long, kept_types long"))
    v, v_kept = (x or 0 for x in answers.agg(F.sum("types"), F.sum("kept_types")).first())

    def deleted_cells(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        grams = Grams.of(row["folds"], row["lengths"], row["words"], row["tokens"], order)
        f, bucket = estimates(grams, _totals(right, "kept", grams, buckets), n_kept, v_kept)
        steps = np.where(f[:, 1:] > 0, np.round(np.log10(np.maximum(f[:, 1:], 1e-30)) * STEPS), -9999).astype(np.int64)
        cell, inverse = np.unique(np.column_stack([bucket, steps]), axis=0, return_inverse=True)
        inverse = inverse.ravel()
        sums = [np.bincount(inverse, f[:, k], len(cell)) for k in range(order + 1)]
        return pa.table({"cell": pa.array(cell.tolist(), pa.list_(pa.int64())), "n": np.bincount(inverse, minlength=len(cell)), "f": pa.array(np.column_stack(sums).tolist(), pa.list_(pa.float64()))})

    held = table.filter("deleted")
    found = held.groupBy("chunk").cogroup(answers.filter("deleted").select("bucket", "chunk", "kept").groupBy("chunk")).applyInArrow(deleted_cells, "cell array<long>, n long, f array<double>")
    # At most 64 buckets and 30 * STEPS steps an order, whatever the corpus.
    cells = found.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("f")[k]) for k in range(order + 1)]).alias("f")).collect()
    weights = learn_weights([(r.cell[0], r.n, [x / r.n for x in r.f]) for r in cells], order)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        grams = Grams.of(row["folds"], row["lengths"], row["words"], row["tokens"], order)
        totals = _totals(right, "every", grams, buckets)
        f, bucket = estimates(grams, totals, n, v)
        start = np.cumsum(grams.lengths) - grams.lengths
        count = totals[grams.at[0][grams.real]]
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": grams.folds == TEST, "n_tokens": grams.lengths,
            "n_known": np.add.reduceat((count > 0).astype(np.int64), start), "train_tokens": np.full(len(start), n),
            "base_score": np.add.reduceat(base, start), "score": np.add.reduceat(np.log10((f * weights[bucket]).sum(axis=1)), start),
        })

    return table.groupBy("chunk").cogroup(answers.select("bucket", "chunk", "every").groupBy("chunk")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
