"""Line deduplication by content-defined chunks of lines, in DataFrame functions only.

A text is its lines. Rolling hashes over WINDOW line hashes choose chunk boundaries (one place in
``divisor``), so that boundaries depend on nearby content and survive shifts. Chunks of two or more lines, not
all blank, that occur again anywhere in the corpus are removed after byte comparison; the first occurrence
(smallest doc_id, then place) stays.

A repeated passage may hold no whole chunk. So, where ``passage_words`` is given, the lines of any passage of
``passage_words`` words or more that occurs before go as well, whatever its chunks. Its units are determined by
content too: from each line the shortest run of lines ahead that has so many words, and the shortest one back. A
repeated passage is covered by such runs that lie inside it, and only a repeated passage has repeated runs. A run
has ``passage_words`` lines at most, since an empty line counts as a word.

1. Every unit (chunk or run) is hashed; only hashes are shuffled and counted.
2. Hashes seen twice make a Bloom filter of ``bits_per_hash`` bits each. Up to ``max_words`` words (16 bytes each) it
   is broadcast, the texts are read again where they lie and the units that pass are taken out of them. Beyond, the
   hashes seen twice meet the units' hashes and places by a shuffle, and the places found go back to their
   texts, each of which then moves once.
3. Only units seen twice move with their content, grouped by hash and SHA-256. The smallest and largest text of
   a group are compared: equal means all are.
4. The removed line numbers of a document come back to it: broadcast up to ``max_bytes``, joined by shuffle
   beyond. Documents that lose nothing are not touched.

Defined cases: a null text stays null and has no lines; rows equal in doc_id and text count as one
document and fare alike; a null doc_id sorts first; an empty table gives an empty result; other
columns are carried through, whatever their names. A document may lose all its lines: it stays with
an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm._common import TMP, materialize
from emberline.llm.exact_dedup import filter_words, mask_of

WINDOW = 2
#: Kinds of units.
CHUNK, RUN = range(2)
KEY, TEXT, GONE = TMP + "key", TMP + "text", TMP + "gone"
_UNITS = "array<struct<kind:int,start:int,end:int>>"


def _words(line: Column) -> Column:
    """Blanks in a line plus one."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1


def _unit(kind: int, start: Column, end: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))


def _runs(passage_words: int) -> list[Column]:
    """Arrays of units, from the columns words and last: runs ahead, runs back, runs of two lines and of one."""
    at = lambda column, i: F.get(F.col(column), i)
    every = F.sequence(F.lit(0), F.col("last"))

    def reach(words: Column) -> Column:
        """How many of the words' lines it takes to passage_words, and their words."""
        return F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(0).alias("total")), lambda s, x: F.when(s["total"] < passage_words, F.struct((s["n"] + 1).alias("n"), (s["total"] + x).alias("total"))).otherwise(s))

    def runs(next_to, words_from, start, end, more) -> Column:
        # Most lines reach it alone or with their neighbour: nothing is added up for them.
        short = F.filter(every, lambda i: at("words", i) + F.coalesce(at("words", next_to(i)), F.lit(0)) < passage_words)
        reached = F.transform(short, lambda i: F.struct(i.alias("i"), reach(words_from(i)).alias("r")))
        reached = F.filter(reached, lambda x: (x["r"]["total"] >= passage_words) & more(x))
        return F.transform(reached, lambda x: F.struct(F.lit(RUN).alias("kind"), start(x).alias("start"), end(x).alias("end")))

    ahead = runs(lambda i: i + 1, lambda i: F.slice("words", i + 1, passage_words), lambda x: x["i"], lambda x: x["i"] + x["r"]["n"] - 1, lambda x: F.lit(True))
    # A run back that is the shortest ahead too is there already.
    longer = lambda x: x["r"]["total"] - at("words", x["i"]) >= passage_words
    first = lambda i: F.greatest(i - (passage_words - 1), F.lit(0))
    back = runs(lambda i: F.when(i > 0, i - 1), lambda i: F.reverse(F.slice("words", first(i) + 1, i - first(i) + 1)), lambda x: x["i"] - x["r"]["n"] + 1, lambda x: x["i"], longer)
    enough = lambda i: at("words", i) >= passage_words
    alone = F.transform(F.filter(every, enough), lambda i: _unit(RUN, i, i))
    # Neighbours that are enough together, of which one is not so alone, are the shortest run from that one.
    before = lambda i: at("words", F.when(i > 0, i - 1))
    both = F.filter(every, lambda i: (i > 0) & (before(i) + at("words", i) >= passage_words) & ~(enough(i) & (before(i) >= passage_words)))
    return [ahead, back, F.transform(both, lambda i: _unit(RUN, i - 1, i)), alone]


def line_units(docs: DataFrame, doc_id: str, text: str, divisor: int, passage_words: int | None) -> DataFrame:
    """(KEY, doc_id, lines, kind, start, end, h) of every chunk to be considered and every run."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(TEXT)).filter(F.col(TEXT).isNotNull())
    base = base.select("doc_id", F.xxhash64("doc_id", TEXT).alias(KEY), F.split(TEXT, "\n").alias("lines"))
    base = base.withColumns({"hashes": F.transform("lines", lambda x: F.xxhash64(x)), "words": F.transform("lines", _words), "last": F.size("lines") - 1})
    at = lambda column, i: F.get(F.col(column), i)

    def ends(i: Column) -> Column:
        rolled = F.xxhash64(*[F.coalesce(at("hashes", i - k), F.lit(0).cast("long")) for k in range(WINDOW)])
        return (i == F.col("last")) | (F.pmod(rolled, F.lit(divisor)) == 0)

    base = base.withColumn("ends", F.filter(F.sequence(F.lit(0), F.col("last")), ends))
    chunks = F.transform("ends", lambda e, k: _unit(CHUNK, F.when(k == 0, 0).otherwise(F.get("ends", k - 1) + 1), e))
    filled = lambda c: F.exists(F.slice("lines", c["start"] + 1, c["end"] - c["start"] + 1), lambda x: F.trim(x) != "")
    chunks = F.filter(chunks, lambda c: (c["end"] > c["start"]) & filled(c))
    parts = [chunks] + (_runs(passage_words) if passage_words else [])
    units = base.select(KEY, "doc_id", "lines", "hashes", F.explode(F.concat(*[p.cast(_UNITS) for p in parts])).alias("u"))
    own = F.slice("hashes", F.col("u.start") + 1, F.col("u.end") - F.col("u.start") + 1)
    return units.select(KEY, "doc_id", "lines", "u.kind", "u.start", "u.end", F.xxhash64("u.kind", own).alias("h"))


def repeated_units(docs: DataFrame, doc_id: str, text: str, divisor: int, passage_words: int | None, bits_per_hash: int, max_words: int) -> DataFrame:
    """(KEY, doc_id, kind, start, end, h, content) of the units whose hash is, or may be, seen twice."""
    content = F.array_join(F.slice("lines", F.col("start") + 1, F.col("end") - F.col("start") + 1), "\n").alias("content")
    out = [KEY, "doc_id", "kind", "start", "end", "h", content]
    units = line_units(docs, doc_id, text, divisor, passage_words)
    twice = materialize(units.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    words = filter_words(twice.count(), bits_per_hash)
    if words <= max_words:
        bits = twice.groupBy(F.pmod("h", F.lit(words)).alias("word")).agg(F.bit_or(mask_of(F.col("h"))).alias("bits"))
        passed = units.withColumn("word", F.pmod("h", F.lit(words))).join(F.broadcast(bits), "word")
        return passed.filter(F.col("bits").bitwiseAND(mask_of(F.col("h"))) == mask_of(F.col("h"))).select(out)
    places = units.drop("lines").join(twice, "h").groupBy(KEY, "doc_id").agg(F.collect_set(F.struct("kind", "start", "end", "h")).alias("places"))
    places = materialize(places.select(F.col(KEY).alias(KEY + "2"), "places"))
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(TEXT)).withColumn(KEY, F.xxhash64("doc_id", TEXT)).filter(F.col(TEXT).isNotNull())
    found = keyed.join(places, F.col(KEY) == F.col(KEY + "2")).select(KEY, "doc_id", F.split(TEXT, "\n").alias("lines"), F.explode("places").alias("p"))
    return found.select(KEY, "doc_id", "lines", "p.kind", "p.start", "p.end", "p.h").select(out)


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", divisor: int = 4, passage_words: int | None = None, bits_per_hash: int = 16, max_words: int = 1 << 21) -> DataFrame:
    """(KEY, GONE: the sorted line numbers that go) of the documents that lose lines."""
    found = repeated_units(docs, doc_id, text, divisor, passage_words, bits_per_hash, max_words)
    found = materialize(found.withColumn("sha", F.unhex(F.sha2("content", 256))))
    place = F.struct("doc_id", KEY, "start")
    # Two texts of one SHA-256 would differ in their smallest and largest.
    # They are written, so that the join reads plain shuffles and a hot unit's can be split.
    groups = materialize(
        found.groupBy("h", "sha", "kind").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.min("content").alias("least"), F.max("content").alias("most"))
        .filter("n > 1 AND least = most").select("h", "sha", "kind", "first")
    )
    later = found.drop("content").join(groups, ["h", "sha", "kind"]).filter(place != F.col("first"))
    lines = later.select(KEY, F.explode(F.sequence("start", "end")).alias("line")).distinct()
    return materialize(lines.groupBy(KEY).agg(F.array_sort(F.collect_list("line")).alias(GONE)))


def _left(lines: Column) -> Column:
    """The lines that stay, in time linear in their number."""
    return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(GONE)), lambda i: F.get(lines, i)), "\n")


def _with_gone(keyed: DataFrame, gone: DataFrame, max_bytes: int) -> DataFrame:
    size = gone.agg(F.sum(4 * F.size(GONE) + 32)).first()[0] or 0
    return keyed.join(F.broadcast(gone) if size <= max_bytes else gone, KEY, "left")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bytes: int = 32 << 20, **options) -> DataFrame:
    """docs with the repeated passages taken out of the text."""
    keyed = docs.withColumn(KEY, F.xxhash64(F.col(doc_id).cast("long"), F.col(text)))
    joined = _with_gone(keyed, removed_lines(docs, doc_id, text, **options), max_bytes)
    return joined.withColumn(text, F.when(F.col(GONE).isNull(), F.col(text)).otherwise(_left(F.split(F.col(text), "\n")))).select(docs.columns)


def line_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bytes: int = 32 << 20, **options) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, removed (line numbers, comma-joined), text_sha256 of what stays."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(TEXT)).withColumn(KEY, F.xxhash64("doc_id", TEXT))
    joined = _with_gone(rows, removed_lines(docs, doc_id, text, **options), max_bytes)
    lost = F.coalesce(GONE, F.array().cast("array<int>"))
    left = F.when(F.col(GONE).isNull(), F.col(TEXT)).otherwise(_left(F.split(TEXT, "\n")))
    lines = F.when(F.col(TEXT).isNull(), 0).otherwise(F.size(F.split(TEXT, "\n")))
    return joined.select("doc_id", lines.cast("long").alias("n_lines"), F.size(lost).cast("long").alias("n_removed"), F.array_join(lost.cast("array<string>"), ",").alias("removed"), F.sha2(F.coalesce(left, F.lit("")), 256).alias("text_sha256"))
