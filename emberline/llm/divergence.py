"""Source divergence audit: how the words of a source differ from its language and from other sources.

Plain relational work: texts are exploded into their terms, which are counted by (lang, source, term);
each language keeps the terms that occur in at least ``min_docs`` of its documents; its groups, one for each
(lang, source), meet the whole kept vocabulary, so that a term a group lacks counts zero there; a self-join on (lang, term) brings
the groups of a language together, sums compare them and windows rank.

All arithmetic is on whole numbers. With N the group's occurrences of kept terms and V the number of these,
p = 1 + floor(10^9 (count + 2) / (N + 2 V)); q is the same of the language or of another group, and the value of a
term is floor((p - q)^2 / (p + q)). Part ``term``: the ``top`` terms of a group with p over that of the language.
Part ``pair``: every other group of the language with the sum of values over all its kept terms.

What bounds it: counts are combined before they are shuffled, by (lang, source, term), which no hot source or
language gathers in one task. Vocabulary and groups meet on (lang, part of the vocabulary), the groups copied to each of
``PARTS`` parts, since a language alone would be a hot key. The best terms are cut to ``top`` in each task before they
meet. Nothing is broadcast by hand and nothing goes to the driver.

Defined cases: null text, lang and source count as empty; a text without terms still makes its group; a
language without kept terms has pairs of value 0 and no terms; one with a single source has no pairs; a repeated row is one more document; texts of
any length are exploded as a whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm._common import materialize

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000
#: Parts of a vocabulary, so that a large language meets its groups in many tasks.
PARTS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z alone in lower case; a text of ASCII only takes the quick way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, n_docs) of docs(lang, source, text).

    In a sorted array of terms the first of each run stands for its document.
    """
    terms = docs.select("lang", "source", F.sort_array(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0))).alias("terms"))
    first = F.transform("terms", lambda x, i: F.struct(x.alias("term"), F.when((i > 0) & (x == F.get("terms", i - 1)), 0).otherwise(1).alias("first")))
    each = terms.select("lang", "source", F.explode(first).alias("t"))
    return each.groupBy("lang", "source", F.col("t.term").alias("term")).agg(F.count("*").alias("n"), F.sum("t.first").alias("n_docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a term with this count: decimals, so that no product overflows."""
    whole = lambda x: x.cast("decimal(20,0)")
    return (F.floor(F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (whole(count) + 2), whole(total) + whole(terms) * 2)) + 1).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(groups: lang, source; dense: lang, source, term, n, p of the group, q of the language), both written tables."""
    groups = materialize(docs.select("lang", "source").distinct())
    of_term = Window.partitionBy("lang", "term")
    kept = materialize(term_counts(docs).withColumn("docs", F.sum("n_docs").over(of_term)).filter(F.col("docs") >= min_docs).select("lang", "source", "term", "n"))
    vocabulary = kept.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # Every group with its total and what holds for its language; a language without kept terms falls out here.
    known = groups.join(langs, "lang").join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    spread = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    crossed = vocabulary.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")).join(spread, ["lang", "part"])
    counted = crossed.join(kept, ["lang", "source", "term"], "left").na.fill(0, ["n"])
    return groups, materialize(counted.select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("n_lang"), F.col("total_lang"), F.col("v")).alias("q")))


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): the terms that set a source apart, and its distance to each other source of its language."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups, dense = shares(docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text")), min_docs)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    out = ["lang", "source", "part", "item", "value", "rank"]
    found = dense.filter("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    terms = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    # The value is the same from either side: each two groups are compared once.
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other"))
    sums = dense.select("lang", "term", "source", "p").join(other, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(divergence(F.col("p"), F.col("other"))).alias("value"))
    both = materialize(sums)
    both = both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    every = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source != item")
    pairs = every.join(both, ["lang", "source", "item"], "left").na.fill(0, ["value"]).withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
    return pairs.select(out).unionByName(terms.select(out))
