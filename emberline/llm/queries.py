"""The corpus operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import clustering, decontaminate, divergence, exact_dedup, html_text, line_dedup, lm_score, ngram_join, packing, pii, quality, sharding, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    return decontaminate.contamination_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_sharding(spark, sf_dir):
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))


def op4_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark, sf_dir):
    return lm_score.lm_scores(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.best_fit_pack(_table(spark, sf_dir, "documents"))


def op7_pii(spark, sf_dir):
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.copy_groups(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.line_digest(_table(spark, sf_dir, "documents"), passage_words=50)


def op10_html_extraction(spark, sf_dir):
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op11_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op12_centroid_clustering(spark, sf_dir):
    return clustering.cluster(_table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark, sf_dir):
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
k AS (SELECT *, least(13, len(w)) AS k FROM i WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, k, list_slice(w, p, p + k - 1) AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM k)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, k, p, list_slice(w, p, p + k - 1) AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM v) WHERE len(w) >= k)),
h AS (SELECT DISTINCT g.doc_id, g.p, g.k, v.item_id FROM g JOIN v USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS place FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP8_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_SQUARED = "list_sum(list_transform(range(1, 65), lambda j: (v[j] - w[j]) * (v[j] - w[j])))"


def _rounds(k: int, rounds: int, seed: int) -> str:
    """Lloyd's rounds as one table after another: c are centroids, a assignments."""
    out = [
        "e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS w FROM (SELECT v, sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h FROM e ORDER BY h LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        out.append(f"a{n} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, v, c, {_SQUARED} AS d FROM e, c{n}) GROUP BY vec_id)")
        if n < rounds:
            out.append(f"m{n} AS MATERIALIZED (SELECT c, list(CAST(floor_sum AS BIGINT) ORDER BY j) AS w FROM (SELECT c, j, (sum(v[j]) - ((sum(v[j]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum FROM a{n}, range(1, 65) AS r(j) GROUP BY c, j) GROUP BY c)")
            out.append(f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m{n}.w, c{n}.w) AS w FROM c{n} LEFT JOIN m{n} USING (c))")
    return ",\n".join(out)


OP12_SQL = f"""
WITH {_rounds(8, 10, 3)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a10 JOIN c10 USING (c)
"""

OP13_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
o AS MATERIALIZED (SELECT r, lang, source, unnest(t) AS term FROM d),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS MATERIALIZED (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
s AS MATERIALIZED (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (coalesce(s.total, 0) + 2 * l.v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (kept.n + 2) // (l.total + 2 * l.v) AS q
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source != b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sums.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
ranked AS (SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms
  UNION ALL BY NAME SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


ALL = (
    op1_decontamination, op2_sharding, op3_quality_classifier, op4_ngram_jaccard_join, op5_lm_scoring, op6_best_fit_packing, op7_pii, op8_exact_dedup, op9_line_dedup, op10_html_extraction,
    op11_toxicity, op12_centroid_clustering, op13_source_divergence,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op8_exact_dedup": OP8_SQL, "op12_centroid_clustering": OP12_SQL, "op13_source_divergence": OP13_SQL}
