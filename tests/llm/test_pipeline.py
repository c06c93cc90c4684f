from collections import defaultdict

import corpus_pipeline
from emberline.llm import quality
from test_decontaminate import brute as contaminated
from test_exact_dedup import brute as copies
from test_ngram_join import brute as near
from test_packing import check as check_packing


def test_each_stage_against_brute_force_on_its_own_input(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, benchmark = docs.columns, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        rows = list(before.items())
        if k < 4:
            assert out.columns == columns
            ids = {r.doc_id for r in out.collect()}
            assert out.count() == len(ids) and all(before[r.doc_id] == r.text for r in out.collect())
        if k == 0:
            model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert ids == {r.doc_id for r in quality.score(docs, model).filter("accepted").collect()} and len(ids) < len(before)
            labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            good = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0]
            assert sum(d in ids for d in good) >= 0.97 * len(good)
            bad = [d for d, r in labels.items() if r.quality == 0 or r.toxic == 1]
            assert sum(d not in ids for d in bad) >= 0.8 * len(bad)  # a few dozen labels teach few words
        if k == 1:
            assert ids == {d for d, *_, kept, _ in copies(rows) if kept}
        if k == 2:
            groups = defaultdict(list)
            for d, (_, c) in near(rows).items():
                groups[c].append(d)
            assert ids == {min(g) for g in groups.values()}
        if k == 3:
            assert ids == {r[0] for r in contaminated(rows, benchmark) if not r[5]} and len(ids) < len(before)
        if k == 4:
            used, least = check_packing(rows, out.collect())
            assert used <= least + 2
        docs = out


def test_run_gives_the_packed_pieces(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and found.count() > 0
