from __future__ import annotations

import pyarrow as pa

import corpus_pipeline
from casewright.llm import quality, queries, toxicity
from casewright.llm.mixing import mix_report
from casewright.llm.tables import BATCH_ROWS, materialise, read_table
from tests.llm.edge import edge, nothing
from tests.llm.test_simhash import least_of_groups


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_takes_effect(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    columns = docs.columns
    (_, good), (_, harmless), (_, once), (_, mixed), (_, pack) = corpus_pipeline.STAGES
    a = materialise(good(spark, docs, sf_dir), "a")
    scores = quality.score_quality(docs, queries.quality_model(spark, sf_dir)).collect()
    assert ids(a) == sorted(r.doc_id for r in scores if r.score >= quality.CUT) and a.columns == columns
    b = materialise(harmless(spark, a, sf_dir), "b")
    toxic = toxicity.score_toxicity(a, queries.toxicity_model(spark, sf_dir)).collect()
    assert ids(b) == sorted(r.doc_id for r in toxic if r.score < toxicity.CUT) and b.columns == columns
    c = materialise(once(spark, b, sf_dir), "c")
    assert ids(c) == sorted(least_of_groups([(r.doc_id, r.text) for r in b.collect()])) and c.columns == columns
    d = materialise(mixed(spark, c, sf_dir), "d")
    copies = {r.doc_id: r.copies for r in mix_report(c).collect()}
    assert ids(d) == sorted(i for i, n in copies.items() for _ in range(n)) and d.columns == columns
    e = pack(spark, d, sf_dir).collect()
    per_doc = {}
    for r in e:
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + r.length
    assert all(per_doc[r.doc_id] == r.doc_tokens * copies[r.doc_id] for r in e) and set(per_doc) == set(ids(d))


def test_stages_take_odd_rows(spark, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (edge(spark), nothing(spark)):
            out = stage(spark, docs, sf_dir)
            out.collect()
            assert name == "packing" or out.columns == docs.columns


def test_stages_send_small_batches_to_python(spark):
    """Each stage bounds the rows of a batch, also where the session allows more; a smaller bound stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in ((10_000, BATCH_ROWS), (0, BATCH_ROWS), (100, 100)):
            spark.conf.set(key, given)
            corpus_pipeline.pack(spark, nothing(spark), "")
            assert int(spark.conf.get(key)) == want
        spark.conf.set(key, 10_000)
        rows = spark.range(BATCH_ROWS + 1, numPartitions=1).selectExpr("id doc_id", "'a b' text", "'en' lang", "'s' source", "3 n_chars")
        corpus_pipeline.mix_sources(spark, rows, "")
        sizes = rows.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        assert sorted(r.n for r in sizes.collect()) == [1, BATCH_ROWS]
    finally:
        spark.conf.set(key, before)
