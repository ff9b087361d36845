"""The pipeline's stages on edge rows, and its result against the operators."""

import corpus_pipeline
from driftwise.llm import QUERIES


def test_stages_take_edge_rows(spark, docs, empty, clashing, tmp_path):
    items = spark.createDataFrame([(1, docs.filter("doc_id = 5").first().text)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for df in (docs, empty, clashing):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, str(tmp_path))
            assert out.columns[:5] == docs.columns
            assert k == 4 or out.columns == df.columns
            if df is clashing and k < 4:  # columns of the input keep their values
                assert {r.kept for r in out.collect()} <= {"x"} and {r.copies for r in out.collect()} <= {"x"}
            assert out.count() <= 3 * max(df.count(), 0)
        out.collect()


def test_run_over_a_small_table(spark):
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf)
    kept = {r.doc_id for r in QUERIES["op7_quality_rules"](spark, sf).filter("kept").collect()}
    leaked = {r.doc_id for r in QUERIES["op4_decontaminate"](spark, sf).collect()}
    ids = {r.doc_id for r in got.collect()}
    assert ids and ids <= kept - leaked
    counts = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "decontaminate", "mix", "shard"]
