import corpus_pipeline
from pagelake.llm.near_dedup import near_classes
from pagelake.llm.toxicity import toxicity


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, ids = docs, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, before, sf_dir).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "toxicity":
            assert kept == {r.doc_id for r in toxicity(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect() if not r.predicted}
        if name == "near_dedup":
            assert kept == {r.class_id for r in near_classes(before).collect()}
        if name == "substring_dedup":
            assert kept == ids
            assert all(r.n_chars == len(r.text) for r in after.collect())
        assert kept <= ids
        before, ids = after, kept
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert {r.doc_id for r in last.collect()} == ids
    assert last.count() == corpus_pipeline.run(spark, sf_dir).count()
