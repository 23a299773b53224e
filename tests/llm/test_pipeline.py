"""The pipeline's stages, each on the result of the one before."""

import corpus_pipeline


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == columns, name
        assert 0 < after.count() <= before.count(), name
        assert after.join(before, "doc_id", "left_anti").count() == 0, name
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert out.select("doc_id").distinct().count() == before.count()
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
