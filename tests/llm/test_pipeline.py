import corpus_pipeline
from conftest import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] == sizes[4] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == sizes[4]
    assert pieces.where("size(ids) <> length").count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    used = rows.groupBy("sequence_id").sum("length")
    assert used.where("`sum(length)` > 1024").count() == 0 and used.count() > 0


def test_empty(spark, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0
