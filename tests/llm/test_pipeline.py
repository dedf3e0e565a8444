import corpus_pipeline


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert 0 < len({r.doc_id for r in rows}) < n
    assert [s[0] for s in corpus_pipeline.STAGES][0] == "quality_rules"
