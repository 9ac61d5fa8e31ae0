import corpus_pipeline as C


def test_stages_keep_columns_and_clean_documents(spark, docs):
    sf = "/root/testdata/sf0.001"
    at, ids = docs, [docs.count()]
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, at, sf)
        assert out.columns == docs.columns, name
        at = spark.createDataFrame(out.collect(), docs.schema)
        ids.append(at.count())
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "minhash_dedup", "decontaminate", "packing"]
    assert ids[1] == ids[0] and ids[2] < ids[1] and ids[4] < ids[3]
    packed = C.STAGES[-1][1](spark, at, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in at.collect()}


def test_odd_rows_pass_all_stages(spark, odd_docs):
    at = odd_docs.select("doc_id", "text", "lang", "source", "n")
    for _, stage in C.STAGES:
        at = stage(spark, at, "/root/testdata/sf0.001")
        at = spark.createDataFrame(at.collect(), at.schema)
    assert at.count() > 0


def test_run_on_an_empty_table(spark, docs, bench, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
