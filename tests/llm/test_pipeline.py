import corpus_pipeline
from docframe.llm import packing as pk

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name.replace(" ", "_"))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] and sizes[2] >= sizes[3] > 0
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tok = pk.WordTokenizer(pk.default_tokenizer())
    assert sum(p["length"] for p in pieces) == sum(len(tok.encode(t)) for ts in texts.values() for t in ts)


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def test_odd_tables(spark, tmp_path):
    import corpus_pipeline

    clean = "One quiet line of words about the river and the bridge.\nAnother line about the old mill by the road."
    rows = [(1, clean, "a", "x"), (1, clean, "a", "x"), (2, clean + " ", "a", "x"), (None, "A line that has no number of its own at all.", None, "x"), (3, None, "b", "x"), (4, "", "b", "x"), (5, "word " * 5000, None, "x")]
    schema = "doc_id long, text string, source string, node string"
    for name, some in (("odd", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 0)] if some else [], "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r["doc_id"] for r in got} <= {1, 2, 3, 4, 5, None} and sum(r["length"] for r in got) > 5000
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
