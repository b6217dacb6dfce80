"""Each stage of the pipeline against what it must drop, on a small folder of tables."""

from tests.llm.fixtures import frame, texts


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    item = "Which of these measured the quick brown fox jumping over the lazy dog near the river bank yesterday"
    docs = [*texts(), (900, "some words before " + item), *[(1000 + i, f"word{i} " * 9 + "you grumpish clown!") for i in range(60)], *[(2000 + i, f"calm{i} mild{i} soft{i} " * 6) for i in range(300)]]
    frame(spark, docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, 1) for i in range(60)] + [(2000 + i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf, kept = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = kept.columns
    kept = P.toxicity(spark, kept, sf)
    ids = [r["doc_id"] for r in kept.collect()]
    assert not any(d is not None and 1000 <= d < 1060 for d in ids) and {2000 + i for i in range(300)} <= set(ids)
    kept = P.line_dedup(spark, kept, sf)
    assert kept.where("text like '%rights reserved%'").count() == 0 and kept.count() == len(ids)
    kept = P.jaccard_join(spark, kept, sf)
    ids = [r["doc_id"] for r in kept.collect()]
    assert len([d for d in ids if d in (13, 100, 101, 102, 103, 310)]) == 1 and 300 in ids and 302 in ids
    kept = P.decontamination(spark, kept, sf)
    assert kept.columns and set(kept.columns) == set(columns)
    assert {r["doc_id"] for r in kept.collect()} == set(ids) - {900}
    out = P.run(spark, sf)
    assert {r["doc_id"] for r in out.collect()} == set(ids) - {900}
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "packing"]


def test_empty_tables_and_names_of_the_stages_own(spark, tmp_path):
    import corpus_pipeline as P

    docs = frame(spark, [(1, "calm words here"), (2, "other words there")])
    for name, rows in (("empty", docs.where("false")), ("full", docs)):
        sf = f"{tmp_path}/{name}"
        rows.selectExpr("doc_id", "text", "'mine' as _score", "'mine' as _lines", "'mine' as _leaks", "'mine' as _node", "'mine' as node").write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        kept = spark.read.parquet(f"{sf}/documents.parquet")
        for _, stage in P.STAGES[:-1]:
            kept = stage(spark, kept, sf)
            assert kept.columns == ["doc_id", "text", "_score", "_lines", "_leaks", "_node", "node"]
            assert kept.where("_score = 'mine' and _lines = 'mine' and _leaks = 'mine' and _node = 'mine'").count() == rows.count()
        assert P.run(spark, sf).count() == rows.count()
