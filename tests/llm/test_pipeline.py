"""The pipeline, stage by stage."""

from __future__ import annotations

from tests.llm import brute


def test_stages(spark, data, documents):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "source_mix"]
    docs, seen = documents, {}
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, data).cache()
        seen[name] = (docs.count(), out.count())
        assert out.columns[: len(documents.columns)] == documents.columns and (k == 4 or out.columns == documents.columns)
        if name == "near_duplicates":
            texts = [r["text"] for r in docs.collect()]
            assert out.count() == len(set(brute.components([0] * len(texts), sets=[brute.shingles(t) for t in texts])))
        if name == "decontamination":
            leaks = brute.leaks([r["text"] for r in docs.collect()], items)
            assert out.count() == sum(x[1] == 0 for x in leaks)
        if name == "personal_data":
            assert out.count() == docs.count() and not any(brute.pii(r["text"]) for r in out.collect())
        docs = out
    assert seen["language_id"][0] == seen["language_id"][1] and all(r["taken"] > 0 for r in docs.collect())


def test_run_is_the_stages(spark, data):
    import corpus_pipeline as pipeline

    assert pipeline.run(spark, data).count() > 0


def test_stages_take_odd_rows(spark, data, odd, none):
    import corpus_pipeline as pipeline

    for table in (odd, none):
        docs = table
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, data).cache()
            docs.collect()


def test_stages_keep_columns_of_any_name(spark, data, documents):
    import corpus_pipeline as pipeline

    names = ("_key", "key", "row", "_id", "_hash", "_text_hash", "h", "i", "_row", "added")
    docs = documents.limit(60).selectExpr("*", *(f"'mine' as {n}" for n in names))
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, data)
        assert set(names) <= set(docs.columns) and all(set(r) == {"mine"} for r in docs.select(*names).collect())
