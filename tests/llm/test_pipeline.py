"""The stages of the corpus pipeline in order, and their columns."""

import pytest

pytest.importorskip("plumbline.llm.queries")
C = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = labels.where("quality = 1 AND toxic = 0").select("doc_id")
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        path = C.scratch_path(spark, f"test-{name}")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        assert 0 < out.count() <= left
        assert out.select("doc_id").distinct().count() == out.count()
        if name != C.STAGES[-1][0]:
            assert out.columns == columns
        if name == "quality_classifier":
            lost = docs.join(out, "doc_id", "left_anti").join(clean, "doc_id").count()
            assert lost == 0
        docs, left = out, out.count()


def test_odd_rows_pass(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, long, "en", "s", 1, 9), (1, long, "en", "s", 1, 9), (None, long + " x", None, None, None, None), (2, None, "en", "s", 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept long")
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert C.drop_near_duplicates(spark, docs, SF).count() == 3
    assert C.reject_by_rules(spark, docs, SF).where("doc_id = 2").count() == 0
