import pytest
from conftest import dicts

from plumbline import load_table, profile, read_csv, write_report
from plumbline.plans.quality import dataset_info
from plumbline.sources import tables
from plumbline.sources.tables import UnsupportedFormat, detect_encoding, preview, recover_report, report_name

TEXT = "이름,점수,날짜\n홍길동,1,2024-01-01\n김철수,NA,2024-01-02\n"


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp949"])
def test_korean_csv_in_any_encoding(spark, tmp_path, encoding):
    path = tmp_path / "t.csv"
    path.write_bytes(TEXT.encode(encoding))
    assert detect_encoding(spark, str(path)) == ("CP949" if encoding == "cp949" else "UTF-8")
    df = load_table(spark, str(path), encoding="auto")
    assert df.columns == ["이름", "점수", "날짜"]
    # dates stay text, so that the type check can report them
    assert [t for _, t in df.dtypes] == ["string", "int", "string"]
    assert sorted(r["이름"] for r in dicts(df)) == ["김철수", "홍길동"]
    assert profile(df).named("날짜").is_time_candidate
    assert dataset_info(df).first()["n_numeric"] == 1


def test_formats(spark, tmp_path):
    df = spark.range(25).selectExpr("id", "concat('v', id) AS t")
    for fmt in ("parquet", "json", "orc"):
        df.write.format(fmt).save(str(tmp_path / f"x.{fmt}"))
        got = load_table(spark, str(tmp_path / f"x.{fmt}"))
        assert got.count() == 25
    assert preview(df).count() == 10
    with pytest.raises(UnsupportedFormat):
        load_table(spark, "table.xlsx")
    with pytest.raises(ValueError):
        read_csv(spark, "x.csv", encoding="latin-7")


def test_report_sink(spark, tmp_path):
    write_report({"score": spark.range(1), "items": spark.range(7)}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "report=items")).count() == 7
    assert report_name("data", "regression").startswith("data_regression_")


def test_csv_keeps_quoted_records(spark, tmp_path):
    import codecs

    body = 'id,said,city\n1,"he said ""x, y"" now",서울\n2,"two\nlines",부산\n3,plain,NA\n'
    want = [(1, 'he said "x, y" now', "서울"), (2, "two\nlines", "부산"), (3, "plain", None)]
    for name, data in {
        "UTF-8": body.encode(),
        "UTF-8-BOM": codecs.BOM_UTF8 + body.encode(),
        "CP949": body.encode("cp949"),
        "auto": body.encode("cp949"),
    }.items():
        path = tmp_path / f"{name}.csv"
        path.write_bytes(data)
        df = read_csv(spark, str(path), name)
        assert df.columns == ["id", "said", "city"]
        assert sorted(tuple(r) for r in df.collect()) == want


def test_a_failed_report_leaves_the_old_one_whole(spark, tmp_path):
    out = tmp_path / "out"
    write_report({"score": spark.range(1), "items": spark.range(7)}, str(out))
    broken = spark.range(5).selectExpr("IF(id = 3, raise_error('lost'), id) AS id")
    with pytest.raises(Exception, match="lost"):
        write_report({"score": spark.range(2), "items": broken}, str(out))
    assert not recover_report(spark, str(out))
    assert spark.read.parquet(f"{out}/report=score").count() == 1
    assert spark.read.parquet(f"{out}/report=items").count() == 7
    write_report({"score": spark.range(3), "items": spark.range(4)}, str(out))
    assert spark.read.parquet(f"{out}/report=score").count() == 3
    assert not (out / tables.MANIFEST).exists()


@pytest.mark.parametrize("steps", range(1, 7))
def test_an_interrupted_commit_is_finished(spark, tmp_path, monkeypatch, steps):
    """The commit is stopped before its n-th file operation and then finished."""
    out = tmp_path / "out"
    write_report({"score": spark.range(1), "items": spark.range(7)}, str(out))
    left = [steps]

    class Stopped(tables._Files):
        def _count(self):
            left[0] -= 1
            if left[0] < 0:
                raise KeyboardInterrupt

        def delete(self, name):
            self._count()
            super().delete(name)

        def rename(self, source, target):
            self._count()
            super().rename(source, target)

    with monkeypatch.context() as patched:
        patched.setattr(tables, "_Files", Stopped)
        try:
            write_report({"score": spark.range(2), "items": spark.range(9)}, str(out))
        except KeyboardInterrupt:
            pass
    recover_report(spark, str(out))
    assert spark.read.parquet(f"{out}/report=score").count() == 2
    assert spark.read.parquet(f"{out}/report=items").count() == 9
    assert not (out / tables.MANIFEST).exists()
