"""CSV read by byte ranges against Python's csv module and Spark's one-task reader."""

import codecs
import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from plumbline import read_csv
from plumbline.sources import split_csv
from plumbline.sources.tables import _read_by_spark

WORDS = ["plain", "", "NA", "two\nlines", 'a "b" c', "x,y", "\n", "서울", "l'été", "tail\n\n", ',"\n', " blank ", "1e3"]


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few hundred bytes, so that records cross many borders."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name, value in zip(names, ("200b", "0b")):
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def text_of(rows, header=("id", "said", "city"), end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(header)
    writer.writerows(rows)
    return out.getvalue()


def made_rows(seed, n, words=WORDS):
    draw = random.Random(seed)
    return [(i, "".join(draw.choices(words, k=draw.choice([1, 1, 2, 40]))), draw.choice(words)) for i in range(n)]


def wanted(rows):
    missing = lambda v: None if v in ("", "NA") else v
    return sorted((i, missing(a), missing(b)) for i, a, b in rows)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_many_tasks_read_one_file_with_line_breaks(spark, tmp_path, small_ranges, seed, end):
    rows = made_rows(seed, 300)
    path = tmp_path / "t.csv"
    path.write_bytes(text_of(rows, end=end).encode())
    df = read_csv(spark, str(path), schema="id INT, said STRING, city STRING")
    assert df.rdd.getNumPartitions() > 20
    assert got(df) == wanted(rows)
    one_task = _read_by_spark(spark, [str(path)], "UTF-8", "id INT, said STRING, city STRING",
                              {"nullValue": "NA", "quote": '"', "escape": '"', "multiLine": "true"})
    assert one_task.rdd.getNumPartitions() == 1
    assert got(one_task) == got(df)


def test_a_record_longer_than_several_ranges(spark, tmp_path, small_ranges):
    rows = [(1, "a", "b"), (2, "\n".join(["line"] * 400), "c"), (3, "x" * 3000, "d"), (4, "\n" * 900, "e"), (5, "z", "NA")]
    path = tmp_path / "t.csv"
    path.write_text(text_of(rows))
    df = read_csv(spark, str(path))
    assert dict(df.dtypes) == {"id": "int", "said": "string", "city": "string"}
    assert got(df) == wanted(rows)


def test_each_file_has_its_own_encoding(spark, tmp_path, small_ranges):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.legacy.javaCharsets",)}
    files = {"a": (1, "utf-8", b""), "b": (2, "cp949", b""), "c": (3, "utf-8", codecs.BOM_UTF8), "d": (4, "cp949", b"")}
    every = []
    words = [w for w in WORDS if "é" not in w]
    for name, (seed, codec, mark) in files.items():
        rows = [(i + 1000 * seed, a, b) for i, a, b in made_rows(seed, 60, words)] + [(seed, "부산", "서울")]
        every += rows
        (tmp_path / f"{name} 표.csv").write_bytes(mark + text_of(rows).encode(codec))
    df = read_csv(spark, str(tmp_path), "auto")
    assert df.columns == ["id", "said", "city"]
    assert got(df) == wanted(every)
    assert {k: spark.conf.get(k, None) for k in before} == before


def test_named_encoding_without_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(text_of([(1, "서울", "x"), (2, "부산", "y")]).encode("euc-kr"))
    df = read_csv(spark, str(path), "EUC-KR", multi_line=False)
    assert got(df) == [(1, "서울", "x"), (2, "부산", "y")]


def test_inferred_types_equal_the_reader_s(spark, tmp_path):
    header = ["i", "l", "big", "d", "e", "b", "t", "day", "none", "mixed", "i", "", "NA"]
    lines = [
        ["1", "2147483648", "123456789012345678901234", "1.5", "1e-3", "true", "x", "2024-01-02", "", "1", "5", "6", "7"],
        ["-7", "3", "2", "NA", ".5", "FALSE", "", "2024-01-03", "NA", "true", "5", "6", "7"],
        ["+2", "NA", "3", "NaN", "7", "", "y", "2024-01-04", "", "2.0", "5", "6", "7"],
    ]
    path = tmp_path / "t.csv"
    path.write_text("\n".join(map(",".join, [header, *lines])))
    options = {"nullValue": "NA", "quote": '"', "escape": '"', "multiLine": "true", "preferDate": "false",
               "timestampFormat": "'never'yyyy", "timestampNTZFormat": "'never'yyyy"}
    want = _read_by_spark(spark, [str(path)], "UTF-8", None, options)
    found = read_csv(spark, str(path))
    assert found.dtypes == want.dtypes
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))


def test_other_separators_and_blank_lines(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id;said\n1;"a;b\n"\n\n2;c|d\n')
    assert got(read_csv(spark, str(path), sep=";")) == [(1, "a;b\n"), (2, "c|d")]


def test_irregular_quotes_fall_back_to_the_reader(spark, tmp_path):
    for i, body in enumerate(('id,size\n1,5" pipe\n2,x\n', 'id,size\n1,5"\n2,x\n', 'id,size\n1, "x"\n')):
        path = tmp_path / f"{i}.csv"
        path.write_text(body)
        options = {"nullValue": "NA", "quote": '"', "escape": '"', "multiLine": "true"}
        assert got(read_csv(spark, str(path))) == got(_read_by_spark(spark, [str(path)], "UTF-8", None, options))


def test_changed_ranges_are_an_error(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(text_of(made_rows(1, 20)))
    plan = split_csv.layout(spark, [str(path)], "UTF-8", ",", True)
    moved = split_csv.Layout(plan.blocks.withColumn("size", F.col("size") + 1), plan.header, True, False)
    with pytest.raises(Exception, match="changed between two scans"):
        split_csv.records(spark, [str(path)], moved, True).collect()


def test_empty_files_and_headers_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,said\n")
    assert read_csv(spark, str(tmp_path / "a.csv")).columns == ["id", "said"]
    assert read_csv(spark, str(tmp_path / "a.csv")).count() == 0
