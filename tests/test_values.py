from pyspark.sql import functions as F

from plumbline import standardize
from plumbline.functions import values as V
from plumbline.functions.rules import band, first_match, matching_codes


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(F.expr(expr)).collect()]


def test_missing_tokens_and_trimming(spark):
    tokens = ["", "NA", "N/A", "na", "n/a", "null", "NULL", ".", "NaN", "-"]
    padded = [f" \t{t}\r\n" for t in tokens]
    kept = ["Null", "none", "n.a.", " a b ", "--", "0"]
    got = column(spark, tokens + padded + kept + [None], V.text_or_null("x"))
    assert got[:20] == [None] * 20
    assert got[20:] == ["Null", "none", "n.a.", "a b", "--", "0", None]


def test_numbers_in_text(spark):
    good = ["1", "-1.5", "+.5", "5.", "1e3", "1E-3", "Inf", "-infinity"]
    bad = ["1.5d", "0x1F", "1,234", "e3", ".", "1 2", "", "abc", "1e"]
    assert column(spark, good, V.looks_numeric("x")) == [True] * len(good)
    assert column(spark, bad, V.looks_numeric("x")) == [False] * len(bad)
    assert column(spark, ["1.5", "x"], V.number_from_text("x")) == [1.5, None]


def test_dates_in_text(spark):
    day = 19753 * 86400  # 2024-01-31
    good = {
        "2024-01-31": day,
        "2024/1/31": day,
        "2024.01.31": day,
        "20240131": day,
        "1/31/2024": day,
        "31/1/2024": day,
        "2024-01-31 01:02:03": day + 3723,
        "2024/01/31 23:59:59": day + 86399,
        "03/04/2024": 19786 * 86400,  # month first: 4 March
    }
    bad = ["2024-02-30", "2024-13-01", "20241331", "2024-01/31", "24-01-31", "2024-01-31T00:00:00"]
    bad += ["2024-01-31 24:00:00", "2024-01-31 10:60:00", "13/13/2024", "2024", "x"]
    assert column(spark, list(good), V.seconds_from_text("x")) == list(good.values())
    assert column(spark, bad, V.seconds_from_text("x")) == [None] * len(bad)


def test_user_codes_by_type(spark):
    df = spark.createDataFrame(
        [(9, 9.0, "9", True), (99, 1.5, " 99 ", False), (1, 999.0, "keep", None)],
        "a int, b double, c string, d boolean",
    )
    got = [tuple(r) for r in standardize(df, [9, "99", 999]).collect()]
    assert got == [(None, None, None, True), (None, 1.5, None, False), (1, None, "keep", None)]
    # never automatic
    assert standardize(df).where("a = 9 AND b = 9").count() == 1


def test_rule_tables(spark):
    df = spark.createDataFrame([(0.049,), (0.05,), (0.4,), (None,)], "rate double")
    points = band("rate", "<", [(0.05, 15), (0.10, 12)], 0)
    assert [r[0] for r in df.select(points).collect()] == [15, 12, 0, 0]
    codes = matching_codes([("low", "rate < 0.1"), ("it's", "rate < 0.05")])
    assert [r[0] for r in df.select(codes).collect()] == [["low", "it's"], ["low"], [], []]
    assert df.select(first_match([], "none")).first()[0] == "none"


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (0.00015,)], "x double")
    assert [r[0] for r in df.select(V.rounded(F.col("x"), 2)).collect()] == [0.12, 0.38, 0.0]
    assert df.select(V.rounded(F.col("x"), 4)).collect()[2][0] == 0.0001
