from plumbline.operators.profile import is_id_like_name, profile, variable_types


def types_of(df, **options):
    return {c.variable: c.variable_type for c in profile(df, **options).columns}


def test_id_like_names():
    assert all(map(is_id_like_name, ["id", "user_id", "ORDER_NO", "zip code", "key1", "a.seq"]))
    assert not any(map(is_id_like_name, ["userid", "orderkey", "note", "codes", "", None, "idx"]))


def test_cardinality_and_id_edges(table):
    n = 40
    cols = {
        "const": [1] * n,
        "two": [i % 2 for i in range(n)],
        "ten": [i % 10 for i in range(n)],
        "eleven": [i % 11 for i in range(n)],
        "t_one": ["a"] * n,
        "t_ten": [f"v{i % 10}" for i in range(n)],
        "t_eleven": [f"v{i % 11}" for i in range(n)],
        "flag": [i % 2 == 0 for i in range(n)],
        "user_id": [i if i < 36 else 0 for i in range(n)],  # ratio 36/40 = .90
        "item_id": [i if i < 35 else 0 for i in range(n)],  # ratio .875
        "userid": list(range(n)),
        "t_id": [f"u{i}" for i in range(n)],
        "CRIM": [i * 0.37 for i in range(n)],
        "none": [None] * n,
    }
    schema = (
        "const int, two int, ten int, eleven int, t_one string, t_ten string, t_eleven string, "
        "flag boolean, user_id int, item_id int, userid int, t_id string, CRIM double, none string"
    )
    want = {
        "const": "excluded",
        "two": "numeric_categorical",
        "ten": "numeric_categorical",
        "eleven": "numeric",
        "t_one": "excluded",
        "t_ten": "categorical",
        "t_eleven": "other",
        "flag": "categorical",
        "user_id": "id",
        "item_id": "numeric",
        "userid": "numeric",
        "t_id": "id",
        "CRIM": "numeric",
        "none": "excluded",
    }
    df = table(cols, schema)
    assert types_of(df) == want
    assert types_of(df, single_pass=True) == want


def test_id_needs_thirty_values(table):
    for n, kind in ((29, "numeric"), (30, "id")):
        assert types_of(table({"user_id": list(range(n))}, "user_id int")) == {"user_id": kind}


def test_dates_before_numbers_and_ids(table):
    days = [20240101 + i for i in range(28)]
    cols = {
        "ymd": days,
        "day_id": [f"2024-01-{i + 1:02d}" for i in range(28)],
        "nine_of_ten": [f"2024-01-{i % 9 + 1:02d}" if i % 10 else "soon" for i in range(28)],
        "bad_day": [20240132] + days[1:],
    }
    got = types_of(table(cols, "ymd int, day_id string, nine_of_ten string, bad_day int"))
    assert got == {
        "ymd": "date",
        "day_id": "date",
        "nine_of_ten": "date",  # 9 of 10 distinct values are dates: exactly .90
        "bad_day": "numeric",
    }


def test_special_values_and_missing(table):
    nan, inf = float("nan"), float("inf")
    df = table({"x": [1.0, nan, inf, -inf, None, 1.0]}, "x double")
    for single in (False, True):
        (c,) = profile(df, single_pass=single).columns
        assert (c.n_missing, c.n_non_missing, c.n_unique) == (2, 4, 3)
        assert (c.n_nan, c.n_pos_inf, c.n_neg_inf, c.n_finite) == (1, 1, 1, 2)
        assert (c.max_count, c.min_count) == (2, 1)


def test_layouts_agree_on_every_type(spark):
    df = spark.sql(
        """SELECT CAST(id AS TINYINT) a, CAST(id AS FLOAT) / 3 b, CAST(id % 7 AS DECIMAL(20, 3)) c,
        DATE'2024-01-01' + CAST(id AS INT) d, TIMESTAMP'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) e,
        TIMESTAMP_NTZ'2024-01-01 00:00:00.000001' f, id % 2 = 0 g, concat(repeat('long ', 30), id % 5, ' 2024-1-1') h,
        array(id) i, CAST(NULL AS STRUCT<x: INT>) j, concat('1,', id) k FROM range(50)"""
    )
    one, many = profile(df, single_pass=True), profile(df, single_pass=False)
    assert one.columns == many.columns
    got = {c.variable: c for c in one.columns}
    assert (got["h"].n_unique, got["h"].has_date_hint, got["h"].n_date_text) == (5, True, 0)
    assert got["i"].n_unique is None and got["i"].variable_type == "other"
    assert got["j"].n_unique == 0 and got["j"].variable_type == "excluded"
    assert got["c"].variable_type == "numeric_categorical"
    assert got["d"].variable_type == got["e"].variable_type == "date"


def test_whole_long_texts_are_compared(table):
    base = "x" * 5000
    df = table({"t": [base + "a", base + "b", base + "a", " " + base + "b "]}, "t string")
    (c,) = profile(df).columns
    assert (c.n_unique, c.max_count, c.min_count) == (2, 2, 2)


def test_empty_blank_and_repeated_names(spark):
    df = spark.createDataFrame([(1, "a", 2)], "x int, y string, z int").toDF("x", " ", "x")
    p = profile(df)
    assert [c.variable for c in p.columns] == ["x", " ", "x"]
    none = profile(spark.createDataFrame([], "a int, b string"))
    assert [(c.n_rows, c.variable_type) for c in none.columns] == [(0, "excluded")] * 2
    assert profile(spark.range(3).select()).n_rows == 3


def test_simple_mode_and_lazy_table(table):
    df = table({"t": [f"v{i}" for i in range(40)], "user_id": list(range(40))}, "t string, user_id int")
    assert types_of(df, mode="simple") == {"t": "categorical", "user_id": "numeric"}
    assert variable_types(df).where("variable = 'user_id'").first()["variable_type"] == "id"


def test_hot_value_and_partition_count(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('v', id)) AS t", "id % 5 AS n")
    a = profile(df.repartition(1)).columns
    b = profile(df.repartition(13)).columns
    assert a == b
    assert (a[0].max_count, a[0].n_unique) == (1000, 2001)
