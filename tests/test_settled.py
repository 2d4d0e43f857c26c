import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators.profile import variable_types
from plumbline.operators.settled import Sketched, settled_types


def compared(df):
    """Settled types beside the exact ones; how each was settled."""
    got = {r.pos: r for r in settled_types(df).collect()}
    want = variable_types(df).collect()
    assert len(got) == len(want)
    for w in want:
        g = got[w.pos]
        assert (g.variable, g.variable_type, g.is_time_candidate) == (w.variable, w.variable_type, w.is_time_candidate)
    return {r.variable: r.settled_by for r in got.values()}


def test_limits_of_few_values(table):
    n = 60
    counts = [1, 2, 9, 10, 11, 12, 13]
    cols = {f"n{k}": [i % k for i in range(n)] for k in counts} | {f"t{k}": [f"v{i % k}" for i in range(n)] for k in counts}
    cols |= {"flag": [i % 2 == 0 for i in range(n)], "none": [None] * n, "hole": [None] * (n - 1) + [1.5]}
    cols |= {"zero": [0.0, -0.0] * (n // 2), "nan": [float("nan"), 1.0] * (n // 2), "dec_id": list(range(n))}
    schema = [f"n{k} int" for k in counts] + [f"t{k} string" for k in counts]
    schema += ["flag boolean", "none string", "hole double", "zero double", "nan double", "dec_id int"]
    compared(table(cols, ", ".join(schema)))


def test_share_of_distinct_values_and_dates(spark):
    df = spark.range(40_000).repartition(7).select(
        F.col("id").alias("user_id"),
        (F.col("id") * 0.905).cast("int").alias("near_id"),
        (F.col("id") * 0.895).cast("int").alias("below_id"),
        (F.col("id") % 5000).alias("some_no"),
        F.concat(F.lit("a long text without any meaning, told apart by its last word only: "), "id").alias("text_id"),
        F.expr("CAST(date_add(DATE'2020-01-01', CAST(id % 900 AS INT)) AS STRING)").alias("day"),
        F.expr("if(id % 20 = 0, concat('x', id), CAST(date_add(DATE'1900-01-01', CAST(id AS INT)) AS STRING))").alias("mostly_day"),
        F.expr("if(id < 30000, 'none', CAST(date_add(DATE'1900-01-01', CAST(id AS INT)) AS STRING))").alias("few_values"),
        F.expr("20200101 + CAST(id % 28 AS INT)").alias("compact"),
        F.expr("if(id = 7, 5, 20200101 + CAST(id % 28 AS INT))").alias("nearly_compact"),
        F.expr("CAST(id AS DECIMAL(12,2))").alias("amount"),
        F.expr("DATE'2020-01-01'").alias("one_day"),
        F.expr("timestamp_seconds(id)").alias("at"),
        F.array("id").alias("list"),
    )
    by = compared(df)
    settled = ("user_id", "some_no", "text_id", "day", "compact", "nearly_compact", "amount", "at")
    assert {by[n] for n in settled} == {"sketch"}
    assert {by[n] for n in ("near_id", "below_id", "mostly_day", "few_values", "list")} == {"exact"}


def test_odd_tables(spark, table):
    compared(spark.createDataFrame([], "a int, b string, c array<int>"))
    named = table({"a": [1, 2], "b": ["x", None], "c": [dt.date(2020, 1, 1), None]}, "a int, b string, c date")
    compared(named.toDF("a.b", "my `col", ""))
    compared(named.toDF("same", "same", "same"))


@pytest.mark.parametrize("distinct, rows, bounds", [(0, 0, (0, 0)), (1, 5, (1, 2)), (10, 50, (9, 11)), (10, 10, (9, 10)), (1000, 1000, (955, 1000))])
def test_bounds(distinct, rows, bounds):
    assert Sketched(0, rows, rows, 0, distinct).bounds == bounds
