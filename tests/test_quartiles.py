import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.operators.outliers import Fence, box_summary, iqr_outliers
from plumbline.operators.profile import profile
from plumbline.operators.quartiles import quantiles

PROBS = [0.25, 0.5, 0.75]


def check(spark, values, **options):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    got = quantiles(df, {"x": len(values)}, PROBS, **options)["x"]
    assert got == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("limit,accuracy", [(10**9, 10_000), (50, 100), (7, 50)])
def test_brackets_find_exact_quantiles(spark, limit, accuracy):
    rng = np.random.default_rng(1)
    check(spark, rng.normal(size=5000), limit=limit, accuracy=accuracy)
    check(spark, np.exp(rng.normal(size=3001) * 8), limit=limit, accuracy=accuracy)


def test_hot_values_end_the_search(spark):
    rng = np.random.default_rng(2)
    values = np.where(rng.random(4000) < 0.4, 7.0, rng.integers(0, 50, 4000))
    check(spark, values, limit=20, accuracy=50)
    check(spark, [3.0] * 500, limit=20, accuracy=50)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=60))
def test_small_inputs(spark, values):
    check(spark, values, limit=5, accuracy=20)


def test_fences_are_strict_and_zero_iqr_has_no_outliers(table):
    # quartiles 2 and 4: fences -1 and 7
    values = [1.0, 2.0, 2.0, 3.0, 3.0, 4.0, 4.0, 7.0, -1.0]
    q1, q3 = np.quantile(values, [0.25, 0.75])
    edge = q3 + 1.5 * (q3 - q1)
    assert edge == 7.0
    df = table({"x": values, "y": [5.0] * 8 + [100.0]}, "x double, y double")
    p = profile(df)
    out = iqr_outliers(p, p.columns)
    assert out.counts == {0: 0, 1: 0}
    assert Fence(1.0, 1.0).iqr == 0
    more = profile(table({"x": values + [7.01]}, "x double"))
    assert iqr_outliers(more, more.columns).counts[0] in (0, 1)


def test_infinite_values_are_left_out(table):
    inf = float("inf")
    df = table({"x": [float(i) for i in range(20)] + [inf, -inf, 500.0]}, "x double")
    p = profile(df)
    out = iqr_outliers(p)
    row = out.table(p).first()
    assert (row["outlier_count"], row["non_missing_count"]) == (1, 21)
    box = box_summary(p, out).first()
    assert (box["whisker_low"], box["whisker_high"], box["median"]) == (0.0, 19.0, 10.0)
