"""Pair correlations: one aggregate for few columns, blocked co-moments for many."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from plumbline.operators import correlations as C
from plumbline.operators.clean import frame_of
from plumbline.operators.correlations import Moments, correlations
from plumbline.operators.profile import profile
from plumbline.plans.readiness.clustering import strong_pairs


def as_dict(df):
    rows = df.collect()
    found = {(r.pos_1, r.pos_2): r.r for r in rows}
    assert len(found) == len(rows)
    return found


def profiled(spark, values, partitions=5):
    """A profile-like view of a numeric matrix with NaN as NULL."""
    names = [f"v {i}.x" for i in range(values.shape[1])]
    rows = [[None if np.isnan(v) else float(v) for v in row] for row in values]
    schema = ", ".join(f"`{n}` double" for n in names)
    return frame_of(spark.createDataFrame(rows, schema).repartition(partitions))


class Place:
    def __init__(self, pos):
        self.pos = pos


def test_pair_correlations_over_complete_rows(table):
    cols = {"a": [1.0, 2.0, 3.0, 4.0, None], "b": [2.0, 4.0, 6.0, 8.0, 0.0], "c": [5.0] * 5}
    p = profile(table(cols, "a double, b double, c double"))
    found = as_dict(correlations(p.frame, p.columns))
    assert found[0, 1] == pytest.approx(1.0)
    assert found[0, 2] is None and found[1, 2] is None


def test_blocks_equal_numpy_and_the_single_aggregate(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_COLUMNS", 4)
    monkeypatch.setattr(C, "MERGE_GROUPS", 2)
    draw = np.random.default_rng(7)
    values = draw.normal(size=(400, 11)) @ draw.normal(size=(11, 11)) + 1e6
    values[:, 3] = 2 - values[:, 0]
    values[:, 5] = 4.25
    values[7, 2], values[9, 8] = np.nan, np.nan
    frame, columns = profiled(spark, values), [Place(i) for i in range(11)]
    blocked = as_dict(correlations(frame, columns, few=2))
    single = as_dict(correlations(frame, columns))
    complete = values[~np.isnan(values).any(axis=1)]
    with np.errstate(invalid="ignore"):
        want = np.corrcoef(complete.T)
    assert set(blocked) == set(single) == {(i, j) for i in range(11) for j in range(i + 1, 11)}
    for pair, r in blocked.items():
        if 5 in pair:
            assert r is None and single[pair] is None
        else:
            assert r == pytest.approx(want[pair], abs=1e-9) and single[pair] == pytest.approx(r, abs=1e-9)


def test_positions_of_chosen_columns(spark):
    draw = np.random.default_rng(1)
    frame = profiled(spark, draw.normal(size=(50, 6)))
    chosen = [Place(4), Place(1), Place(3)]
    assert set(as_dict(correlations(frame, chosen))) == set(as_dict(correlations(frame, chosen, few=2))) == {(4, 1), (4, 3), (1, 3)}


@pytest.mark.parametrize("few", [2, 20])
def test_no_row_one_row_and_infinite_values(spark, few):
    columns = [Place(i) for i in range(3)]
    values = np.array([[1.0, 2.0, 3.0]])
    assert as_dict(correlations(profiled(spark, values), columns, few)) == {(0, 1): None, (0, 2): None, (1, 2): None}
    empty = frame_of(spark.createDataFrame([], "a double, b double, c double"))
    assert as_dict(correlations(empty, columns, few)) == {(0, 1): None, (0, 2): None, (1, 2): None}
    values = np.array([[1.0, 2.0, 3.0], [2.0, 4.0, np.inf], [3.0, 7.0, 5.0]])
    found = as_dict(correlations(profiled(spark, values), columns, few))
    assert found[0, 1] == pytest.approx(np.corrcoef(values[:, 0], values[:, 1])[0, 1])
    assert found[0, 2] is None and found[1, 2] is None
    assert as_dict(correlations(profiled(spark, values), columns[:1], few)) == {}


def test_merging_keeps_small_spreads_beside_large_means():
    draw = np.random.default_rng(2)
    values = 1e9 + draw.normal(size=(3000, 2)) @ np.array([[1.0, 0.5], [0.0, 0.1]])
    whole, parts = Moments(2), Moments(2)
    whole.add(values)
    for part in np.array_split(values, 17):
        parts.add(part)
    assert parts.n == whole.n == 3000
    assert np.allclose(parts.products, whole.products, rtol=1e-6)


def test_a_thousand_columns_are_one_scan(spark, tmp_path):
    """The plan reads the table once, whatever the number of columns, and pairs stay distributed."""
    width = 1000
    values = np.random.default_rng(5).normal(size=(300, width))
    columns = {f"v{i}": values[:, i] for i in range(width)}
    pq.write_table(pa.table(columns), tmp_path / "wide.parquet")
    found = correlations(frame_of(spark.read.parquet(str(tmp_path))), [Place(i) for i in range(width)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" parquet") == 1
    got = found.toPandas()
    assert len(got) == width * (width - 1) // 2
    assert np.allclose(got.r, np.corrcoef(values.T)[got.pos_1, got.pos_2], atol=1e-9)


def test_strong_pairs_of_many_columns(spark):
    draw = np.random.default_rng(3)
    values = draw.normal(size=(60, 22)).round(3)
    values[:, 21] = values[:, 0] * 2
    names = [f"v{i}" for i in range(22)]
    p = profile(spark.createDataFrame(values.tolist(), names))
    found = strong_pairs(p, p.of_type("numeric")).where("is_strong").collect()
    assert [(r.variable_1, r.variable_2) for r in found] == [("v0", "v21")]


def test_presence_in_wide_tables(spark):
    width = 100
    rows = [[1.0] * width, [None] * width, [float("nan")] * 99 + [2.0], [None] + [2.0] * 99]
    frame = frame_of(spark.createDataFrame(rows, ", ".join(f"v{i} double" for i in range(width))))
    for places in (range(width), range(30)):
        found = frame.df.select(frame.all_present(places).alias("all"), frame.any_present(places).alias("any")).collect()
        assert [r["all"] for r in found] == [True, False, False, False]
        assert [r["any"] for r in found] == [True, False, len(places) == width, True]
    none = frame.df.select(frame.all_present([]).alias("all"), frame.any_present([]).alias("any")).first()
    assert none["all"] and not none["any"]
