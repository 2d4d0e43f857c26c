import random
from datetime import date, timedelta

import pytest

from plumbline.operators.gaps import gap_stats, ordered_gaps, sequence_buckets, sequence_share
from plumbline.operators.gaps import sequence_share_of_huge, series_gap_stats
from plumbline.operators.profile import profile
from plumbline.plans.readiness.clustering import obvious_ids


def business_days(n, start=date(2024, 1, 1)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(days=1)
    return out


def test_range_partitioned_gaps_equal_one_window(spark):
    values = sorted({(i * i * 7919) % 100_003 for i in range(1, 900)})
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    want = sorted(b - a for a, b in zip(values, values[1:]))
    for limit in (10**6, 100, 37):
        got = sorted(r["gap"] for r in ordered_gaps(df, "v", len(values), limit).collect())
        assert got == want


@pytest.mark.parametrize("as_type", ["date", "timestamp", "string"])
def test_trading_days_count_as_regular(spark, as_type):
    days = business_days(60)
    df = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days)], "d date, v double")
    p = profile(df.selectExpr(f"CAST(d AS {as_type}) AS d", "v"))
    s = gap_stats(p.frame, p.named("d"))
    assert (s.unit, s.n_points, s.median, s.smallest) == ("day", 60, 1.0, 1.0)
    assert s.business_day_like and s.cv == 0.05 and s.cv_raw > 0.5


def test_seconds_stay_seconds(spark):
    df = spark.range(30).selectExpr(
        "TIMESTAMP'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0, id * 10 + 0.5) AS t"
    )
    p = profile(df)
    s = gap_stats(p.frame, p.named("t"))
    assert (s.unit, s.mean, s.cv, s.business_day_like) == ("second", 10.0, 0.0, False)


def test_plain_numbers_and_short_series(table):
    p = profile(table({"t": [0, 5, 10, 15, 100, 100]}, "t int"))
    s = gap_stats(p.frame, p.named("t"))
    assert (s.n_rows, s.n_points, s.unit, s.mean, s.median) == (6, 5, "number", 25.0, 5.0)
    short = profile(table({"t": [1, 2]}, "t int"))
    assert gap_stats(short.frame, short.named("t")).cv is None


def test_sequence_share_counts_unit_gaps(table):
    cols = {"a": list(range(10)), "b": [0, 1, 2, 10, 20, 20, 21, 30, 31, 32], "c": [i + 0.5 for i in range(10)]}
    p = profile(table(cols, "a int, b int, c double"))
    got = {r["pos"]: (r["sequence_share"], r["whole"]) for r in sequence_share(p.frame, p.columns).collect()}
    assert got[0] == (1.0, True)
    assert got[1] == (5 / 8, True)  # 0,1,2,10,20,21,30,31,32
    assert got[2][1] is False


def test_several_series_equal_one_at_a_time(spark):
    """Also over many small ranges, some of which hold no point of a series."""
    rows = [(i * i % 977, i % 3 or None, i if i < 20 else None, i if i in (5, 700) else None, i) for i in range(900)]
    df = spark.createDataFrame(rows, "t int, a int, b int, c int, d int").repartition(4)
    p = profile(df)
    present = [p.frame.present(p.named(n).pos) for n in "abcd"]
    single = [gap_stats(p.frame, p.named("t"), ok) for ok in present]
    assert [s.n_points >= 3 for s in single] == [True, True, False, True]
    for limit in (10**6, 50, 7):
        found = series_gap_stats(p.frame, p.named("t"), present, limit)
        for one, many in zip(single, found):
            assert (one.n_rows, one.n_points, one.unit, one.smallest, one.median) == (
                many.n_rows, many.n_points, many.unit, many.smallest, many.median)
            assert many.mean == pytest.approx(one.mean) and many.sd == pytest.approx(one.sd)


def test_four_series_take_the_jobs_of_one(spark, monkeypatch):
    """Aggregates and ordered passes are counted where they are asked for."""
    from plumbline.operators import gaps as G

    df = spark.range(300).selectExpr("CAST(id AS INT) AS t", *[f"IF(id % {k} = 0, NULL, id) AS v{k}" for k in (3, 4, 5, 7)])
    p = profile(df)
    calls = []
    for name in ("time_points", "previous_values", "quantiles"):
        kept = getattr(G, name)
        monkeypatch.setattr(G, name, lambda *a, kept=kept, name=name, **k: calls.append(name) or kept(*a, **k))
    G.series_gap_stats(p.frame, p.named("t"), [p.frame.present(i) for i in range(1, 5)])
    assert sorted(calls) == ["previous_values", "quantiles", "time_points"]


@pytest.mark.parametrize("seed", [1, 2])
def test_sequences_equal_brute_force(spark, seed):
    draw = random.Random(seed)
    kinds = [
        [draw.randrange(-200, 200) for _ in range(300)],  # dense, over many borders of buckets
        [v for v in range(-130, 130) if draw.random() < 0.9],
        [draw.randrange(-(10**12), 10**12) for _ in range(200)],
        [63 * i + d for i in range(-3, 4) for d in (-1, 0, 62)],
        [(1 << 53) - i for i in range(30)] + [-(1 << 53)],
        [5],
    ]
    n = max(map(len, kinds))
    rows = list(zip(*[[float(v) for v in k] + [None] * (n - len(k)) for k in kinds]))
    p = profile(spark.createDataFrame(rows, ", ".join(f"v{i} double" for i in range(len(kinds)))).repartition(3))
    got = {r["pos"]: r for r in sequence_share(p.frame, p.columns).collect()}
    for pos, values in enumerate(kinds):
        values = sorted(set(values))
        near = sum(b - a == 1 for a, b in zip(values, values[1:]))
        assert got[pos]["whole"]
        assert got[pos]["sequence_share"] == (near / (len(values) - 1) if len(values) > 1 else 0)


def test_a_dense_column_is_one_row_per_bucket(spark):
    p = profile(spark.range(6300).selectExpr("id AS v"))
    rows = sequence_buckets(p.frame, p.columns).collect()
    assert len(rows) == 101 and all(r["whole"] for r in rows)  # the first bit is carried to a bucket of its own


def test_values_beyond_exact_doubles(spark):
    values = [float(1 << 60) + 256.0 * i for i in range(40)]
    p = profile(spark.createDataFrame([(v, float(i)) for i, v in enumerate(values)], "v double, w double"))
    got = {r["pos"]: r["whole"] for r in sequence_share(p.frame, p.columns).collect()}
    assert got == {0: False, 1: True}
    huge = sequence_share_of_huge(p.frame, p.columns[:1]).first()["sequence_share"]
    assert huge == 40 / 39  # v + 1 is v for every one of them, as with doubles anywhere
    assert obvious_ids(p, p.columns) == {0: True, 1: True}
