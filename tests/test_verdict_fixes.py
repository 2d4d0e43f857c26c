"""Cases at the edge of earlier results: clock zones, repeated keys, running errors, boolean codes."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators.clean import frame_of, standardize
from plumbline.operators.duplicates import duplicate_figures, duplicate_positions, duplicate_summary, with_row_position
from plumbline.operators.gaps import ensure_checkpoint_dir, gap_stats
from plumbline.operators.profile import profile
from plumbline.plans.readiness import evaluate_readiness


@pytest.mark.parametrize("zone", ["UTC", "Asia/Seoul", "America/New_York"])
def test_business_days_in_any_zone(spark, zone):
    """Midnights of weekdays over two clock changes, as the session's zone shows them."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        days = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(320)]
        rows = [(d.strftime("%Y-%m-%d"), float(i)) for i, d in enumerate(days) if d.weekday() < 5]
        df = spark.createDataFrame(rows, "d string, v double").select(F.to_timestamp("d").alias("t"), "v")
        profiled = profile(df)
        stats = gap_stats(profiled.frame, profiled.named("t"))
        assert stats.unit == "day" and stats.business_day_like
        assert stats.median == 1.0 and stats.smallest == 1.0 and stats.cv <= 0.05
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("partitions", [1, 4])
def test_positions_with_repeated_keys(spark, partitions):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b"), (None, "c"), (4, "c")], "k int, v string")
    found = duplicate_positions(df.repartition(partitions), ["k"], ["v"])
    assert sorted((r.k for r in found.collect()), key=lambda k: (k is None, k)) in ([1, 2, 4], [1, 2, None])
    two = duplicate_positions(df.na.drop().withColumn("j", F.col("k") + 1), ["k", "j"], ["v"])
    assert sorted(tuple(r) for r in two.collect()) == [(1, 2), (2, 3)]


def test_positions_use_hash_aggregates(spark):
    df = spark.range(10).select("id", (F.col("id") % 3).alias("v"))
    plan = duplicate_positions(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_nested_values_keep_microseconds_and_nulls(spark):
    times = [datetime(2024, 1, 1, 0, 0, 0, micros) for micros in (1, 2, 1)]
    df = spark.createDataFrame([((t, None),) for t in times], "s struct<t:timestamp,x:int>")
    row = duplicate_summary(frame_of(df)).first()
    assert (row.total_rows, row.duplicate_count) == (3, 1)


def test_boolean_codes(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    for code in (True, "true", "TRUE"):
        assert [r.b for r in standardize(df, [code]).orderBy("b").collect()] == [None, None, False]


def test_running_errors_are_raised(spark):
    broken = spark.range(50).select(F.expr("IF(id = 40, raise_error('lost'), id)").cast("double").alias("v"))
    with pytest.raises(Exception, match="lost"):
        evaluate_readiness(broken, "basic_stats", {}).result.collect()
    df = spark.range(5).select(F.col("id").cast("double").alias("v"))
    verdict = evaluate_readiness(df, "regression", {"no_such_role": "v"}).result.first()
    assert verdict.status == "unfit" and verdict.score == 0


def test_checkpoint_folder_is_never_machine_local_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():
            return Context

        @staticmethod
        def isDefined():
            return False

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session)


def test_errors_of_settings_and_of_the_library_are_raised(spark, monkeypatch):
    from plumbline.operators.shared import MissingSetting
    from plumbline.plans.readiness import dispatch

    df = spark.range(50).selectExpr("id AS t", "CAST(id * 7 % 11 AS DOUBLE) AS v")
    for error in (MissingSetting("set spark.checkpoint.dir"), KeyError("own fault"), TypeError("own fault"), ValueError("own fault")):

        def broken(*_, error=error):
            raise error

        monkeypatch.setitem(dispatch.CHECKS, "time_series", broken)
        with pytest.raises(type(error)):
            evaluate_readiness(df, "time_series", {"time_var": "t", "value_var": "v"})
    monkeypatch.undo()
    for roles in ({"response_var": 5}, ["v"], {"response_var": "absent"}, {"response_var": None}):
        verdict = evaluate_readiness(df, "regression", roles)
        assert verdict.result.first().status == "unfit"


def test_a_repeated_key_is_written_out_in_steps(spark):
    df = spark.range(1000).selectExpr("IF(id < 900, 1, id) AS k", "IF(id < 990, 'hot', 'other') AS v")
    found = duplicate_positions(df, ["k"], ["v"], rows_per_step=7)
    assert sorted(r.k for r in found.collect()) == [1] * 899 + list(range(900, 990)) + list(range(991, 1000))
    sizes = [len(p) for p in found.repartition(1).rdd.glom().collect()]
    assert sum(sizes) == 899 + 90 + 9


@pytest.mark.parametrize("kind", ["parquet", "json", "csv"])
def test_positions_are_the_same_under_any_split_size(spark, tmp_path, kind):
    """Several files of different sizes, in the order of their paths."""
    path, order = str(tmp_path / "t"), []
    for i, n in enumerate((5, 300, 40)):
        rows = [f"{i}-{k}" for k in range(n)]
        order += rows
        one = spark.createDataFrame([(r,) for r in rows], "v string").coalesce(1)
        one.write.format(kind).save(f"{path}/part={i}")
    for size in ("128m", "300b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0b")
        try:
            df = spark.read.schema("v string").format(kind).load(path).select("v")
            assert [r.v for r in with_row_position(df).orderBy("position").collect()] == order
            kept = with_row_position(df.where("v LIKE '1-%7'")).orderBy("position").collect()
            assert [(r.v, r.position) for r in kept] == [(v, i) for i, v in enumerate((v for v in order if v[:2] == "1-" and v[-1] == "7"), 1)]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    mixed = with_row_position(spark.range(100).repartition(7)).orderBy("position").collect()
    assert [r.position for r in mixed] == list(range(1, 101))


def test_a_clash_of_row_keys_is_not_counted(spark):
    """Every row, or every row of a remainder, gets one key; only equal rows count."""
    rows = [(i % 40, None if i % 7 == 0 else f"t{i % 40}") for i in range(200)]
    frame = frame_of(spark.createDataFrame(rows, "a int, b string"))
    want = len(rows) - len(set(rows))
    for clash in (F.lit(5).cast("bigint"), (F.col("c0") % 3).cast("bigint")):
        found = duplicate_figures(frame, key=lambda f, c=clash: [c.alias("h1"), F.lit(0).cast("bigint").alias("h2")])
        assert found == {"total_rows": 200, "duplicate_count": want}
    assert duplicate_figures(frame) == {"total_rows": 200, "duplicate_count": want}
    unlike = frame_of(spark.range(100).selectExpr("id", "array(id) AS n"))
    one = lambda f: [F.lit(-9).cast("bigint").alias("h1"), F.lit(0).cast("bigint").alias("h2")]
    assert duplicate_figures(unlike, key=one)["duplicate_count"] == 0


def test_report_metrics_cost_no_scan_of_their_own(spark, monkeypatch):
    from plumbline.plans import quality as Q

    rows = [(1, "x", 1.0), (1, "x", 1.0), (None, "NA", float("nan")), (4, None, 2.0)] * 5
    df = spark.createDataFrame(rows, "a int, b string, c double")
    report = Q.assess_data_quality(df)
    monkeypatch.setattr(Q, "raw_missing_cells", None)
    row = report.report_metrics.first()
    assert (row.n_rows, row.n_missing_cells, row.n_duplicate_rows) == (20, 15, 17)


def test_duplicates_take_two_scans(spark, monkeypatch):
    """The rows are read once for their keys and once to be compared, however small the bit table."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(i % 700, f"t{i % 700}", None if i % 7 else 0.0 if i % 2 else -0.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, t string, x double").mapInArrow(counted, "k long, t string, x double")
    want = {"total_rows": 1000, "duplicate_count": 1000 - len({repr(r).replace("-0.0", "0.0") for r in rows})}
    assert duplicate_figures(frame_of(df)) == want
    assert read.value == 2000
    monkeypatch.setattr("plumbline.operators.duplicates.FILTER_BITS", 64)
    assert duplicate_figures(frame_of(df)) == want
