"""Differences between neighbouring distinct values, for series and sequences."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import values as V
from plumbline.operators.clean import Frame
from plumbline.operators.profile import Column_
from plumbline.operators.quartiles import quantiles
from plumbline.operators.shared import ensure_checkpoint_dir

ROWS_PER_TASK = 1_000_000
DAY = float(V.SECONDS_PER_DAY)


def previous_values(
    points: DataFrame, series: Sequence[str], n: int, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Per series and row of ``points`` (distinct ``t``) the series' last value before, as ``p0``, ``p1``, ...

    ``series`` names columns that rise with ``t`` and are NULL where the series has no value.  All of
    them share one order: the rows are range-partitioned by ``t``, each range is ordered on its own,
    and a series without an earlier value in a range takes it from an edge table that holds, per
    range and series, the last value of all ranges before (one row per range).  The ranged rows are
    checkpointed, because both uses must see the same range borders even if an executor is lost
    in between; few rows are one range and need neither.
    """
    earlier = (Window.unboundedPreceding, -1)
    ranges = max(1, -(-n // rows_per_task))
    if ranges == 1:
        window = Window.orderBy("t").rowsBetween(*earlier)
        return points.select("*", *[F.last(c, ignorenulls=True).over(window).alias(f"p{i}") for i, c in enumerate(series)])
    ensure_checkpoint_dir(points.sparkSession)
    ranged = points.repartitionByRange(ranges, "t").withColumn("b", F.spark_partition_id()).checkpoint()
    edges = ranged.groupBy("b").agg(F.min("t").alias("lo"), *[F.max(c).alias(f"hi{i}") for i, c in enumerate(series)])
    before = Window.orderBy("lo").rowsBetween(*earlier)
    carried = [F.last(f"hi{i}", ignorenulls=True).over(before).alias(f"before{i}") for i in range(len(series))]
    within = Window.partitionBy("b").orderBy("t").rowsBetween(*earlier)
    last = [F.last(c, ignorenulls=True).over(within).alias(f"last{i}") for i, c in enumerate(series)]
    joined = ranged.select("*", *last).join(F.broadcast(edges.select("b", *carried)), "b")
    found = [F.coalesce(f"last{i}", f"before{i}").alias(f"p{i}") for i in range(len(series))]
    return joined.select(*points.columns, *found)


def ordered_gaps(
    distinct: DataFrame, value: str, n: int, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Difference of every distinct value to the next smaller one (n - 1 rows, ``gap``)."""
    points = distinct.select(F.col(value).alias("t"))
    found = previous_values(points, ["t"], n, rows_per_task)
    return found.select((F.col("t") - F.col("p0")).alias("gap")).where("gap IS NOT NULL")


def time_value(frame: Frame, column: Column_) -> tuple[Column, bool]:
    """The time axis of a column as a double, and whether its unit is seconds.

    Dates, timestamps, date text and whole YYYYMMDD numbers become seconds; any other
    number stands for itself.
    """
    c, dtype, kind = frame.col(column.pos), frame.dtypes[column.pos], column.kind
    if kind in ("date", "timestamp"):
        return V.seconds_from_timestamp(f"c{column.pos}", dtype), True
    if kind == "string":
        return F.expr(V.seconds_from_text(f"c{column.pos}")).cast("double"), True
    if kind == "numeric" and column.is_time_candidate:
        return F.expr(V.seconds_from_compact_number(f"CAST(c{column.pos} AS DOUBLE)")).cast("double"), True
    if kind == "numeric":
        return F.when(frame.present(column.pos), c.cast("double")), False
    return F.lit(None).cast("double"), False


def civil_seconds(frame: Frame, column: Column_, t: Column) -> Column:
    """The wall clock of a time axis: a timestamp as the session's time zone shows it.

    Whether times are at midnight, and how many days lie between them, is a matter of the
    calendar and not of UTC; ``t`` itself for anything but timestamps.
    """
    if column.kind == "timestamp":
        return V.seconds_from_timestamp(f"CAST(c{column.pos} AS TIMESTAMP_NTZ)", T.TimestampNTZType())
    return t


@dataclass(frozen=True)
class GapStats:
    """Spacing of the distinct time points of a series."""

    n_rows: int
    n_points: int
    unit: str
    mean: float | None
    sd: float | None
    smallest: float | None
    median: float | None
    small_share: float | None
    cv_raw: float | None
    cv: float | None
    business_day_like: bool


def time_points(frame: Frame, time_column: Column_, present: Sequence[Column]) -> DataFrame:
    """The distinct times with ``civil`` and, per condition, how many rows hold it (``n0``, ``n1``, ...).

    One shuffle serves all value columns of a series.
    """
    t, _ = time_value(frame, time_column)
    conditions = [ok.alias(f"ok{i}") for i, ok in enumerate(present)]
    rows = frame.df.select(t.alias("t"), civil_seconds(frame, time_column, t).alias("civil"), *conditions)
    counts = [F.count_if(F.col(f"ok{i}")).alias(f"n{i}") for i in range(len(present))]
    return rows.where("t IS NOT NULL").groupBy("t").agg(F.min("civil").alias("civil"), *counts)


def gap_stats(
    frame: Frame,
    time_column: Column_,
    value_present: Column | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> GapStats:
    """Count, spread and regularity of the distinct time points (rows with a value)."""
    present = F.lit(True) if value_present is None else value_present
    return series_gap_stats(frame, time_column, [present], rows_per_task)[0]


def series_gap_stats(
    frame: Frame, time_column: Column_, present: Sequence[Column], rows_per_task: int = ROWS_PER_TASK
) -> list[GapStats]:
    """:func:`gap_stats` of several series, one per condition, with the passes of a single one."""
    if not present:
        return []
    points = time_points(frame, time_column, present).persist()
    try:
        return _spacings(frame, time_column, points, len(present), rows_per_task)
    finally:
        points.unpersist()


def _spacings(
    frame: Frame, time_column: Column_, points: DataFrame, n_series: int, rows_per_task: int
) -> list[GapStats]:
    """The spacing of each series among the :func:`time_points`: those with a count ``n<i>`` above zero."""
    in_seconds, series = time_value(frame, time_column)[1], range(n_series)
    tests = [F.count(F.lit(1)).alias("points")]
    for i in series:
        has = F.col(f"n{i}") > 0
        tests += [
            F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"rows{i}"),
            F.count_if(has).alias(f"points{i}"),
            F.bool_and(F.when(has, F.pmod(F.col("civil"), F.lit(DAY)) == 0)).alias(f"midnight{i}"),
        ]
    head = points.agg(*tests).first()
    units = ["number" if not in_seconds else "day" if head[f"midnight{i}"] else "second" for i in series]
    long = [i for i in series if head[f"points{i}"] >= 3]
    found: dict[int, GapStats] = {}
    if long:
        axis = [
            F.when(F.col(f"n{i}") > 0, F.col("civil") / F.lit(DAY) if units[i] == "day" else F.col("t")).alias(f"x{i}")
            for i in long
        ]
        ordered = previous_values(points.select("t", *axis), [f"x{i}" for i in long], head["points"], rows_per_task)
        gaps = ordered.select(*[(F.col(f"x{i}") - F.col(f"p{k}")).alias(f"gap{i}") for k, i in enumerate(long)]).persist()
        figures = []
        for i in long:
            gap = F.col(f"gap{i}")
            figures += [
                F.avg(gap).alias(f"mean{i}"),
                F.stddev_samp(gap).alias(f"sd{i}"),
                F.min(gap).alias(f"smallest{i}"),
                F.avg(gap.between(1, 4).cast("double")).alias(f"small{i}"),
            ]
        stats = gaps.agg(*figures).first()
        medians = quantiles(gaps, {f"gap{i}": head[f"points{i}"] - 1 for i in long}, [0.5])
        gaps.unpersist()
        for i in long:
            mean, sd, median = stats[f"mean{i}"], stats[f"sd{i}"], medians[f"gap{i}"][0]
            cv = 0.0 if not mean or sd is None else sd / mean
            small = stats[f"small{i}"]
            trading = bool(
                time_column.is_time_candidate and stats[f"smallest{i}"] >= 1 and median <= 1.5 and small >= 0.60
            )
            found[i] = GapStats(
                head[f"rows{i}"], head[f"points{i}"], units[i], mean, sd, stats[f"smallest{i}"], median, small,
                cv, min(cv, 0.05) if trading else cv, trading,
            )
    short = [None] * 7
    return [found.get(i) or GapStats(head[f"rows{i}"], head[f"points{i}"], units[i], *short, False) for i in series]


#: Whole numbers up to here have an exact successor as a double.
LARGEST_EXACT = float(1 << 53)
#: New values per bucket of a sequence; a bucket's last bit repeats the first of the next one.
BUCKET = 63


def whole_columns(frame: Frame, columns: Sequence[Column_]) -> list[Column_]:
    """The columns that hold whole numbers only: one aggregate, no shuffle of values."""
    tests = [
        F.bool_and(frame.finite(c.pos) == F.floor(frame.finite(c.pos))).alias(f"w{c.pos}") for c in columns
    ]
    row = frame.df.agg(*tests).first()
    return [c for c in columns if row[f"w{c.pos}"]]


def sequence_buckets(frame: Frame, columns: Sequence[Column_]) -> DataFrame:
    """(pos, bucket, bits, whole): which of 63 neighbouring whole numbers occur in a column, as bits.

    Bits are combined before the shuffle, so a dense column costs one short row per 63 values.  A
    number that opens a bucket is also the last bit of the bucket before: every pair of neighbours
    lies in one bucket.
    """
    cells = []
    for c in columns:
        v = frame.finite(c.pos)
        known = F.when(F.abs(v) <= LARGEST_EXACT, F.floor(v).cast("bigint"))
        bit = F.pmod(known, F.lit(BUCKET)).cast("int")
        bucket = F.floor((known - bit) / BUCKET).cast("bigint")
        one = F.lit(1).cast("bigint")
        whole = (v == F.floor(v)) & (F.abs(v) <= LARGEST_EXACT)
        own = (bucket, F.call_function("shiftleft", one, bit), whole)
        carried = (F.when(bit == 0, bucket - 1), F.lit(-1 << 63).cast("bigint"), whole)
        for b, m, w in (own, carried):
            cells.append(F.struct(F.lit(c.pos).alias("pos"), b.alias("bucket"), m.alias("bits"), w.alias("whole"), v.alias("v")))
    rows = frame.df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    # a number beyond the exact ones keeps its row, to tell that the column isn't settled here
    rows = rows.where("v IS NOT NULL AND (bucket IS NOT NULL OR NOT whole)")
    return rows.groupBy("pos", "bucket").agg(F.bit_or("bits").alias("bits"), F.bool_and("whole").alias("whole"))


def sequence_share(frame: Frame, columns: Sequence[Column_]) -> DataFrame:
    """Share of neighbouring distinct whole values that differ by exactly one, per column.

    No ordering is needed: a bucket's bits and the same bits moved by one have the pairs in common.
    ``whole`` is false, and the share without meaning, if a value isn't whole or beyond 2^53.
    """
    bits = F.when(F.col("bucket").isNotNull(), F.col("bits")).otherwise(F.lit(0).cast("bigint"))
    pairs = F.bit_count(bits.bitwiseAND(F.shiftrightunsigned(bits, 1)))
    values = F.bit_count(bits.bitwiseAND(F.lit((1 << 63) - 1)))
    return sequence_buckets(frame, columns).groupBy("pos").agg(
        V.ratio(F.sum(pairs), F.sum(values) - F.lit(1)).alias("sequence_share"), F.bool_and("whole").alias("whole")
    )


def sequence_share_of_huge(frame: Frame, columns: Sequence[Column_]) -> DataFrame:
    """The same for values beyond 2^53, whose successor as a double may be themselves.

    A gap of one at v exists when v - 1 is present as well, so every value is marked at v and at
    v + 1 and the marks meet in a hash aggregate.
    """
    marks = F.explode(
        F.array(
            *[
                F.struct(F.lit(c.pos).alias("pos"), (v + F.lit(step)).alias("v"), F.lit(mark).alias("m"))
                for c in columns
                for v in [frame.finite(c.pos)]
                for step, mark in ((0.0, 1), (1.0, 2))
            ]
        )
    )
    rows = frame.df.select(marks.alias("x")).select("x.*").where("v IS NOT NULL")
    met = rows.groupBy("pos", "v").agg(F.bit_or("m").alias("m"))
    return met.groupBy("pos").agg(
        V.ratio(F.count_if(F.col("m") == 3), F.count_if(F.col("m").isin(1, 3)) - F.lit(1)).alias("sequence_share")
    )
