"""Readiness for time series, judged per value column and rolled up."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import astuple
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.rules import first_match
from plumbline.operators.gaps import GapStats, gap_stats, series_gap_stats
from plumbline.operators.local import local_table
from plumbline.operators.outliers import iqr_outliers
from plumbline.operators.profile import Column_, Profile
from plumbline.plans.labels import FIT_COLORS
from plumbline.plans.readiness.verdict import Criterion, Readiness, Rulebook, judge

TIME_SERIES = Rulebook(
    name="time_series",
    essential=[
        ("F1", "time_selected"),
        ("F2", "time_selected AND time_valid"),
        ("F3", "value_selected"),
        ("F4", "CASE WHEN value_selected THEN value_numeric END"),
        ("F5", "CASE WHEN value_selected THEN n_points >= 20 END"),
        ("F6", "CASE WHEN value_selected THEN value_unique >= 2 END"),
    ],
    points=[
        Criterion(
            "R1",
            35,
            [("n_points >= 100", 35), ("n_points >= 50", 28), ("n_points >= 30", 20), ("n_points >= 20", 10)],
        ),
        Criterion(
            "R2", 20, [("gap_cv < 0.10", 20), ("gap_cv < 0.30", 15), ("gap_cv < 0.50", 10), ("gap_cv < 1.00", 5)]
        ),
        Criterion(
            "R3", 15, [("repeat_share < 0.05", 15), ("repeat_share < 0.15", 10), ("repeat_share < 0.30", 5)]
        ),
        Criterion(
            "R4",
            20,
            [
                ("time_missing < 0.01 AND value_missing < 0.05", 20),
                ("time_missing < 0.05 AND value_missing < 0.20", 15),
                ("time_missing < 0.10 AND value_missing < 0.40", 8),
            ],
        ),
        Criterion("R5", 10, [("outlier_rate <= 0.10", 10), ("outlier_rate <= 0.20", 5)]),
    ],
    messages=[
        ("few_points", "n_points >= 20 AND n_points < 30"),
        ("repeated_times", "repeat_share >= 0.30"),
        ("irregular_gaps", "gap_cv >= 0.50"),
        ("business_days", "business_day_like"),
        ("time_missing", "time_missing >= 0.05"),
        ("value_missing", "value_missing >= 0.20"),
        ("outliers_high", "outlier_rate > 0.20"),
        ("forecast_needs_stationarity", "passed AND forecast_model"),
    ],
    summary=[
        "n_valid",
        "n_points",
        "repeat_share",
        "gap_cv",
        "gap_cv_raw",
        "time_missing",
        "value_missing",
        "value_unique",
        "outlier_rate",
    ],
)

GAP_SCHEMA = (
    "n_rows bigint, n_points bigint, unit string, mean_gap double, sd_gap double, min_gap double, "
    "median_gap double, small_share double, cv_raw double, cv double, business_day_like boolean"
)

# Verdict over all value columns.
OVERALL = [("n_fit = n_columns", "fit"), ("n_fit + n_partly > 0", "partly")]


def is_valid_time(column: Column_) -> bool:
    """Dates, date-like text or numbers, or a number with at least 20 distinct values."""
    return (
        column.kind in ("date", "timestamp")
        or column.is_time_candidate
        or (column.kind == "numeric" and (column.n_unique or 0) >= 20)
    )


def series_figures(
    time: Column_ | None, value: Column_, forecast_model: bool, rate: float | None, stats: GapStats | None
) -> dict[str, object]:
    n_valid = stats.n_rows if stats else 0
    n_points = stats.n_points if stats else 0
    return {
        "time_selected": time is not None,
        "time_valid": time is not None and is_valid_time(time),
        "value_selected": True,
        "value_numeric": value.kind == "numeric" and value.variable_type == "numeric",
        "n_valid": n_valid,
        "n_points": n_points,
        "repeat_share": (n_valid - n_points) / n_valid if n_valid else None,
        "gap_cv": stats.cv if stats else None,
        "gap_cv_raw": stats.cv_raw if stats else None,
        "business_day_like": bool(stats and stats.business_day_like),
        "time_missing": time.missing_rate if time else 1.0,
        "value_missing": value.missing_rate,
        "value_unique": value.n_unique or 0,
        "outlier_rate": rate,
        "forecast_model": bool(forecast_model),
    }


def series_gaps(profile: Profile, time: Column_ | None, values: Sequence[Column_]) -> dict[str, GapStats]:
    """Spacing of the times at which each value column has a value, in the passes of one column."""
    if time is None:
        return {}
    present = [profile.frame.present(v.pos) for v in values]
    return {v.variable: s for v, s in zip(values, series_gap_stats(profile.frame, time, present))}


def spacing_table(spark: SparkSession, gaps: dict[str, GapStats]) -> DataFrame:
    """The spacing figures, one row per value column."""
    return local_table(spark, [(name, *astuple(s)) for name, s in gaps.items()], f"variable string, {GAP_SCHEMA}")


def check_timeseries(
    profile: Profile,
    time_var: str | None = None,
    analysis_vars: Sequence[str] = (),
    forecast_model: bool = False,
) -> Readiness:
    """One verdict per value column, then the roll-up; a failed column has no score."""
    spark, names = profile.frame.df.sparkSession, profile.frame.names
    time = profile.named(time_var) if time_var is not None and time_var in names else None
    values = [profile.named(v) for v in dict.fromkeys(analysis_vars) if v in names]
    if not values:
        figures = {
            "time_selected": time is not None,
            "time_valid": time is not None and is_valid_time(time),
            "value_selected": False,
        }
        figures |= {"value_numeric": False, "n_points": None, "value_unique": None}
        empty = {n: None for n in TIME_SERIES.summary if n not in figures}
        empty |= {"business_day_like": False, "forecast_model": False}
        book = Rulebook(
            "time_series",
            TIME_SERIES.essential,
            TIME_SERIES.points,
            [("no_value_column", "true")],
            (),
            TIME_SERIES.summary,
        )
        return judge(spark, book, figures | empty)

    numeric = [v for v in values if v.variable_type == "numeric" and v.kind == "numeric"]
    outliers, gaps = iqr_outliers(profile, numeric), series_gaps(profile, time, values)
    spacing = spacing_table(spark, gaps)
    parts = {
        v.variable: judge(
            spark,
            TIME_SERIES,
            series_figures(time, v, forecast_model, outliers.rate(v) if v in numeric else None, gaps.get(v.variable)),
        )
        for v in values
    }

    def together(pick) -> DataFrame:
        return reduce(
            DataFrame.unionByName,
            [pick(r).withColumn("variable", F.lit(name)) for name, r in parts.items()],
        )

    passed = together(lambda r: r.essential).groupBy("variable").agg(
        F.bool_and(F.coalesce("passed", F.lit(False))).alias("passed")
    )
    per_column = (
        together(lambda r: r.result)
        .join(F.broadcast(passed), "variable")
        .withColumn("score", F.when(F.col("passed"), F.col("score")))
    )
    result = (
        per_column.agg(
            F.count(F.lit(1)).alias("n_columns"),
            F.count_if(F.expr("status = 'fit'")).alias("n_fit"),
            F.count_if(F.expr("status = 'partly'")).alias("n_partly"),
            F.avg("score").alias("score"),
        )
        .withColumn("status", first_match(OVERALL, "unfit"))
        .select(
            F.lit("time_series").alias("purpose"),
            "status",
            first_match([(f"status = '{s}'", c) for s, c in FIT_COLORS.items()], "secondary").alias("color"),
            "score",
        )
    )
    if len(parts) == 1:
        only = next(iter(parts.values()))
        return Readiness(
            "time_series", result, only.essential, only.score_detail, only.summary, only.messages
        ).with_details(per_column=per_column, spacing=spacing)

    def prefixed(pick, key: str) -> DataFrame:
        return together(pick).withColumn(key, F.concat_ws(".", "variable", key)).drop("variable")

    messages = (
        together(lambda r: r.messages)
        .groupBy("kind", "code")
        .agg(F.min("message_no").alias("message_no"))
        .select("message_no", "kind", "code")
    )
    return Readiness(
        "time_series",
        result,
        prefixed(lambda r: r.essential, "criterion"),
        prefixed(lambda r: r.score_detail, "criterion"),
        prefixed(lambda r: r.summary, "item"),
        messages,
    ).with_details(per_column=per_column, spacing=spacing)


def gap_table(profile: Profile, time_var: str, value_var: str | None = None) -> DataFrame:
    """Spacing of the distinct time points as a one-row table."""
    present = profile.frame.present(profile.named(value_var).pos) if value_var else None
    s = gap_stats(profile.frame, profile.named(time_var), present)
    return local_table(profile.frame.df.sparkSession, [astuple(s)], GAP_SCHEMA)
