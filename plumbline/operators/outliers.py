"""Outliers by the 1.5 x IQR fences, and box-plot summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import values as V
from plumbline.operators.clean import Frame
from plumbline.operators.local import local_table
from plumbline.operators.profile import Column_, Profile
from plumbline.operators.quartiles import quantiles

WHISKER = 1.5

OUTLIER_SCHEMA = (
    "pos int, variable string, outlier_count bigint, non_missing_count bigint, "
    "outlier_rate double, outlier_percent double, lower_bound double, upper_bound double"
)


@dataclass(frozen=True)
class Fence:
    """Quartiles and outlier fences of one numeric column (finite values only)."""

    q1: float
    q3: float

    @property
    def iqr(self) -> float:
        return self.q3 - self.q1

    @property
    def lower(self) -> float:
        return self.q1 - WHISKER * self.iqr

    @property
    def upper(self) -> float:
        return self.q3 + WHISKER * self.iqr

    def outside(self, value: Column) -> Column:
        if self.iqr == 0:
            return F.lit(False)
        return (value < F.lit(self.lower)) | (value > F.lit(self.upper))


def finite_frame(frame: Frame, positions: Sequence[int]) -> DataFrame:
    """The chosen numeric columns as doubles, NULL when missing or infinite."""
    return frame.df.select(*[frame.finite(p).alias(f"c{p}") for p in positions])


def fences(frame: Frame, columns: Sequence[Column_], **options: int) -> dict[int, Fence]:
    """Exact quartiles per column position; columns without a finite value are left out."""
    chosen = [c for c in columns if c.kind == "numeric" and c.n_finite > 0]
    if not chosen:
        return {}
    found = quantiles(
        finite_frame(frame, [c.pos for c in chosen]),
        {f"c{c.pos}": c.n_finite for c in chosen},
        [0.25, 0.75],
        **options,
    )
    return {c.pos: Fence(*found[f"c{c.pos}"]) for c in chosen}


def outlier_counts(frame: Frame, bounds: dict[int, Fence]) -> dict[int, int]:
    """Rows outside the fences, all columns in one scan."""
    if not bounds:
        return {}
    row = (
        finite_frame(frame, list(bounds))
        .agg(
            *[
                F.count_if(fence.outside(F.col(f"c{p}"))).alias(f"c{p}")
                for p, fence in bounds.items()
            ]
        )
        .first()
    )
    return {p: row[f"c{p}"] for p in bounds}


def outlier_rate(fence: Fence | None, value: Column) -> Column:
    """Aggregate: share of finite values outside the fences (0 for under two values)."""
    if fence is None:
        return F.lit(0.0)
    n = F.count(value)
    return F.when(n < 2, F.lit(0.0)).otherwise(V.ratio(F.count_if(fence.outside(value)), n))


@dataclass(frozen=True)
class Outliers:
    """Fences and counts for the ``numeric`` columns of a profile."""

    columns: tuple[Column_, ...]
    fences: dict[int, Fence]
    counts: dict[int, int]

    def rate(self, column: Column_) -> float:
        n = column.n_finite
        return self.counts.get(column.pos, 0) / n if n > 1 else 0.0

    def table(self, profile: Profile) -> DataFrame:
        """One row per ``numeric`` column."""
        rows = []
        for c in self.columns:
            fence = self.fences.get(c.pos)
            rows.append(
                (
                    c.pos,
                    c.variable,
                    self.counts.get(c.pos, 0),
                    c.n_finite,
                    None if fence is None else fence.lower,
                    None if fence is None else fence.upper,
                )
            )
        base = local_table(
            profile.frame.df.sparkSession,
            rows,
            "pos int, variable string, outlier_count bigint, non_missing_count bigint, "
            "lower_bound double, upper_bound double",
        )
        rate = V.ratio(F.col("outlier_count"), F.col("non_missing_count"))
        return base.select(
            "pos",
            "variable",
            "outlier_count",
            "non_missing_count",
            V.rounded(rate, 4).alias("outlier_rate"),
            V.percent(rate).alias("outlier_percent"),
            "lower_bound",
            "upper_bound",
        )


def iqr_outliers(profile: Profile, columns: Sequence[Column_] | None = None, **options: int) -> Outliers:
    """Fences and outlier counts of the ``numeric`` columns (or the given ones)."""
    chosen = profile.of_type("numeric") if columns is None else list(columns)
    bounds = fences(profile.frame, chosen, **options)
    return Outliers(tuple(chosen), bounds, outlier_counts(profile.frame, bounds))


def box_summary(profile: Profile, outliers: Outliers, top: int = 20) -> DataFrame:
    """Box-plot figures of the columns with most outliers: quartiles, median, whiskers."""
    spark = profile.frame.df.sparkSession
    schema = (
        "pos int, variable string, q1 double, median double, q3 double, "
        "whisker_low double, whisker_high double, outlier_count bigint, value_count bigint"
    )
    ranked = sorted(
        (c for c in outliers.columns if outliers.counts.get(c.pos, 0) > 0),
        key=lambda c: (-round(outliers.rate(c) * 100, 2), c.pos),
    )[:top]
    if not ranked:
        return local_table(spark, [], schema)
    data = finite_frame(profile.frame, [c.pos for c in ranked])
    middle = quantiles(data, {f"c{c.pos}": c.n_finite for c in ranked}, [0.5])
    ends = []
    for c in ranked:
        fence, value = outliers.fences[c.pos], F.col(f"c{c.pos}")
        kept = F.when(~fence.outside(value), value)
        ends += [F.min(kept).alias(f"lo{c.pos}"), F.max(kept).alias(f"hi{c.pos}")]
    row = data.agg(*ends).first()
    return local_table(
        spark,
        [
            (
                c.pos,
                c.variable,
                outliers.fences[c.pos].q1,
                middle[f"c{c.pos}"][0],
                outliers.fences[c.pos].q3,
                row[f"lo{c.pos}"],
                row[f"hi{c.pos}"],
                outliers.counts[c.pos],
                c.n_finite,
            )
            for c in ranked
        ],
        schema,
    )
