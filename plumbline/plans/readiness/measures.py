"""Figures several purposes share: usable rows, outlier shares, usable predictors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.local import local_table
from plumbline.operators.outliers import Fence, fences
from plumbline.operators.profile import Column_, Profile


def mean(values: Sequence[float]) -> float | None:
    return sum(values) / len(values) if values else None


def scan(profile: Profile, figures: Mapping[str, Column]) -> dict[str, object]:
    """Several figures from one pass over the table."""
    if not figures:
        return {}
    row = profile.frame.df.agg(*[c.alias(n) for n, c in figures.items()]).first()
    return row.asDict()


def outlier_columns(
    profile: Profile, columns: Sequence[Column_]
) -> tuple[dict[int, Fence], dict[str, Column]]:
    """Fences of the columns and the aggregates that count values outside them."""
    bounds = fences(profile.frame, columns)
    counts = {
        f"outside{p}": F.count_if(fence.outside(profile.frame.finite(p)))
        for p, fence in bounds.items()
    }
    return bounds, counts


def outlier_rates(columns: Sequence[Column_], found: Mapping[str, object]) -> list[float]:
    """Share of values outside the fences per column; 0 for fewer than two values."""
    return [
        found.get(f"outside{c.pos}", 0) / c.n_finite if c.n_finite > 1 else 0.0 for c in columns
    ]


@dataclass(frozen=True)
class Predictor:
    """Use of one candidate column as an explanatory variable."""

    column: Column_
    role: str  # numeric, categorical or none

    @property
    def is_modelable(self) -> bool:
        return self.role != "none"

    def row(self) -> tuple:
        c = self.column
        return (
            c.variable,
            c.variable_type,
            c.n_non_missing,
            c.n_unique,
            c.missing_rate,
            c.is_id_by_ratio,
            (c.n_unique or 0) < 2,
            c.missing_rate >= 0.80,
            self.is_modelable,
            self.role,
        )


PREDICTOR_SCHEMA = (
    "variable string, variable_type string, n_non_missing bigint, n_unique bigint, "
    "missing_rate double, is_id boolean, is_single_value boolean, is_missing_excess boolean, "
    "is_modelable boolean, modelable_role string"
)


def _role(c: Column_, purpose: str) -> str:
    """Fixed rules: which columns a purpose can use, by type and number of values."""
    n = c.n_unique or 0
    if n < 2 or c.is_id_by_ratio or c.missing_rate >= 0.80:
        return "none"
    if purpose == "regression":
        if c.variable_type in ("id", "excluded", "date"):
            return "none"
        if c.kind == "numeric":
            return "numeric"
        return "categorical" if c.kind in ("string", "boolean") and n <= 20 else "none"
    if c.variable_type == "numeric":
        return "numeric"
    if c.variable_type in ("categorical", "numeric_categorical"):
        return "categorical" if purpose == "survival" or n <= 10 else "none"
    return "none"


def predictors_of(profile: Profile, names: Sequence[str], purpose: str) -> list[Predictor]:
    return [Predictor(c, _role(c, purpose)) for c in (profile.named(n) for n in names)]


def predictor_table(profile: Profile, found: Sequence[Predictor]) -> DataFrame:
    return local_table(profile.frame.df.sparkSession, [p.row() for p in found], PREDICTOR_SCHEMA)


def level_sizes(profile: Profile, column: Column_, usable: Column) -> DataFrame:
    """Level count, smallest level and row count of a column among usable rows.

    Equal levels are combined before the shuffle, so a dominant level costs one row
    per task.
    """
    counted = (
        profile.frame.df.where(usable)
        .groupBy(profile.frame.col(column.pos).alias("level"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return counted.agg(
        F.count(F.lit(1)).alias("n_levels"),
        F.coalesce(F.min("cnt"), F.lit(0)).alias("min_level"),
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_valid"),
    )
