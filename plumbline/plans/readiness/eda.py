"""Readiness for basic statistics and frequencies, correlation, dimension reduction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import functions as F

from plumbline.operators.profile import Profile
from plumbline.plans.readiness.measures import mean, outlier_columns, outlier_rates, scan
from plumbline.plans.readiness.verdict import Criterion, Readiness, Rulebook, judge

EDA = Rulebook(
    name="basic_stats",
    essential=[
        ("F1", "n_analyzable >= 1"),
        ("F2", "CASE WHEN n_analyzable >= 1 THEN n_valid >= 10 END"),
    ],
    points=[
        Criterion(
            "R1",
            35,
            [("n_valid >= 50", 35), ("n_valid >= 30", 28), ("n_valid >= 20", 20), ("n_valid >= 10", 10)],
        ),
        Criterion(
            "R2",
            20,
            [
                ("n_numeric >= 3 AND n_valid >= n_numeric * 5", 20),
                ("n_numeric >= 3", 16),
                ("n_numeric = 2", 12),
                ("n_numeric = 1", 6),
            ],
        ),
        Criterion(
            "R3", 20, [("n_categorical >= 3", 20), ("n_categorical = 2", 15), ("n_categorical = 1", 8)]
        ),
        Criterion(
            "R4",
            20,
            [
                ("avg_missing_rate < 0.05", 20),
                ("avg_missing_rate < 0.20", 15),
                ("avg_missing_rate < 0.40", 8),
                ("avg_missing_rate < 0.60", 3),
            ],
        ),
        Criterion(
            "R5",
            5,
            [("n_numeric = 0", 5), ("avg_outlier_rate <= 0.10", 5), ("avg_outlier_rate <= 0.20", 3)],
        ),
    ],
    messages=[
        ("no_analyzable_columns", "n_analyzable < 1"),
        ("too_few_rows", "n_analyzable >= 1 AND n_valid < 10"),
        ("small_sample", "passed AND n_valid < 20"),
        ("no_numeric", "passed AND n_numeric = 0"),
        ("no_categorical", "passed AND n_categorical = 0"),
        ("single_variable_only", "passed AND n_numeric <= 1 AND n_categorical <= 1"),
        ("few_rows_per_numeric", "passed AND n_numeric >= 3 AND n_valid < n_numeric * 5"),
        ("missing_very_high", "passed AND avg_missing_rate >= 0.60"),
        ("missing_high", "passed AND avg_missing_rate >= 0.40 AND avg_missing_rate < 0.60"),
        ("missing_many", "passed AND avg_missing_rate >= 0.20 AND avg_missing_rate < 0.40"),
        ("outliers_high", "passed AND avg_outlier_rate > 0.20"),
        ("outliers_some", "passed AND avg_outlier_rate > 0.10 AND avg_outlier_rate <= 0.20"),
    ],
    notes=[
        ("score_meaning", "true"),
        ("numeric_and_categorical", "n_numeric > 0 AND n_categorical > 0"),
        ("categorical_only", "n_numeric = 0 AND n_categorical > 0"),
        ("numeric_only", "n_categorical = 0 AND n_numeric > 0"),
    ],
    summary=[
        "n_selected",
        "n_analyzable",
        "n_numeric",
        "n_categorical",
        "n_valid",
        "avg_missing_rate",
        "avg_outlier_rate",
    ],
)

# Purposes that need two numeric columns before the same scoring applies.
MULTIVARIATE = Rulebook(
    name="correlation",
    essential=[("F0", "n_numeric_all >= 2"), ("F0s", "n_chosen = 0 OR n_numeric >= 2"), *EDA.essential],
    points=EDA.points,
    messages=[
        ("under_two_numeric_in_table", "n_numeric_all < 2"),
        ("under_two_numeric_selected", "n_numeric_all >= 2 AND n_chosen > 0 AND n_numeric < 2"),
        *[
            (code, condition)
            for code, condition in EDA.messages
            if code not in ("no_analyzable_columns", "too_few_rows")
        ],
        ("too_few_rows", "n_numeric_all >= 2 AND (n_chosen = 0 OR n_numeric >= 2) AND n_valid < 10"),
    ],
    notes=[
        ("purpose_score_meaning", "n_numeric_all >= 2 AND (n_chosen = 0 OR n_numeric >= 2)"),
        ("numeric_only", "n_numeric_all >= 2 AND (n_chosen = 0 OR n_numeric >= 2)"),
    ],
    summary=EDA.summary,
)


def eda_figures(profile: Profile, names: Sequence[str] | None) -> dict[str, object]:
    """Usable rows (any analyzable column present), type counts, missing, outliers."""
    chosen = [c for c in profile.columns if names is None or c.variable in names]
    numeric = [c for c in chosen if c.variable_type == "numeric"]
    categorical = [
        c for c in chosen if c.variable_type in ("categorical", "numeric_categorical")
    ]
    analyzable = [c for c in chosen if c in numeric or c in categorical]
    _, outside = outlier_columns(profile, numeric)
    frame = profile.frame
    found = (
        scan(profile, {"n_valid": F.count_if(frame.any_present([c.pos for c in analyzable])), **outside})
        if analyzable
        else {"n_valid": 0}
    )
    return {
        "n_selected": len(chosen),
        "n_analyzable": len(analyzable),
        "n_numeric": len(numeric),
        "n_categorical": len(categorical),
        "n_valid": found["n_valid"],
        "avg_missing_rate": mean([c.missing_rate for c in analyzable]),
        "avg_outlier_rate": mean(outlier_rates(numeric, found)),
    }


def check_eda(
    profile: Profile, names: Sequence[str] | None = None, purpose: str = "basic_stats"
) -> Readiness:
    """Basic statistics (``basic_stats``) or category frequencies (``visualization``)."""
    spark = profile.frame.df.sparkSession
    return judge(spark, replace(EDA, name=purpose), eda_figures(profile, names))


def has_two_numeric(profile: Profile, names: Sequence[str] = ()) -> bool:
    """At least two ``numeric`` columns, in the table or among the given names."""
    return sum(c.variable_type == "numeric" and (not names or c.variable in names) for c in profile.columns) >= 2


def check_multivariate(profile: Profile, names: Sequence[str] = (), purpose: str = "correlation") -> Readiness:
    """Correlation or dimension reduction over the ``numeric`` columns."""
    every = [c.variable for c in profile.of_type("numeric")]
    numeric = [n for n in every if n in names] if names else every
    figures = eda_figures(profile, numeric)
    figures |= {"n_numeric_all": len(every), "n_chosen": len(names)}
    return judge(profile.frame.df.sparkSession, replace(MULTIVARIATE, name=purpose), figures)
