"""Readiness for regression and classification models."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators.clean import predictors
from plumbline.operators.profile import Profile
from plumbline.plans.readiness.measures import (
    level_sizes,
    mean,
    outlier_columns,
    outlier_rates,
    predictor_table,
    predictors_of,
    scan,
)
from plumbline.plans.readiness.verdict import Criterion, Readiness, Rulebook, judge


def _missing(code: str) -> Criterion:
    return Criterion(
        code,
        10,
        [("avg_missing_rate < 0.05", 10), ("avg_missing_rate < 0.20", 7), ("avg_missing_rate < 0.40", 3)],
    )


REGRESSION = Rulebook(
    name="regression",
    essential=[
        ("F1", "response_selected"),
        ("F2", "response_selected AND response_numeric"),
        ("F3", "n_candidates >= 1"),
        ("F4", "n_valid >= 30"),
        ("F5", "response_selected AND response_unique >= 2"),
        ("F6", "n_modelable >= 1"),
    ],
    points=[
        Criterion(
            "R1",
            30,
            [("n_valid >= 200", 30), ("n_valid >= 100", 24), ("n_valid >= 50", 18), ("n_valid >= 30", 10)],
        ),
        Criterion(
            "R2",
            20,
            [("rows_per_predictor >= 10", 20), ("rows_per_predictor >= 5", 15), ("rows_per_predictor >= 3", 8)],
            3,
        ),
        Criterion(
            "R3",
            20,
            [
                ("response_missing < 0.05 AND response_unique >= 10", 20),
                ("response_missing < 0.20 AND response_unique >= 5", 15),
                ("response_missing < 0.40 AND response_unique >= 2", 8),
            ],
        ),
        Criterion(
            "R4", 15, [("usable_share >= 0.80", 15), ("usable_share >= 0.50", 10), ("usable_share >= 0.20", 5)]
        ),
        _missing("R5"),
        Criterion("R6", 5, [("avg_outlier_rate <= 0.10", 5), ("avg_outlier_rate <= 0.20", 3)]),
    ],
    messages=[
        ("response_few_values", "response_selected AND response_unique BETWEEN 2 AND 4"),
        ("overfitting_risk", "rows_per_predictor < 3"),
        ("response_missing_high", "response_missing >= 0.40"),
        ("missing_high", "avg_missing_rate >= 0.40"),
        ("response_outliers_high", "response_outlier_rate > 0.20"),
    ],
    summary=[
        "n_candidates",
        "n_modelable",
        "n_valid",
        "rows_per_predictor",
        "response_missing",
        "response_unique",
        "usable_share",
        "avg_missing_rate",
        "response_outlier_rate",
        "avg_outlier_rate",
    ],
)

CLASSIFICATION = Rulebook(
    name="classification",
    essential=[
        ("F1", "response_selected"),
        ("F2", "response_selected AND response_categorical"),
        ("F3", "n_class >= 2"),
        ("F4", "n_candidates >= 1"),
        ("F5", "n_valid >= 30"),
        ("F6", "min_class >= 2"),
        ("F7", "n_modelable >= 1"),
    ],
    points=[
        Criterion(
            "R1",
            25,
            [("n_valid >= 200", 25), ("n_valid >= 100", 20), ("n_valid >= 50", 15), ("n_valid >= 30", 8)],
        ),
        Criterion(
            "R2",
            20,
            [("min_class >= 20", 20), ("min_class >= 10", 15), ("min_class >= 5", 8), ("min_class >= 2", 3)],
        ),
        Criterion(
            "R3",
            20,
            [
                ("n_class = 2 AND min_class_share >= 0.30", 20),
                ("n_class = 2 AND min_class_share >= 0.20", 16),
                ("n_class = 2 AND min_class_share >= 0.10", 10),
                ("n_class = 2 AND min_class_share >= 0.05", 5),
                ("n_class > 2 AND min_class_share >= 0.15", 20),
                ("n_class > 2 AND min_class_share >= 0.10", 16),
                ("n_class > 2 AND min_class_share >= 0.05", 10),
                ("n_class > 2 AND min_class_share >= 0.02", 5),
            ],
        ),
        Criterion(
            "R4",
            15,
            [("rows_per_predictor >= 10", 15), ("rows_per_predictor >= 5", 11), ("rows_per_predictor >= 3", 6)],
            2,
        ),
        Criterion(
            "R5", 10, [("usable_share >= 0.80", 10), ("usable_share >= 0.50", 7), ("usable_share >= 0.20", 3)]
        ),
        _missing("R6"),
    ],
    messages=[
        ("many_classes", "n_class > 10"),
        ("multi_class", "n_class BETWEEN 3 AND 10"),
        ("two_classes", "n_class = 2"),
        ("class_very_small", "n_class >= 2 AND min_class < 5"),
        ("imbalance", "n_class = 2 AND min_class_share < 0.10"),
        ("rare_class", "n_class >= 3 AND min_class_share < 0.05"),
        ("overfitting_risk", "rows_per_predictor < 3"),
        ("missing_high", "avg_missing_rate >= 0.40"),
    ],
    notes=[
        ("numeric_predictors", "n_numeric_modelable >= 1"),
        ("categorical_predictors", "n_categorical_modelable >= 1"),
    ],
    summary=[
        "n_candidates",
        "n_modelable",
        "n_numeric_modelable",
        "n_categorical_modelable",
        "n_valid",
        "n_class",
        "min_class",
        "min_class_share",
        "rows_per_predictor",
        "usable_share",
        "avg_missing_rate",
    ],
)


def _common(profile: Profile, response: str | None, chosen: object, purpose: str):
    names = profile.frame.names
    selected = response is not None and response in names
    y = profile.named(response) if selected else None
    found = predictors_of(profile, predictors(names, chosen, response if selected else None), purpose)
    modelable = [p.column for p in found if p.is_modelable]
    rates = [p.column.missing_rate for p in found]
    figures: dict[str, object] = {
        "response_selected": selected,
        "n_candidates": len(found),
        "n_modelable": len(modelable),
        "n_numeric_modelable": sum(p.role == "numeric" for p in found),
        "n_categorical_modelable": sum(p.role == "categorical" for p in found),
        "usable_share": len(modelable) / len(found) if found else None,
        "avg_missing_rate": mean([y.missing_rate, *rates]) if y else None,
    }
    usable = None
    if y and modelable:
        usable = profile.frame.present(y.pos) & profile.frame.any_present([c.pos for c in modelable])
    return y, found, modelable, figures, usable


def check_regression(
    profile: Profile, y_var: str | None = None, x_vars: object = None
) -> Readiness:
    """Regression: response, usable predictors and rows that carry both."""
    y, found, modelable, figures, usable = _common(profile, y_var, x_vars, "regression")
    response_numeric = bool(
        y and y.kind == "numeric" and y.variable_type in ("numeric", "numeric_categorical")
    )
    numbers = [p.column for p in found if p.role == "numeric"]
    watched = ([y] if response_numeric else []) + numbers
    _, outside = outlier_columns(profile, watched)
    measured = dict(outside)
    if usable is not None:
        measured["n_valid"] = F.count_if(usable)
    counted = scan(profile, measured)
    n_valid = counted.get("n_valid", 0)
    rates = outlier_rates(watched, counted)
    figures |= {
        "response_numeric": response_numeric,
        "response_missing": y.missing_rate if y else None,
        "response_unique": (y.n_unique or 0) if y else 0,
        "n_valid": n_valid,
        "rows_per_predictor": n_valid / len(modelable) if modelable else None,
        "response_outlier_rate": rates[0] if response_numeric else None,
        "avg_outlier_rate": mean(rates) if response_numeric else None,
    }
    return judge(profile.frame.df.sparkSession, REGRESSION, figures).with_details(
        predictors=predictor_table(profile, found)
    )


def check_classification(
    profile: Profile, y_var: str | None = None, x_vars: object = None
) -> Readiness:
    """Classification: classes among usable rows and their balance."""
    y, found, modelable, figures, usable = _common(profile, y_var, x_vars, "classification")
    levels = {"n_levels": 0, "min_level": 0, "n_valid": 0}
    if usable is not None:
        levels = level_sizes(profile, y, usable).first().asDict()
    n_valid = levels["n_valid"]
    figures |= {
        "response_categorical": bool(
            y
            and (
                y.variable_type in ("categorical", "numeric_categorical")
                or y.kind in ("string", "boolean")
            )
        ),
        "n_valid": n_valid,
        "n_class": levels["n_levels"],
        "min_class": levels["min_level"],
        "min_class_share": levels["min_level"] / n_valid if n_valid else None,
        "rows_per_predictor": n_valid / len(modelable) if modelable else None,
    }
    return judge(profile.frame.df.sparkSession, CLASSIFICATION, figures).with_details(
        predictors=predictor_table(profile, found)
    )
