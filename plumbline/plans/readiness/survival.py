"""Readiness for survival analysis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import values as V
from plumbline.operators.clean import clean_names
from plumbline.operators.profile import Column_, Profile
from plumbline.plans.readiness.measures import predictor_table, predictors_of, scan
from plumbline.plans.readiness.verdict import Criterion, Readiness, Rulebook, judge

SURVIVAL = Rulebook(
    name="survival",
    essential=[
        ("F1", "time_selected"),
        ("F2", "time_selected AND time_valid"),
        ("F3", "event_selected"),
        ("F4", "event_selected AND event_confirmed"),
        ("F5", "n_valid >= 10"),
        ("F6", "time_unique >= 2"),
    ],
    points=[
        Criterion(
            "R1",
            30,
            [("n_valid >= 100", 30), ("n_valid >= 50", 24), ("n_valid >= 30", 18), ("n_valid >= 10", 8)],
        ),
        Criterion(
            "R2",
            25,
            [("n_events >= 30", 25), ("n_events >= 15", 18), ("n_events >= 5", 10), ("n_events >= 1", 3)],
        ),
        Criterion(
            "R3",
            20,
            [
                ("n_events = 0", 0),
                ("event_rate >= 0.20 AND event_rate <= 0.80", 20),
                ("event_rate >= 0.10 AND event_rate <= 0.90", 14),
                ("event_rate >= 0.05 AND event_rate <= 0.95", 7),
            ],
            2,
        ),
        Criterion(
            "R4",
            15,
            [("time_unique >= 30", 15), ("time_unique >= 15", 11), ("time_unique >= 5", 6), ("time_unique >= 2", 3)],
        ),
        Criterion(
            "R5",
            10,
            [
                ("time_missing < 0.05 AND event_missing < 0.05 AND zero_time_share < 0.10", 10),
                ("time_missing < 0.10 AND event_missing < 0.10 AND zero_time_share < 0.20", 7),
                ("time_missing < 0.20 AND event_missing < 0.20 AND zero_time_share < 0.30", 3),
            ],
        ),
    ],
    messages=[
        ("one_event_level", "event_levels = 1"),
        ("many_event_levels", "event_levels >= 3"),
        ("event_value_taken_as_event", "event_levels >= 3 AND event_confirmed"),
        ("few_events", "event_confirmed AND n_events < 5"),
        ("events_rare", "event_confirmed AND event_rate < 0.05"),
        ("events_dominate", "event_confirmed AND event_rate > 0.95"),
        (
            "missing_in_key_columns",
            "time_missing IS NOT NULL AND event_missing IS NOT NULL "
            "AND (time_missing >= 0.10 OR event_missing >= 0.10)",
        ),
        ("many_zero_times", "zero_time_share >= 0.10"),
        ("no_covariates", "n_candidates = 0"),
        ("covariates_usable", "n_candidates > 0 AND n_modelable >= 1"),
        ("covariates_unusable", "n_candidates > 0 AND n_modelable = 0"),
        ("categorical_covariates", "n_categorical_modelable >= 1"),
        ("few_events_per_covariate", "n_modelable >= 1 AND events_per_covariate < 5"),
    ],
    notes=[
        ("time_and_event_are_key", "true"),
        ("date_is_not_a_duration", "time_is_date"),
        ("all_events", "event_confirmed AND n_censored = 0 AND n_events > 0"),
        ("no_events", "event_confirmed AND n_events = 0"),
        ("covariates_used", "n_candidates > 0"),
        ("cox_needs_proportional_hazards", "passed AND cox_model"),
    ],
    summary=[
        "n_valid",
        "time_unique",
        "n_events",
        "n_censored",
        "event_rate",
        "time_missing",
        "event_missing",
        "zero_time_share",
        "n_candidates",
        "n_modelable",
        "events_per_covariate",
    ],
)


def duration(profile: Profile, column: Column_) -> Column:
    """The column as a duration: numbers and number text; dates are not durations."""
    c = profile.frame.col(column.pos)
    if column.kind == "numeric":
        return F.when(profile.frame.present(column.pos), c.cast("double"))
    if column.kind == "string":
        return F.expr(V.number_from_text(f"c{column.pos}"))
    return F.lit(None).cast("double")


def same_level(profile: Profile, column: Column_, level: object) -> Column:
    """Does the column hold the given level (numbers compare as numbers)?"""
    c = profile.frame.col(column.pos)
    if column.kind == "numeric":
        try:
            return c.cast("double") == F.lit(float(str(level)))
        except ValueError:
            return F.lit(False)
    if column.kind == "boolean":
        return F.upper(c.cast("string")) == F.lit(str(level).upper())
    return c.cast("string") == F.lit(str(level))


def check_survival(
    profile: Profile,
    time_var: str | None = None,
    event_var: str | None = None,
    event_value: object = None,
    single_event_is_event: bool | None = None,
    x_vars: object = None,
    cox_model: bool = False,
) -> Readiness:
    """Durations, event coding and covariates, from one scan of the table."""
    frame = profile.frame
    time = profile.named(time_var) if time_var in frame.names else None
    event = profile.named(event_var) if event_var in frame.names else None
    t = duration(profile, time) if time else F.lit(None).cast("double")
    t_raw = frame.present(time.pos) if time else F.lit(False)
    e_here = frame.present(event.pos) if event else F.lit(False)
    valid = t.isNotNull() & e_here

    levels = (event.n_unique or 0) if event else 0
    never = F.lit(False)
    is_event, is_censored, level_seen = never, never, never
    confirmed: bool | None = False
    if levels == 1 and single_event_is_event is not None:
        confirmed = True
        is_event = e_here if single_event_is_event else never
        is_censored = never if single_event_is_event else e_here
    elif levels >= 2 and event_value is not None:
        confirmed = None  # known once the level has been looked for
        hit = same_level(profile, event, event_value)
        is_event, is_censored, level_seen = hit, e_here & ~hit, hit

    found = scan(
        profile,
        {
            "n_valid": F.count_if(valid),
            "n_events": F.count_if(valid & is_event),
            "n_censored": F.count_if(valid & is_censored),
            "n_zero": F.count_if(valid & (t == 0)),
            "n_bad_time": F.count_if(t_raw & (t.isNull() | (t < 0))),
            "n_level": F.count_if(level_seen),
        },
    )
    if confirmed is None:
        confirmed = found["n_level"] > 0
    time_unique = 0
    if time and time.kind == "numeric":
        time_unique = time.n_unique or 0
    elif time and time.kind == "string":
        time_unique = frame.df.agg(F.count_distinct(t).alias("n")).first()["n"]

    chosen = [n for n in clean_names(x_vars) if n in frame.names and n not in (time_var, event_var)]
    used = predictors_of(profile, chosen, "survival")
    n_modelable = sum(p.is_modelable for p in used)
    n_valid = found["n_valid"]
    n_events = found["n_events"] if confirmed else 0
    figures = {
        "time_selected": time is not None,
        "time_valid": bool(time and time.n_non_missing > 0 and found["n_bad_time"] == 0),
        "time_is_date": bool(time and time.kind in ("date", "timestamp")),
        "event_selected": event is not None,
        "event_confirmed": confirmed,
        "event_levels": levels,
        "n_valid": n_valid,
        "time_unique": time_unique,
        "n_events": n_events,
        "n_censored": found["n_censored"] if confirmed else 0,
        "event_rate": n_events / n_valid if n_valid else None,
        "time_missing": time.missing_rate if time else None,
        "event_missing": event.missing_rate if event else None,
        "zero_time_share": found["n_zero"] / n_valid if n_valid else None,
        "n_candidates": len(used),
        "n_modelable": n_modelable,
        "n_categorical_modelable": sum(p.role == "categorical" for p in used),
        "events_per_covariate": n_events / n_modelable if n_modelable else None,
        "cox_model": bool(cox_model),
    }
    return judge(frame.df.sparkSession, SURVIVAL, figures).with_details(
        predictors=predictor_table(profile, used)
    )
