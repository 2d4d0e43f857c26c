"""One entry point for all purposes: roles in, verdict out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.clean import BadInput, clean_names
from plumbline.operators.local import local_table
from plumbline.operators.profile import Profile, profile
from plumbline.plans.readiness.clustering import check_clustering
from plumbline.plans.readiness.eda import check_eda, check_multivariate
from plumbline.plans.readiness.hypothesis import check_hypothesis
from plumbline.plans.readiness.models import check_classification, check_regression
from plumbline.plans.readiness.survival import check_survival
from plumbline.plans.readiness.timeseries import check_timeseries
from plumbline.plans.readiness.verdict import Readiness

# Names under which a caller may pass each role, first present wins.
VARIABLES = ("selected_vars", "variables", "eda_vars", "analysis_vars")
RESPONSE = ("response_var", "y_var", "target_var", "dependent_var")
CLASS_RESPONSE = ("response_var", "y_var", "target_var", "class_var", "dependent_var")
PREDICTORS = ("predictor_vars", "x_vars", "explanatory_vars", "input_vars")
GROUP = ("group_var", "group_variable")
CLUSTER = ("cluster_vars", "selected_vars", "variables", "analysis_vars")
TIME = ("time_var", "date_var", "time_variable")
SERIES = ("value_var", "value_vars", "analysis_vars", "target_vars", "selected_vars", "variables")
SURVIVAL_TIME = ("survival_time_var", "time_var", "duration_var")
EVENT = ("event_var", "status_var", "event_status_var")
COVARIATES = ("predictor_vars", "x_vars", "explanatory_vars", "covariates")
CORRELATION = ("corr_variables", "selected_vars", "variables", "analysis_vars")
DIMENSION = ("dim_vars", "selected_vars", "variables", "analysis_vars")

# Roles echoed in a report, per purpose.
ECHO = {
    "regression": {"response": ("response_var",), "predictor": ("predictor_vars",)},
    "classification": {"class": ("response_var",), "predictor": ("predictor_vars",)},
    "time_series": {"time": ("time_var",), "value": ("value_var",)},
    "survival": {
        "survival_time": ("survival_time_var",),
        "event": ("event_var",),
        "covariate": ("covariates",),
    },
    "dimension": {"dimension": ("dim_vars",)},
    "correlation": {"correlation": ("corr_variables",)},
    "cluster": {"cluster": ("cluster_vars",)},
    "advanced_ml": {
        "group": ("group_var",),
        "value": ("value_var",),
        "variable_1": ("chi_var1", "corr_var1"),
        "variable_2": ("chi_var2", "corr_var2"),
    },
}


def role(roles: Mapping[str, object], names: Sequence[str], default: object = None) -> object:
    """First of the given role names that is set."""
    return next((roles[n] for n in names if roles.get(n) is not None), default)


def columns_for(roles: Mapping[str, object], names: Sequence[str]) -> list[str]:
    return clean_names(role(roles, names))


def column_for(roles: Mapping[str, object], names: Sequence[str]) -> str | None:
    return next(iter(columns_for(roles, names)), None)


def selected_roles(spark: SparkSession, purpose: str, roles: Mapping[str, object]) -> DataFrame:
    """The chosen columns by role, as shown in a report."""
    rows = [
        (label, name)
        for label, keys in ECHO.get(purpose, {}).items()
        for key in keys
        for name in clean_names(roles.get(key))
    ]
    return local_table(spark, rows, "role string, variable string")


def _plain(spark: SparkSession, purpose: str | None, status: str, color: str, score, code: str) -> Readiness:
    return Readiness(
        purpose or "",
        local_table(
            spark,
            [(purpose, status, color, score)],
            "purpose string, status string, color string, score double",
        ),
        local_table(spark, [], "criterion string, passed boolean"),
        local_table(spark, [], "criterion string, score int, max_score int, reason string"),
        local_table(spark, [], "item string, value double"),
        local_table(spark, [(0, "message", code)], "message_no int, kind string, code string"),
    )


def _survival(p: Profile, r: Mapping[str, object]) -> Readiness:
    return check_survival(
        p,
        column_for(r, SURVIVAL_TIME),
        column_for(r, EVENT),
        r.get("event_value"),
        r.get("single_event_is_event"),
        columns_for(r, COVARIATES),
        role(r, ("cox_model", "use_cox"), False) is True,
    )


def _timeseries(p: Profile, r: Mapping[str, object]) -> Readiness:
    return check_timeseries(
        p,
        column_for(r, TIME),
        columns_for(r, SERIES),
        role(r, ("forecast_model", "is_forecast"), False) is True,
    )


CHECKS: dict[str, Callable[[Profile, Mapping[str, object]], Readiness]] = {
    "basic_stats": lambda p, r: check_eda(p, columns_for(r, VARIABLES) or None, "basic_stats"),
    "visualization": lambda p, r: check_eda(p, columns_for(r, VARIABLES) or None, "visualization"),
    "advanced_ml": lambda p, r: check_hypothesis(p, column_for(r, GROUP)),
    "regression": lambda p, r: check_regression(p, column_for(r, RESPONSE), columns_for(r, PREDICTORS)),
    "classification": lambda p, r: check_classification(
        p, column_for(r, CLASS_RESPONSE), columns_for(r, PREDICTORS)
    ),
    "cluster": lambda p, r: check_clustering(p, columns_for(r, CLUSTER)),
    "time_series": _timeseries,
    "survival": _survival,
    "correlation": lambda p, r: check_multivariate(p, columns_for(r, CORRELATION), "correlation"),
    "dimension": lambda p, r: check_multivariate(p, columns_for(r, DIMENSION), "dimension"),
}


def _needed(purpose: str, roles: Mapping[str, object], columns: Sequence[str]) -> list[str]:
    """Columns a purpose looks at; the others need no profile.  All when none are chosen."""
    chosen: list[str] = []
    if purpose in ("basic_stats", "visualization"):
        chosen = columns_for(roles, VARIABLES)
    elif purpose in ("regression", "classification"):
        wanted = columns_for(roles, PREDICTORS)
        response = columns_for(roles, CLASS_RESPONSE if purpose == "classification" else RESPONSE)[:1]
        chosen = wanted and wanted + response
    elif purpose == "cluster":
        chosen = columns_for(roles, CLUSTER)
    elif purpose == "time_series":
        chosen = columns_for(roles, TIME)[:1] + columns_for(roles, SERIES)
    elif purpose == "survival":
        chosen = columns_for(roles, SURVIVAL_TIME)[:1] + columns_for(roles, EVENT)[:1]
        chosen += columns_for(roles, COVARIATES)
    kept = [c for c in columns if c in chosen]
    return kept or list(columns)


def _profile_for(df: DataFrame, purpose: str, roles: Mapping[str, object]) -> Profile:
    names = df.columns
    needed = _needed(purpose, roles, names)
    if len(needed) == len(names) or len(set(names)) < len(names):
        return profile(df)
    view = df.toDF(*[f"x{i}" for i in range(len(names))])
    return profile(view.select(*[F.col(f"x{names.index(n)}").alias(n) for n in needed]))


def evaluate_readiness(
    data: DataFrame | Profile | None,
    purpose: str | None,
    roles: Mapping[str, object] | None = None,
    spark: SparkSession | None = None,
) -> Readiness:
    """Judge a table for a purpose; ``roles`` maps role names to column names.

    The table is judged as it was read (user missing codes are not applied).  An unknown
    or empty purpose gives "unselected"; input that can't be judged (an unknown role or
    column, a wrong type) gives "unfit" with the error as message.  Errors of a running job, of
    the session's settings and of this library say nothing about the data and are raised.
    """
    session = spark or (
        data.frame.df.sparkSession if isinstance(data, Profile) else data.sparkSession if data is not None else SparkSession.active()
    )
    if not purpose:
        return _plain(session, purpose, "unselected", "secondary", None, "no_purpose_selected")
    if data is None:
        return _plain(session, purpose, "unfit", "danger", 0.0, "no_data")
    if purpose not in CHECKS:
        return _plain(session, purpose, "unselected", "secondary", None, "unknown_purpose")
    try:
        if not isinstance(roles or {}, Mapping):
            raise BadInput(f"roles are names with columns, not {roles!r}")
        chosen = dict(roles or {})
        profiled = data if isinstance(data, Profile) else _profile_for(data, purpose, chosen)
        return CHECKS[purpose](profiled, chosen)
    except (AnalysisException, BadInput) as error:
        return _plain(session, purpose, "unfit", "danger", 0.0, f"error: {error}")


def all_recommendations(quality: DataFrame, readiness: Readiness) -> DataFrame:
    """Quality recommendations followed by the readiness ones, each once."""
    return (
        quality.select("recommendation")
        .unionByName(readiness.recommendations().select(F.col("code").alias("recommendation")))
        .dropDuplicates(["recommendation"])
    )
