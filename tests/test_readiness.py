import pytest
from conftest import dicts

from plumbline import evaluate_readiness
from plumbline.operators.profile import profile
from plumbline.plans.quality import assess_data_quality
from plumbline.plans.readiness.dispatch import all_recommendations, selected_roles
from plumbline.plans.readiness.hypothesis import possible_tests
from plumbline.plans.readiness.models import CLASSIFICATION, REGRESSION
from plumbline.plans.readiness.survival import SURVIVAL
from plumbline.plans.readiness.verdict import judge


def points(r):
    return {d["criterion"]: d["score"] for d in dicts(r.score_detail)}


def essential(r):
    return {d["criterion"]: d["passed"] for d in dicts(r.essential)}


def status(r):
    row = r.result.first()
    return row["status"], row["score"]


def codes(r):
    return {d["code"] for d in dicts(r.messages)}


def figures_of(book, **known):
    """Neutral figures for a rulebook, overridden by the given ones."""
    base = {
        "response_selected": True,
        "response_numeric": True,
        "response_categorical": True,
        "n_candidates": 4,
        "n_modelable": 4,
        "n_numeric_modelable": 2,
        "n_categorical_modelable": 2,
        "n_valid": 1000,
        "rows_per_predictor": 250.0,
        "response_missing": 0.0,
        "response_unique": 50,
        "usable_share": 1.0,
        "avg_missing_rate": 0.0,
        "response_outlier_rate": 0.0,
        "avg_outlier_rate": 0.0,
        "n_class": 2,
        "min_class": 400,
        "min_class_share": 0.4,
    }
    return base | known


@pytest.mark.parametrize(
    "known,code,want",
    [
        ({"n_valid": 200}, "R1", 30),
        ({"n_valid": 199}, "R1", 24),
        ({"n_valid": 49}, "R1", 10),
        ({"rows_per_predictor": 4.99}, "R2", 8),
        ({"rows_per_predictor": 2.9}, "R2", 3),
        ({"response_missing": 0.04, "response_unique": 9}, "R3", 15),
        ({"response_missing": 0.39, "response_unique": 4}, "R3", 8),
        ({"usable_share": 0.79}, "R4", 10),
        ({"avg_missing_rate": 0.2}, "R5", 3),
        ({"avg_outlier_rate": 0.1}, "R6", 5),
        ({"avg_outlier_rate": 0.21}, "R6", 0),
    ],
)
def test_regression_points(spark, known, code, want):
    assert points(judge(spark, REGRESSION, figures_of(REGRESSION, **known)))[code] == want


@pytest.mark.parametrize(
    "n_class,share,want",
    [
        (2, 0.30, 20),
        (2, 0.29, 16),
        (2, 0.10, 10),
        (2, 0.05, 5),
        (2, 0.04, 0),
        (3, 0.15, 20),
        (3, 0.14, 16),
        (3, 0.05, 10),
        (3, 0.02, 5),
        (3, 0.01, 0),
    ],
)
def test_class_balance_points(spark, n_class, share, want):
    got = judge(
        spark, CLASSIFICATION, figures_of(CLASSIFICATION, n_class=n_class, min_class_share=share)
    )
    assert points(got)["R3"] == want


def test_survival_event_rate_bands(spark):
    base = {n: 0.0 for n in SURVIVAL.summary} | {
        "time_selected": True,
        "time_valid": True,
        "time_is_date": False,
        "event_selected": True,
        "event_confirmed": True,
        "event_levels": 2,
        "n_valid": 100,
        "time_unique": 30,
        "n_categorical_modelable": 0,
        "cox_model": False,
    }
    for rate, want in ((0.2, 20), (0.8, 20), (0.81, 14), (0.1, 14), (0.91, 7), (0.05, 7), (0.96, 2)):
        got = judge(spark, SURVIVAL, base | {"event_rate": rate, "n_events": int(rate * 100)})
        assert points(got)["R3"] == want


def test_eda_and_correlation(table):
    n = 40
    cols = {"x": [i * 1.5 for i in range(n)], "g": ["ab"[i % 2] for i in range(n)]}
    p = profile(table(cols, "x double, g string"))
    r = evaluate_readiness(p, "basic_stats")
    assert points(r) == {"R1": 28, "R2": 6, "R3": 8, "R4": 20, "R5": 5}
    assert status(r) == ("partly", 67.0)
    assert status(evaluate_readiness(p, "correlation")) == ("unfit", 0.0)
    assert "under_two_numeric_in_table" in codes(evaluate_readiness(p, "dimension"))
    only = evaluate_readiness(p, "visualization", {"eda_vars": ["g"]})
    assert points(only)["R2"] == 0 and "no_numeric" in codes(only)
    few = evaluate_readiness(table({"x": [1, 2]}, "x int"), "basic_stats")
    assert essential(few) == {"F1": True, "F2": False} and "too_few_rows" in codes(few)


def test_group_structure(table):
    n = 60
    cols = {"g": ["ab"[i % 2] for i in range(n)], "x": list(range(n)), "c": [i % 3 for i in range(n)]}
    df = table(cols, "g string, x int, c int")
    r = evaluate_readiness(df, "advanced_ml", {"group_var": "g"})
    assert points(r) == {"R1": 24, "R2": 30, "R3": 15, "R4": 10, "R5": 10}
    tests = [d["test"] for d in dicts(r.details["possible_tests"])]
    assert tests == ["independent_t", "welch_t", "mann_whitney_u", "group_chi_square", "fisher_exact", "two_proportions"]
    one = table(cols | {"g": ["a"] * n}, "g string, x int, c int")
    assert "group_has_one_level" in codes(evaluate_readiness(one, "advanced_ml", {"group_var": "g"}))


@pytest.mark.parametrize("p,q,k,n", [(0, 0, None, 0), (1, 0, None, 3), (3, 2, None, 15), (2, 0, 3, 4), (3, 1, 2, 9)])
def test_possible_tests(spark, p, q, k, n):
    assert possible_tests(spark, p, q, k).count() == n


def test_followup_event_coding(table):
    n = 60
    cols = {
        "time": [float(i % 25) for i in range(n)],
        "status": [i % 3 for i in range(n)],
        "one": [1] * n,
        "when": ["2024-01-01"] * n,
        "age": [20 + i % 30 for i in range(n)],
    }
    df = table(cols, "time double, status int, one int, when string, age int")
    roles = {"survival_time_var": "time", "event_var": "status", "covariates": ["age"]}
    three = evaluate_readiness(df, "survival", roles | {"event_value": "2"})
    assert essential(three)["F4"] and "event_value_taken_as_event" in codes(three)
    summary = {d["item"]: d["value"] for d in dicts(three.summary)}
    assert (summary["n_events"], summary["n_censored"]) == (20, 40)
    assert not essential(evaluate_readiness(df, "survival", roles | {"event_value": ""}))["F4"]
    assert not essential(evaluate_readiness(df, "survival", roles | {"event_value": 7}))["F4"]
    single = roles | {"event_var": "one"}
    assert not essential(evaluate_readiness(df, "survival", single))["F4"]
    yes = evaluate_readiness(df, "survival", single | {"single_event_is_event": True})
    assert essential(yes)["F4"] and {"all_events", "one_event_level"} <= codes(yes)
    no = evaluate_readiness(df, "survival", single | {"single_event_is_event": False})
    assert points(no)["R3"] == 0 and "no_events" in codes(no)
    dated = evaluate_readiness(df, "survival", roles | {"survival_time_var": "when", "event_value": 2})
    assert not essential(dated)["F2"]


def test_time_series_roll_up(table):
    n = 40
    cols = {"t": [20240101 + i % 28 for i in range(n)], "a": [i * 1.0 for i in range(n)], "b": [1.0] * n}
    df = table(cols, "t int, a double, b double")
    r = evaluate_readiness(df, "time_series", {"time_var": "t", "value_var": ["a", "b"]})
    got = {d["variable"]: (d["status"], d["score"]) for d in dicts(r.details["per_column"])}
    assert got["b"] == ("unfit", None) and got["a"][0] in ("fit", "partly")
    assert status(r) == ("partly", got["a"][1])
    none = evaluate_readiness(df, "time_series", {"time_var": "t"})
    assert status(none) == ("unfit", 0.0) and codes(none) == {"no_value_column"}
    assert essential(none)["F4"] is None


def test_clustering_picks_final_columns(table):
    n = 60
    cols = {
        "row_id": list(range(n)),
        "serial": list(range(100, 100 + n)),
        "x": [(i * 37 % 101) * 1.1 for i in range(n)],
        "y": [(i * 37 % 101) * 2.2 for i in range(n)],
        "flat": [1.0 if i else 2.0 for i in range(n)],
        "g": ["ab"[i % 2] for i in range(n)],
    }
    df = table(cols, "row_id int, serial int, x double, y double, flat double, g string")
    r = evaluate_readiness(df, "cluster", {"cluster_vars": list(cols)})
    summary = {d["item"]: d["value"] for d in dicts(r.summary)}
    assert (summary["n_candidates"], summary["n_final"]) == (6, 3)  # x, y, flat
    assert summary["strong_pair_share"] == pytest.approx(1 / 3)
    assert {"id_chosen", "category_chosen", "little_variation", "similar_columns"} <= codes(r)


def test_dispatch_and_reports(spark, table):
    df = table({"y": list(range(40)), "x": [i % 4 for i in range(40)]}, "y int, x int")
    assert status(evaluate_readiness(df, "unknown")) == ("unselected", None)
    assert status(evaluate_readiness(df, None)) == ("unselected", None)
    assert status(evaluate_readiness(None, "regression", spark=spark)) == ("unfit", 0.0)
    r = evaluate_readiness(df, "regression", {"target_var": " y ", "x_vars": ["x", "y", "gone"]})
    assert essential(r) == {f"F{i}": True for i in range(1, 7)}
    rows = {d["variable"]: d["modelable_role"] for d in dicts(r.details["predictors"])}
    assert rows == {"x": "numeric"}
    missing = evaluate_readiness(df, "classification", {"response_var": "gone"})
    assert essential(missing)["F1"] is False and status(missing) == ("unfit", 0.0)
    echo = dicts(selected_roles(spark, "regression", {"response_var": "y", "predictor_vars": ["x", ""]}))
    assert echo == [{"role": "response", "variable": "y"}, {"role": "predictor", "variable": "x"}]
    quality = assess_data_quality(df)
    merged = all_recommendations(quality.recommendations, evaluate_readiness(df, "basic_stats"))
    assert merged.count() == merged.distinct().count() > 0
