"""Readiness for hypothesis tests, without and with a group column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rules import matching_codes
from plumbline.operators.local import local_table
from plumbline.operators.profile import Profile
from plumbline.plans.readiness.measures import level_sizes, scan
from plumbline.plans.readiness.verdict import Criterion, Readiness, Rulebook, judge

# Tests the column structure allows, in order (k levels, p numeric, q categorical).
TESTS_WITHOUT_GROUP = [
    ("one_sample_t", "p >= 1"),
    ("wilcoxon_signed_rank", "p >= 1"),
    ("normality", "p >= 1"),
    ("paired_t", "p >= 2"),
    ("pearson_correlation", "p >= 2"),
    ("spearman_correlation", "p >= 2"),
    ("kendall_correlation", "p >= 2"),
    ("multiple_correlation", "p >= 3"),
    ("bartlett_sphericity", "p >= 3"),
    ("kmo", "p >= 3"),
    ("binomial", "q >= 1"),
    ("chi_square_goodness_of_fit", "q >= 1"),
    ("chi_square_independence", "q >= 2"),
    ("fisher_exact", "q >= 2"),
    ("category_pairs", "q >= 2"),
]
TESTS_WITH_GROUP = [
    ("independent_t", "k = 2 AND p >= 1"),
    ("welch_t", "k = 2 AND p >= 1"),
    ("mann_whitney_u", "k = 2 AND p >= 1"),
    ("anova", "k >= 3 AND p >= 1"),
    ("welch_anova", "k >= 3 AND p >= 1"),
    ("kruskal_wallis", "k >= 3 AND p >= 1"),
    ("hotelling_t2", "k = 2 AND p >= 2"),
    ("manova", "k >= 2 AND p >= 2"),
    ("multivariate_structure", "k >= 2 AND p >= 3"),
    ("group_chi_square", "k >= 2 AND q >= 1"),
    ("fisher_exact", "k >= 2 AND q >= 1"),
    ("two_proportions", "k = 2 AND q >= 1"),
    ("category_distribution", "k >= 3 AND q >= 1"),
    ("category_independence", "q >= 2"),
]

COMMON_MESSAGES = [
    ("no_candidate", "n_candidates < 1"),
    ("too_few_rows", "n_valid < 10"),
    ("small_sample", "n_valid >= 10 AND n_valid < 30"),
    ("missing_high", "missing_rate >= 0.40"),
    ("missing_many", "missing_rate >= 0.20 AND missing_rate < 0.40"),
    ("mostly_unstable", "stable_rate < 0.20"),
    ("partly_unstable", "stable_rate >= 0.20 AND stable_rate < 0.50"),
    ("id_suspect", "n_id > 0"),
    ("many_categories", "n_high_cardinality > 0"),
]


def _missing(code: str, a: int, b: int, c: int) -> Criterion:
    return Criterion(
        code, a, [("missing_rate < 0.05", a), ("missing_rate < 0.20", b), ("missing_rate < 0.40", c)]
    )


def _stable(code: str) -> Criterion:
    return Criterion(
        code, 10, [("stable_rate >= 0.80", 10), ("stable_rate >= 0.50", 7), ("stable_rate >= 0.20", 3)]
    )


def _rows(code: str, *points: int) -> Criterion:
    return Criterion(
        code, points[0], [(f"n_valid >= {n}", p) for n, p in zip((100, 50, 30, 10), points)]
    )


WITHOUT_GROUP = Rulebook(
    name="advanced_ml",
    essential=[("F1", "n_candidates >= 1"), ("F2", "n_valid >= 10"), ("F3", "n_tests >= 1")],
    points=[
        _rows("R1", 40, 32, 24, 12),
        Criterion(
            "R2", 30, [("p >= 3", 30), ("p >= 2", 25), ("q >= 2", 25), ("p >= 1", 15), ("q >= 1", 15)]
        ),
        _missing("R3", 20, 14, 7),
        _stable("R4"),
    ],
    messages=[
        *COMMON_MESSAGES,
        ("scored_without_group", "NOT group_selected"),
        ("group_has_one_level", "group_selected"),
        ("multivariate_structure", "p >= 3"),
        ("pair_tests_possible", "p = 2"),
        ("single_numeric_only", "p = 1"),
        ("category_pairs_possible", "q >= 2"),
        ("single_category_only", "q = 1"),
        ("no_test_possible", "p = 0 AND q = 0"),
    ],
    notes=[
        ("score_meaning", "true"),
        ("tests_are_candidates", "true"),
        ("best_structure_counts", "true"),
        ("group_not_a_candidate", "group_selected"),
        ("reference_value_needed", "p >= 1 OR q >= 1"),
        ("multivariate_needs_checks", "p >= 3"),
    ],
    summary=["n_valid", "p", "q", "missing_rate", "stable_rate", "n_tests"],
)

WITH_GROUP = Rulebook(
    name="advanced_ml",
    essential=[("F1", "k >= 2"), ("F2", "n_valid >= 10"), ("F3", "n_candidates >= 1")],
    points=[
        _rows("R1", 30, 24, 18, 10),
        Criterion(
            "R2",
            30,
            [
                ("k BETWEEN 2 AND 5 AND min_group >= 10", 30),
                ("k BETWEEN 2 AND 10 AND min_group >= 5", 22),
                ("k >= 2 AND min_group >= 3", 14),
                ("k >= 2", 5),
            ],
        ),
        Criterion("R3", 20, [("p >= 2", 20), ("p >= 1", 15), ("q >= 1", 12)]),
        _missing("R4", 10, 7, 3),
        _stable("R5"),
    ],
    messages=[
        *COMMON_MESSAGES,
        ("scored_by_group", "true"),
        ("two_groups", "k = 2"),
        ("three_or_more_groups", "k >= 3"),
        ("many_groups", "k >= 11"),
        ("group_very_small", "min_group < 3"),
        ("group_small", "min_group >= 3 AND min_group < 5"),
        ("nothing_to_compare", "p = 0 AND q = 0"),
        ("no_numeric_to_compare", "p = 0 AND q > 0"),
        ("no_category_to_compare", "q = 0 AND p > 0"),
        ("multivariate_group_test", "p >= 2"),
        ("numeric_group_test", "p = 1"),
        ("category_group_test", "q >= 1"),
    ],
    notes=[
        ("score_meaning", "true"),
        ("tests_are_candidates", "true"),
        ("group_not_a_candidate", "true"),
        ("best_structure_counts", "true"),
        ("reference_value_needed", "p >= 1 OR q >= 1"),
        ("multivariate_needs_checks", "p >= 2"),
    ],
    summary=["n_valid", "k", "min_group", "p", "q", "missing_rate", "stable_rate", "n_tests"],
)


def candidate_detail(profile: Profile, exclude: str | None = None) -> DataFrame:
    """Per column: is it a test candidate, and is it stable enough to be tested."""
    return candidates_of(profile.table(), exclude)


def candidates_of(profiled: DataFrame, exclude: str | None = None) -> DataFrame:
    out = profiled if exclude is None else profiled.where(F.col("variable") != F.lit(exclude))
    return (
        out.withColumn("missing_rate", F.expr("CASE WHEN n_rows > 0 THEN n_missing / n_rows ELSE 0 END"))
        .withColumn("is_id", F.expr("n_non_missing >= 30 AND unique_ratio >= 0.9"))
        .withColumn("is_numeric_candidate", F.expr("variable_type = 'numeric' AND n_unique >= 2"))
        .withColumn(
            "is_categorical_candidate",
            F.expr("variable_type IN ('categorical', 'numeric_categorical') AND n_unique >= 2"),
        )
        .withColumn(
            "is_test_candidate",
            F.expr("variable_type IN ('numeric', 'categorical', 'numeric_categorical')"),
        )
        # eleven or more distinct finite values always vary; infinite ones leave no variance
        .withColumn(
            "is_stable_numeric",
            F.expr("is_numeric_candidate AND n_non_missing >= 10 AND n_pos_inf + n_neg_inf = 0"),
        )
        .withColumn(
            "is_stable_categorical",
            F.expr(
                "is_categorical_candidate AND n_non_missing >= 10 AND n_unique <= 10 AND min_count >= 3"
            ),
        )
        .withColumn("is_stable", F.expr("is_stable_numeric OR is_stable_categorical"))
        .withColumn(
            "is_high_cardinality",
            F.expr(
                "(kind IN ('string', 'boolean') OR variable_type = 'categorical') AND n_unique > 10"
            ),
        )
        .select(
            "pos",
            "variable",
            "variable_type",
            "n_non_missing",
            "n_unique",
            "missing_rate",
            "unique_ratio",
            "is_id",
            "is_numeric_candidate",
            "is_categorical_candidate",
            "is_test_candidate",
            "is_stable_numeric",
            "is_stable_categorical",
            "is_stable",
            "is_high_cardinality",
        )
    )


def possible_tests(spark, p: int, q: int, k: int | None = None) -> DataFrame:
    """Tests the structure allows: p numeric and q categorical candidates, k group levels."""
    rules = TESTS_WITHOUT_GROUP if k is None else TESTS_WITH_GROUP
    row = local_table(spark, [(p, q, 0 if k is None else k)], "p int, q int, k int")
    return row.select(F.posexplode(matching_codes(rules)).alias("test_no", "test"))


def check_hypothesis(profile: Profile, group_var: str | None = None) -> Readiness:
    """Test readiness; a group column with at most one level is set aside."""
    spark, frame = profile.frame.df.sparkSession, profile.frame
    selected = group_var is not None and group_var in frame.names
    group = profile.named(group_var) if selected else None
    detail = candidate_detail(profile, group_var if selected else None)
    rows = [r.asDict() for r in detail.collect()]
    tested = [r for r in rows if r["is_test_candidate"]]
    usable = frame.any_present([r["pos"] for r in tested])
    figures: dict[str, object] = {
        "n_candidates": len(tested),
        "p": sum(r["is_numeric_candidate"] for r in rows),
        "q": sum(r["is_categorical_candidate"] for r in rows),
        "missing_rate": sum(r["missing_rate"] for r in tested) / len(tested) if tested else None,
        "stable_rate": sum(r["is_stable"] for r in tested) / len(tested) if tested else None,
        "n_id": sum(r["is_id"] for r in rows),
        "n_high_cardinality": sum(bool(r["is_high_cardinality"]) for r in rows),
        "group_selected": selected,
    }
    if group is None or (group.n_unique or 0) <= 1:
        figures["n_valid"] = (
            scan(profile, {"n": F.count_if(usable)})["n"] if tested else 0
        )
        tests = possible_tests(spark, figures["p"], figures["q"])
        book = WITHOUT_GROUP
    else:
        levels = level_sizes(profile, group, frame.present(group.pos) & usable).first()
        figures |= {
            "n_valid": levels["n_valid"],
            "k": levels["n_levels"],
            "min_group": levels["min_level"],
        }
        tests = possible_tests(spark, figures["p"], figures["q"], figures["k"])
        book = WITH_GROUP
    figures["n_tests"] = tests.count()
    return judge(spark, book, figures).with_details(candidates=detail, possible_tests=tests)
