"""Readiness for cluster analysis."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rules import first_match
from plumbline.operators.correlations import correlations
from plumbline.operators.gaps import sequence_share, sequence_share_of_huge, whole_columns
from plumbline.operators.local import local_table
from plumbline.operators.profile import Column_, Profile
from plumbline.plans.readiness.measures import mean, outlier_columns, outlier_rates, scan
from plumbline.plans.readiness.verdict import Criterion, Readiness, Rulebook, judge

# Fixed value: names that mark an identifier.
ID_NAME = re.compile(r"(^id$|_id$|^id_|_id_|번호|식별자|코드|name|이름)", re.IGNORECASE)
STRONG_R = 0.9

CLUSTERING = Rulebook(
    name="cluster",
    essential=[
        ("F1", "n_final >= 2"),
        ("F2", "n_final >= 1"),
        ("F3", "n_final >= 1"),
        ("F4", "n_final >= 2 AND n_valid >= 20"),
    ],
    points=[
        Criterion(
            "R1",
            25,
            [("n_valid >= 100", 25), ("n_valid >= 50", 20), ("n_valid >= 30", 15), ("n_valid >= 20", 8)],
        ),
        Criterion(
            "R2",
            20,
            [("n_final BETWEEN 3 AND 10", 20), ("n_final = 2", 16), ("n_final BETWEEN 11 AND 20", 12), ("n_final >= 21", 6)],
        ),
        Criterion(
            "R3",
            20,
            [("rows_per_column >= 10", 20), ("rows_per_column >= 5", 15), ("rows_per_column >= 3", 8)],
            2,
        ),
        Criterion(
            "R4",
            15,
            [("avg_missing_rate < 0.05", 15), ("avg_missing_rate < 0.20", 11), ("avg_missing_rate < 0.40", 5)],
        ),
        Criterion("R5", 10, [("avg_outlier_rate <= 0.10", 10), ("avg_outlier_rate <= 0.20", 5)]),
        Criterion(
            "R6",
            10,
            [
                ("coalesce(strong_pair_share, 0) < 0.10", 10),
                ("strong_pair_share < 0.30", 7),
                ("strong_pair_share < 0.50", 3),
            ],
        ),
    ],
    messages=[
        ("too_few_columns", "n_final < 2"),
        ("too_many_columns", "n_final >= 21"),
        ("too_few_rows", "n_final >= 2 AND n_valid < 20"),
        ("small_sample", "n_final >= 2 AND n_valid >= 20 AND n_valid < 30"),
        ("few_rows_per_column", "rows_per_column < 3"),
        ("missing_high", "avg_missing_rate >= 0.40"),
        ("missing_many", "avg_missing_rate >= 0.20 AND avg_missing_rate < 0.40"),
        ("outliers_high", "avg_outlier_rate > 0.20"),
        ("outliers_some", "avg_outlier_rate > 0.10 AND avg_outlier_rate <= 0.20"),
        ("similar_columns", "strong_pair_share >= 0.30"),
        ("little_variation", "n_flat > 0"),
        ("category_chosen", "user_selected AND n_category_chosen > 0"),
        ("date_chosen", "user_selected AND n_date > 0"),
        ("id_chosen", "user_selected AND n_obvious_id > 0"),
        ("single_value_chosen", "user_selected AND n_single > 0"),
        ("continuous_high_unique", "n_high_unique > 0"),
    ],
    notes=[
        ("score_meaning", "true"),
        ("scaling_needed", "true"),
        ("cluster_count_open", "true"),
        ("category_needs_other_distance", "user_selected AND n_category_chosen > 0"),
        ("robust_methods", "avg_outlier_rate > 0.10"),
    ],
    summary=[
        "n_candidates",
        "n_final",
        "n_valid",
        "rows_per_column",
        "avg_missing_rate",
        "avg_outlier_rate",
        "strong_pair_share",
    ],
)


def is_date_column(c: Column_) -> bool:
    return c.variable_type == "date" or c.kind in ("date", "timestamp") or c.is_time_candidate


def obvious_ids(profile: Profile, columns: Sequence[Column_]) -> dict[int, bool]:
    """Identifier by name, or a nearly gap-free whole-number sequence of distinct values."""
    found = {c.pos: bool(ID_NAME.search(c.variable or "")) for c in columns}
    check = [
        c
        for c in columns
        if not found[c.pos]
        and c.kind == "numeric"
        and c.is_id_by_ratio
        and c.n_pos_inf + c.n_neg_inf == 0
        and (c.n_unique or 0) >= 2
    ]
    whole = whole_columns(profile.frame, check) if check else []
    if whole:  # one row per column comes back
        huge = []
        for row in sequence_share(profile.frame, whole).collect():
            if row["whole"]:
                found[row["pos"]] = row["sequence_share"] >= 0.9
            else:
                huge += [c for c in whole if c.pos == row["pos"]]
        for row in sequence_share_of_huge(profile.frame, huge).collect() if huge else ():
            found[row["pos"]] = row["sequence_share"] >= 0.9
    return found


def obvious_id_table(profile: Profile) -> DataFrame:
    found = obvious_ids(profile, profile.columns)
    return local_table(
        profile.frame.df.sparkSession,
        [(c.pos, c.variable, c.n_non_missing, c.n_unique, found[c.pos]) for c in profile.columns],
        "pos int, variable string, n_non_missing bigint, n_unique bigint, is_obvious_id boolean",
    )


def strong_pairs(profile: Profile, columns: Sequence[Column_]) -> DataFrame:
    """Correlation of every pair over complete rows, a distributed table; undefined r is NULL."""
    names = local_table(profile.frame.df.sparkSession, [(c.pos, c.variable) for c in columns], "pos_1 int, variable_1 string")
    table = correlations(profile.frame, columns).join(F.broadcast(names), "pos_1")
    table = table.join(F.broadcast(names.toDF("pos_2", "variable_2")), "pos_2").select("variable_1", "variable_2", "r")
    # r is compared after rounding away the last digits of floating-point noise
    return table.withColumn("is_strong", F.coalesce(F.abs(F.round("r", 9)) >= STRONG_R, F.lit(False)))


# Why a candidate is left out, first match wins.
CANDIDATE_REASONS = [
    ("is_date", "date_chosen"),
    ("is_obvious_id", "id_chosen"),
    ("kind <> 'numeric'", "category_chosen"),
    ("n_unique < 2", "single_value_chosen"),
]


def candidate_table(profile: Profile, candidates: Sequence[Column_], ids: dict[int, bool]) -> DataFrame:
    """One row per candidate: whether it is used for clustering, or why not."""
    rows = [
        (c.pos, c.variable, c.variable_type, c.kind, c.n_unique or 0, is_date_column(c), ids[c.pos]) for c in candidates
    ]
    table = local_table(
        profile.frame.df.sparkSession,
        rows,
        "pos int, variable string, variable_type string, kind string, n_unique bigint, is_date boolean, "
        "is_obvious_id boolean",
    )
    table = table.withColumn("reason", first_match(CANDIDATE_REASONS, "final"))
    return table.select("pos", "variable", "variable_type", "n_unique", (F.col("reason") == "final").alias("is_final"), "reason")


def check_clustering(profile: Profile, cluster_vars: Sequence[str] | None = None) -> Readiness:
    """Final columns, complete rows, outliers and redundancy."""
    frame, spark = profile.frame, profile.frame.df.sparkSession
    chosen = bool(cluster_vars)
    if chosen:
        candidates = [profile.named(n) for n in dict.fromkeys(cluster_vars) if n in frame.names]
    else:
        candidates = profile.of_type("numeric")
    ids = obvious_ids(profile, candidates)
    final = [
        c
        for c in candidates
        if c.kind == "numeric" and (c.n_unique or 0) >= 2 and not is_date_column(c) and not ids[c.pos]
    ]
    bounds, outside = outlier_columns(profile, final)
    found = (
        scan(profile, {"n_valid": F.count_if(frame.all_present([c.pos for c in final])), **outside})
        if final
        else {"n_valid": 0}
    )
    n_valid = found["n_valid"]
    share, pairs = None, None
    if len(final) >= 2 and n_valid >= 2:
        pairs = strong_pairs(profile, final)
        share = pairs.agg(F.avg(F.col("is_strong").cast("double")).alias("s")).first()["s"]
    flat = [
        c
        for c in final
        if c.n_finite < 2 or c.pos not in bounds or bounds[c.pos].iqr == 0
    ]
    figures = {
        "user_selected": chosen,
        "n_candidates": len(candidates),
        "n_final": len(final),
        "n_valid": n_valid,
        "rows_per_column": n_valid / len(final) if final else None,
        "avg_missing_rate": mean([c.missing_rate for c in final]),
        "avg_outlier_rate": mean(outlier_rates(final, found)),
        "strong_pair_share": share,
        "n_flat": len(flat),
        "n_category_chosen": sum(
            c.variable_type == "categorical" or c.kind in ("string", "boolean") for c in candidates
        ),
        "n_date": sum(is_date_column(c) for c in candidates),
        "n_obvious_id": sum(ids[c.pos] for c in candidates),
        "n_single": sum((c.n_unique or 0) <= 1 for c in candidates),
        "n_high_unique": sum(c.is_id_by_ratio for c in final),
    }
    out = judge(spark, CLUSTERING, figures)
    out = out.with_details(candidates=candidate_table(profile, candidates, ids))
    return out if pairs is None else out.with_details(pairs=pairs)
