"""Registered queries: every operator over whole given tables, with its DuckDB check.

``queries()`` runs the package, ``oracle_sql()`` recomputes the same result in SQL;
``SPECS`` fixes the output columns of both (names and kinds).
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracle as O  # noqa: E402
from cases import CASES, Case  # noqa: E402
from plumbline.operators.clean import frame_of, standardize  # noqa: E402
from plumbline.operators.duplicates import (  # noqa: E402
    duplicate_positions,
    duplicate_summary,
    with_row_position,
)
from plumbline.operators.outliers import box_summary, iqr_outliers  # noqa: E402
from plumbline.operators.shared import ensure_checkpoint_dir  # noqa: E402
from plumbline.operators.profile import (  # noqa: E402
    column_summary,
    profile,
    role_candidates,
    typed_profile,
    variable_types,
)
from plumbline.operators.settled import settled_types  # noqa: E402
from plumbline.plans import quality as Q  # noqa: E402
from plumbline.plans.quality import assess_data_quality  # noqa: E402
from plumbline.plans.readiness import evaluate_readiness  # noqa: E402
from plumbline.plans.readiness.clustering import check_clustering, obvious_id_table, strong_pairs  # noqa: E402
from plumbline.plans.readiness.dispatch import selected_roles  # noqa: E402
from plumbline.plans.readiness.eda import has_two_numeric  # noqa: E402
from plumbline.plans.readiness.hypothesis import candidates_of, check_hypothesis  # noqa: E402
from plumbline.plans.readiness.timeseries import gap_table  # noqa: E402
from plumbline.sources.tables import UnsupportedFormat, load_table, preview  # noqa: E402

SPARK_TYPES = {"i": "bigint", "d": "double", "s": "string", "b": "boolean"}
CODES = (1, 17)


def _shaped(df: DataFrame, spec: str) -> DataFrame:
    cells = []
    for item in spec.split():
        name, kind = item.split(":")
        cell = F.col(name).cast(SPARK_TYPES[kind])
        cells.append((F.round(cell, 6) if kind == "d" else cell).alias(name))
    return df.select(*cells)


def _read(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return CASES[name].read(spark, sf_dir)


def _c(name: str):
    return CASES[name]


# --- outputs ------------------------------------------------------------------------------

TYPE_OUT = (
    "pos:i variable:s n_non_missing:i n_unique:i unique_ratio:d variable_type:s is_time_candidate:b"
)
SUMMARY_OUT = (
    "pos:i variable:s variable_type:s missing_count:i missing_percent:d non_missing_count:i "
    "unique_count:i unique_rate:d"
)
OUTLIER_OUT = (
    "pos:i variable:s outlier_count:i non_missing_count:i outlier_rate:d outlier_percent:d "
    "lower_bound:d upper_bound:d"
)
SCORE_OUT = "total_score:i force_danger:b final_status:s grade:s"
ITEM_OUT = "item_no:i item:s score:i max_score:i status:s"
FINDING_OUT = "priority:i kind:s subject:s severity:s"
POSITIONS_OUT = "event_id:i"

TYPES_SQL = (
    "SELECT pos, variable, n AS n_non_missing, u AS n_unique, round_even(ratio, 3) AS unique_ratio, "
    "vt AS variable_type, is_time AS is_time_candidate FROM types"
)
SUMMARY_SQL = (
    "SELECT pos, variable, vt AS variable_type, n_missing AS missing_count, round_even(miss * 100, 2) AS missing_percent, "
    "n AS non_missing_count, u AS unique_count, round_even(ratio, 4) AS unique_rate FROM types"
)
OUTLIER_SQL = (
    "SELECT o.pos, o.variable, n_out AS outlier_count, n_fin AS non_missing_count, round_even(rate, 4) AS outlier_rate, "
    "round_even(rate * 100, 2) AS outlier_percent, lo AS lower_bound, hi AS upper_bound "
    "FROM outl o JOIN types t ON o.pos = t.pos WHERE vt = 'numeric'"
)

ORDERS_USABLE = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
EVENTS_USABLE = ["user_id", "event_type", "value"]
LINE_NUMERIC = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
]
PART_NUMERIC = ["p_partkey", "p_size", "p_retailprice"]


def _quality(name: str, codes: tuple = ()) -> Callable[[SparkSession, str], Q.QualityReport]:
    return lambda s, d: assess_data_quality(_read(name, s, d), codes)


def _types(name: str) -> tuple:
    return (
        TYPE_OUT,
        lambda s, d: variable_types(_read(name, s, d)),
        f"WITH {O.profile(_c(name))} {TYPES_SQL}",
    )


def _score(name: str) -> tuple:
    return (
        SCORE_OUT,
        lambda s, d: _quality(name)(s, d).score,
        f"WITH {O.quality(_c(name))} {O.SCORE}",
    )


def _items(name: str) -> tuple:
    return (
        ITEM_OUT,
        lambda s, d: _quality(name)(s, d).item_scores,
        f"WITH {O.quality(_c(name))} SELECT * FROM items",
    )


def _duplicates(name: str) -> tuple:
    return (
        "total_rows:i duplicate_count:i duplicate_rate:d",
        lambda s, d: duplicate_summary(frame_of(_read(name, s, d))),
        f"WITH {O.clean(_c(name))}, {O.dup_cte(_c(name))} "
        "SELECT total_rows, dups AS duplicate_count, dups / total_rows AS duplicate_rate FROM dup",
    )


def _ready(name: str, purpose: str, roles: dict, sql: str) -> tuple:
    return (
        O.SHEET_OUT,
        lambda s, d: evaluate_readiness(_read(name, s, d), purpose, roles).sheet(),
        sql,
    )


def _registry() -> dict[str, tuple]:
    """name -> (output columns, Spark query, DuckDB SQL)."""
    od, ev, li = _c("orders_dirty"), _c("events_special"), _c("lineitem")
    r: dict[str, tuple] = {}

    # cleaning
    normal = " ".join(f"{n}:{'s' if k in 'st' else k}" for _, n, k in od.columns if k != "t")
    keep = [n for _, n, k in od.columns if k != "t"]
    r["missing_normalize"] = (
        normal,
        lambda s, d: standardize(_read("orders_dirty", s, d)).select(*keep),
        f"WITH {O.clean(od)} SELECT * FROM clean",
    )
    r["missing_user_codes"] = (
        normal,
        lambda s, d: standardize(_read("orders_dirty", s, d), (*CODES, "2-HIGH")).select(*keep),
        f"WITH {O.clean(od, (*CODES, '2-HIGH'))} SELECT * FROM clean",
    )

    # missing values
    for name in ("orders_dirty", "events_special", "documents"):
        suffix = "" if name == "orders_dirty" else f"_{name.split('_')[0]}"
        r[f"missing_profile{suffix}"] = (
            O.MISSING_OUT,
            lambda s, d, n=name: Q.missing_profile(_read(n, s, d)),
            f"WITH {O.missing_table(_c(name))} SELECT * FROM miss",
        )
    r["missing_score"] = (
        "total_missing:i total_cells:i total_rate:d max_rate:d over_10:i over_20:i over_30:i "
        "total_points:i pattern_points:i score:i",
        lambda s, d: Q.missing_score(Q.missing_profile(_read("orders_dirty", s, d))),
        O.missing_score(od),
    )

    # profile and types
    for name, key in (
        ("orders_dirty", "column_profile"),
        ("documents", "column_profile_documents"),
    ):
        r[key] = (
            SUMMARY_OUT,
            lambda s, d, n=name: column_summary(typed_profile(frame_of(_read(n, s, d)))),
            f"WITH {O.profile(_c(name))} {SUMMARY_SQL}",
        )
    r["column_profile_single_pass"] = (
        SUMMARY_OUT,
        lambda s, d: column_summary(
            typed_profile(frame_of(_read("lineitem", s, d)), single_pass=True)
        ),
        f"WITH {O.profile(li)} {SUMMARY_SQL}",
    )
    r["variable_types"] = _types("lineitem")
    for name in ("events_special", "documents", "conversations", "pages", "customer", "labels"):
        r[f"variable_types_{name.split('_')[0]}"] = _types(name)
    r["date_convertible"] = _types("lineitem_text")
    # the same types without a shuffle of distinct values
    for name, key in (("lineitem", ""), ("orders_dirty", "_orders"), ("documents", "_documents"), ("events_special", "_events"), ("lineitem_text", "_text")):
        r[f"settled_types{key}"] = (
            "pos:i variable:s variable_type:s is_time_candidate:b",
            lambda s, d, n=name: settled_types(_read(n, s, d)),
            f"WITH {O.profile(_c(name))} SELECT pos, variable, vt AS variable_type, is_time AS is_time_candidate FROM types",
        )
    r["role_candidates"] = (
        "role:s pos:i variable:s",
        lambda s, d: role_candidates(variable_types(_read("lineitem", s, d))),
        f"WITH {O.profile(li)} SELECT 'numeric' AS role, pos, variable FROM types WHERE vt = 'numeric' "
        "UNION ALL SELECT 'categorical', pos, variable FROM types WHERE vt IN ('categorical', 'numeric_categorical') "
        "UNION ALL SELECT 'date', pos, variable FROM types WHERE vt = 'date' OR is_time",
    )

    # checks
    for name, key in (("lineitem_text", "type_issues"), ("documents", "type_issues_documents")):
        r[key] = (
            "pos:i variable:s issue:s numeric_percent:d date_percent:d",
            lambda s, d, n=name: Q.type_issues(typed_profile(frame_of(_read(n, s, d)))),
            f"WITH {O.profile(_c(name))}, {O.ISSUE_CTE} SELECT pos, variable, array_to_string(issues, '; ') AS issue, "
            "round_even(ns * 100, 2) AS numeric_percent, round_even(ds * 100, 2) AS date_percent FROM iss",
        )
    r["special_values"] = (
        "pos:i variable:s nan_count:i inf_count:i negative_inf_count:i has_special_value:b",
        lambda s, d: Q.special_values(_read("events_special", s, d)),
        f"WITH {O.profile(ev)} SELECT pos, variable, n_nan AS nan_count, n_pinf AS inf_count, n_ninf AS negative_inf_count, "
        "n_nan + n_pinf + n_ninf > 0 AS has_special_value FROM types WHERE kind = 'numeric'",
    )
    r["format_issues"] = (
        "pos:i variable:s issue:s",
        lambda s, d: _quality("events_special")(s, d).format_issues,
        f"WITH {O.profile(ev)}, {O.ISSUE_CTE} SELECT pos, variable, array_to_string(issues, '; ') AS issue FROM iss "
        "UNION ALL SELECT pos, variable, 'special_value' FROM types WHERE n_nan + n_pinf + n_ninf > 0",
    )
    r["duplicate_rows"] = _duplicates("line_facts")
    r["duplicate_rows_lineitem"] = _duplicates("lineitem")
    r["duplicate_positions"] = (
        POSITIONS_OUT,
        lambda s, d: duplicate_positions(
            _read("events_special", s, d), ["event_id"], ["user_id", "event_type"]
        ),
        O.duplicate_positions(ev, "event_id", ["user_id", "event_type"]),
    )
    r["duplicate_positions_documents"] = (
        "doc_id:i",
        lambda s, d: duplicate_positions(_read("documents", s, d), ["doc_id"], ["text", "lang"]),
        O.duplicate_positions(_c("documents"), "doc_id", ["text", "lang"]),
    )
    # every fiftieth order's lines twice, compared whole
    repeated = Case("(FROM lineitem UNION ALL FROM lineitem WHERE l_orderkey % 50 = 0)", li.columns)
    r["duplicate_rows_repeated"] = (
        "total_rows:i duplicate_count:i duplicate_rate:d",
        lambda s, d: duplicate_summary(frame_of(_repeated_lines(s, d))),
        f"WITH {O.clean(repeated)}, {O.dup_cte(repeated)} "
        "SELECT total_rows, dups AS duplicate_count, dups / total_rows AS duplicate_rate FROM dup",
    )
    r["duplicate_positions_repeated"] = (
        "l_orderkey:i l_linenumber:i",
        lambda s, d: duplicate_positions(
            _repeated_lines(s, d), ["l_orderkey", "l_linenumber"], [n for _, n, _ in li.columns]
        ),
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 50 = 0",
    )
    r["duplicate_positions_embeddings"] = (
        "vec_id:i",
        lambda s, d: duplicate_positions(_read("embeddings", s, d), ["vec_id"]),
        "SELECT vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY embedding, label ORDER BY vec_id) > 1",
    )
    # positions in file order
    r["row_positions"] = (
        "conv_id:i turn:i role:s text:s position:i",
        lambda s, d: with_row_position(_read("conversations", s, d)),
        "SELECT *, row_number() OVER () AS position FROM conversations",
    )
    r["duplicate_positions_file_order"] = (
        "position:i",
        lambda s, d: duplicate_positions(with_row_position(_read("documents", s, d).select("text", "lang")), ["position"]),
        "SELECT position FROM (SELECT *, row_number() OVER () AS position FROM documents) "
        "QUALIFY row_number() OVER (PARTITION BY text, lang ORDER BY position) > 1",
    )
    points = O.steps("dup_rate", "<", [(0.01, 15), (0.05, 12), (0.1, 8), (0.2, 4)])
    r["duplicate_relaxed"] = (
        "n_rows:i duplicate_count:i duplicate_percent:d raw_score:i score:i relaxed:b",
        lambda s, d: _quality("line_categories")(s, d).duplicate_table,
        f"WITH {O.quality(_c('line_categories'))} SELECT n_rows, dups AS duplicate_count, "
        f"round_even(dup_rate * 100, 2) AS duplicate_percent, {points} AS raw_score, "
        "(SELECT score FROM items WHERE item = 'duplicate') AS score, relaxed FROM fig",
    )
    for name, key in (
        ("events_special", "iqr_outliers"),
        ("lineitem", "iqr_outliers_lineitem"),
        ("documents", "iqr_outliers_documents"),
    ):
        r[key] = (
            OUTLIER_OUT,
            lambda s, d, n=name: _outliers(_read(n, s, d)),
            f"WITH {O.profile(_c(name))}, {O.outliers(_c(name))} {OUTLIER_SQL}",
        )
    r["variable_structure"] = (
        "pos:i variable:s problem:s",
        lambda s, d: Q.structure_problems(typed_profile(frame_of(_read("documents", s, d)))),
        f"WITH {O.profile(_c('documents'))}, {O.STRUCT_CTE} SELECT * FROM struct",
    )
    r["category_quality"] = (
        "pos:i variable:s max_category_percent:d unique_count:i unique_rate:d problem:s",
        lambda s, d: Q.category_quality(typed_profile(frame_of(_read("labels", s, d)))),
        f"WITH {O.profile(_c('labels'))}, {O.CAT_CTE} SELECT pos, variable, top AS max_category_percent, u AS unique_count, "
        "round_even(ur, 4) AS unique_rate, array_to_string(problems, '; ') AS problem FROM cat",
    )
    r["basic_structure"] = (
        "n_rows:i n_cols:i n_analyzable:i n_name_problems:i force_danger:b score:i",
        lambda s, d: _quality("documents")(s, d).basic_structure,
        f"WITH {O.quality(_c('documents'))} SELECT n_rows, n_cols, n_ok AS n_analyzable, 0 AS n_name_problems, "
        "force AS force_danger, (SELECT score FROM items WHERE item = 'basic') AS score FROM fig",
    )

    # score and report tables
    r["quality_score"] = _score("orders_dirty")
    for name in ("events_special", "lineitem", "documents", "conversations", "line_categories"):
        r[f"quality_score_{name.removesuffix('_special')}"] = _score(name)
    r["quality_items"] = _items("orders_dirty")
    for name in ("events_special", "lineitem_text", "documents"):
        r[f"quality_items_{name.removesuffix('_special')}"] = _items(name)
    r["quality_items_user_codes"] = (
        ITEM_OUT,
        lambda s, d: _quality("events_special", ("click",))(s, d).item_scores,
        f"WITH {O.quality(ev, ('click',))} SELECT * FROM items",
    )
    r["major_issues"] = (
        "item_no:i item:s status:s",
        lambda s, d: _quality("events_special")(s, d).major_issues,
        f"WITH {O.quality(ev)} {O.MAJOR}",
    )
    r["quality_warnings"] = (
        "warning:s",
        lambda s, d: _quality("events_special", ("click",))(s, d).warnings,
        f"WITH {O.quality(ev, ('click',))} SELECT warning FROM warn",
    )
    r["top_missing"] = (
        "pos:i variable:s missing_count:i missing_percent:d band:s",
        lambda s, d: Q.top_missing(Q.missing_profile(_read("orders_dirty", s, d))),
        f"WITH {O.missing_table(od)} SELECT *, CASE WHEN missing_percent >= 10 THEN 'red' ELSE 'amber' END AS band "
        "FROM miss WHERE missing_count > 0 ORDER BY missing_percent DESC, pos LIMIT 20",
    )
    r["top_outliers"] = (
        "pos:i variable:s outlier_count:i outlier_percent:d",
        lambda s, d: Q.top_outliers(_outliers(_read("events_special", s, d))),
        f"WITH {O.profile(ev)}, {O.outliers(ev)} SELECT * FROM ({OUTLIER_SQL}) WHERE outlier_count > 0 "
        "ORDER BY outlier_percent DESC, pos LIMIT 20",
    )
    r["box_summary"] = (
        "pos:i variable:s q1:d median:d q3:d whisker_low:d whisker_high:d outlier_count:i value_count:i",
        lambda s, d: _boxes(_read("documents", s, d)),
        f"WITH {O.profile(_c('documents'))}, {O.outliers(_c('documents'))} SELECT o.pos, o.variable, q1, med AS median, q3, "
        "w_lo AS whisker_low, w_hi AS whisker_high, n_out AS outlier_count, n_fin AS value_count "
        "FROM outl o JOIN types t ON o.pos = t.pos WHERE vt = 'numeric' AND n_out > 0",
    )
    for name, key in (("orders_dirty", "findings"), ("events_special", "findings_events")):
        r[key] = (
            FINDING_OUT,
            lambda s, d, n=name: _quality(n)(s, d).findings,
            f"WITH {O.quality(_c(name))}, {O.FINDINGS} SELECT * FROM allf",
        )
    r["recommendations"] = (
        "recommendation:s",
        lambda s, d: _quality("events_special")(s, d).recommendations,
        f"WITH {O.quality(ev)} {O.RECOMMEND}",
    )
    r["column_report"] = (
        "pos:i variable:s variable_type:s missing_percent:d unique_count:i unique_percent:d "
        "outlier_count:i outlier_percent:d band:s",
        lambda s, d: _quality("events_special")(s, d).column_report,
        f"WITH {O.quality(ev)} {O.COLUMN_REPORT}",
    )
    r["dataset_info"] = (
        "n_rows:i n_cols:i n_numeric:i n_text:i n_date:i",
        lambda s, d: Q.dataset_info(_read("documents", s, d)),
        "SELECT count(*) AS n_rows, 5 AS n_cols, 2 AS n_numeric, 3 AS n_text, 0 AS n_date FROM documents",
    )
    r["report_metrics"] = (
        "n_rows:i n_cols:i n_missing_cells:i n_duplicate_rows:i total_score:i final_status:s grade:s",
        lambda s, d: _quality("orders_dirty")(s, d).report_metrics,
        f"WITH {O.quality(od)} SELECT (SELECT n_rows FROM fig) AS n_rows, 6 AS n_cols, "
        "(SELECT count(*) - count(o_totalprice) FROM base) AS n_missing_cells, (SELECT dups FROM dup) AS n_duplicate_rows, "
        f"total_score, final_status, grade FROM ({O.SCORE})",
    )

    # the table written as CSV and read back by byte ranges; texts hold line breaks, quotes and commas
    r["csv_documents"] = (
        "doc_id:i text:s lang:s source:s n_chars:i",
        lambda s, d: load_table(s, _as_csv(_read("documents", s, d)), "csv"),
        "SELECT doc_id, nullif(text, 'NA') AS text, lang, source, n_chars FROM documents",
    )
    r["preview"] = (
        "doc_id:i text:s lang:s source:s n_chars:i",
        lambda s, d: preview(_read("documents", s, d).orderBy("doc_id")),
        "SELECT * FROM documents ORDER BY doc_id LIMIT 10",
    )
    r["unsupported_format"] = (
        "name:s supported:b",
        lambda s, d: _supported(s, d),
        "SELECT unnest(['orders.parquet', 'orders.xlsx', 'orders']) AS name, unnest([true, false, false]) AS supported "
        "WHERE (SELECT count(*) FROM orders) > 0",
    )
    r["two_numeric"] = (
        "chosen:s enough:b",
        lambda s, d: _two_numeric(s, d),
        f"WITH {O.profile(li)} SELECT chosen, (SELECT count(*) FROM types WHERE vt = 'numeric' AND list_contains(names, variable)) >= 2 AS enough "
        "FROM (SELECT 'all' AS chosen, (SELECT list(variable) FROM types) AS names UNION ALL SELECT 'one', ['l_quantity', 'l_returnflag'] "
        "UNION ALL SELECT 'two', ['l_quantity', 'l_discount'])",
    )
    r["role_echo"] = (
        "role:s variable:s",
        lambda s, d: _role_echo(s, d),
        f"WITH {O.profile(_c('line_facts'))} SELECT 'survival_time' AS role, variable FROM types WHERE variable = 'l_quantity' "
        "UNION ALL SELECT 'event', variable FROM types WHERE variable = 'l_returnflag' "
        "UNION ALL SELECT 'covariate', variable FROM types WHERE variable IN ('l_suppkey')",
    )

    # readiness
    r["ready_eda"] = _ready("orders_dirty", "basic_stats", {}, O.ready_eda(od, ORDERS_USABLE))
    r["ready_eda_events"] = _ready("events_special", "visualization", {}, O.ready_eda(ev, EVENTS_USABLE))
    r["test_candidates"] = (
        O.CANDIDATE_OUT,
        lambda s, d: candidates_of(typed_profile(frame_of(_read("events_special", s, d)))),
        f"WITH {O.profile(ev)}, {O.CANDIDATES} SELECT *, is_stable_numeric OR is_stable_categorical AS is_stable FROM cand",
    )
    r["ready_test_nogroup"] = _ready("orders_dirty", "advanced_ml", {}, O.ready_test(od, ORDERS_USABLE))
    in_group = [c for c in ORDERS_USABLE if c != "o_orderpriority"]
    r["ready_test_group"] = _ready(
        "orders_dirty",
        "advanced_ml",
        {"group_var": "o_orderpriority"},
        O.ready_test_group(od, "o_orderpriority", in_group),
    )
    r["possible_tests"] = (
        "test:s",
        lambda s, d: check_hypothesis(profile(_read("orders_dirty", s, d)), "o_orderpriority").details[
            "possible_tests"
        ],
        f"WITH {O.group_ctes(od, 'o_orderpriority', in_group)}, m AS "
        f"({O.test_figures('o_orderpriority', *O.GROUP_FIGURES, O.TESTS_GROUP)}) "
        f"SELECT unnest({O.tests_list(O.TESTS_GROUP)}) AS test FROM m",
    )
    r["ready_regression"] = _ready(
        "orders_dirty",
        "regression",
        {"response_var": "o_totalprice"},
        O.ready_regression(od, "o_totalprice", ["o_custkey", "o_orderstatus", "o_orderpriority"]),
    )
    r["ready_classification"] = _ready(
        "events_special",
        "classification",
        {"response_var": "event_type"},
        O.ready_classification(ev, "event_type", ["user_id", "value"]),
    )
    r["time_gaps"] = (
        O.GAP_OUT,
        lambda s, d: gap_table(profile(_read("orders", s, d).select("o_orderdate")), "o_orderdate"),
        O.time_gaps(_c("orders"), "o_orderdate"),
    )
    r["time_gaps_events"] = (
        O.GAP_OUT,
        lambda s, d: gap_table(profile(_read("events_special", s, d).select("ts")), "ts"),
        O.time_gaps(ev, "ts"),
    )
    for name in ("date_text", "date_number"):  # both write the days of l_shipdate
        r[f"time_gaps_{name}"] = (
            O.GAP_OUT,
            lambda s, d, n=name: gap_table(profile(_read("lineitem_text", s, d).select(n)), n),
            O.time_gaps(Case("lineitem", (("date_trunc('day', l_shipdate)", "t", "t"),)), "t"),
        )
    weekdays = Case("orders", (("CASE WHEN isodow(o_orderdate) < 6 THEN o_orderdate END", "t", "t"),))
    r["time_gaps_business"] = (
        O.GAP_OUT,
        lambda s, d: gap_table(
            profile(_read("orders", s, d).selectExpr("CASE WHEN weekday(o_orderdate) < 5 THEN o_orderdate END AS t")), "t"
        ),
        O.time_gaps(weekdays, "t"),
    )
    r["ready_timeseries"] = _ready(
        "lineitem",
        "time_series",
        {"time_var": "l_shipdate", "value_var": "l_quantity"},
        O.ready_timeseries(li, "l_shipdate", "l_quantity"),
    )
    r["ready_timeseries_events"] = _ready(
        "events_special",
        "time_series",
        {"time_var": "ts", "value_var": "value"},
        O.ready_timeseries(ev, "ts", "value"),
    )
    series = ["quantity", "price", "net", "gross"]
    roles = {"time_var": "l_shipdate", "value_vars": series}
    r["time_gaps_columns"] = (
        f"variable:s {O.GAP_OUT}",
        lambda s, d: evaluate_readiness(_read("line_series", s, d), "time_series", roles).details["spacing"],
        O.time_gaps_of(_c("line_series"), "l_shipdate", series),
    )
    r["ready_timeseries_columns"] = (
        "purpose:s status:s score:d",
        lambda s, d: evaluate_readiness(_read("line_series", s, d), "time_series", roles).result,
        O.timeseries_rollup(_c("line_series"), "l_shipdate", series),
    )
    covariates = ["l_discount", "l_linestatus", "l_tax"]
    r["ready_survival"] = _ready(
        "lineitem",
        "survival",
        {
            "survival_time_var": "l_quantity",
            "event_var": "l_returnflag",
            "event_value": "R",
            "covariates": covariates,
        },
        O.ready_survival(li, "l_quantity", "l_returnflag", "R", covariates),
    )
    r["strong_pairs"] = (
        "variable_1:s variable_2:s r:d is_strong:b",
        lambda s, d: _pairs(_read("part", s, d)),
        f"WITH {O.clean(_c('part'))} {O.pairs_sql(PART_NUMERIC)}",
    )
    r["strong_pairs_embeddings"] = (  # 64 columns: blocked co-moments
        "variable_1:s variable_2:s r:d is_strong:b",
        lambda s, d: _pairs(_embedding_columns(s, d)),
        O.EMBEDDING_PAIRS,
    )
    r["obvious_ids"] = (
        "pos:i variable:s n_non_missing:i n_unique:i is_obvious_id:b",
        lambda s, d: obvious_id_table(profile(_read("customer", s, d))),
        O.obvious_ids(_c("customer")),
    )
    cu = _c("customer")
    r["clustering_candidates"] = (
        "pos:i variable:s variable_type:s n_unique:i is_final:b reason:s",
        lambda s, d: check_clustering(
            profile(_read("customer", s, d)), [n for _, n, _ in cu.columns]
        ).details["candidates"],
        f"WITH {O.profile(cu)} SELECT pos, variable, vt AS variable_type, u AS n_unique, reason = 'final' AS is_final, reason "
        "FROM (SELECT t.*, CASE WHEN is_obvious_id THEN 'id_chosen' WHEN kind <> 'numeric' THEN 'category_chosen' "
        f"WHEN u < 2 THEN 'single_value_chosen' ELSE 'final' END AS reason FROM types t JOIN ({O.obvious_ids(cu)}) o USING (pos))",
    )
    r["ready_clustering"] = _ready("lineitem", "cluster", {}, O.ready_clustering(li, LINE_NUMERIC))
    r["ready_correlation"] = _ready(
        "orders_dirty",
        "correlation",
        {},
        O.ready_multivariate(od, ["o_orderkey", "o_custkey", "o_totalprice"]),
    )
    r["ready_dimension"] = _ready(
        "lineitem", "dimension", {}, O.ready_multivariate(li, LINE_NUMERIC)
    )
    return r


def _repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read("lineitem", spark, sf_dir)
    return lines.union(lines.where("l_orderkey % 50 = 0"))


def _as_csv(df: DataFrame) -> str:
    """Write a table as CSV to the shared folder; every text is quoted."""
    ensure_checkpoint_dir(df.sparkSession)
    folder = df.sparkSession.sparkContext.getCheckpointDir()
    path = f"{folder}/csv-{uuid.uuid4().hex}"
    df.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def _supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names ``load_table`` takes for a format."""
    rows = []
    for name in ("orders.parquet", "orders.xlsx", "orders"):
        try:
            rows.append((name, load_table(spark, f"{sf_dir}/{name}").limit(1).count() == 1))
        except UnsupportedFormat:
            rows.append((name, False))
    return spark.createDataFrame(rows, "name string, supported boolean")


def _two_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled = profile(_read("lineitem", spark, sf_dir))
    chosen = {"all": (), "one": ("l_quantity", "l_returnflag"), "two": ("l_quantity", "l_discount")}
    return spark.createDataFrame([(k, has_two_numeric(profiled, v)) for k, v in chosen.items()], "chosen string, enough boolean")


def _role_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen roles of a purpose, as far as the table has their columns."""
    roles = {"survival_time_var": "l_quantity", "event_var": " l_returnflag ", "covariates": ["l_suppkey", "l_suppkey", ""]}
    columns = variable_types(_read("line_facts", spark, sf_dir)).select("variable")
    return selected_roles(spark, "survival", roles).join(columns, "variable").select("role", "variable")


def _embedding_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.selectExpr(*[f"CAST(embedding[{i}] AS DOUBLE) AS e{i}" for i in range(64)])


def _outliers(df: DataFrame) -> DataFrame:
    profiled = profile(df)
    return iqr_outliers(profiled).table(profiled)


def _boxes(df: DataFrame) -> DataFrame:
    profiled = profile(df)
    return box_summary(profiled, iqr_outliers(profiled))


def _pairs(df: DataFrame) -> DataFrame:
    profiled = profile(df)
    return strong_pairs(profiled, profiled.of_type("numeric"))


REGISTRY = _registry()


def entry(spark: SparkSession) -> DataFrame:
    """Quality score of the orders table with missing prices and priorities."""
    return queries()["quality_score"](spark, "/root/testdata/sf0.001")


try:  # both go together, and everything else works without them
    import corpus_pipeline
    from plumbline.llm.queries import ORACLE, QUERIES

    LLM_QUERIES = {**QUERIES, "pipeline": corpus_pipeline.run}
    LLM_ORACLE = {**ORACLE, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
except ImportError:
    LLM_QUERIES, LLM_ORACLE = {}, {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {
        name: (lambda s, d, spec=spec, run=run: _shaped(run(s, d), spec))
        for name, (spec, run, _) in REGISTRY.items()
    }
    return {**own, **LLM_QUERIES}


def oracle_sql() -> dict[str, str]:
    own = {name: O.shaped(sql, spec) for name, (spec, _, sql) in REGISTRY.items()}
    return {**own, **LLM_ORACLE}
