"""DuckDB SQL that recomputes every registered query from the raw tables.

Written apart from the package: the SQL uses DuckDB's own exact aggregates
(``quantile_cont``, ``count(DISTINCT)``, ``corr``, window ``lag``) and states the limits
again, so a wrong limit on either side shows up as a mismatch.
"""

from __future__ import annotations

from cases import CASES, Case

BLANKS = "' ' || chr(9) || chr(13) || chr(10)"
TOKENS = "('', 'NA', 'N/A', 'na', 'n/a', 'null', 'NULL', '.', 'NaN', '-')"
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
HINT = r"\d{4}[-/.]?\d{1,2}[-/.]?\d{1,2}"
CAST = {"i": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}


def shaped(sql: str, spec: str) -> str:
    """Cast and round the outputs named in ``spec`` (``name:kind``) the same way on both sides."""
    cells = []
    for item in spec.split():
        name, kind = item.split(":")
        cell = f"CAST({name} AS {CAST[kind]})"
        cells.append(f"{f'round({cell}, 6)' if kind == 'd' else cell} AS {name}")
    return f"SELECT {', '.join(cells)} FROM (\n{sql}\n)"


# --- cleaning and profile ---------------------------------------------------------------


def norm(expr: str, kind: str, codes: tuple = ()) -> str:
    if kind == "s":
        t = f"trim({expr}, {BLANKS})"
        extra = "".join(f", '{c}'" for c in codes)
        return f"CASE WHEN {t} NOT IN {TOKENS[:-1]}{extra}) THEN {t} END"
    if kind == "d":
        expr = f"CASE WHEN NOT isnan({expr}) THEN {expr} END"
    if codes and kind in "id":
        numbers = ", ".join(str(float(c)) for c in codes if str(c).replace(".", "", 1).isdigit())
        if numbers:
            expr = f"CASE WHEN CAST({expr} AS DOUBLE) NOT IN ({numbers}) THEN {expr} END"
    return expr


def clean(case: Case, codes: tuple = ()) -> str:
    cells = ", ".join(f"{norm(n, k, codes)} AS {n}" for _, n, k in case.columns)
    return f"base AS ({case.select()}),\nclean AS (SELECT {cells} FROM base)"


def is_number(k: str) -> str:
    return f"regexp_matches(replace({k}, ',', ''), '{NUMBER}')"


def is_date(k: str) -> str:
    tests = []
    for sep in ("-", "/", r"\."):
        day = rf"^(\d{{4}}){sep}(\d{{1,2}}){sep}(\d{{1,2}})"
        tests.append((day + "$", r"\1-\2-\3", ""))
        clock = r" (\d{1,2}):(\d{1,2}):(\d{1,2})$"
        limit = " AND ".join(
            f"try_cast(regexp_extract({k}, '{day + clock}', {g}) AS INT) <= {top}"
            for g, top in ((4, 23), (5, 59), (6, 59))
        )
        tests.append((day + clock, r"\1-\2-\3", f" AND {limit}"))
    tests.append((r"^(\d{4})(\d{2})(\d{2})$", r"\1-\2-\3", ""))
    tests.append((r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"\3-\1-\2", ""))
    tests.append((r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"\3-\2-\1", ""))
    return "(" + " OR ".join(
        f"(regexp_matches({k}, '{p}') AND try_cast(regexp_replace({k}, '{p}', '{t}') AS DATE) IS NOT NULL{x})"
        for p, t, x in tests
    ) + ")"


def is_compact(k: str) -> str:
    d = f"CAST({k} AS DOUBLE)"
    text = f"CAST(CAST({k} AS BIGINT) AS VARCHAR)"
    day = rf"regexp_replace({text}, '^(\d{{4}})(\d{{2}})(\d{{2}})$', '\1-\2-\3')"
    return (
        f"CASE WHEN {d} = floor({d}) AND {d} >= 10000000 AND {d} < 100000000 "
        f"THEN try_cast({day} AS DATE) IS NOT NULL ELSE false END"
    )


def profile(case: Case, codes: tuple = ()) -> str:
    """CTEs base, clean, prof and types (one row per column)."""
    parts = []
    for pos, (_, name, kind) in enumerate(case.columns):
        number = date = hint = "0"
        time = "false"
        special = ["0", "0", "0"]
        if kind == "s":
            number = f"coalesce(sum(cnt) FILTER (k IS NOT NULL AND {is_number('k')}), 0)"
            date = f"coalesce(sum(cnt) FILTER (k IS NOT NULL AND {is_date('k')}), 0)"
            hint = f"coalesce(max(CAST(regexp_matches(k, '{HINT}') AS INT)), 0)"
            time = f"coalesce(avg(CAST({is_date('k')} AS INT)) >= 0.9, false)"
        elif kind in "id":
            time = f"coalesce(bool_and({is_compact('k')}) FILTER (k IS NOT NULL AND isfinite(CAST(k AS DOUBLE))), false)"
            if kind == "d":
                time = f"(coalesce(bool_and(isfinite(k)), true) AND {time})"
                special = [
                    f"(SELECT count(*) FILTER ({test}) FROM base)"
                    for test in (
                        f"isnan({name})",
                        f"{name} = CAST('Infinity' AS DOUBLE)",
                        f"{name} = CAST('-Infinity' AS DOUBLE)",
                    )
                ]
        elif kind == "t":
            time = "true"
        word = {"i": "numeric", "d": "numeric", "s": "string", "t": "timestamp"}[kind]
        parts.append(
            f"SELECT {pos} AS pos, '{name}' AS variable, '{word}' AS kind, "
            "coalesce(sum(cnt), 0) AS n_rows, coalesce(sum(cnt) FILTER (k IS NULL), 0) AS n_missing, "
            "coalesce(sum(cnt) FILTER (k IS NOT NULL), 0) AS n, count(k) AS u, "
            "coalesce(max(cnt) FILTER (k IS NOT NULL), 0) AS mx, "
            "coalesce(min(cnt) FILTER (k IS NOT NULL), 0) AS mn, "
            f"{number} AS number_text, {date} AS date_text, {hint} AS hint, {time} AS is_time, "
            f"{special[0]} AS n_nan, {special[1]} AS n_pinf, {special[2]} AS n_ninf "
            f"FROM (SELECT {name} AS k, count(*) AS cnt FROM clean GROUP BY 1)"
        )
    union = "\nUNION ALL ".join(parts)
    return f"""{clean(case, codes)},
prof AS (SELECT *, CASE WHEN n > 0 THEN u / n ELSE 0 END AS ratio,
  CASE WHEN n_rows > 0 THEN n_missing / n_rows ELSE 0 END AS miss,
  n - n_pinf - n_ninf AS n_finite FROM ({union})),
types AS (SELECT *, CASE
  WHEN u <= 1 THEN 'excluded'
  WHEN is_time THEN 'date'
  WHEN n >= 30 AND ratio >= 0.9
    AND regexp_matches(lower(trim(variable)), '(^|[^a-z])(id|no|code|key|seq)([^a-z]|$)') THEN 'id'
  WHEN kind = 'numeric' THEN CASE WHEN u <= 10 THEN 'numeric_categorical' ELSE 'numeric' END
  WHEN kind = 'string' AND u <= 10 THEN 'categorical'
  ELSE 'other' END AS vt FROM prof)"""


def outliers(case: Case, only: tuple[str, ...] | None = None) -> str:
    """CTE outl: quartiles, fences and outlier counts of every physically numeric column."""
    parts = []
    for pos, (_, name, kind) in enumerate(case.columns):
        if kind not in "id" or (only is not None and name not in only):
            continue
        parts.append(
            f"SELECT {pos} AS pos, '{name}' AS variable, q1, q3, med, n AS n_fin, "
            "q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, "
            "CASE WHEN q3 = q1 THEN 0 ELSE (SELECT count(*) FROM clean WHERE "
            f"isfinite(CAST({name} AS DOUBLE)) AND ({name} < q1 - 1.5 * (q3 - q1) OR {name} > q3 + 1.5 * (q3 - q1))) END AS n_out, "
            f"(SELECT min({name}) FROM clean WHERE isfinite(CAST({name} AS DOUBLE)) AND ({name} >= q1 - 1.5 * (q3 - q1) OR q1 = q3)) AS w_lo, "
            f"(SELECT max({name}) FROM clean WHERE isfinite(CAST({name} AS DOUBLE)) AND ({name} <= q3 + 1.5 * (q3 - q1) OR q1 = q3)) AS w_hi "
            f"FROM (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, "
            f"quantile_cont(v, 0.5) AS med, count(v) AS n FROM "
            f"(SELECT CAST({name} AS DOUBLE) AS v FROM clean) WHERE isfinite(v))"
        )
    return (
        "outl AS (SELECT *, CASE WHEN n_fin > 1 THEN n_out / n_fin ELSE 0 END AS rate FROM ("
        + "\nUNION ALL ".join(parts)
        + "))"
    )


def steps(metric: str, op: str, pairs: list[tuple[float, float]], default: float = 0) -> str:
    body = " ".join(f"WHEN {metric} {op} {limit} THEN {points}" for limit, points in pairs)
    return f"CASE {body} ELSE {default} END"


# --- quality ------------------------------------------------------------------------------

MISSING_OUT = (
    "pos:i variable:s missing_count:i missing_rate:d missing_percent:d missing_over_10:b "
    "missing_over_20:b missing_over_30:b high_missing:b"
)


def missing_table(case: Case) -> str:
    parts = [
        f"SELECT {p} AS pos, '{n}' AS variable, count(*) AS n_rows, count(*) - count({n}) AS missing_count FROM clean"
        for p, (_, n, _) in enumerate(case.columns)
    ]
    return (
        f"{clean(case)}, counted AS ({' UNION ALL '.join(parts)}), "
        "miss AS (SELECT pos, variable, n_rows, missing_count, round_even(missing_count / n_rows, 4) AS missing_rate, "
        "round_even(missing_count / n_rows * 100, 2) AS missing_percent, missing_count / n_rows >= 0.1 AS missing_over_10, "
        "missing_count / n_rows >= 0.2 AS missing_over_20, missing_count / n_rows >= 0.3 AS missing_over_30, "
        "missing_count / n_rows >= 0.4 AS high_missing FROM counted)"
    )


PATTERN = (
    "greatest(0, 10 - CASE WHEN max_rate >= 0.3 THEN 3 WHEN max_rate >= 0.2 THEN 2 WHEN max_rate >= 0.1 THEN 1 ELSE 0 END"
    " - CASE WHEN over_30 > 0 THEN 2 ELSE 0 END - CASE WHEN over_20 > 0 THEN 2 ELSE 0 END"
    " - CASE WHEN over_10 > 0 THEN 1 ELSE 0 END)"
)
TOTAL = steps("total_rate", "<", [(0.05, 15), (0.1, 12), (0.2, 8), (0.4, 4)])


def missing_score(case: Case) -> str:
    return (
        f"WITH {missing_table(case)}, t AS (SELECT sum(missing_count) AS total_missing, sum(n_rows) AS total_cells, "
        "sum(missing_count) / sum(n_rows) AS total_rate, max(missing_rate) AS max_rate, "
        "count(*) FILTER (missing_over_10) AS over_10, count(*) FILTER (missing_over_20) AS over_20, "
        "count(*) FILTER (missing_over_30) AS over_30 FROM miss) "
        f"SELECT *, {TOTAL} AS total_points, {PATTERN} AS pattern_points, {TOTAL} + {PATTERN} AS score FROM t"
    )


ISSUES = (
    "list_filter([CASE WHEN ns >= 0.8 THEN 'should_be_numeric' END, CASE WHEN ds >= 0.8 THEN 'should_be_date' END, "
    "CASE WHEN ns > 0 AND ns < 0.8 THEN 'mixed_number_text' END, "
    "CASE WHEN hint > 0 AND ds > 0 AND ds < 0.8 THEN 'mixed_date' END], lambda x: x IS NOT NULL)"
)
ISSUE_CTE = (
    f"iss AS (SELECT * FROM (SELECT *, {ISSUES} AS issues FROM (SELECT *, number_text / n AS ns, date_text / n AS ds "
    "FROM types WHERE kind = 'string' AND n > 0)) WHERE len(issues) > 0)"
)
STRUCT_CTE = (
    "struct AS (SELECT pos, variable, 'excluded' AS problem FROM types WHERE vt = 'excluded' "
    "UNION ALL SELECT pos, variable, 'id_suspect' FROM types WHERE vt = 'id' "
    "UNION ALL SELECT pos, variable, 'zero_variance' FROM types WHERE vt = 'numeric' AND n_finite > 1 "
    "AND u - (n_pinf > 0)::INT - (n_ninf > 0)::INT = 1)"
)
CAT_CTE = (
    "cat AS (SELECT *, round_even(mx / n * 100, 2) AS top, u / n_rows AS ur, list_filter(["
    "CASE WHEN mx / n >= 0.9 THEN 'dominant_category' END, CASE WHEN u / n_rows >= 0.5 THEN 'too_many_values_for_rows' END, "
    "CASE WHEN u > 10 THEN 'too_many_categories' END], lambda x: x IS NOT NULL) AS problems "
    "FROM types WHERE vt IN ('categorical', 'numeric_categorical'))"
)


def dup_cte(case: Case) -> str:
    names = ", ".join(n for _, n, _ in case.columns)
    return (
        "dup AS (SELECT (SELECT count(*) FROM clean) AS total_rows, (SELECT count(*) FROM clean) - count(*) AS dups "
        f"FROM (SELECT DISTINCT {names} FROM clean))"
    )


def quality(case: Case, codes: tuple = ()) -> str:
    """All quality CTEs up to ``fig`` (one row of figures) and ``items`` (seven scores)."""
    dup_points = steps("dup_rate", "<", [(0.01, 15), (0.05, 12), (0.1, 8), (0.2, 4)])
    dup_score = f"CASE WHEN relaxed THEN greatest(12, {dup_points}) ELSE {dup_points} END"
    type_points = steps("type_rate", "<", [(0.05, 15), (0.1, 12), (0.2, 8), (0.3, 4)])
    special = (
        "CASE WHEN special_rate = 0 THEN 5 WHEN special_rate < 0.05 THEN 4 WHEN special_rate < 0.1 THEN 3 "
        "WHEN special_rate < 0.2 THEN 1 ELSE 0 END"
    )
    ten = [(0.05, 10), (0.1, 8), (0.2, 5), (0.3, 3)]
    items = [
        ("missing", f"{TOTAL} + {PATTERN}", 25),
        ("type_format", f"{type_points} + {special}", 20),
        ("duplicate", dup_score, 15),
        ("outlier", steps("mean_out", "<=", [(0.05, 15), (0.1, 12), (0.2, 8), (0.3, 4)]), 15),
        ("structure", steps("struct_rate", "<", ten), 10),
        ("categorical", steps("cat_rate", "<", ten), 10),
        (
            "basic",
            "CASE WHEN force THEN 0 WHEN n_rows >= 10 AND n_cols >= 2 THEN 5 WHEN n_rows < 10 OR n_cols = 1 THEN 3 ELSE 0 END",
            5,
        ),
    ]
    rows = " UNION ALL ".join(
        f"SELECT {i + 1} AS item_no, '{name}' AS item, {points} AS score, {top} AS max_score FROM fig"
        for i, (name, points, top) in enumerate(items)
    )
    numeric = any(k in "id" for _, _, k in case.columns)
    outl = outliers(case) if numeric else "outl AS (SELECT 0 AS pos, '' AS variable, 0 AS n_out, 1 AS n_fin, 0.0 AS rate, 0.0 AS lo, 0.0 AS hi WHERE false)"
    return f"""{profile(case, codes)}, {outl}, {ISSUE_CTE}, {STRUCT_CTE}, {CAT_CTE}, {dup_cte(case)},
onum AS (SELECT o.* FROM outl o JOIN types t ON o.pos = t.pos WHERE t.vt = 'numeric'),
fig AS (SELECT *, dups / n_rows AS dup_rate, dups > 0 AND n_numeric = 0 AND n_cat > 0 AS relaxed,
  n_rows = 0 OR n_ok = 0 AS force FROM (SELECT count(*) AS n_cols, max(n_rows) AS n_rows,
  sum(n_missing) / sum(n_rows) AS total_rate, max(round_even(miss, 4)) AS max_rate,
  count(*) FILTER (miss >= 0.1) AS over_10, count(*) FILTER (miss >= 0.2) AS over_20, count(*) FILTER (miss >= 0.3) AS over_30,
  (SELECT count(*) FROM iss) / count(*) AS type_rate,
  coalesce(count(*) FILTER (n_nan + n_pinf + n_ninf > 0) / nullif(count(*) FILTER (kind = 'numeric'), 0), 0) AS special_rate,
  count(*) FILTER (n_nan + n_pinf + n_ninf > 0) AS n_special,
  (SELECT count(DISTINCT pos) FROM struct) / count(*) AS struct_rate,
  (SELECT coalesce(count(*) FILTER (len(problems) > 0) / nullif(count(*), 0), 0) FROM cat) AS cat_rate,
  (SELECT coalesce(avg(round_even(rate, 4)), 0) FROM onum) AS mean_out, (SELECT dups FROM dup) AS dups,
  count(*) FILTER (vt = 'numeric') AS n_numeric, count(*) FILTER (vt = 'date') AS n_date,
  count(*) FILTER (vt IN ('categorical', 'numeric_categorical')) AS n_cat,
  count(*) FILTER (vt IN ('date', 'categorical', 'numeric_categorical', 'numeric')) AS n_ok FROM types)),
scored AS ({rows}),
items AS (SELECT *, CASE WHEN score / max_score >= 0.8 THEN 'good' WHEN score / max_score >= 0.6 THEN 'caution' ELSE 'danger' END AS status FROM scored),
warn AS (SELECT unnest(list_filter([{"'user_missing_codes_used'" if codes else "NULL"}, CASE WHEN n_date > 0 THEN 'date_columns_not_penalised' END,
  CASE WHEN relaxed THEN 'duplicates_relaxed' END, CASE WHEN n_numeric = 0 THEN 'outliers_skipped' END,
  CASE WHEN n_special > 0 THEN 'special_values_present' END, CASE WHEN n_cat = 0 THEN 'categories_skipped' END,
  CASE WHEN force THEN 'force_danger' END], lambda x: x IS NOT NULL)) AS warning FROM fig)"""


SCORE = (
    "SELECT total_score, force AS force_danger, CASE WHEN force THEN 'danger' WHEN total_score >= 80 THEN 'good' "
    "WHEN total_score >= 60 THEN 'caution' ELSE 'danger' END AS final_status, CASE WHEN total_score >= 90 THEN 'excellent' "
    "WHEN total_score >= 70 THEN 'good' WHEN total_score >= 50 THEN 'caution' ELSE 'unfit' END AS grade "
    "FROM (SELECT sum(score) AS total_score FROM items), fig"
)
MAJOR = (
    "SELECT item_no, item, status FROM items WHERE status <> 'good' UNION ALL "
    "SELECT 0, 'none', 'good' WHERE NOT EXISTS (SELECT 1 FROM items WHERE status <> 'good')"
)
FINDINGS = """allf AS (
SELECT 1 AS priority, 'item' AS kind, item AS subject, status AS severity FROM items WHERE status <> 'good'
UNION ALL SELECT 2, 'missing', variable, CASE WHEN round_even(miss * 100, 2) >= 10 THEN 'danger' ELSE 'caution' END FROM types WHERE n_missing > 0
UNION ALL SELECT 3, 'outlier', variable, CASE WHEN round_even(rate * 100, 2) >= 5 THEN 'danger' ELSE 'caution' END FROM onum
  WHERE n_out > 0 AND NOT EXISTS (SELECT 1 FROM items WHERE item = 'outlier' AND status <> 'good')
UNION ALL SELECT 4, 'duplicate', CAST(dups AS VARCHAR), 'caution' FROM fig WHERE dups > 0
UNION ALL SELECT 5, 'warning', warning, 'info' FROM warn)"""
RECOMMEND = """SELECT 'handle_missing' AS recommendation WHERE EXISTS (SELECT 1 FROM types WHERE n_missing > 0)
UNION ALL SELECT 'check_outliers' WHERE EXISTS (SELECT 1 FROM onum WHERE n_out > 0)
UNION ALL SELECT 'convert_types' WHERE EXISTS (SELECT 1 FROM iss)
UNION ALL SELECT 'review_duplicates' FROM fig WHERE dups > 0"""
COLUMN_REPORT = """SELECT *, CASE WHEN missing_percent >= 10 THEN 'red' WHEN missing_percent > 0 OR outlier_count IS NOT NULL THEN 'amber' ELSE 'none' END AS band
FROM (SELECT t.pos, t.variable, vt AS variable_type, round_even(round_even(miss * 100, 2), 1) AS missing_percent, u AS unique_count,
  round_even(round_even(ratio, 4) * 100, 1) AS unique_percent, CASE WHEN n_out > 0 THEN n_out END AS outlier_count,
  CASE WHEN n_out > 0 THEN round_even(rate * 100, 2) END AS outlier_percent FROM types t LEFT JOIN onum o ON o.pos = t.pos)"""


# --- readiness ----------------------------------------------------------------------------

SHEET_OUT = "section:s item:s value:d"


def sheet(
    ctes: str,
    figures: str,
    essential: list[tuple[str, str]],
    points: list[tuple[str, str]],
    summary: list[str],
    messages: list[tuple[str, str]],
    notes: list[tuple[str, str]],
) -> str:
    passed = " AND ".join(f"coalesce({c}, false)" for _, c in essential)
    scores = ", ".join(f"{body} AS {code}" for code, body in points)
    total = " + ".join(code for code, _ in points)
    rows = [f"SELECT 'essential' AS section, '{c}' AS item, CAST(({t})::INT AS DOUBLE) AS value FROM p" for c, t in essential]
    rows += [f"SELECT 'points', '{c}', CAST({c} AS DOUBLE) FROM p WHERE passed" for c, _ in points]
    rows += [f"SELECT 'summary', '{n}', round_even(CAST({n} AS DOUBLE), 4) FROM p" for n in summary]
    rows += [f"SELECT 'message', '{c}', 1.0 FROM p WHERE {t}" for c, t in messages]
    rows += [f"SELECT 'note', '{c}', 1.0 FROM p WHERE {t}" for c, t in notes]
    rows.append(
        "SELECT 'status', CASE WHEN NOT passed THEN 'unfit' WHEN total >= 80 THEN 'fit' WHEN total >= 60 THEN 'partly' "
        "ELSE 'unfit' END, CAST(CASE WHEN passed THEN total ELSE 0 END AS DOUBLE) FROM p"
    )
    return (
        f"WITH {ctes}, m AS ({figures}), e AS (SELECT *, {passed} AS passed FROM m), "
        f"s AS (SELECT *, {scores} FROM e), p AS (SELECT *, {total} AS total FROM s)\n"
        + "\nUNION ALL ".join(rows)
    )


def names(case: Case) -> list[str]:
    return [n for _, n, _ in case.columns]


def any_value(columns: list[str]) -> str:
    return "(" + (" OR ".join(f"{c} IS NOT NULL" for c in columns) or "false") + ")"


def up(metric: str, *pairs: tuple[float, float], default: float = 0) -> str:
    return steps(metric, ">=", list(pairs), default)


def down(metric: str, *pairs: tuple[float, float], default: float = 0) -> str:
    return steps(metric, "<", list(pairs), default)


EDA_POINTS = [
    ("R1", up("n_valid", (50, 35), (30, 28), (20, 20), (10, 10))),
    (
        "R2",
        "CASE WHEN n_numeric >= 3 THEN CASE WHEN n_valid >= 5 * n_numeric THEN 20 ELSE 16 END "
        "WHEN n_numeric = 2 THEN 12 WHEN n_numeric = 1 THEN 6 ELSE 0 END",
    ),
    ("R3", up("n_categorical", (3, 20), (2, 15), (1, 8))),
    ("R4", down("avg_missing_rate", (0.05, 20), (0.2, 15), (0.4, 8), (0.6, 3))),
    ("R5", "CASE WHEN n_numeric = 0 OR avg_outlier_rate <= 0.1 THEN 5 WHEN avg_outlier_rate <= 0.2 THEN 3 ELSE 0 END"),
]
EDA_SUMMARY = "n_selected n_analyzable n_numeric n_categorical n_valid avg_missing_rate avg_outlier_rate".split()
EDA_MESSAGES = [
    ("small_sample", "passed AND n_valid < 20"),
    ("no_numeric", "passed AND n_numeric = 0"),
    ("no_categorical", "passed AND n_categorical = 0"),
    ("single_variable_only", "passed AND n_numeric < 2 AND n_categorical < 2"),
    ("few_rows_per_numeric", "passed AND n_numeric > 2 AND n_valid < 5 * n_numeric"),
    ("missing_very_high", "passed AND avg_missing_rate >= 0.6"),
    ("missing_high", "passed AND avg_missing_rate >= 0.4 AND avg_missing_rate < 0.6"),
    ("missing_many", "passed AND avg_missing_rate >= 0.2 AND avg_missing_rate < 0.4"),
    ("outliers_high", "passed AND avg_outlier_rate > 0.2"),
    ("outliers_some", "passed AND avg_outlier_rate > 0.1 AND avg_outlier_rate <= 0.2"),
]


def eda_figures(case: Case, where: str, usable: list[str]) -> str:
    """``usable`` lists the columns that can be analysed; ``where`` picks them in types."""
    return (
        f"SELECT (SELECT count(*) FROM types WHERE {where}) AS n_selected, count(*) AS n_analyzable, "
        "count(*) FILTER (vt = 'numeric') AS n_numeric, count(*) FILTER (vt <> 'numeric') AS n_categorical, "
        f"(SELECT count(*) FROM clean WHERE {any_value(usable)}) AS n_valid, avg(miss) AS avg_missing_rate, "
        f"(SELECT avg(rate) FROM outl o JOIN types t ON o.pos = t.pos WHERE vt = 'numeric' AND t.pos IN (SELECT pos FROM types WHERE {where})) AS avg_outlier_rate, "
        "(SELECT count(*) FROM types WHERE vt = 'numeric') AS n_numeric_all, 0 AS n_chosen "
        f"FROM types WHERE ({where}) AND vt IN ('numeric', 'categorical', 'numeric_categorical')"
    )


def ready_eda(case: Case, usable: list[str]) -> str:
    return sheet(
        f"{profile(case)}, {outliers(case)}",
        eda_figures(case, "true", usable),
        [("F1", "n_analyzable > 0"), ("F2", "CASE WHEN n_analyzable > 0 THEN n_valid >= 10 END")],
        EDA_POINTS,
        EDA_SUMMARY,
        [
            ("no_analyzable_columns", "n_analyzable = 0"),
            ("too_few_rows", "n_analyzable > 0 AND n_valid < 10"),
            *EDA_MESSAGES,
        ],
        [
            ("score_meaning", "true"),
            ("numeric_and_categorical", "n_numeric > 0 AND n_categorical > 0"),
            ("categorical_only", "n_numeric = 0 AND n_categorical > 0"),
            ("numeric_only", "n_numeric > 0 AND n_categorical = 0"),
        ],
    )


def ready_multivariate(case: Case, usable: list[str]) -> str:
    return sheet(
        f"{profile(case)}, {outliers(case)}",
        eda_figures(case, "vt = 'numeric'", usable),
        [
            ("F0", "n_numeric_all >= 2"),
            ("F0s", "n_chosen = 0 OR n_numeric >= 2"),
            ("F1", "n_analyzable > 0"),
            ("F2", "CASE WHEN n_analyzable > 0 THEN n_valid >= 10 END"),
        ],
        EDA_POINTS,
        EDA_SUMMARY,
        [
            ("under_two_numeric_in_table", "n_numeric_all < 2"),
            *EDA_MESSAGES,
            ("too_few_rows", "n_numeric_all >= 2 AND n_valid < 10"),
        ],
        [("purpose_score_meaning", "n_numeric_all >= 2"), ("numeric_only", "n_numeric_all >= 2")],
    )


CANDIDATES = """cand AS (SELECT pos, variable, vt AS variable_type, n AS n_non_missing, u AS n_unique, miss AS missing_rate, ratio AS unique_ratio,
 n >= 30 AND ratio >= 0.9 AS is_id, vt = 'numeric' AS is_numeric_candidate,
 vt IN ('categorical', 'numeric_categorical') AS is_categorical_candidate,
 vt IN ('numeric', 'categorical', 'numeric_categorical') AS is_test_candidate,
 vt = 'numeric' AND n >= 10 AND n_pinf + n_ninf = 0 AS is_stable_numeric,
 vt IN ('categorical', 'numeric_categorical') AND n >= 10 AND u <= 10 AND mn >= 3 AS is_stable_categorical,
 (kind = 'string' OR vt = 'categorical') AND u > 10 AS is_high_cardinality FROM types)"""
CANDIDATE_OUT = (
    "pos:i variable:s variable_type:s n_non_missing:i n_unique:i missing_rate:d unique_ratio:d is_id:b "
    "is_numeric_candidate:b is_categorical_candidate:b is_test_candidate:b is_stable_numeric:b "
    "is_stable_categorical:b is_stable:b is_high_cardinality:b"
)
TESTS_PLAIN = [
    ("p >= 1", "one_sample_t wilcoxon_signed_rank normality"),
    ("p >= 2", "paired_t pearson_correlation spearman_correlation kendall_correlation"),
    ("p >= 3", "multiple_correlation bartlett_sphericity kmo"),
    ("q >= 1", "binomial chi_square_goodness_of_fit"),
    ("q >= 2", "chi_square_independence fisher_exact category_pairs"),
]
TESTS_GROUP = [
    ("k = 2 AND p >= 1", "independent_t welch_t mann_whitney_u"),
    ("k > 2 AND p >= 1", "anova welch_anova kruskal_wallis"),
    ("k = 2 AND p >= 2", "hotelling_t2"),
    ("k >= 2 AND p >= 2", "manova"),
    ("k >= 2 AND p >= 3", "multivariate_structure"),
    ("k >= 2 AND q >= 1", "group_chi_square fisher_exact"),
    ("k = 2 AND q >= 1", "two_proportions"),
    ("k > 2 AND q >= 1", "category_distribution"),
    ("q >= 2", "category_independence"),
]


def tests_list(rules: list[tuple[str, str]]) -> str:
    cells = [f"CASE WHEN {c} THEN '{t}' END" for c, ts in rules for t in ts.split()]
    return f"list_filter([{', '.join(cells)}], lambda x: x IS NOT NULL)"


COMMON = [
    ("no_candidate", "n_cand = 0"),
    ("too_few_rows", "n_valid < 10"),
    ("small_sample", "n_valid BETWEEN 10 AND 29"),
    ("missing_high", "missing_rate >= 0.4"),
    ("missing_many", "missing_rate >= 0.2 AND missing_rate < 0.4"),
    ("mostly_unstable", "stable_rate < 0.2"),
    ("partly_unstable", "stable_rate >= 0.2 AND stable_rate < 0.5"),
    ("id_suspect", "n_id > 0"),
    ("many_categories", "n_high > 0"),
]


def test_figures(exclude: str, k: str, min_group: str, n_valid: str, rules) -> str:
    return (
        f"SELECT *, len({tests_list(rules)}) AS n_tests FROM (SELECT count(*) FILTER (is_test_candidate) AS n_cand, "
        "count(*) FILTER (is_numeric_candidate) AS p, count(*) FILTER (is_categorical_candidate) AS q, "
        "avg(missing_rate) FILTER (is_test_candidate) AS missing_rate, "
        "avg((is_stable_numeric OR is_stable_categorical)::INT) FILTER (is_test_candidate) AS stable_rate, "
        "count(*) FILTER (is_id) AS n_id, count(*) FILTER (is_high_cardinality) AS n_high, "
        f"{k} AS k, {min_group} AS min_group, {n_valid} AS n_valid FROM cand WHERE variable <> '{exclude}')"
    )


def ready_test(case: Case, usable: list[str]) -> str:
    figures = test_figures("", "0", "0", f"(SELECT count(*) FROM clean WHERE {any_value(usable)})", TESTS_PLAIN)
    return sheet(
        f"{profile(case)}, {CANDIDATES}",
        figures,
        [("F1", "n_cand >= 1"), ("F2", "n_valid >= 10"), ("F3", "n_tests >= 1")],
        [
            ("R1", up("n_valid", (100, 40), (50, 32), (30, 24), (10, 12))),
            ("R2", "CASE WHEN p >= 3 THEN 30 WHEN p = 2 OR q >= 2 THEN 25 WHEN p = 1 OR q = 1 THEN 15 ELSE 0 END"),
            ("R3", down("missing_rate", (0.05, 20), (0.2, 14), (0.4, 7))),
            ("R4", up("stable_rate", (0.8, 10), (0.5, 7), (0.2, 3))),
        ],
        "n_valid p q missing_rate stable_rate n_tests".split(),
        [
            *COMMON,
            ("scored_without_group", "true"),
            ("multivariate_structure", "p >= 3"),
            ("pair_tests_possible", "p = 2"),
            ("single_numeric_only", "p = 1"),
            ("category_pairs_possible", "q >= 2"),
            ("single_category_only", "q = 1"),
            ("no_test_possible", "p + q = 0"),
        ],
        [
            ("score_meaning", "true"),
            ("tests_are_candidates", "true"),
            ("best_structure_counts", "true"),
            ("reference_value_needed", "p + q > 0"),
            ("multivariate_needs_checks", "p >= 3"),
        ],
    )


def group_ctes(case: Case, group: str, usable: list[str]) -> str:
    return (
        f"{profile(case)}, {CANDIDATES}, lev AS (SELECT {group} AS level, count(*) AS cnt FROM clean "
        f"WHERE {group} IS NOT NULL AND {any_value(usable)} GROUP BY 1)"
    )


GROUP_FIGURES = ("(SELECT count(*) FROM lev)", "(SELECT coalesce(min(cnt), 0) FROM lev)", "(SELECT coalesce(sum(cnt), 0) FROM lev)")


def ready_test_group(case: Case, group: str, usable: list[str]) -> str:
    return sheet(
        group_ctes(case, group, usable),
        test_figures(group, *GROUP_FIGURES, TESTS_GROUP),
        [("F1", "k >= 2"), ("F2", "n_valid >= 10"), ("F3", "n_cand >= 1")],
        [
            ("R1", up("n_valid", (100, 30), (50, 24), (30, 18), (10, 10))),
            (
                "R2",
                "CASE WHEN k < 2 THEN 0 WHEN k <= 5 AND min_group >= 10 THEN 30 WHEN k <= 10 AND min_group >= 5 THEN 22 "
                "WHEN min_group >= 3 THEN 14 ELSE 5 END",
            ),
            ("R3", "CASE WHEN p >= 2 THEN 20 WHEN p = 1 THEN 15 WHEN q >= 1 THEN 12 ELSE 0 END"),
            ("R4", down("missing_rate", (0.05, 10), (0.2, 7), (0.4, 3))),
            ("R5", up("stable_rate", (0.8, 10), (0.5, 7), (0.2, 3))),
        ],
        "n_valid k min_group p q missing_rate stable_rate n_tests".split(),
        [
            *COMMON,
            ("scored_by_group", "true"),
            ("two_groups", "k = 2"),
            ("three_or_more_groups", "k > 2"),
            ("many_groups", "k > 10"),
            ("group_very_small", "min_group < 3"),
            ("group_small", "min_group IN (3, 4)"),
            ("nothing_to_compare", "p + q = 0"),
            ("no_numeric_to_compare", "p = 0 AND q > 0"),
            ("no_category_to_compare", "q = 0 AND p > 0"),
            ("multivariate_group_test", "p >= 2"),
            ("numeric_group_test", "p = 1"),
            ("category_group_test", "q >= 1"),
        ],
        [
            ("score_meaning", "true"),
            ("tests_are_candidates", "true"),
            ("group_not_a_candidate", "true"),
            ("best_structure_counts", "true"),
            ("reference_value_needed", "p + q > 0"),
            ("multivariate_needs_checks", "p >= 2"),
        ],
    )


def predictor_cte(purpose: str, response: str, chosen: str = "true") -> str:
    if purpose == "regression":
        role = (
            "CASE WHEN vt IN ('id', 'excluded', 'date') THEN NULL WHEN kind = 'numeric' THEN 'numeric' "
            "WHEN kind = 'string' AND u <= 20 THEN 'categorical' END"
        )
    else:
        top = "10" if purpose == "classification" else "1000000000"
        role = (
            "CASE WHEN vt = 'numeric' THEN 'numeric' WHEN vt IN ('categorical', 'numeric_categorical') "
            f"AND u <= {top} THEN 'categorical' END"
        )
    return (
        f"x AS (SELECT *, CASE WHEN u >= 2 AND NOT (n >= 30 AND ratio >= 0.9) AND miss < 0.8 THEN {role} END AS role "
        f"FROM types WHERE variable <> '{response}' AND {chosen})"
    )


X_FIGURES = (
    "(SELECT count(*) FROM x) AS n_candidates, (SELECT count(role) FROM x) AS n_modelable, "
    "(SELECT count(*) FROM x WHERE role = 'numeric') AS n_numeric_modelable, "
    "(SELECT count(*) FROM x WHERE role = 'categorical') AS n_categorical_modelable"
)


def ready_regression(case: Case, y: str, modelable: list[str]) -> str:
    figures = (
        f"SELECT *, n_valid / nullif(n_modelable, 0) AS rows_per_predictor, n_modelable / nullif(n_candidates, 0) AS usable_share "
        f"FROM (SELECT {X_FIGURES}, (SELECT count(*) FROM clean WHERE {y} IS NOT NULL AND {any_value(modelable)}) AS n_valid, "
        "miss AS response_missing, u AS response_unique, vt, kind, "
        f"(SELECT avg(miss) FROM (SELECT miss FROM x UNION ALL SELECT miss FROM types WHERE variable = '{y}')) AS avg_missing_rate, "
        f"(SELECT rate FROM outl WHERE variable = '{y}') AS response_outlier_rate, "
        f"(SELECT avg(rate) FROM outl WHERE variable = '{y}' OR variable IN (SELECT variable FROM x WHERE role = 'numeric')) AS avg_outlier_rate "
        f"FROM types WHERE variable = '{y}')"
    )
    return sheet(
        f"{profile(case)}, {outliers(case)}, {predictor_cte('regression', y)}",
        figures,
        [
            ("F1", "true"),
            ("F2", "kind = 'numeric' AND vt IN ('numeric', 'numeric_categorical')"),
            ("F3", "n_candidates >= 1"),
            ("F4", "n_valid >= 30"),
            ("F5", "response_unique >= 2"),
            ("F6", "n_modelable >= 1"),
        ],
        [
            ("R1", up("n_valid", (200, 30), (100, 24), (50, 18), (30, 10))),
            ("R2", up("rows_per_predictor", (10, 20), (5, 15), (3, 8), default=3)),
            (
                "R3",
                "CASE WHEN response_missing < 0.05 AND response_unique >= 10 THEN 20 WHEN response_missing < 0.2 AND response_unique >= 5 THEN 15 "
                "WHEN response_missing < 0.4 AND response_unique >= 2 THEN 8 ELSE 0 END",
            ),
            ("R4", up("usable_share", (0.8, 15), (0.5, 10), (0.2, 5))),
            ("R5", down("avg_missing_rate", (0.05, 10), (0.2, 7), (0.4, 3))),
            ("R6", steps("avg_outlier_rate", "<=", [(0.1, 5), (0.2, 3)])),
        ],
        "n_candidates n_modelable n_valid rows_per_predictor response_missing response_unique usable_share avg_missing_rate response_outlier_rate avg_outlier_rate".split(),
        [
            ("response_few_values", "response_unique IN (2, 3, 4)"),
            ("overfitting_risk", "rows_per_predictor < 3"),
            ("response_missing_high", "response_missing >= 0.4"),
            ("missing_high", "avg_missing_rate >= 0.4"),
            ("response_outliers_high", "response_outlier_rate > 0.2"),
        ],
        [],
    )


def ready_classification(case: Case, y: str, modelable: list[str]) -> str:
    figures = (
        "SELECT *, n_valid / nullif(n_modelable, 0) AS rows_per_predictor, n_modelable / nullif(n_candidates, 0) AS usable_share, "
        "min_class / nullif(n_valid, 0) AS min_class_share "
        f"FROM (SELECT {X_FIGURES}, (SELECT coalesce(sum(cnt), 0) FROM lev) AS n_valid, (SELECT count(*) FROM lev) AS n_class, "
        "(SELECT coalesce(min(cnt), 0) FROM lev) AS min_class, vt, kind, "
        f"(SELECT avg(miss) FROM (SELECT miss FROM x UNION ALL SELECT miss FROM types WHERE variable = '{y}')) AS avg_missing_rate "
        f"FROM types WHERE variable = '{y}')"
    )
    return sheet(
        f"{profile(case)}, {predictor_cte('classification', y)}, lev AS (SELECT {y} AS level, count(*) AS cnt FROM clean "
        f"WHERE {y} IS NOT NULL AND {any_value(modelable)} GROUP BY 1)",
        figures,
        [
            ("F1", "true"),
            ("F2", "vt IN ('categorical', 'numeric_categorical') OR kind = 'string'"),
            ("F3", "n_class >= 2"),
            ("F4", "n_candidates >= 1"),
            ("F5", "n_valid >= 30"),
            ("F6", "min_class >= 2"),
            ("F7", "n_modelable >= 1"),
        ],
        [
            ("R1", up("n_valid", (200, 25), (100, 20), (50, 15), (30, 8))),
            ("R2", up("min_class", (20, 20), (10, 15), (5, 8), (2, 3))),
            (
                "R3",
                f"CASE WHEN n_class = 2 THEN {up('min_class_share', (0.3, 20), (0.2, 16), (0.1, 10), (0.05, 5))} "
                f"ELSE {up('min_class_share', (0.15, 20), (0.1, 16), (0.05, 10), (0.02, 5))} END",
            ),
            ("R4", up("rows_per_predictor", (10, 15), (5, 11), (3, 6), default=2)),
            ("R5", up("usable_share", (0.8, 10), (0.5, 7), (0.2, 3))),
            ("R6", down("avg_missing_rate", (0.05, 10), (0.2, 7), (0.4, 3))),
        ],
        "n_candidates n_modelable n_numeric_modelable n_categorical_modelable n_valid n_class min_class min_class_share rows_per_predictor usable_share avg_missing_rate".split(),
        [
            ("many_classes", "n_class > 10"),
            ("multi_class", "n_class >= 3 AND n_class <= 10"),
            ("two_classes", "n_class = 2"),
            ("class_very_small", "n_class >= 2 AND min_class < 5"),
            ("imbalance", "n_class = 2 AND min_class_share < 0.1"),
            ("rare_class", "n_class >= 3 AND min_class_share < 0.05"),
            ("overfitting_risk", "rows_per_predictor < 3"),
            ("missing_high", "avg_missing_rate >= 0.4"),
        ],
        [("numeric_predictors", "n_numeric_modelable > 0"), ("categorical_predictors", "n_categorical_modelable > 0")],
    )


def gap_cte(time: str, where: str = "true") -> str:
    """CTEs pts, unit, gaps, gs: spacing of the distinct times, days when all at midnight."""
    return f"""pts AS (SELECT {time} AS t, count(*) AS cnt FROM clean WHERE {time} IS NOT NULL AND {where} GROUP BY 1),
unit AS (SELECT bool_and(epoch_us(t) % 86400000000 = 0) AS midnight FROM pts),
axis AS (SELECT CASE WHEN midnight THEN (epoch_us(t) / 1e6) / 86400 ELSE epoch_us(t) / 1e6 END AS v FROM pts, unit),
gaps AS (SELECT v - lag(v) OVER (ORDER BY v) AS gap FROM axis),
gs AS (SELECT *, CASE WHEN trading THEN least(cv_raw, 0.05) ELSE cv_raw END AS cv FROM (SELECT *,
  coalesce(min_gap >= 1 AND median_gap <= 1.5 AND small_share >= 0.6, false) AS trading FROM (SELECT
  (SELECT sum(cnt) FROM pts) AS n_rows, (SELECT count(*) FROM pts) AS n_points, avg(gap) AS mean_gap, stddev_samp(gap) AS sd_gap,
  min(gap) AS min_gap, median(gap) AS median_gap, avg((gap BETWEEN 1 AND 4)::INT) FILTER (gap IS NOT NULL) AS small_share,
  CASE WHEN avg(gap) = 0 THEN 0 ELSE coalesce(stddev_samp(gap) / avg(gap), 0) END AS cv_raw FROM gaps)))"""


GAP_OUT = (
    "n_rows:i n_points:i unit:s mean_gap:d sd_gap:d min_gap:d median_gap:d small_share:d cv_raw:d cv:d business_day_like:b"
)


def time_gaps(case: Case, time: str, where: str = "true") -> str:
    return (
        f"WITH {clean(case)}, {gap_cte(time, where)} SELECT *, CASE WHEN midnight THEN 'day' ELSE 'second' END AS unit, "
        "trading AS business_day_like FROM gs, unit"
    )


def time_gaps_of(case: Case, time: str, values: list[str]) -> str:
    """The spacing of several value columns, each on its own."""
    return " UNION ALL ".join(
        f"SELECT '{v}' AS variable, * FROM ({time_gaps(case, time, f'{v} IS NOT NULL')})" for v in values
    )


def timeseries_rollup(case: Case, time: str, values: list[str]) -> str:
    """Verdict over all value columns from the verdict of each."""
    parts = [
        f"SELECT item, CASE WHEN (SELECT bool_and(value = 1) FROM s{i} WHERE section = 'essential') THEN value END AS score "
        f"FROM s{i} WHERE section = 'status'"
        for i in range(len(values))
    ]
    sheets = ", ".join(f"s{i} AS ({ready_timeseries(case, time, v)})" for i, v in enumerate(values))
    return (
        f"WITH {sheets}, parts AS ({' UNION ALL '.join(parts)}), figures AS (SELECT count(*) AS n, count(*) FILTER (item = 'fit') AS fit, "
        "count(*) FILTER (item = 'partly') AS partly, avg(score) AS score FROM parts) "
        "SELECT 'time_series' AS purpose, CASE WHEN fit = n THEN 'fit' WHEN fit + partly > 0 THEN 'partly' ELSE 'unfit' END AS status, score FROM figures"
    )


def ready_timeseries(case: Case, time: str, value: str) -> str:
    figures = (
        "SELECT gs.n_rows AS n_valid, n_points, (gs.n_rows - n_points) / gs.n_rows AS repeat_share, gs.cv AS gap_cv, cv_raw AS gap_cv_raw, trading, "
        f"(SELECT miss FROM types WHERE variable = '{time}') AS time_missing, miss AS value_missing, u AS value_unique, vt, "
        f"(SELECT rate FROM outl WHERE variable = '{value}') AS outlier_rate FROM types, gs WHERE variable = '{value}'"
    )
    return sheet(
        f"{profile(case)}, {outliers(case, (value,))}, {gap_cte(time, f'{value} IS NOT NULL')}",
        figures,
        [
            ("F1", "true"),
            ("F2", "true"),
            ("F3", "true"),
            ("F4", "vt = 'numeric'"),
            ("F5", "n_points >= 20"),
            ("F6", "value_unique >= 2"),
        ],
        [
            ("R1", up("n_points", (100, 35), (50, 28), (30, 20), (20, 10))),
            ("R2", down("gap_cv", (0.1, 20), (0.3, 15), (0.5, 10), (1, 5))),
            ("R3", down("repeat_share", (0.05, 15), (0.15, 10), (0.3, 5))),
            (
                "R4",
                "CASE WHEN time_missing < 0.01 AND value_missing < 0.05 THEN 20 WHEN time_missing < 0.05 AND value_missing < 0.2 THEN 15 "
                "WHEN time_missing < 0.1 AND value_missing < 0.4 THEN 8 ELSE 0 END",
            ),
            ("R5", steps("outlier_rate", "<=", [(0.1, 10), (0.2, 5)])),
        ],
        "n_valid n_points repeat_share gap_cv gap_cv_raw time_missing value_missing value_unique outlier_rate".split(),
        [
            ("few_points", "n_points BETWEEN 20 AND 29"),
            ("repeated_times", "repeat_share >= 0.3"),
            ("irregular_gaps", "gap_cv >= 0.5"),
            ("business_days", "trading"),
            ("time_missing", "time_missing >= 0.05"),
            ("value_missing", "value_missing >= 0.2"),
            ("outliers_high", "outlier_rate > 0.2"),
        ],
        [],
    )


def ready_survival(case: Case, time: str, event: str, level: str, covariates: list[str]) -> str:
    chosen = "variable IN (" + ", ".join(f"'{c}'" for c in covariates) + ")"
    figures = (
        "SELECT *, n_events / nullif(n_valid, 0) AS event_rate, n_zero / nullif(n_valid, 0) AS zero_time_share, "
        "n_events / nullif(n_modelable, 0) AS events_per_covariate FROM (SELECT "
        f"{X_FIGURES}, count(*) FILTER ({time} IS NOT NULL AND {event} IS NOT NULL) AS n_valid, count(DISTINCT {time}) AS time_unique, "
        f"count(DISTINCT {event}) AS event_levels, bool_and({time} >= 0) AS time_ok, bool_or({event} = '{level}') AS confirmed, "
        f"count(*) FILTER ({time} IS NOT NULL AND {event} = '{level}') AS n_events, "
        f"count(*) FILTER ({time} IS NOT NULL AND {event} <> '{level}') AS n_censored, "
        f"count(*) FILTER ({time} = 0 AND {event} IS NOT NULL) AS n_zero, "
        f"1 - count({time}) / count(*) AS time_missing, 1 - count({event}) / count(*) AS event_missing FROM clean)"
    )
    return sheet(
        f"{profile(case)}, {predictor_cte('survival', '', chosen)}",
        figures,
        [
            ("F1", "true"),
            ("F2", "time_ok"),
            ("F3", "true"),
            ("F4", "confirmed AND event_levels >= 2"),
            ("F5", "n_valid >= 10"),
            ("F6", "time_unique >= 2"),
        ],
        [
            ("R1", up("n_valid", (100, 30), (50, 24), (30, 18), (10, 8))),
            ("R2", up("n_events", (30, 25), (15, 18), (5, 10), (1, 3))),
            (
                "R3",
                "CASE WHEN n_events = 0 THEN 0 WHEN event_rate BETWEEN 0.2 AND 0.8 THEN 20 WHEN event_rate BETWEEN 0.1 AND 0.9 THEN 14 "
                "WHEN event_rate BETWEEN 0.05 AND 0.95 THEN 7 ELSE 2 END",
            ),
            ("R4", up("time_unique", (30, 15), (15, 11), (5, 6), (2, 3))),
            (
                "R5",
                "CASE WHEN greatest(time_missing, event_missing) < 0.05 AND zero_time_share < 0.1 THEN 10 "
                "WHEN greatest(time_missing, event_missing) < 0.1 AND zero_time_share < 0.2 THEN 7 "
                "WHEN greatest(time_missing, event_missing) < 0.2 AND zero_time_share < 0.3 THEN 3 ELSE 0 END",
            ),
        ],
        "n_valid time_unique n_events n_censored event_rate time_missing event_missing zero_time_share n_candidates n_modelable events_per_covariate".split(),
        [
            ("one_event_level", "event_levels = 1"),
            ("many_event_levels", "event_levels >= 3"),
            ("event_value_taken_as_event", "event_levels >= 3 AND confirmed"),
            ("few_events", "confirmed AND n_events < 5"),
            ("events_rare", "confirmed AND event_rate < 0.05"),
            ("events_dominate", "confirmed AND event_rate > 0.95"),
            ("missing_in_key_columns", "greatest(time_missing, event_missing) >= 0.1"),
            ("many_zero_times", "zero_time_share >= 0.1"),
            ("no_covariates", "n_candidates = 0"),
            ("covariates_usable", "n_modelable >= 1"),
            ("covariates_unusable", "n_candidates > 0 AND n_modelable = 0"),
            ("categorical_covariates", "n_categorical_modelable >= 1"),
            ("few_events_per_covariate", "events_per_covariate < 5"),
        ],
        [
            ("time_and_event_are_key", "true"),
            ("all_events", "confirmed AND n_censored = 0 AND n_events > 0"),
            ("no_events", "confirmed AND n_events = 0"),
            ("covariates_used", "n_candidates > 0"),
        ],
    )


def pairs_sql(columns: list[str]) -> str:
    whole = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    parts = [
        f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM clean WHERE {whole}"
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    ]
    return "SELECT *, coalesce(abs(round_even(r, 9)) >= 0.9, false) AS is_strong FROM (" + " UNION ALL ".join(parts) + ")"


EMBEDDING_PAIRS = """WITH cells AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
pairs AS (SELECT a.i AS i, b.i AS j, corr(a.v, b.v) AS r FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY ALL)
SELECT 'e' || i AS variable_1, 'e' || j AS variable_2, r, coalesce(abs(round_even(r, 9)) >= 0.9, false) AS is_strong FROM pairs"""


def sequence_cte(case: Case) -> str:
    """CTE seq: share of unit gaps between sorted distinct values of the numeric columns."""
    parts = [
        f"SELECT {p} AS pos, avg((g = 1)::INT) AS share, bool_and(whole) AS whole FROM (SELECT v - lag(v) OVER (ORDER BY v) AS g, "
        f"v = floor(v) AS whole FROM (SELECT DISTINCT CAST({n} AS DOUBLE) AS v FROM clean WHERE {n} IS NOT NULL))"
        for p, (_, n, k) in enumerate(case.columns)
        if k in "id"
    ]
    return f"seq AS ({' UNION ALL '.join(parts)})"


IDS_CTE = (
    "ids AS (SELECT t.*, regexp_matches(lower(variable), '(^id$|_id$|^id_|_id_|번호|식별자|코드|name|이름)') OR "
    "(n >= 30 AND ratio >= 0.9 AND kind = 'numeric' AND n_pinf + n_ninf = 0 AND coalesce(whole AND share >= 0.9, false)) AS is_obvious_id "
    "FROM types t LEFT JOIN seq ON seq.pos = t.pos)"
)


def obvious_ids(case: Case) -> str:
    return (
        f"WITH {profile(case)}, {sequence_cte(case)}, {IDS_CTE} SELECT pos, variable, n AS n_non_missing, u AS n_unique, is_obvious_id FROM ids"
    )


def ready_clustering(case: Case, final: list[str]) -> str:
    whole = " AND ".join(f"{c} IS NOT NULL" for c in final)
    figures = (
        "SELECT *, n_valid / nullif(n_final, 0) AS rows_per_column FROM (SELECT "
        "(SELECT count(*) FROM ids WHERE vt = 'numeric') AS n_candidates, count(*) AS n_final, "
        f"(SELECT count(*) FROM clean WHERE {whole}) AS n_valid, avg(miss) AS avg_missing_rate, avg(rate) AS avg_outlier_rate, "
        "(SELECT avg(is_strong::INT) FROM pr) AS strong_pair_share, count(*) FILTER (q1 = q3 OR n_fin < 2) AS n_flat, "
        "count(*) FILTER (n >= 30 AND ratio >= 0.9) AS n_high_unique "
        "FROM ids JOIN outl ON outl.pos = ids.pos WHERE vt = 'numeric' AND NOT is_obvious_id)"
    )
    return sheet(
        f"{profile(case)}, {sequence_cte(case)}, {IDS_CTE}, {outliers(case)}, pr AS ({pairs_sql(final)})",
        figures,
        [
            ("F1", "n_final >= 2"),
            ("F2", "n_final >= 1"),
            ("F3", "n_final >= 1"),
            ("F4", "n_final >= 2 AND n_valid >= 20"),
        ],
        [
            ("R1", up("n_valid", (100, 25), (50, 20), (30, 15), (20, 8))),
            ("R2", "CASE WHEN n_final > 20 THEN 6 WHEN n_final > 10 THEN 12 WHEN n_final > 2 THEN 20 WHEN n_final = 2 THEN 16 ELSE 0 END"),
            ("R3", up("rows_per_column", (10, 20), (5, 15), (3, 8), default=2)),
            ("R4", down("avg_missing_rate", (0.05, 15), (0.2, 11), (0.4, 5))),
            ("R5", steps("avg_outlier_rate", "<=", [(0.1, 10), (0.2, 5)])),
            ("R6", down("coalesce(strong_pair_share, 0)", (0.1, 10), (0.3, 7), (0.5, 3))),
        ],
        "n_candidates n_final n_valid rows_per_column avg_missing_rate avg_outlier_rate strong_pair_share".split(),
        [
            ("too_few_columns", "n_final < 2"),
            ("too_many_columns", "n_final > 20"),
            ("too_few_rows", "n_final >= 2 AND n_valid < 20"),
            ("small_sample", "n_final >= 2 AND n_valid BETWEEN 20 AND 29"),
            ("few_rows_per_column", "rows_per_column < 3"),
            ("missing_high", "avg_missing_rate >= 0.4"),
            ("missing_many", "avg_missing_rate >= 0.2 AND avg_missing_rate < 0.4"),
            ("outliers_high", "avg_outlier_rate > 0.2"),
            ("outliers_some", "avg_outlier_rate > 0.1 AND avg_outlier_rate <= 0.2"),
            ("similar_columns", "strong_pair_share >= 0.3"),
            ("little_variation", "n_flat > 0"),
            ("continuous_high_unique", "n_high_unique > 0"),
        ],
        [
            ("score_meaning", "true"),
            ("scaling_needed", "true"),
            ("cluster_count_open", "true"),
            ("robust_methods", "avg_outlier_rate > 0.1"),
        ],
    )


def duplicate_positions(case: Case, key: str, compare: list[str]) -> str:
    return (
        f"WITH {clean(case)} SELECT {key} FROM (SELECT {key}, row_number() OVER (PARTITION BY {', '.join(compare)} "
        f"ORDER BY {key}) AS rn FROM clean) WHERE rn > 1"
    )


def case(name: str) -> Case:
    return CASES[name]
