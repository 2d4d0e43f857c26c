"""Quality checks, the 100-point score, and the tables a report is made of.

The profile, the duplicate summary and the outlier counts are Spark jobs over the data;
every rule below works on their small results (one row per column).
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from plumbline.functions import values as V
from plumbline.functions.rules import band, first_match, matching_codes
from plumbline.operators.clean import Frame, frame_of
from plumbline.operators.duplicates import duplicate_figures
from plumbline.operators.local import local_table
from plumbline.operators.outliers import Outliers, box_summary, iqr_outliers
from plumbline.operators.profile import Profile, column_summary, profile
from plumbline.plans.texts import ITEM_TEXTS, STATUS_TEXTS, with_texts

TOP_N = 20

# --- fixed values: score bands ----------------------------------------------

MISSING_TOTAL = [(0.05, 15), (0.10, 12), (0.20, 8), (0.40, 4)]
TYPE_ISSUE = [(0.05, 15), (0.10, 12), (0.20, 8), (0.30, 4)]
SPECIAL_VALUE = [("special_rate = 0", 5), ("special_rate < 0.05", 4), ("special_rate < 0.10", 3)]
SPECIAL_VALUE += [("special_rate < 0.20", 1)]
DUPLICATE = [(0.01, 15), (0.05, 12), (0.10, 8), (0.20, 4)]
OUTLIER = [(0.05, 15), (0.10, 12), (0.20, 8), (0.30, 4)]
STRUCTURE = [(0.05, 10), (0.10, 8), (0.20, 5), (0.30, 3)]
CATEGORICAL = [(0.05, 10), (0.10, 8), (0.20, 5), (0.30, 3)]
ITEM_MAX = {
    "missing": 25,
    "type_format": 20,
    "duplicate": 15,
    "outlier": 15,
    "structure": 10,
    "categorical": 10,
    "basic": 5,
}
CATEGORY_TYPES = ("categorical", "numeric_categorical")
ANALYZABLE_TYPES = ("date", "categorical", "numeric_categorical", "numeric")

ITEM_STATUS = [("rate >= 0.80", "good"), ("rate >= 0.60", "caution")]
FINAL_STATUS = [
    ("force_danger", "danger"),
    ("total_score >= 80", "good"),
    ("total_score >= 60", "caution"),
]
GRADE = [("score >= 90", "excellent"), ("score >= 70", "good"), ("score >= 50", "caution")]

BASIC_RULES = [
    ("force_danger", 0),
    ("n_name_problems > 0", 2),
    ("n_rows >= 10 AND n_cols >= 2 AND n_analyzable >= 1", 5),
    ("n_rows BETWEEN 1 AND 9 OR n_cols = 1", 3),
]

# Type-issue rules over the shares of number-like and date-like values.
TYPE_ISSUES = [
    ("should_be_numeric", "numeric_share >= 0.80"),
    ("should_be_date", "date_share >= 0.80"),
    ("mixed_number_text", "numeric_share > 0 AND numeric_share < 0.80"),
    ("mixed_date", "has_date_hint AND date_share > 0 AND date_share < 0.80"),
]
CATEGORY_PROBLEMS = [
    ("dominant_category", "top_share >= 0.90"),
    ("too_many_values_for_rows", "unique_rate >= 0.50"),
    ("too_many_categories", "unique_count > 10"),
]


# --- D1 missing ---------------------------------------------------------------


def missing_profile(df: DataFrame, user_missing_codes: Sequence[object] | None = None) -> DataFrame:
    """Missing count, rate and threshold flags per column: one scan, no row shuffle."""
    return missing_table(frame_of(df, user_missing_codes))


def missing_table(frame: Frame) -> DataFrame:
    if frame.width == 0:
        base = local_table(
            frame.df.sparkSession, [], "pos int, missing_count bigint, n_rows bigint, variable string"
        )
        return missing_rates(base)
    counts = frame.df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(frame.missing(p)).alias(f"m{p}") for p in range(frame.width)],
    )
    cells: list[Column] = []
    for p, name in enumerate(frame.names):
        cells += [F.lit(p), F.lit(name), F.col(f"m{p}")]
    base = counts.select(
        "n_rows", F.stack(F.lit(frame.width), *cells).alias("pos", "variable", "missing_count")
    )
    return missing_rates(base)


def missing_rates(base: DataFrame) -> DataFrame:
    rate = V.ratio(F.col("missing_count"), F.col("n_rows"))
    return base.select(
        "pos",
        "variable",
        "missing_count",
        V.rounded(rate, 4).alias("missing_rate"),
        V.percent(rate).alias("missing_percent"),
        (rate >= 0.10).alias("missing_over_10"),
        (rate >= 0.20).alias("missing_over_20"),
        (rate >= 0.30).alias("missing_over_30"),
        (rate >= 0.40).alias("high_missing"),
        "n_rows",
    )


def missing_score(table: DataFrame) -> DataFrame:
    """Total-rate and pattern points from a missing table."""
    totals = table.agg(
        F.coalesce(F.sum("missing_count"), F.lit(0)).alias("total_missing"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_cells"),
        F.coalesce(F.max("missing_rate"), F.lit(0.0)).alias("max_rate"),
        F.count_if(F.expr("missing_over_10")).alias("over_10"),
        F.count_if(F.expr("missing_over_20")).alias("over_20"),
        F.count_if(F.expr("missing_over_30")).alias("over_30"),
    ).withColumn("total_rate", V.ratio(F.col("total_missing"), F.col("total_cells")))
    return totals.select(
        "total_missing",
        "total_cells",
        "total_rate",
        "max_rate",
        "over_10",
        "over_20",
        "over_30",
        missing_total_points().alias("total_points"),
        missing_pattern_points().alias("pattern_points"),
    ).withColumn("score", F.col("total_points") + F.col("pattern_points"))


def missing_total_points() -> Column:
    return band("total_rate", "<", MISSING_TOTAL, 0)


def missing_pattern_points() -> Column:
    """Ten points less deductions for the worst column and for columns over each limit."""
    left = (
        F.lit(10)
        - first_match([("max_rate >= 0.30", 3), ("max_rate >= 0.20", 2), ("max_rate >= 0.10", 1)], 0)
        - first_match([("over_30 > 0", 2)], 0)
        - first_match([("over_20 > 0", 2)], 0)
        - first_match([("over_10 > 0", 1)], 0)
    )
    return F.greatest(left, F.lit(0))


# --- D2, D3 types and special values --------------------------------------------


def with_type_issues(profiled: DataFrame) -> DataFrame:
    """Shares of number-like and date-like values (over rows) and the issue codes."""
    text = F.expr("kind = 'string' AND n_non_missing > 0")
    return (
        profiled.withColumn("numeric_share", V.ratio(F.col("n_number_text"), F.col("n_non_missing")))
        .withColumn("date_share", V.ratio(F.col("n_date_text"), F.col("n_non_missing")))
        .withColumn("issues", F.when(text, matching_codes(TYPE_ISSUES)).otherwise(F.array()))
    )


def type_issues(profiled: DataFrame) -> DataFrame:
    """Suspect string columns and why."""
    return (
        with_type_issues(profiled)
        .where("size(issues) > 0")
        .select(
            "pos",
            "variable",
            F.array_join("issues", "; ").alias("issue"),
            V.percent(F.col("numeric_share")).alias("numeric_percent"),
            V.percent(F.col("date_share")).alias("date_percent"),
        )
    )


def special_values(df: DataFrame, user_missing_codes: Sequence[object] | None = None) -> DataFrame:
    """NaN and infinity counts per physically numeric column: one scan."""
    frame = frame_of(df, user_missing_codes)
    numeric = [p for p, k in enumerate(frame.kinds) if k == "numeric"]
    if not numeric:
        return special_table(
            local_table(
                df.sparkSession,
                [],
                "pos int, variable string, kind string, n_nan bigint, n_pos_inf bigint, n_neg_inf bigint",
            )
        )
    aggs: list[Column] = []
    cells: list[Column] = []
    for p in numeric:
        c = frame.col(p)
        floating = V.is_floating(frame.dtypes[p])
        tests = (
            (F.isnan(c), c == F.lit(float("inf")), c == F.lit(float("-inf")))
            if floating
            else (F.lit(False),) * 3
        )
        aggs += [F.count_if(t).alias(f"{n}{p}") for n, t in zip(("x", "y", "z"), tests)]
        cells += [F.lit(p), F.lit(frame.names[p]), *[F.col(f"{n}{p}") for n in ("x", "y", "z")]]
    return special_table(
        frame.df.agg(*aggs).select(
            F.stack(F.lit(len(numeric)), *cells).alias(
                "pos", "variable", "n_nan", "n_pos_inf", "n_neg_inf"
            ),
            F.lit("numeric").alias("kind"),
        )
    )


def special_table(profiled: DataFrame) -> DataFrame:
    return profiled.where("kind = 'numeric'").select(
        "pos",
        "variable",
        F.col("n_nan").alias("nan_count"),
        F.col("n_pos_inf").alias("inf_count"),
        F.col("n_neg_inf").alias("negative_inf_count"),
        F.expr("n_nan + n_pos_inf + n_neg_inf > 0").alias("has_special_value"),
    )


# --- D6, D7 structure and categories ---------------------------------------------


N_FINITE = "(n_non_missing - n_pos_inf - n_neg_inf)"
N_FINITE_UNIQUE = "(n_unique - CAST(n_pos_inf > 0 AS INT) - CAST(n_neg_inf > 0 AS INT))"
STRUCTURE_PROBLEMS = [
    ("excluded", "variable_type = 'excluded'"),
    ("id_suspect", "variable_type = 'id'"),
    # no variance: a single finite value seen more than once
    ("zero_variance", f"variable_type = 'numeric' AND {N_FINITE} > 1 AND {N_FINITE_UNIQUE} = 1"),
]


def structure_problems(profiled: DataFrame) -> DataFrame:
    """One row per (column, reason): excluded, identifier, or a number without variance."""
    return profiled.select(
        "pos", "variable", F.explode(matching_codes(STRUCTURE_PROBLEMS)).alias("problem")
    )


def with_category_problems(profiled: DataFrame) -> DataFrame:
    """Top share, values per row and the problem codes of categorical columns."""
    categorical = F.col("variable_type").isin(*CATEGORY_TYPES)
    return (
        profiled.withColumn("top_share", V.ratio(F.col("max_count"), F.col("n_non_missing")))
        .withColumn("unique_count", F.col("n_unique"))
        .withColumn("unique_rate", V.ratio(F.col("n_unique"), F.col("n_rows")))
        .withColumn(
            "problems", F.when(categorical, matching_codes(CATEGORY_PROBLEMS)).otherwise(F.array())
        )
    )


def category_quality(profiled: DataFrame) -> DataFrame:
    """Every categorical column with its top share and the problems found."""
    return (
        with_category_problems(profiled)
        .where(F.col("variable_type").isin(*CATEGORY_TYPES))
        .select(
            "pos",
            "variable",
            V.percent(F.col("top_share")).alias("max_category_percent"),
            "unique_count",
            V.rounded(F.col("unique_rate"), 4).alias("unique_rate"),
            F.array_join("problems", "; ").alias("problem"),
        )
    )


# --- D8 names ----------------------------------------------------------------------


def name_problems(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Blank and repeated column names by position (from 1)."""
    table = local_table(
        spark, [(i + 1, n) for i, n in enumerate(names)], "position int, variable string"
    )
    blank = "variable IS NULL OR btrim(variable) = ''"
    repeats = F.count(F.lit(1)).over(Window.partitionBy("variable"))
    return (
        table.withColumn("repeats", repeats)
        .withColumn(
            "problem",
            F.when(F.expr(blank), F.lit("blank_name")).when(
                F.col("repeats") > 1, F.lit("repeated_name")
            ),
        )
        .where("problem IS NOT NULL")
        .select("position", "variable", "problem")
    )


def dataset_info(df: DataFrame) -> DataFrame:
    """Rows, columns and counts of numeric, text and date columns by physical type."""
    kinds = [V.kind_of(f.dataType) for f in df.schema.fields]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(kinds)).alias("n_cols"),
        F.lit(kinds.count("numeric")).alias("n_numeric"),
        F.lit(kinds.count("string")).alias("n_text"),
        F.lit(kinds.count("date")).alias("n_date"),
    )


def raw_missing_cells(df: DataFrame) -> DataFrame:
    """Missing cells of the table as it was read (no token normalisation)."""
    view = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    cells = [
        F.when(V.is_missing(F.col(f"c{i}"), f.dataType), 1).otherwise(0)
        for i, f in enumerate(df.schema.fields)
    ]
    total = reduce(lambda a, b: a + b, cells, F.lit(0))
    return view.agg(
        F.coalesce(F.sum(total.cast("bigint")), F.lit(0)).alias("n_missing_cells")
    )


# --- the assessment -----------------------------------------------------------------


MEASURED = (
    "pos variable kind variable_type n_rows n_missing n_non_missing n_unique max_count n_nan n_pos_inf "
    "n_neg_inf n_number_text n_date_text has_date_hint"
).split()
MEASURED_SCHEMA = (
    "pos int, variable string, kind string, variable_type string, n_rows bigint, n_missing bigint, "
    "n_non_missing bigint, n_unique bigint, max_count bigint, n_nan bigint, n_pos_inf bigint, "
    "n_neg_inf bigint, n_number_text bigint, n_date_text bigint, has_date_hint boolean, "
    "outlier_count bigint"
)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


@dataclass(frozen=True)
class QualityReport:
    """All quality tables of one data set.  Built by :func:`assess_data_quality`."""

    profile: Profile
    outliers: Outliers
    duplicates: tuple[int, int]
    user_missing_codes: tuple
    top_n: int = TOP_N
    n_missing_cells: int | None = None  # of the table as read

    @property
    def spark(self) -> SparkSession:
        return self.profile.frame.df.sparkSession

    @cached_property
    def profiled(self) -> DataFrame:
        return self.profile.table()

    @cached_property
    def variable_types(self) -> DataFrame:
        return self.profiled.select(
            "pos", "variable", "physical_type", "variable_type", "is_time_candidate"
        )

    @cached_property
    def data_clean(self) -> DataFrame:
        return self.profile.frame.df.toDF(*self.profile.frame.names)

    @cached_property
    def column_summary(self) -> DataFrame:
        return column_summary(self.profiled)

    @cached_property
    def missing(self) -> DataFrame:
        return missing_rates(
            self.profiled.select("pos", "variable", F.col("n_missing").alias("missing_count"), "n_rows")
        )

    @cached_property
    def outlier_table(self) -> DataFrame:
        return self.outliers.table(self.profile)

    @cached_property
    def type_issues(self) -> DataFrame:
        return type_issues(self.profiled)

    @cached_property
    def special_values(self) -> DataFrame:
        return special_table(self.profiled)

    @cached_property
    def format_issues(self) -> DataFrame:
        """Type suspects and columns with special values in one list."""
        special = self.special_values.where("has_special_value").select(
            "pos", "variable", F.lit("special_value").alias("issue")
        )
        return self.type_issues.select("pos", "variable", "issue").unionByName(special)

    @cached_property
    def structure_problems(self) -> DataFrame:
        return structure_problems(self.profiled)

    @cached_property
    def category_quality(self) -> DataFrame:
        return category_quality(self.profiled)

    @cached_property
    def name_problems(self) -> DataFrame:
        return name_problems(self.spark, self.profile.frame.names)

    @cached_property
    def measures(self) -> DataFrame:
        """One row with every figure the scores depend on."""
        names = self.profile.frame.names
        repeated = sum(n is None or not n.strip() or names.count(n) > 1 for n in names)
        rows, duplicates = self.duplicates
        counts = {c.pos: self.outliers.counts.get(c.pos, 0) for c in self.outliers.columns}
        per_column = local_table(
            self.spark,
            [
                (*(getattr(c, n) for n in MEASURED), counts.get(c.pos))
                for c in self.profile.columns
            ],
            MEASURED_SCHEMA,
        )
        missing_rate = V.ratio(F.col("n_missing"), F.col("n_rows"))
        outlier_rate = V.ratio(F.col("outlier_count"), F.expr(N_FINITE))
        has_special = F.expr("n_nan + n_pos_inf + n_neg_inf > 0")
        figures = (
            with_category_problems(with_type_issues(per_column))
            .agg(
                F.count(F.lit(1)).alias("n_cols"),
                F.coalesce(F.sum("n_missing"), F.lit(0)).alias("total_missing"),
                F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_cells"),
                F.coalesce(F.max(V.rounded(missing_rate, 4)), F.lit(0.0)).alias("max_rate"),
                F.count_if(missing_rate >= 0.10).alias("over_10"),
                F.count_if(missing_rate >= 0.20).alias("over_20"),
                F.count_if(missing_rate >= 0.30).alias("over_30"),
                F.count_if(F.size("issues") > 0).alias("n_type_issues"),
                F.count_if(F.expr("kind = 'numeric'")).alias("n_physical_numeric"),
                F.count_if(has_special).alias("n_special"),
                F.count_if(F.size(matching_codes(STRUCTURE_PROBLEMS)) > 0).alias("n_structure"),
                F.count_if(F.col("variable_type").isin(*CATEGORY_TYPES)).alias("n_categorical"),
                F.count_if(F.size("problems") > 0).alias("n_bad_categories"),
                F.count_if(F.expr("variable_type = 'numeric'")).alias("n_numeric"),
                F.count_if(F.expr("variable_type = 'date'")).alias("n_date"),
                F.count_if(F.col("variable_type").isin(*ANALYZABLE_TYPES)).alias("n_analyzable"),
                F.coalesce(
                    F.avg(F.when(F.col("outlier_count").isNotNull(), V.rounded(outlier_rate, 4))),
                    F.lit(0.0),
                ).alias("mean_outlier_rate"),
            )
            .withColumn("n_rows", F.lit(self.profile.n_rows))
            .withColumn("duplicate_count", F.lit(duplicates if rows > 1 else 0))
            .withColumn("duplicate_rate", V.ratio(F.col("duplicate_count"), F.col("n_rows")))
            .withColumn("n_name_problems", F.lit(repeated))
            .withColumn("total_rate", V.ratio(F.col("total_missing"), F.col("total_cells")))
            .withColumn("type_rate", V.ratio(F.col("n_type_issues"), F.col("n_cols")))
            .withColumn("special_rate", V.ratio(F.col("n_special"), F.col("n_physical_numeric")))
            .withColumn("structure_rate", V.ratio(F.col("n_structure"), F.col("n_cols")))
            .withColumn("category_rate", V.ratio(F.col("n_bad_categories"), F.col("n_categorical")))
            .withColumn(
                "relaxed", F.expr("duplicate_count > 0 AND n_numeric = 0 AND n_categorical > 0")
            )
            .withColumn("force_danger", F.expr("n_rows = 0 OR n_cols = 0 OR n_analyzable = 0"))
            .withColumn("missing_points", missing_total_points() + missing_pattern_points())
            .withColumn("raw_duplicate_points", band("duplicate_rate", "<", DUPLICATE, 0))
            .withColumn(
                "duplicate_points",
                F.expr(
                    "CASE WHEN relaxed THEN greatest(raw_duplicate_points, 12) ELSE raw_duplicate_points END"
                ),
            )
        )
        # one row: kept as a local table so that no later rule starts a job of its own
        return local_table(self.spark, [tuple(figures.first())], _ddl(figures))

    @cached_property
    def duplicate_table(self) -> DataFrame:
        """Duplicate figures with the relaxation for purely categorical tables."""
        return self.measures.select(
            "n_rows",
            "duplicate_count",
            V.percent(F.col("duplicate_rate")).alias("duplicate_percent"),
            F.col("raw_duplicate_points").alias("raw_score"),
            F.col("duplicate_points").alias("score"),
            "relaxed",
        )

    @cached_property
    def basic_structure(self) -> DataFrame:
        return self.measures.select(
            "n_rows",
            "n_cols",
            "n_analyzable",
            "n_name_problems",
            "force_danger",
            first_match(BASIC_RULES, 0).alias("score"),
        )

    @cached_property
    def item_scores(self) -> DataFrame:
        """Seven items with score, maximum and status."""
        points = {
            "missing": F.col("missing_points"),
            "type_format": band("type_rate", "<", TYPE_ISSUE, 0) + first_match(SPECIAL_VALUE, 0),
            "duplicate": F.col("duplicate_points"),
            "outlier": band("mean_outlier_rate", "<=", OUTLIER, 0),
            "structure": F.when(F.col("n_cols") == 0, F.lit(0)).otherwise(
                band("structure_rate", "<", STRUCTURE, 0)
            ),
            "categorical": band("category_rate", "<", CATEGORICAL, 0),
            "basic": first_match(BASIC_RULES, 0),
        }
        cells: list[Column] = []
        for i, (item, score) in enumerate(points.items()):
            cells += [F.lit(i + 1), F.lit(item), score.cast("int"), F.lit(ITEM_MAX[item])]
        return (
            self.measures.select(
                F.stack(F.lit(len(points)), *cells).alias("item_no", "item", "score", "max_score")
            )
            .withColumn("rate", V.ratio(F.col("score"), F.col("max_score")))
            .withColumn("status", first_match(ITEM_STATUS, "danger"))
            .drop("rate")
        )

    @cached_property
    def score(self) -> DataFrame:
        """One row: total of 100, final status and the display grade."""
        force = self.measures.first()["force_danger"]
        return (
            self.item_scores.agg(F.sum("score").cast("int").alias("total_score"))
            .withColumn("force_danger", F.lit(force))
            .withColumn("final_status", first_match(FINAL_STATUS, "danger"))
            .withColumn("score", F.col("total_score"))
            .withColumn("grade", first_match(GRADE, "unfit"))
            .drop("score")
        )

    @cached_property
    def major_issues(self) -> DataFrame:
        """Items in caution or danger; a single row "none" when all are good."""
        bad = self.item_scores.where("status <> 'good'").select("item_no", "item", "status")
        none = (
            self.item_scores.agg(F.count_if(F.expr("status <> 'good'")).alias("n"))
            .where("n = 0")
            .select(F.lit(0).alias("item_no"), F.lit("none").alias("item"), F.lit("good").alias("status"))
        )
        return bad.unionByName(none)

    @cached_property
    def warnings(self) -> DataFrame:
        """Codes of the general warnings that apply, in fixed order."""
        codes = self.user_missing_codes
        rules = [
            ("user_missing_codes_used", "true" if codes else "false"),
            ("date_columns_not_penalised", "n_date > 0"),
            ("duplicates_relaxed", "relaxed"),
            ("outliers_skipped", "n_numeric = 0"),
            ("special_values_present", "n_special > 0"),
            ("categories_skipped", "n_categorical = 0"),
            ("name_problems", "n_name_problems > 0"),
            ("force_danger", "force_danger"),
        ]
        return self.measures.select(
            F.posexplode(matching_codes(rules)).alias("warning_no", "warning")
        )

    @cached_property
    def explanations(self) -> DataFrame:
        """What a reader is told: (section, code, text); the codes that count as missing are named."""

        def said(section: str, rows: DataFrame, code: str, texts: dict[str, str] | None = None) -> DataFrame:
            return with_texts(rows, code, texts).select(F.lit(section).alias("section"), F.col(code).alias("code"), "text")

        named = ", ".join(str(c) for c in self.user_missing_codes)
        warnings = said("warning", self.warnings, "warning").withColumn(
            "text",
            F.when(F.col("code") == "user_missing_codes_used", F.concat("text", F.lit(f": {named}."))).otherwise(F.col("text")),
        )
        items = with_texts(self.item_scores, "status", ITEM_TEXTS)
        return reduce(
            DataFrame.unionByName,
            [
                said("final", self.score, "final_status", STATUS_TEXTS),
                items.select(F.lit("item").alias("section"), F.col("item").alias("code"), "text"),
                warnings,
                said("recommendation", self.recommendations, "recommendation"),
            ],
        )

    @cached_property
    def top_missing(self) -> DataFrame:
        return top_missing(self.missing, self.top_n)

    @cached_property
    def top_outliers(self) -> DataFrame:
        return top_outliers(self.outlier_table, self.top_n)

    @cached_property
    def box_summary(self) -> DataFrame:
        return box_summary(self.profile, self.outliers, self.top_n)

    @cached_property
    def column_report(self) -> DataFrame:
        """Per-column display row with a colour band."""
        found = self.outlier_table.where("outlier_count > 0").select(
            "pos", "outlier_count", "outlier_percent"
        )
        return (
            self.column_summary.join(F.broadcast(found), "pos", "left")
            .withColumn("missing_percent", V.rounded(F.col("missing_percent"), 1))
            .withColumn("unique_percent", V.rounded(F.col("unique_rate") * 100, 1))
            .withColumn(
                "band",
                first_match(
                    [
                        ("missing_percent >= 10", "red"),
                        ("missing_percent > 0 OR outlier_count IS NOT NULL", "amber"),
                    ],
                    "none",
                ),
            )
            .select(
                "pos",
                "variable",
                "variable_type",
                "missing_percent",
                "unique_count",
                "unique_percent",
                "outlier_count",
                "outlier_percent",
                "band",
            )
        )

    @cached_property
    def findings(self) -> DataFrame:
        """Findings in report order: (priority, kind, subject, severity)."""
        issues = self.major_issues.where("item <> 'none'").select(
            F.lit(1).alias("priority"),
            F.lit("item").alias("kind"),
            F.col("item").alias("subject"),
            F.col("status").alias("severity"),
        )
        missing = self.missing.where("missing_count > 0").select(
            F.lit(2).alias("priority"),
            F.lit("missing").alias("kind"),
            F.col("variable").alias("subject"),
            F.when(F.col("missing_percent") >= 10, F.lit("danger"))
            .otherwise(F.lit("caution"))
            .alias("severity"),
        )
        # a finding that already speaks of outliers suppresses the per-column ones
        word = "이상치"
        covered = (
            self.major_issues.where("item = 'outlier'").count() > 0
            or self.missing.where("missing_count > 0")
            .where(F.col("variable").contains(word))
            .count()
            > 0
        )
        outliers = self.outlier_table.where("outlier_count > 0").select(
            F.lit(3).alias("priority"),
            F.lit("outlier").alias("kind"),
            F.col("variable").alias("subject"),
            F.when(F.col("outlier_percent") >= 5, F.lit("danger"))
            .otherwise(F.lit("caution"))
            .alias("severity"),
        )
        duplicate = self.measures.where("duplicate_count > 0").select(
            F.lit(4).alias("priority"),
            F.lit("duplicate").alias("kind"),
            F.col("duplicate_count").cast("string").alias("subject"),
            F.lit("caution").alias("severity"),
        )
        notices = self.warnings.select(
            F.lit(5).alias("priority"),
            F.lit("warning").alias("kind"),
            F.col("warning").alias("subject"),
            F.lit("info").alias("severity"),
        )
        parts = [issues, missing, duplicate, notices]
        if not covered:
            parts.insert(2, outliers)
        out = reduce(DataFrame.unionByName, parts)
        none = (
            out.agg(F.count(F.lit(1)).alias("n"))
            .where("n = 0")
            .select(
                F.lit(6).alias("priority"),
                F.lit("none").alias("kind"),
                F.lit("").alias("subject"),
                F.lit("good").alias("severity"),
            )
        )
        return out.unionByName(none)

    @cached_property
    def recommendations(self) -> DataFrame:
        """One code per kind of problem present."""
        present = {
            "handle_missing": self.missing.where("missing_count > 0"),
            "check_outliers": self.outlier_table.where("outlier_count > 0"),
            "convert_types": self.type_issues,
            "review_duplicates": self.measures.where("duplicate_count > 0"),
        }
        parts = [
            rows.agg(F.count(F.lit(1)).alias("n"))
            .where("n > 0")
            .select(F.lit(code).alias("recommendation"))
            for code, rows in present.items()
        ]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def report_metrics(self) -> DataFrame:
        """Header figures of a report: raw missing cells, duplicates and the grade."""
        cells = self.n_missing_cells
        if cells is None:
            cells = raw_missing_cells(self.profile.raw).first()["n_missing_cells"]
        return self.score.select(
            F.lit(self.profile.n_rows).alias("n_rows"),
            F.lit(self.profile.frame.width).alias("n_cols"),
            F.lit(cells).alias("n_missing_cells"),
            F.lit(self.duplicates[1]).alias("n_duplicate_rows"),
            "total_score",
            "final_status",
            "grade",
        )

    def tables(self) -> dict[str, DataFrame]:
        names = (
            "explanations score item_scores major_issues warnings findings recommendations report_metrics "
            "column_summary column_report variable_types missing outlier_table type_issues "
            "special_values format_issues duplicate_table structure_problems category_quality "
            "basic_structure name_problems top_missing top_outliers box_summary"
        )
        return {n: getattr(self, n) for n in names.split()}


def top_missing(missing: DataFrame, top: int = TOP_N) -> DataFrame:
    """Columns with most missing values, with the bar colour band."""
    return (
        missing.where("missing_count > 0")
        .withColumn(
            "band", F.when(F.col("missing_percent") >= 10, F.lit("red")).otherwise(F.lit("amber"))
        )
        .orderBy(F.desc("missing_percent"), "pos")
        .limit(top)
        .select("pos", "variable", "missing_count", "missing_percent", "band")
    )


def top_outliers(outlier_table: DataFrame, top: int = TOP_N) -> DataFrame:
    """Columns with the highest outlier share."""
    return (
        outlier_table.where("outlier_count > 0")
        .orderBy(F.desc("outlier_percent"), "pos")
        .limit(top)
        .select("pos", "variable", "outlier_count", "outlier_percent")
    )


def duplicate_counts(frame: Frame) -> tuple[int, int]:
    if frame.width == 0:
        return 0, 0
    found = duplicate_figures(frame)
    return found["total_rows"], found["duplicate_count"]


def raw_figures(df: DataFrame, user_missing_codes: Sequence[object] | None = None) -> tuple[int, int, int]:
    """Rows and duplicate rows of the normalised table, and missing cells of the table as read: one scan."""
    if not df.columns:
        return 0, 0, 0
    missing = [f"c{i} IS NULL" + (f" OR isnan(c{i})" if V.is_floating(f.dataType) else "") for i, f in enumerate(df.schema.fields)]
    cells = f"CAST(size(filter(array({', '.join(missing)}), x -> x)) AS BIGINT)"
    found = duplicate_figures(frame_of(df, user_missing_codes, {"n_missing_cells": cells}), ["n_missing_cells"])
    return found["total_rows"], found["duplicate_count"], found["n_missing_cells"]


def assess_data_quality(
    df: DataFrame,
    user_missing_codes: Sequence[object] | None = None,
    single_pass: bool | None = None,
    top_n: int = TOP_N,
) -> QualityReport:
    """Run the quality jobs (profile, duplicates, quartiles, outlier counts) on a table.

    ``top_n`` is the length of the lists of most missing, most outlying and boxed columns.
    The duplicate job depends on nothing else, so it runs beside the others.
    """
    beside = inheritable_thread_target(df.sparkSession)
    with ThreadPoolExecutor(1) as pool:
        figures = pool.submit(beside(raw_figures), df, user_missing_codes)
        profiled = profile(df, user_missing_codes, single_pass=single_pass)
        outliers = iqr_outliers(profiled)
        n_rows, n_duplicates, n_missing = figures.result()
        return QualityReport(
            profiled, outliers, (n_rows, n_duplicates), tuple(user_missing_codes or ()), top_n, n_missing
        )
