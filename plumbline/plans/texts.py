"""What a reader is told for each result code (one short sentence of our own per code)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.local import local_table

TEXTS = {
    # any purpose
    "no_purpose_selected": "Choose a purpose first.",
    "unknown_purpose": "This purpose is not known.",
    "no_data": "There is no table to judge.",
    "score_meaning": "The score tells how ready the table is, not how good a result will be.",
    "purpose_score_meaning": "The score refers to this purpose only.",
    "small_sample": "There are few usable rows, so results will be uncertain.",
    "too_few_rows": "There are too few usable rows.",
    "missing_very_high": "Most values of the columns are missing.",
    "missing_high": "A very large part of the values is missing.",
    "missing_many": "Many values are missing; decide how to fill or leave them out.",
    "outliers_high": "A large part of the numbers lies outside the box limits.",
    "outliers_some": "Some numbers lie outside the box limits.",
    "overfitting_risk": "There are few rows for each predictor, so a model may fit noise.",
    # exploration, correlation, dimension
    "no_analyzable_columns": "No column can be analysed.",
    "no_numeric": "There is no numeric column.",
    "no_categorical": "There is no categorical column.",
    "single_variable_only": "Only single columns can be described, not relations.",
    "few_rows_per_numeric": "There are few rows for the number of numeric columns.",
    "numeric_and_categorical": "Numbers can be compared between categories.",
    "categorical_only": "Counts and shares of categories can be shown.",
    "numeric_only": "Distributions and relations of numbers can be shown.",
    "under_two_numeric_in_table": "The table has fewer than two numeric columns.",
    "under_two_numeric_selected": "Fewer than two of the chosen columns are numeric.",
    # clusters
    "too_few_columns": "At least two usable numeric columns are needed.",
    "too_many_columns": "So many columns blur distances; reduce them first.",
    "few_rows_per_column": "There are few rows for each column.",
    "similar_columns": "Many pairs of columns say nearly the same.",
    "little_variation": "Some columns hardly vary.",
    "category_chosen": "A categorical or text column was chosen; distances need numbers.",
    "date_chosen": "A date column was chosen; it is not used.",
    "id_chosen": "A column that only names rows was chosen; it is not used.",
    "single_value_chosen": "A column with one value was chosen; it can't separate rows.",
    "continuous_high_unique": "Some numbers are nearly all distinct; they count as measurements.",
    "scaling_needed": "Bring the columns to a common scale before measuring distances.",
    "cluster_count_open": "How many clusters there are must be found out separately.",
    "category_needs_other_distance": "Categories need a distance made for mixed columns.",
    "robust_methods": "Prefer methods that tolerate extreme values.",
    # tests
    "no_candidate": "No column can be tested.",
    "mostly_unstable": "Most columns are too sparse or too uneven for a test.",
    "partly_unstable": "Many columns are too sparse or too uneven for a test.",
    "id_suspect": "The column seems to name rows.",
    "many_categories": "A column has many categories.",
    "scored_without_group": "The score was given without a group column.",
    "group_has_one_level": "The group column has only one level, so groups can't be compared.",
    "multivariate_structure": "Several numbers can be tested together.",
    "pair_tests_possible": "Two numbers can be tested against each other.",
    "single_numeric_only": "One number can be tested against a reference value.",
    "category_pairs_possible": "Categories can be tested for independence.",
    "single_category_only": "One category can be tested against expected shares.",
    "no_test_possible": "No test fits these columns.",
    "tests_are_candidates": "The tests named are candidates; check what each assumes.",
    "best_structure_counts": "The structure with the most points decides the score.",
    "group_not_a_candidate": "The group column itself is not tested.",
    "reference_value_needed": "Tests of one column need a value to compare with.",
    "multivariate_needs_checks": "Tests of several columns need further checks of their conditions.",
    "scored_by_group": "The score was given for a comparison of groups.",
    "two_groups": "Two groups can be compared.",
    "three_or_more_groups": "Three or more groups can be compared.",
    "many_groups": "There are very many groups.",
    "group_very_small": "The smallest group has fewer than three rows.",
    "group_small": "The smallest group has fewer than five rows.",
    "nothing_to_compare": "No column is left to compare between the groups.",
    "no_numeric_to_compare": "Only categories can be compared between the groups.",
    "no_category_to_compare": "Only numbers can be compared between the groups.",
    "multivariate_group_test": "Several numbers can be compared between the groups at once.",
    "numeric_group_test": "One number can be compared between the groups.",
    "category_group_test": "Categories can be compared between the groups.",
    # models
    "response_few_values": "The response has few values; a classification may fit better.",
    "response_missing_high": "A very large part of the response is missing.",
    "response_outliers_high": "A large part of the response lies outside the box limits.",
    "many_classes": "The response has more than ten classes.",
    "multi_class": "The response has several classes.",
    "two_classes": "The response has two classes.",
    "class_very_small": "The smallest class has fewer than five rows.",
    "imbalance": "One of the two classes is rare.",
    "rare_class": "At least one class is rare.",
    "numeric_predictors": "Numeric predictors are usable.",
    "categorical_predictors": "Categorical predictors are usable once encoded.",
    # survival
    "one_event_level": "The event column has one level; say whether it is the event.",
    "many_event_levels": "The event column has three levels or more; name the event.",
    "event_value_taken_as_event": "The named value is the event, all others are censored.",
    "few_events": "There are fewer than five events.",
    "events_rare": "Events are rare.",
    "events_dominate": "Nearly all rows are events.",
    "missing_in_key_columns": "Values of the time or event column are missing.",
    "many_zero_times": "Many durations are zero.",
    "no_covariates": "No covariate was chosen.",
    "covariates_usable": "Covariates are usable.",
    "covariates_unusable": "No chosen covariate is usable.",
    "categorical_covariates": "Categorical covariates are usable once encoded.",
    "few_events_per_covariate": "There are few events for each covariate.",
    "time_and_event_are_key": "The time and event columns decide the verdict.",
    "date_is_not_a_duration": "A date was chosen; a duration is needed.",
    "all_events": "Every row is an event; nothing is censored.",
    "no_events": "No row is an event.",
    "covariates_used": "The covariates took part in the score.",
    "cox_needs_proportional_hazards": "A Cox model needs hazards that stay in proportion.",
    # series
    "no_value_column": "No value column was chosen.",
    "few_points": "The series has few points in time.",
    "repeated_times": "Many rows share a time; combine them first.",
    "irregular_gaps": "The times are unevenly spaced.",
    "business_days": "The times look like business days; free days were not held against them.",
    "time_missing": "Times are missing.",
    "value_missing": "Many values of the series are missing.",
    "forecast_needs_stationarity": "A forecast needs further checks, such as a steady mean.",
    # quality warnings and recommendations
    "user_missing_codes_used": "These codes counted as missing",
    "date_columns_not_penalised": "Date columns lost no points for distinct values.",
    "duplicates_relaxed": "Repeated rows were judged mildly, as all columns are categories.",
    "outliers_skipped": "There is no number to check for outliers.",
    "special_values_present": "NaN or infinite values occur.",
    "categories_skipped": "There is no category to check.",
    "name_problems": "Column names are blank or repeated.",
    "force_danger": "The table is empty or has no usable column, which decides the status.",
    "handle_missing": "Treat the missing values.",
    "check_outliers": "Look at the outliers before you use means.",
    "convert_types": "Convert columns whose text holds numbers or dates.",
    "review_duplicates": "Check whether the repeated rows are meant.",
    # column problems
    "should_be_numeric": "Text that mostly holds numbers.",
    "should_be_date": "Text that mostly holds dates.",
    "mixed_number_text": "Numbers and other text are mixed.",
    "mixed_date": "Dates and other text are mixed.",
    "special_value": "NaN or infinite values occur in the column.",
    "excluded": "The column is empty or has one value.",
    "zero_variance": "The numbers of the column do not vary.",
    "dominant_category": "One category fills nearly all rows.",
    "too_many_values_for_rows": "There are too many categories for the rows.",
    "too_many_categories": "There are more than ten categories.",
    "blank_name": "The column has no name.",
    "repeated_name": "Several columns have this name.",
}
# what is said of a whole table
STATUS_TEXTS = {
    "good": "The table can be used as it is.",
    "caution": "The table can be used once its weak points are treated.",
    "danger": "The table needs work before it is used.",
}
ITEM_TEXTS = {
    "good": "Nothing to do.",
    "caution": "Look at the columns concerned.",
    "danger": "Treat the columns concerned first.",
}


def with_texts(rows: DataFrame, code: str = "code", texts: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with a ``text`` for each code; an unknown code stands for itself.

    The broadcast table holds the fixed texts only.
    """
    table = local_table(rows.sparkSession, list((TEXTS if texts is None else texts).items()), "_code string, _text string")
    joined = rows.join(F.broadcast(table), rows[code] == F.col("_code"), "left")
    return joined.withColumn("text", F.coalesce("_text", F.col(code))).drop("_code", "_text")
