"""Texts for codes, reports of verdicts, and the spacing of several value columns."""

import importlib
import pkgutil
from datetime import datetime, timedelta

from pyspark.sql import functions as F

import plumbline.plans.readiness as readiness
from plumbline import profile, write_report
from plumbline.operators.gaps import gap_stats, ordered_gaps
from plumbline.plans import quality as Q
from plumbline.plans.quality import assess_data_quality
from plumbline.plans.readiness import evaluate_readiness
from plumbline.plans.readiness.timeseries import check_timeseries
from plumbline.plans.readiness.verdict import Rulebook
from plumbline.plans.texts import ITEM_TEXTS, STATUS_TEXTS, TEXTS


def test_every_code_has_a_text():
    codes = set()
    for module in pkgutil.iter_modules(readiness.__path__):
        for value in vars(importlib.import_module(f"{readiness.__name__}.{module.name}")).values():
            if isinstance(value, Rulebook):
                codes |= {code for code, _ in [*value.messages, *value.notes]}
    for rules in (Q.TYPE_ISSUES, Q.CATEGORY_PROBLEMS, Q.STRUCTURE_PROBLEMS):
        codes |= {code for code, _ in rules}
    codes |= {"no_purpose_selected", "no_data", "unknown_purpose", "no_value_column", "blank_name", "repeated_name"}
    assert codes <= set(TEXTS)
    assert set(STATUS_TEXTS) == set(ITEM_TEXTS) == {"good", "caution", "danger"}


def test_explanations_name_the_codes(spark):
    df = spark.createDataFrame([(1, "a"), (99, "b"), (3, None)], "n int, s string")
    report = assess_data_quality(df, [99], top_n=1)
    said = {(r.section, r.code): r.text for r in report.explanations.collect()}
    assert said["warning", "user_missing_codes_used"].endswith(": 99.")
    assert said["recommendation", "handle_missing"] == TEXTS["handle_missing"]
    assert sum(section == "item" for section, _ in said) == 7
    assert report.top_missing.count() == 1


def test_verdicts_can_be_written(spark, tmp_path):
    df = spark.range(40).selectExpr("id * 1.5 AS a", "id % 7 * 2.5 AS b")
    verdict = evaluate_readiness(df, "cluster")
    write_report(verdict.tables(), str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} >= {"report=result", "report=messages", "report=detail_candidates"}
    texts = [r.text for r in spark.read.parquet(f"{tmp_path}/report=messages").collect()]
    assert texts and not set(texts) & set(TEXTS)


def test_spacing_of_several_value_columns(spark):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(days=i), float(i), float(i) if i % 3 == 0 else None) for i in range(90)]
    p = profile(spark.createDataFrame(rows, "t timestamp, a double, b double"))
    spacing = {r.variable: r for r in check_timeseries(p, "t", ["a", "b"]).details["spacing"].collect()}
    for name, points, gap in (("a", 90, 1.0), ("b", 30, 3.0)):
        alone = gap_stats(p.frame, p.named("t"), p.frame.present(p.named(name).pos))
        assert (spacing[name].n_points, spacing[name].median_gap) == (points, gap) == (alone.n_points, alone.median)


def test_gaps_over_empty_and_single_ranges(spark):
    values = spark.range(1000).select((F.col("id") * F.col("id")).cast("double").alias("v"))
    want = sorted(float(2 * i + 1) for i in range(999))
    for rows_per_task in (10, 333, 10_000):
        gaps = ordered_gaps(values, "v", 1000, rows_per_task)
        assert sorted(r.gap for r in gaps.collect()) == want
