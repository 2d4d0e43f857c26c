"""Plumbline: data quality and analysis readiness of Spark tables."""

from plumbline.operators.clean import standardize
from plumbline.operators.profile import profile, variable_types
from plumbline.operators.settled import settled_types
from plumbline.plans.quality import assess_data_quality
from plumbline.plans.readiness import evaluate_readiness
from plumbline.sources.tables import load_table, read_csv, write_report

__all__ = [
    "assess_data_quality",
    "evaluate_readiness",
    "load_table",
    "profile",
    "read_csv",
    "settled_types",
    "standardize",
    "variable_types",
    "write_report",
]
