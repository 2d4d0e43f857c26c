"""How the columns of a table are spread over scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

# Upper limit of columns handled in one scan, so that generated code stays small.
COLUMNS_PER_SCAN = 64


def input_files(df: DataFrame) -> list[str]:
    try:
        return df.inputFiles()
    except AnalysisException:  # inputs that have no file list
        return []


def columns_per_scan(df: DataFrame, width: int, files: Sequence[str]) -> int:
    """Columns stacked in one scan.

    A table of few files cannot occupy the cluster with one scan, so its columns are
    spread over several; a table of many files gets as few scans as possible.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    scans = max(1, cores // max(1, len(files))) if files else 1
    return min(COLUMNS_PER_SCAN, max(1, -(-width // scans)))
