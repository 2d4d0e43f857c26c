"""Small result tables: one row per column or per criterion, never data rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A DataFrame over already aggregated metadata (bounded by the number of columns)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = [
        pa.array([row[i] for row in rows], type=field.type) for i, field in enumerate(arrow)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema=struct)
