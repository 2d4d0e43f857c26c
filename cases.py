"""The inputs of the registered queries: projections over the given tables.

Every projection is plain SQL that Spark and DuckDB both accept, and reads its whole
table.  Dirty values are written into existing cells (never by dropping rows).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Case:
    """A projection: (expression, name, kind) per column over one table.

    ``kind`` is the physical class: i whole number, d double, s string, t timestamp.
    """

    table: str
    columns: tuple[tuple[str, str, str], ...]

    def select(self) -> str:
        cells = ", ".join(f"{e} AS {n}" for e, n, _ in self.columns)
        return f"SELECT {cells} FROM {self.table}"

    def read(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        return df.selectExpr(*[f"{e} AS {n}" for e, n, _ in self.columns])


def plain(table: str, names: str) -> Case:
    """Columns as they are: ``name:kind`` separated by blanks."""
    pairs = [item.split(":") for item in names.split()]
    return Case(table, tuple((n, n, k) for n, k in pairs))


CASES = {
    "orders_dirty": Case(
        "orders",
        (
            ("o_orderkey", "o_orderkey", "i"),
            ("o_custkey", "o_custkey", "i"),
            ("o_orderstatus", "o_orderstatus", "s"),
            ("CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END", "o_totalprice", "d"),
            ("o_orderdate", "o_orderdate", "t"),
            (
                "CASE WHEN o_orderpriority = '5-LOW' THEN ' N/A ' ELSE o_orderpriority END",
                "o_orderpriority",
                "s",
            ),
        ),
    ),
    "orders": plain(
        "orders",
        "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    ),
    "lineitem": plain(
        "lineitem",
        "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d "
        "l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    ),
    "lineitem_text": Case(
        "lineitem",
        (
            (
                "CASE WHEN l_linenumber = 7 THEN 'x' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END",
                "quantity_text",
                "s",
            ),
            ("CASE WHEN l_linenumber <= 3 THEN 'x' ELSE concat('1,', CAST(l_suppkey AS STRING)) END", "supplier_text", "s"),
            (
                "CASE WHEN l_returnflag = 'A' THEN CAST(CAST(l_shipdate AS DATE) AS STRING) "
                "WHEN l_returnflag = 'N' THEN 'unknown' ELSE 'late' END",
                "ship_text",
                "s",
            ),
            ("CAST(CAST(l_shipdate AS DATE) AS STRING)", "date_text", "s"),
            (
                "CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS INT)",
                "date_number",
                "i",
            ),
            ("l_linestatus", "l_linestatus", "s"),
            ("l_tax", "l_tax", "d"),
        ),
    ),
    # every value column misses other rows
    "line_series": Case(
        "lineitem",
        (
            ("l_shipdate", "l_shipdate", "t"),
            ("CASE WHEN l_linenumber > 1 THEN l_quantity END", "quantity", "d"),
            ("CASE WHEN l_returnflag = 'R' THEN l_extendedprice END", "price", "d"),
            ("CASE WHEN l_orderkey < 40 THEN l_extendedprice * (1 - l_discount) END", "net", "d"),
            ("l_extendedprice", "gross", "d"),
        ),
    ),
    "line_facts": plain("lineitem", "l_suppkey:i l_quantity:d l_returnflag:s"),
    "line_categories": plain("lineitem", "l_returnflag:s l_linestatus:s"),
    "events_special": Case(
        "events",
        (
            ("event_id", "event_id", "i"),
            ("ts", "ts", "t"),
            ("user_id", "user_id", "i"),
            ("event_type", "event_type", "s"),
            (
                "CASE WHEN event_type = 'error' THEN CAST('NaN' AS DOUBLE) "
                "WHEN event_type = 'signup' AND value > 200 THEN CAST('Infinity' AS DOUBLE) "
                "ELSE value END",
                "value",
                "d",
            ),
            ("props", "props", "s"),
        ),
    ),
    "documents": plain("documents", "doc_id:i text:s lang:s source:s n_chars:i"),
    "conversations": plain("conversations", "conv_id:i turn:i role:s text:s"),
    "pages": plain("pages", "page_id:i url:s html:s"),
    "labels": plain("labels", "doc_id:i quality:i toxic:i"),
    "customer": plain(
        "customer", "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s"
    ),
    "part": plain(
        "part", "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d"
    ),
    "embeddings": plain("embeddings", "vec_id:i embedding:s label:i"),
}
