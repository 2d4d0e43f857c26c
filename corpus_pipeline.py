"""The corpus pipeline: documents pass five operators, each stage written as Parquet and reread.

Columns that ``documents`` has beyond its own pass every stage but the last.  Null texts are empty
texts: they have too few words for the quality rules and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.byte_bpe import encode_documents
from plumbline.llm.common import scratch_path, table
from plumbline.llm.decontamination import decontaminate
from plumbline.llm.near_duplicates import near_duplicates
from plumbline.llm.quality_classifier import classify
from plumbline.llm.quality_rules import quality_rules


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or the learned decision list rejects go."""
    return quality_rules(docs, table(spark, sf_dir, "labels")).where("kept").select("doc.*")


def reject_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its limit go."""
    return classify(docs).where("kept").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays, once.

    Rows without a doc_id can't be named by a group and stay, equal ones once.
    """
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.join(kept, docs.doc_id.cast("long") == kept.doc_id, "left_semi")
    return named.union(docs.where("doc_id IS NULL")).dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    found = found.select(F.col("doc_id").alias("id"), F.col("tk")).distinct()
    same = docs.doc_id.cast("long").eqNullSafe(found.id) & (F.xxhash64(docs.text.cast("string")) == found.tk)
    return docs.join(found, same, "left_anti")


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of every document that is left."""
    return encode_documents(docs)


STAGES = [
    ("quality_rules", reject_by_rules),
    ("quality_classifier", reject_by_classifier),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", to_token_ids),
]
#: Learned rules and a trained scorer have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
