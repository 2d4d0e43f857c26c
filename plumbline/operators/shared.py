"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


class MissingSetting(ValueError):
    """The session lacks a setting that the work needs; says nothing about the data."""


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared checkpoint folder; only a local session without one gets its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not named and (not context.master.startswith("local") or context.master.startswith("local-")):
        raise MissingSetting("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-checkpoint-"))
