"""Cutting lineage where a result is read more than once or must not change between reads."""

from __future__ import annotations

import tempfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode a temporary one if it is unset.

    A cluster's machines share no temporary folder, so there the setting has to be made.
    """
    context: SparkContext = spark.sparkContext
    named = context.getCheckpointDir()
    if named is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="siltlog-"))
        named = context.getCheckpointDir()
    return named


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, deleted when nothing refers to it any more."""
    shared_folder(df.sparkSession)
    settings = df.sparkSession.sparkContext._jsc.sc().conf()
    if not settings.contains(_CLEAN):
        settings.set(_CLEAN, "true")
    return df.checkpoint(eager=True)
