"""Session and DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.plans.materialize import durable

__all__ = ["durable", "free_name", "read_table", "with_ids", "without_ids"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(docs: DataFrame, name: str) -> str:
    """The name, lengthened until no column of docs has it (in any case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A set of ids of at most so many rows is broadcast (about 16 MB); a larger one is joined by shuffle.
BROADCAST_IDS = 500_000


def _sized_ids(ids: DataFrame, name: str) -> DataFrame:
    """The distinct ids in one column, marked for broadcast if they are few."""
    ids = durable(ids.toDF(name).distinct())
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def without_ids(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not among the one column of ``dropped``; null matches null.

    The ids are counted first: a small set is broadcast, so the documents stay where they are.
    """
    name = free_name(docs, "listed_id")
    return docs.join(_sized_ids(dropped, name), F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def with_ids(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among the one column of ``kept``, in the same way."""
    name = free_name(docs, "listed_id")
    return docs.join(_sized_ids(kept, name), F.col("doc_id") == F.col(name), "left_semi")
