"""Memtable accounting and flush boundaries.

A put adds key bytes, value bytes and a fixed entry cost; a delete adds nothing, and nothing is ever
subtracted, so an overwrite counts again. A memtable is full at the put that brings it to the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltlog.config import KeyType, key_size
from siltlog.operators.fold import fold_with_reset
from siltlog.operators.ordered import ranged

#: Fixed value: the bytes that an entry costs besides key and value.
ENTRY_BYTES = 30


def entry_size(kind: KeyType) -> Column:
    """Bytes that a log row adds to the memtable."""
    put = key_size("key", kind) + F.coalesce(F.octet_length("value"), F.lit(0)) + ENTRY_BYTES
    return F.when(F.col("op") == "put", put).otherwise(0).cast("bigint")


def running_bytes(log: DataFrame, kind: KeyType) -> DataFrame:
    """seq, key, size, total: bytes accounted so far, were the memtable never flushed."""
    rows = ranged(log.select("seq", "key", entry_size(kind).alias("size")), [F.col("seq")])
    line = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    bases = rows.groupBy("part_").agg(F.sum("size").alias("s_")).select(F.col("part_").alias("b_part_"), F.coalesce(F.sum("s_").over(line), F.lit(0)).alias("base_"))
    inside = F.sum("size").over(Window.partitionBy("part_").orderBy("seq"))
    joined = rows.withColumn("in_", inside).join(F.broadcast(bases), F.col("part_") == F.col("b_part_"))
    return joined.select("seq", "key", "size", (F.col("base_") + F.col("in_")).cast("bigint").alias("total"))


def totals(log: DataFrame, kind: KeyType) -> DataFrame:
    """entries, key_bytes, value_bytes (with entry costs) and bytes of a memtable fed by the whole log."""
    put = F.col("op") == "put"
    key_bytes = F.coalesce(F.sum(F.when(put, key_size("key", kind))), F.lit(0)).cast("bigint")
    value_bytes = F.coalesce(F.sum(F.when(put, F.coalesce(F.octet_length("value"), F.lit(0)) + ENTRY_BYTES)), F.lit(0)).cast("bigint")
    counts = log.agg(F.count_distinct("key").alias("entries"), key_bytes.alias("key_bytes"), value_bytes.alias("value_bytes"))
    return counts.withColumn("bytes", F.col("key_bytes") + F.col("value_bytes"))


def with_generations(log: DataFrame, kind: KeyType, limit: int) -> DataFrame:
    """The log with ``gen`` (from 0): the number of the memtable that takes the row."""
    sized = log.withColumn("size_", entry_size(kind))
    return fold_with_reset(sized, ["seq"], "size_", limit).withColumnRenamed("grp", "gen").drop("size_", "grp_before", "closes", "pos")


def flush_points(log: DataFrame, kind: KeyType, limit: int) -> DataFrame:
    """gen, seq, mem_bytes of each put that fills a memtable."""
    sized = log.select("seq", entry_size(kind).alias("size"))
    folded = fold_with_reset(sized, ["seq"], "size", limit).where("closes")
    return folded.select(F.col("grp").alias("gen"), "seq", (F.col("grp_before") + F.col("size")).alias("mem_bytes"))
