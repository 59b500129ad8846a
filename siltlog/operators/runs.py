"""Sorted immutable runs: flushing, statistics, blocks, the sparse index and look-ups through it.

A record takes a length word for key and value and their bytes. A block closes at the record that brings it
to the block size, so a record never straddles blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltlog.config import KeyType, TableConfig, key_size
from siltlog.operators import oplog
from siltlog.operators.fold import fold_with_reset
from siltlog.operators.ordered import as_of, with_position

#: Fixed value: bytes of the two length words of a record.
RECORD_OVERHEAD = 8


def flush(tiered_log: DataFrame) -> DataFrame:
    """gen, key, value, is_tombstone: each memtable reduced to its last row a key. An empty log gives none."""
    rows = oplog.reduce_tiers(tiered_log)
    gone = F.col("op") == oplog.DEL
    return rows.select("gen", "key", F.when(~gone, F.col("value")).alias("value"), gone.alias("is_tombstone"))


def next_generation(runs: DataFrame) -> DataFrame:
    """current_gen (0 without runs) and next_gen."""
    return runs.agg(F.coalesce(F.max("gen"), F.lit(0)).cast("bigint").alias("current_gen"), (F.coalesce(F.max("gen"), F.lit(-1)) + 1).cast("bigint").alias("next_gen"))


def record_size(kind: KeyType, key: str = "key", value: str = "value") -> Column:
    return (RECORD_OVERHEAD + key_size(key, kind) + F.coalesce(F.octet_length(value), F.lit(0))).cast("bigint")


def statistics(rows: DataFrame, kind: KeyType, key: str = "key", value: str = "value") -> DataFrame:
    """records, total_key_size, total_data_size, avg_key_size (whole bytes; the width for fixed keys)."""
    totals = rows.agg(F.count("*").alias("records"), F.coalesce(F.sum(key_size(key, kind)), F.lit(0)).cast("bigint").alias("total_key_size"), F.coalesce(F.sum(F.octet_length(value)), F.lit(0)).cast("bigint").alias("total_data_size"))
    average = F.expr("CASE WHEN records = 0 THEN 0 ELSE total_key_size DIV records END") if kind.dynamic else F.lit(kind.width)
    return totals.withColumn("avg_key_size", average.cast("bigint"))


def blocks(rows: DataFrame, kind: KeyType, block_size: int, key: str = "key") -> DataFrame:
    """key, pos, block, inner_offset of each record of a run (``rows``: key and value).

    Keys are distinct in a run; a run with repeated keys needs a total order given by its values too.
    """
    sized = rows.select(F.col(key).alias("key"), record_size(kind, key).alias("size"))
    folded = fold_with_reset(sized, ["key"], "size", block_size)
    return folded.select("key", "pos", F.col("grp").alias("block"), F.col("grp_before").alias("inner_offset"))


def sparse_index(block_rows: DataFrame, interval: int) -> DataFrame:
    """The records that get an index entry: each ``interval``-th one, and the first of each block."""
    return block_rows.where((F.col("pos") % interval == 0) | (F.col("inner_offset") == 0))


def index_lookup(probes: DataFrame, probe: str, index: DataFrame, block_rows: DataFrame) -> DataFrame:
    """For each probe the index entry to start at and the record found from there: start_key, block, found.

    The entry is the greatest start key <= probe, none for a probe below the first; the record then lies in
    that entry's block or nowhere.
    """
    started = as_of(probes, probe, index, "key").withColumnRenamed("found_key", "start_key")
    entry = index.select(F.col("key").alias("i_key"), F.col("block").alias("i_block"))
    placed = started.join(entry, F.col("start_key") == F.col("i_key"), "left")
    record = block_rows.select(F.col("key").alias("r_key"), F.col("block").alias("r_block"))
    found = placed.join(record, (F.col(probe) == F.col("r_key")) & (F.col("i_block") == F.col("r_block")), "left")
    return found.select(*probes.columns, "start_key", F.col("i_block").alias("block"), F.col("r_key").isNotNull().alias("found"))


def index_level(stats: DataFrame, config: TableConfig) -> DataFrame:
    """Adds summary_entries, summary_interval and sparse_type: 'sum' where the index needs a second level."""
    entries = F.greatest(F.lit(1), F.expr(f"{config.max_summary_bytes} DIV greatest(1, avg_key_size)"))
    out = stats.withColumn("summary_entries", entries.cast("bigint"))
    out = out.withColumn("summary_interval", F.expr(f"(records DIV {config.min_index_interval}) DIV summary_entries"))
    return out.withColumn("sparse_type", F.when(F.col("summary_interval") > 2, "sum").otherwise("idx"))


def numbered(index: DataFrame) -> DataFrame:
    """The index with ``entry``, the number of each entry in key order."""
    return with_position(index, [F.col("key")], "entry")


def second_level(index: DataFrame, every: int) -> DataFrame:
    """Every ``every``-th entry of an index, numbered: the level to search first."""
    return numbered(index).where(F.col("entry") % max(1, every) == 0)


def two_level_lookup(probes: DataFrame, probe: str, summary: DataFrame, index: DataFrame, block_rows: DataFrame, every: int) -> DataFrame:
    """``index_lookup`` through a second level: sum_key, start_key, block, found for each probe row.

    ``index`` has ``entry`` numbers and ``summary`` each ``every``-th of its rows (``second_level``). The greatest
    summary key <= probe names a stretch of ``every`` index entries; only those are searched for the start key, so
    a probe costs at most ``every`` rows. The last stretch is searched like the others.
    """
    rows = probes.withColumn("row_", F.monotonically_increasing_id())
    placed = as_of(rows, probe, summary, "key").withColumnRenamed("found_key", "sum_key")
    heads = summary.select(F.col("key").alias("h_key"), F.expr(f"entry DIV {max(1, every)}").alias("stretch"))
    stretches = index.select(F.expr(f"entry DIV {max(1, every)}").alias("i_stretch"), F.col("key").alias("i_key"), F.col("block").alias("i_block"))
    met = placed.join(heads, F.col("sum_key") == F.col("h_key")).join(stretches, F.col("stretch") == F.col("i_stretch")).where(F.col("i_key") <= F.col(probe))
    start = met.groupBy(F.col("row_").alias("m_row_")).agg(F.max(F.struct("i_key", "i_block")).alias("s"))
    started = placed.join(start, F.col("row_") == F.col("m_row_"), "left")
    record = block_rows.select(F.col("key").alias("r_key"), F.col("block").alias("r_block"))
    found = started.join(record, (F.col(probe) == F.col("r_key")) & (F.col("s.i_block") == F.col("r_block")), "left")
    return found.select(*probes.columns, "sum_key", F.col("s.i_key").alias("start_key"), F.col("s.i_block").alias("block"), F.col("r_key").isNotNull().alias("found"))
