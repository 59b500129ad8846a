"""Compaction: the sorted merge of runs.

``merge_keep_all`` keeps both rows of an equal key, the first run's first; ``merge_lww`` keeps the newest
generation's row. Tombstones may be purged only by a merge that covers the oldest generation: otherwise an
older run's value would come back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltlog.operators.ordered import with_position


def merge_keep_all(first: DataFrame, second: DataFrame, order: Sequence[str]) -> DataFrame:
    """All rows of both runs with ``src`` (1, 2) and ``pos`` in the order columns, then src.

    ``order`` orders each run totally; it begins with the key.
    """
    both = first.withColumn("src", F.lit(1)).unionByName(second.withColumn("src", F.lit(2)))
    key, *rest = order
    return with_position(both, [F.col(key), F.col("src"), *[F.col(c) for c in rest]])


def merge_lww(runs: DataFrame, key: Sequence[str], rank: Sequence[Column | str], values: Sequence[str]) -> DataFrame:
    """One row a key, of the greatest rank (generation first): a partial aggregate, no sort."""
    won = runs.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*rank)).alias("w"))
    return won.select(*key, "w.*")


def _merged(runs: DataFrame, inside: Column, gen: int, purge: bool) -> DataFrame:
    merged = merge_lww(runs.where(inside), ["key"], ["gen"], ["value", "is_tombstone"])
    merged = merged.select(F.lit(gen).cast("bigint").alias("gen"), "key", "value", "is_tombstone")
    if purge:
        merged = merged.where(~F.col("is_tombstone"))
    return runs.where(~inside).select(F.col("gen").cast("bigint").alias("gen"), "key", "value", "is_tombstone").unionByName(merged)


def compact(runs: DataFrame, generations: Sequence[int], purge: bool = False) -> DataFrame:
    """The runs (gen, key, value, is_tombstone) with those generations merged into the newest of them.

    ``purge`` drops tombstones; it is refused unless the oldest generation is among those merged and no
    generation between them is left out.
    """
    chosen = sorted(set(generations))
    if not chosen:
        return runs
    inside = F.col("gen").isin(chosen)
    if purge and not runs.where(~inside & (F.col("gen") < chosen[-1])).isEmpty():
        raise ValueError("tombstones can be purged only if no older generation is left out of the merge")
    return _merged(runs, inside, chosen[-1], purge)


def compact_through(runs: DataFrame, newest: int, purge: bool = False) -> DataFrame:
    """All generations up to ``newest`` merged into it, however many they are; tombstones may always be purged."""
    return _merged(runs, F.col("gen") <= newest, newest, purge)


def merged_statistics(stats: DataFrame) -> DataFrame:
    """The sums of runs' statistics, as a merge that keeps all rows has them."""
    return stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("records", "total_key_size", "total_data_size")])
