"""Ordered-map operators.

A single-key question (least, floor, first match) is a filter and an aggregate or top-1, which push the bound
to the scan. Questions about every row's place (position, neighbour, as-of) work on range partitions: the
table is parted by key range once, each partition answers for itself, and one row a partition carries over
what the next one needs. Nothing sorts the whole table in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltlog.config import KeyType, order_columns
#: Range parts for each shuffle partition: they are dealt by hash, and several a task even out.
PARTS_EACH = 2
#: Sampled rows for each range part.
SAMPLED_EACH = 20
#: Bounds up to which the search is spelled out.
NESTED = 64


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _width(rows: Sequence[Sequence[object]]) -> int:
    """How many of the first values tell each of the sorted rows from the one before it (NaNs are equal)."""
    plain = [[None if v != v else v for v in row] for row in rows]
    return next((w for w in range(1, len(rows[0])) if all(a[:w] != b[:w] for a, b in zip(plain, plain[1:]))), len(rows[0]))


def _bounds(df: DataFrame, order: Sequence[Column], parts: int) -> tuple[Column, list[Column]]:
    """The key to search with, and up to ``parts`` - 1 literal bounds for it from the rows of least hash.

    The key has as few of the first order columns as tell the bounds and the least row apart, so that none of its
    values has the rows of more than about two parts. One column without a null bound is compared as it is, others as a struct.
    """
    names = [f"o{k}_" for k in range(len(order))]
    keys = df.select(*[c.alias(n) for c, n in zip(order, names)])
    # the limit leaves one partition, which is sorted as it is
    rows = keys.orderBy(F.xxhash64(*names)).limit(parts * SAMPLED_EACH).sortWithinPartitions(*names).collect()
    kinds = [f.dataType for f in keys.schema.fields]
    picked = sorted({len(rows) * k // parts for k in range(1, parts)} - {0}) if rows else []
    picked = [rows[k] for k, before in zip(picked, [0, *picked]) if rows[k] != rows[before]]
    if not picked:
        return F.lit(None), []
    width = _width([rows[0], *picked])
    if width == 1 and all(row[0] is not None for row in picked):
        return order[0], [F.lit(row[0]).cast(kinds[0]) for row in picked]
    fields = list(zip(names, kinds))[:width]
    return F.struct(*[c.alias(n) for c, (n, _) in zip(order, fields)]), [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields)]) for row in picked]


def ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows with the number of their range of the order columns in ``part_``; nothing moves yet.

    The bounds are literals in the plan, so every read of it sees the same ranges, and a read that needs the
    order columns only reads only them. They are searched by halves in generated code: few are spelled out, many
    lie in an array, a projection for each step.
    """
    key, bounds = _bounds(df, order, PARTS_EACH * _partitions(df))
    if not bounds:
        return df.withColumn("part_", F.lit(0))
    if len(bounds) <= NESTED:

        def among(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(bounds[middle] <= key, among(middle + 1, high)).otherwise(among(low, middle))

        return df.withColumn("part_", among(0, len(bounds)))
    # each step's place is used twice in the next, so that the steps stay projections; past the end a bound is null
    rows = df.select("*", key.alias("key_"), F.array(*bounds).alias("bounds_"), F.lit(0).alias("part_"))
    for step in (1 << k for k in reversed(range(len(bounds).bit_length()))):
        above = F.get("bounds_", F.col("part_") + (step - 1)) <= F.col("key_")
        rows = rows.withColumn("part_", F.col("part_") + F.when(above, step).otherwise(0))
    return rows.drop("key_", "bounds_")


def dealt(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows of ``ranged`` with each range whole in one partition, in order; a partition may have several ranges."""
    return rows.repartition(_partitions(rows), "part_").sortWithinPartitions("part_", *order)


def with_position(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Adds each row's place, from 0, in the whole order (which should be total)."""
    rows = ranged(df, order)
    sizes = rows.groupBy("part_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    bases = sizes.select(F.col("part_").alias("b_part_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    # each range is a partition of its own, sorted by the order alone, so a row's number there is its place in the range
    alone = rows.repartitionById(PARTS_EACH * _partitions(df), "part_").sortWithinPartitions(*order)
    placed = alone.withColumn("in_", F.monotonically_increasing_id() % (1 << 33))
    joined = placed.join(F.broadcast(bases), F.col("part_") == F.col("b_part_"))
    return joined.withColumn(name, (F.col("base_") + F.col("in_")).cast("bigint")).drop("part_", "in_", "b_part_", "base_")


def scan(df: DataFrame, key: str, kind: KeyType) -> DataFrame:
    """All rows in key order, ``pos`` counting from 0; tombstones are rows like others."""
    return with_position(df, order_columns(key, kind))


def least(df: DataFrame, key: str, kind: KeyType) -> DataFrame:
    return df.orderBy(*order_columns(key, kind)).limit(1)


def greatest(df: DataFrame, key: str, kind: KeyType) -> DataFrame:
    return df.orderBy(*[c.desc() for c in order_columns(key, kind)]).limit(1)


def floor(df: DataFrame, key: str, bound: object) -> DataFrame:
    """The row of the greatest key <= bound."""
    return df.where(F.col(key) <= F.lit(bound)).orderBy(F.col(key).desc()).limit(1)


def ceiling(df: DataFrame, key: str, bound: object) -> DataFrame:
    return df.where(F.col(key) >= F.lit(bound)).orderBy(F.col(key)).limit(1)


def seek(df: DataFrame, key: str, bound: object, count: int) -> DataFrame:
    """The first ``count`` rows from ``bound`` on."""
    return df.where(F.col(key) >= F.lit(bound)).orderBy(F.col(key)).limit(count)


def next_to(df: DataFrame, key: str, after: object, predicate: Column) -> DataFrame:
    """The first row after a key that satisfies the predicate."""
    return df.where((F.col(key) > F.lit(after)) & predicate).orderBy(F.col(key)).limit(1)


def prev_to(df: DataFrame, key: str, before: object, predicate: Column) -> DataFrame:
    return df.where((F.col(key) < F.lit(before)) & predicate).orderBy(F.col(key).desc()).limit(1)


def neighbours(df: DataFrame, key: str, kind: KeyType) -> DataFrame:
    """Adds ``prev_key`` and ``next_key``, the keys beside each row's in order; keys are distinct."""
    order = order_columns(key, kind)
    rows = ranged(df, order)
    ends = rows.groupBy("part_").agg(F.min_by(key, F.struct(*order)).alias("first_"), F.max_by(key, F.struct(*order)).alias("last_"))
    line = Window.orderBy("part_")  # one row a partition
    ends = ends.select(F.col("part_").alias("e_part_"), F.lag("last_").over(line).alias("before_"), F.lead("first_").over(line).alias("after_"))
    inside = Window.partitionBy("part_").orderBy(*order)
    rows = rows.withColumn("lag_", F.lag(key).over(inside)).withColumn("lead_", F.lead(key).over(inside))
    joined = rows.join(F.broadcast(ends), F.col("part_") == F.col("e_part_"))
    out = joined.withColumn("prev_key", F.coalesce("lag_", "before_")).withColumn("next_key", F.coalesce("lead_", "after_"))
    return out.drop("part_", "e_part_", "before_", "after_", "lag_", "lead_")


def as_of(probes: DataFrame, probe: str, keys: DataFrame, key: str, backward: bool = True) -> DataFrame:
    """Adds ``found_key`` to each probe row: the greatest key <= probe, or backward=False the least key >= it.

    Both sides are parted by value range together, probes of one value by a hash of the row too, so a hot value
    is spread; a part without a key takes the nearest one from the parts before it (after it), one row each. A null
    probe finds nothing.
    """
    columns = probes.columns
    left = probes.select(F.col(probe).alias("v_"), F.struct(*columns).alias("row_"), F.lit(1 if backward else 0).alias("side_"), F.xxhash64(*columns).alias("salt_"))
    right = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("v_"), F.lit(None).cast(left.schema["row_"].dataType).alias("row_"), F.lit(0 if backward else 1).alias("side_"), F.lit(0).cast("bigint").alias("salt_")).distinct()
    is_key = F.col("row_").isNull()
    rows = ranged(left.unionByName(right), [F.col("v_"), F.col("side_"), F.col("salt_")])
    own = F.when(is_key, F.col("v_"))
    if backward:
        reach = Window.partitionBy("part_").orderBy("v_", "side_").rowsBetween(Window.unboundedPreceding, 0)
        near, edge, line = F.last(own, ignorenulls=True).over(reach), F.max(own), Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
        carry = F.max("edge_").over(line)
    else:
        reach = Window.partitionBy("part_").orderBy("v_", "side_").rowsBetween(0, Window.unboundedFollowing)
        near, edge, line = F.first(own, ignorenulls=True).over(reach), F.min(own), Window.orderBy("part_").rowsBetween(1, Window.unboundedFollowing)
        carry = F.min("edge_").over(line)
    edges = rows.groupBy("part_").agg(edge.alias("edge_")).select(F.col("part_").alias("c_part_"), carry.alias("carry_"))
    found = rows.withColumn("near_", near).where(~is_key).join(F.broadcast(edges), F.col("part_") == F.col("c_part_"))
    return found.select("row_.*", F.when(F.col("v_").isNotNull(), F.coalesce("near_", "carry_")).alias("found_key"))
