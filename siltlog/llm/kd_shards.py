"""Operator 4: sharding by k-d tree partitioning, with built-in functions only.

The metadata of a document (text bytes, source, language) place it in a space of whole numbers. A node of
the tree that must give n leaves is cut along its widest dimension (range over the table's range) at the
weighted median, weight being size in bytes, so that the two sides get weight in proportion to their leaves;
rows that tie on the dimension are ordered by doc_id, then by content. Medians are exact: one aggregation
a pass counts the weight of all nodes in bins and finds each node's bin with the median; the next pass looks
between the least and greatest value of that bin, until they are one. The driver reads ``BINS`` counts a pass, or
``LEAST_BINS`` a node where that is more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltlog.llm.frames import durable

#: The bins of one pass over all open nodes, and the fewest of a node.
BINS = 1 << 14
LEAST_BINS = 256
#: Holds doc_id and checksum as one number.
WIDE = "decimal(38,0)"
#: A (shard, bucket) task numbers about so many rows.
SLOT_ROWS = 50_000
DIMENSIONS = ("d_bytes", "d_source", "d_lang")


def _lookup(values: list[int], index: Column, kind: str = "bigint") -> Column:
    """values[index], from one constant-folded literal array."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), (index + 1).cast("int"))


def _points(docs: DataFrame) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", text.alias("body"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"))
    return rows.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint")).alias("t_id"),
        (F.octet_length("body") + 1).cast("bigint").alias("size"),
        F.crc32("body").alias("text_crc32"),
        F.octet_length("body").cast("bigint").alias("d_bytes"),
        F.crc32(F.encode("source", "UTF-8")).alias("d_source"),
        F.crc32(F.encode("lang", "UTF-8")).alias("d_lang"),
    )


def _cut(rows: DataFrame, count: int, key: Column, kind: str, bounds: dict[int, tuple[int, int, int]], wanted: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """For each node the least value v with weight(key <= v) > wanted, the weight below v, and that at v.

    ``bounds`` has the key's range and the weight in each node, ``wanted`` less than that weight. A pass counts
    the rest of the range in bins and keeps the bin that holds v, down to the least and greatest value in it;
    doubles number the bins, which keeps the order of the values however long these are.
    """
    low = {n: a for n, (a, _, _) in bounds.items()}
    high = {n: b for n, (_, b, _) in bounds.items()}
    below, here = dict.fromkeys(bounds, 0), {n: w for n, (_, _, w) in bounds.items()}
    while open_nodes := [n for n in bounds if low[n] < high[n]]:
        bins = max(LEAST_BINS, BINS // len(open_nodes))
        column = lambda values, kind="bigint": _lookup([values.get(n, 0) for n in range(count)], F.col("node"), kind)
        active = column(dict.fromkeys(open_nodes, 1)) == 1
        inside = rows.where(active).select("node", "size", key.alias("key")).where((F.col("key") >= column(low, kind)) & (F.col("key") <= column(high, kind)))
        width = column({n: (high[n] - low[n]) // bins + 1 for n in open_nodes}, kind).cast("double")
        binned = inside.withColumn("bin", F.floor((F.col("key") - column(low, kind)).cast("double") / width))
        counts = binned.groupBy("node", "bin").agg(F.sum("size").alias("w"), F.min("key").alias("a"), F.max("key").alias("b"))
        passed: set[int] = set()
        for r in sorted(counts.collect(), key=lambda r: (r.node, r.bin)):
            if r.node in passed:
                continue
            if below[r.node] + r.w > wanted[r.node]:
                low[r.node], high[r.node], here[r.node] = int(r.a), int(r.b), int(r.w)
                passed.add(r.node)
            else:
                below[r.node] += int(r.w)
    return {n: (low[n], below[n], here[n]) for n in bounds}


def _split(rows: DataFrame, leaves: list[int]) -> tuple[DataFrame, list[int]]:
    """Cuts every node that must give more than one leaf; the rows with their new node, and its leaves."""
    count = len(leaves)
    facts = [f(c).alias(f"{name}_{c}") for c in (*DIMENSIONS, "t_id") for f, name in ((F.min, "lo"), (F.max, "hi"))]
    found = {r.node: r for r in rows.groupBy("node").agg(*facts, F.sum("size").alias("w")).collect()}
    cut = [n for n in found if leaves[n] > 1]
    whole = {d: max(1, max(found[n][f"hi_{d}"] for n in found) - min(found[n][f"lo_{d}"] for n in found)) for d in DIMENSIONS} if found else {}
    widest = {n: max(range(len(DIMENSIONS)), key=lambda k: ((found[n][f"hi_{DIMENSIONS[k]}"] - found[n][f"lo_{DIMENSIONS[k]}"]) / whole[DIMENSIONS[k]], -k)) for n in cut}
    wanted = {n: int(found[n].w) * (leaves[n] // 2) // leaves[n] for n in cut}
    dimension = _lookup([widest.get(n, 0) for n in range(count)], F.col("node"))
    key = F.when(dimension == 0, F.col(DIMENSIONS[0])).when(dimension == 1, F.col(DIMENSIONS[1])).otherwise(F.col(DIMENSIONS[2]))
    bounds = {n: (found[n][f"lo_{DIMENSIONS[widest[n]]}"], found[n][f"hi_{DIMENSIONS[widest[n]]}"], int(found[n].w)) for n in cut}
    rows = rows.withColumn("k", key)
    values = _cut(rows, count, F.col("k"), "bigint", bounds, wanted)

    # rows at the median value are parted by doc_id, and repeated doc_ids by checksum: one number has both
    at = lambda table, kind="bigint": _lookup([int(table.get(n, 0)) for n in range(count)], F.col("node"), kind)
    tie = (F.col("t_id").cast(WIDE) * F.lit(1 << 32).cast("decimal(10,0)")).cast(WIDE) + F.col("text_crc32")
    is_cut = at(dict.fromkeys(cut, 1)) == 1
    value = at({n: v for n, (v, _, _) in values.items()})
    spans = {n: (found[n].lo_t_id << 32, (found[n].hi_t_id << 32) + (1 << 32) - 1, values[n][2]) for n in cut}
    rest = {n: wanted[n] - values[n][1] for n in cut}
    last = _cut(rows.where(is_cut & (F.col("k") == value)), count, tie.cast(WIDE), WIDE, spans, rest)
    # the rows at the cut itself go to the side that then lies nearer to its share
    cuts = {n: v + (2 * (rest[n] - below) > here) for n, (v, below, here) in last.items()}

    left = F.when(F.col("k") == value, tie < at(cuts, WIDE)).otherwise(F.col("k") < value)
    names, first = [], {}
    for n in range(count):
        first[n] = len(names)
        names += [leaves[n]] if leaves[n] == 1 else [leaves[n] // 2, leaves[n] - leaves[n] // 2]
    node = at(first) + F.when(is_cut & ~left, 1).otherwise(0)
    return rows.withColumn("node", node.cast("int")).drop("k"), names


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    Give the number of shards, or ``target_bytes``, from which it follows: the fewest leaves whose mean size
    is at most that. size is the text's UTF-8 bytes plus 1 (a null text has none); a null source or language
    counts as an empty string, a null doc_id orders before all others. Rows alike in dimension, doc_id and
    checksum stay together. slot numbers a shard's rows from 0 without gaps. An empty table gives no rows;
    extra columns are ignored. A very long text counts by its size alone. What reaches the driver is bounded
    by ``BINS`` counts a pass, or ``LEAST_BINS`` a node.
    """
    rows = durable(_points(docs).withColumn("node", F.lit(0)))
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // max(1, target_bytes or total or 1)))
    leaves = [shards]
    while max(leaves) > 1:
        rows, leaves = _split(rows, leaves)
        if max(leaves) > 1:
            rows = durable(rows)
    return _slots(rows.withColumnRenamed("node", "shard"))


def _slots(rows: DataFrame) -> DataFrame:
    rows = durable(rows.select("doc_id", "t_id", "size", "text_crc32", "shard"))
    buckets = max(1, -(-rows.count() // SLOT_ROWS)) * 4
    # shards count up at the same time, so a bucket holds about the same rows whatever the number of shards
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("t_id", "text_crc32"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    bases = counts.selectExpr("shard AS b_shard", "bucket AS b_bucket", "coalesce(sum(n) OVER (PARTITION BY shard ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base")
    numbered = rows.selectExpr("*", "row_number() OVER (PARTITION BY shard, bucket ORDER BY t_id, text_crc32, size) - 1 AS place")
    joined = numbered.join(bases, (F.col("shard") == F.col("b_shard")) & (F.col("bucket") == F.col("b_bucket")))
    return joined.selectExpr("doc_id", "size", "text_crc32", "shard", "CAST(base + place AS BIGINT) AS slot")
