"""Connected components: by union-find in one task for few edges, else by alternating star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltlog.llm.frames import durable


#: Up to so many edges (about 10 MB) one task does without the rounds of shuffles that more edges take.
FEW_EDGES = 250_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict = {}

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root.setdefault(u, u)
            root.setdefault(v, v)
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    if kind is not None:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(n) for n in nodes], kind)], names=["node", "label"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    moved = down.join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (u, v); label is the least node reachable.

    Edges may repeat and run either way; loops are ignored; no edges give no rows. Edges are counted first: few
    go through one task, more through rounds. Each round's edges are checkpointed, and only their count and
    checksum come to the driver. A hub's edges are joined with one
    row, so adaptive execution can split them.
    """
    current = durable(edges.where("u <> v").select("u", "v"))
    kind = current.schema["u"].dataType.simpleString()
    if current.count() <= FEW_EDGES:
        return durable(current.coalesce(1).mapInArrow(_union_find, f"node {kind}, label {kind}"))
    state = _state(current)
    while state[0]:
        current = durable(_small_star(_large_star(current)))
        before, state = state, _state(current)
        if before == state:
            break
    labels = current.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
