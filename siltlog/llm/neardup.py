"""Operator 7: near-duplicate documents by bottom-k sketches.

One hash function orders all word shingles; a document's sketch is its k smallest shingle hashes.

1. Documents with the same word sequence become one node, so exact copies cost nothing further.
2. The least ``KEYS`` retained values of each node are its entries in inverted lists. Two documents of
   Jaccard similarity 0.8 share none of them with probability 0.2**8.
3. A list is parted by size grade (linked documents have the same or neighbouring grades). Within a part the
   union sketch estimates each pair's similarity from the overlaps; pairs clearly below the threshold go. A
   pair is looked at in the list of the least value it shares only.
4. The nodes left there meet with their full shingle sets, and exact similarity decides. The links found are
   a forest: the result is one class per component.
5. A part of more than ``LONG`` nodes (fewer, if their sets are large) is contracted first: all its nodes are
   compared with ``PIVOTS`` pivots, by sketch and then exactly. A part that is one class then is done.
   - Where the largest class holds a fair share, it is a group of copies. Its nodes are connected with each
     other, so only pairs with a node outside the class are left; blocks of such nodes meet every block.
   - Otherwise its nodes share a passage and little else. It is split by each further retained value w of its
     nodes into lists (v, w), which again are parted, compared, or contracted and split, to ``DEPTH`` values.
     Two documents at the threshold share fewer than two of ``FURTHER`` values with probability 2e-7. Nodes
     that share no second value never meet, and a node costs at most ``FURTHER`` rows a list. If the split
     lists would cost more than the part itself, it is compared in blocks.
6. Components of the confirmed links give the classes.

No step emits the pairs of a group, no node of a list is dropped, and no task holds more than two blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltlog.llm import kernels
from siltlog.llm.components import connected_components
from siltlog.llm.frames import durable, free_name, with_ids, without_ids

SKETCH = 64
KEYS = 8
#: Retained values by which a long part is split.
FURTHER = 12
DEPTH = 3
#: A part of more nodes is contracted and then split or compared in blocks of so many nodes.
LONG = 8192
#: The full sets of a part, or of a block, take about so many bytes at most.
SET_BYTES = 64 << 20
PIVOTS = 3
#: From this share in its largest class on, a part is a group of copies.
COPIES = 0.25
#: Rows of a group that are compared with all its rows at once.
TILE = 256
#: Standard errors of the estimate that a pair may lie below the threshold and still be verified.
MARGIN = 4.5
_U = np.uint64


def _distinct_shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    if not len(hashes):
        return hashes
    found = kernels.shingles(hashes, width) if len(hashes) >= width else kernels.whole_sequence(hashes)
    return np.unique(found)


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    for lo, hi, data, offsets in kernels.text_slices(column):
        hashes, _, _, first = kernels.words(kernels.ascii_lower(data), offsets)
        for k in range(hi - lo):
            yield hashes[first[k] : first[k + 1]]


def _node(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _sketcher(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, keys, sketches = [], [], [], []
            for hashes in _texts(batch.column(1)):
                found = _distinct_shingles(hashes, width)
                sizes.append(len(found))
                nodes.append(_node(hashes) if len(hashes) else None)
                keys.append(found[:FURTHER].astype(np.int64))
                sketches.append((found[:SKETCH] >> _U(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["doc_id", "null_rep", "n_shingles", "node", "keys", "sketch"],
            )

    return run


def _setter(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 512):
                nodes, sets = [], []
                for hashes in _texts(batch.column(1).slice(lo, 512)):
                    nodes.append(_node(hashes) if len(hashes) else None)
                    sets.append(_distinct_shingles(hashes, width).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "set"])

    return run


class _Overlaps:
    """How many values the sets of a group have in common, for all pairs of different ones, ``TILE`` rows at a time.

    Values in an eighth of the sets or more go through matrix products, the others through their lists.
    """

    def __init__(self, values: list[np.ndarray]) -> None:
        self.m = len(values)
        row = np.repeat(np.arange(self.m), [len(v) for v in values])
        _, column, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        often = counts >= max(16, self.m // 8)
        order = np.argsort(column, kind="stable")
        self.rows, self.starts = row[order].astype(np.int32), np.concatenate(([0], np.cumsum(counts)))
        lists = (counts[column] > 1) & ~often[column]
        self.row, self.column, self.counts = row[lists], column[lists], counts
        place = np.cumsum(often) - 1
        dense = often[column]
        self.grids = []
        self.dense_row, self.dense_column, self.n_dense = row[dense], place[column[dense]], int(often.sum())
        if self.n_dense <= 2048:
            self.grids = list(self._grids())

    def _grids(self) -> Iterator[np.ndarray]:
        for lo in range(0, self.n_dense, 2048):
            here = (self.dense_column >= lo) & (self.dense_column < lo + 2048)
            grid = np.zeros((self.m, min(2048, self.n_dense - lo)), dtype=np.float32)
            grid[self.dense_row[here], self.dense_column[here] - lo] = 1.0
            yield grid

    def tiles(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, row after the last, overlaps of these rows with all rows)."""
        for lo in range(0, self.m, TILE):
            hi = min(lo + TILE, self.m)
            out = np.zeros((hi - lo, self.m), dtype=np.float32)
            for grid in self.grids or self._grids():
                out += grid[lo:hi] @ grid.T
            a, b = np.searchsorted(self.row, (lo, hi))
            ends = np.cumsum(self.counts[self.column[a:b]])
            at = 0
            while a + at < b:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 22), side="right")))
                columns = self.column[a + at : a + to]
                counts = self.counts[columns]
                inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                other = self.rows[np.repeat(self.starts[columns], counts) + inside]
                flat = np.repeat((self.row[a + at : a + to] - lo) * self.m, counts) + other
                out += np.bincount(flat, minlength=out.size).reshape(out.shape)
                at = to
            yield lo, hi, out


def candidates(values: list[np.ndarray], sizes: np.ndarray, percent: int, k: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, which pairs of these rows and all rows may reach the threshold).

    ``values`` are sorted sketches. Up to the smaller of two limits (the largest value of a sketch that left
    values out; no limit for a complete one) both sketches hold all their set's values: there the overlap's share
    of the union sketch estimates the similarity.
    """
    share = percent / 100.0
    lengths = np.array([len(v) for v in values])
    complete = sizes <= k
    top = np.array([v[-1] for v in values])
    for lo, hi, shared in _Overlaps(values).tiles():
        within = np.empty((hi - lo, len(values)), dtype=np.float32)
        beyond = np.empty((hi - lo, len(values)), dtype=np.float32)
        for i in range(lo, hi):
            within[i - lo] = np.where(complete, lengths[i], np.searchsorted(values[i], top, side="right"))
        for j, v in enumerate(values):
            beyond[:, j] = np.where(complete[lo:hi], lengths[j], np.searchsorted(v, top[lo:hi], side="right"))
        estimate = shared / np.maximum(within + beyond - shared, 1.0)
        lowest = np.where(complete[lo:hi, None] & complete[None, :], share - 0.02, share - MARGIN * (share * (1 - share) / k) ** 0.5)
        small, large = np.minimum(sizes[lo:hi, None], sizes[None, :]), np.maximum(sizes[lo:hi, None], sizes[None, :])
        yield lo, hi, (estimate >= lowest) & (100 * small >= percent * large)


_GROUP = ["level", "key", "grade", "x", "y"]
#: The value of y in a group of one pivot (block 0) and nodes to compare with it (block 1).
_STAR = -1


def _grouped(batches: Iterator[pa.RecordBatch], work: Callable[[pa.RecordBatch], list]) -> Iterator[list]:
    """Calls ``work`` with the rows of each group; the partition is sorted by the group columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [table.column(c).to_numpy() for c in _GROUP]
        change = np.zeros(table.num_rows - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = np.concatenate(([0], np.flatnonzero(change) + 1))
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a > 1:
                yield work(table.slice(a, b - a))
        rest = table.slice(int(starts[-1]))
        held = rest.to_batches()
    if held:
        last = pa.Table.from_batches(held).combine_chunks()
        if last.num_rows > 1:
            yield work(last)


def _apart(rows: pa.Table) -> np.ndarray | None:
    """The block of each row where only pairs of different blocks count."""
    return rows.column("block").to_numpy() if rows.column("x")[0].as_py() != rows.column("y")[0].as_py() else None


def _filterer(percent: int) -> Callable:
    def work(rows: pa.Table) -> pa.Table | None:
        sketches = [np.frombuffer(s, dtype="<u4") for s in rows.column("sketch").to_pylist()]
        sizes = rows.column("n_shingles").to_numpy()
        level, grade, y = (rows.column(c)[0].as_py() for c in ("level", "grade", "y"))
        block, labels, grades = _apart(rows), rows.column("label").to_numpy(), rows.column("own_grade").to_numpy()
        below = None
        if level == 1 and y != _STAR:
            key = np.uint32(np.uint64(rows.column("key")[0].as_py() & 0xFFFFFFFFFFFFFFFF) >> _U(32))
            heads = [s[:KEYS] for s in sketches]
            below = _Overlaps([h[h < key] for h in heads]).tiles()
        taken = np.zeros(rows.num_rows, dtype=bool)
        for lo, hi, good in candidates(sketches, sizes, percent, SKETCH):
            if block is not None:
                good &= block[lo:hi, None] != block[None, :]
            else:
                good[np.arange(hi - lo), np.arange(lo, hi)] = False
            if y != _STAR:
                good &= labels[lo:hi, None] != labels[None, :]
                good &= np.maximum(grades[lo:hi, None], grades[None, :]) == grade
            if below is not None:
                good &= next(below)[2] == 0
            taken[lo:hi] |= good.any(axis=1)
            taken |= good.any(axis=0)
        return rows.filter(pa.array(taken)) if taken.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_GROUP, "block", "label", "node", "rep", "null_rep"]
        for found in _grouped(batches, work):
            if found is not None:
                yield from found.select(names).to_batches()

    return run


def _verifier(percent: int) -> Callable:
    def work(rows: pa.Table) -> list[tuple[bytes, bytes]]:
        first = {n: i for i, n in reversed(list(enumerate(rows.column("node").to_pylist())))}
        rows = rows.take(pa.array(sorted(first.values())))
        nodes = rows.column("node").to_pylist()
        if len(nodes) < 2:
            return []
        sets = [np.frombuffer(s, dtype="<u8") for s in rows.column("set").to_pylist()]
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        block = _apart(rows)
        _, root = np.unique(rows.column("label").to_numpy(), return_inverse=True)
        links = []
        for lo, hi, common in _Overlaps(sets).tiles():
            linked = 100.0 * common >= percent * (sizes[lo:hi, None] + sizes[None, :] - common)
            if block is not None:
                linked &= block[lo:hi, None] != block[None, :]
            for i in range(lo, hi):
                others = np.flatnonzero(linked[i - lo])
                others = others[root[others] != root[i]]
                if not len(others):
                    continue
                fresh, one = np.unique(root[others], return_index=True)
                links += [(nodes[i], nodes[j]) for j in others[one].tolist()]
                root[np.isin(root, fresh)] = root[i]
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for links in _grouped(batches, work):
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], names=["u", "v"])

    return run


class _Compared:
    """Confirms the links among the nodes of groups."""

    def __init__(self, source: DataFrame, graded: DataFrame, width: int, percent: int) -> None:
        self.source, self.graded, self.width, self.percent = source, graded, width, percent
        self.partitions = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def _sets(self, met: DataFrame) -> DataFrame:
        """s_node, set of the nodes; one row of the documents stands for each, for nodes without a doc_id by its text."""
        setter, schema = _setter(self.width), "s_node binary, set binary"
        named = with_ids(self.source, met.where("rep IS NOT NULL").select("rep")).mapInArrow(setter, schema)
        least = met.where("rep IS NULL").select("null_rep").distinct()
        nameless = self.source.where("doc_id IS NULL").withColumn("text_hash", F.xxhash64("text"))
        nameless = nameless.join(least, F.col("text_hash") == F.col("null_rep"), "left_semi").dropDuplicates(["text_hash"])
        return named.unionByName(nameless.select("doc_id", "text").mapInArrow(setter, schema))

    def links(self, groups: DataFrame) -> DataFrame:
        """u, v of a forest of each group's links. ``groups``: the group columns, block, label, p_node."""
        sketched = self.graded.join(groups, F.col("node") == F.col("p_node")).drop("p_node")
        sketched = sketched.repartition(self.partitions, *_GROUP).sortWithinPartitions(*_GROUP)
        fields = "level int, key long, grade int, x int, y int, block int, label long, node binary, rep long, null_rep long"
        met = durable(sketched.select(*_GROUP, "block", "label", "own_grade", "node", "rep", "null_rep", "n_shingles", "sketch").mapInArrow(_filterer(self.percent), fields))
        armed = met.join(self._sets(met), F.col("node") == F.col("s_node")).select(*_GROUP, "block", "label", "node", "set")
        return armed.repartition(self.partitions, *_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_verifier(self.percent), "u binary, v binary")


_PART = ["level", "key", "grade"]


def _limit(grade: str, percent: int) -> str:
    """The nodes of a part, or block, of a grade: ``LONG``, or fewer where sets of that grade are large."""
    return f"CAST(greatest(16, least({LONG}, {SET_BYTES} / (8 * pow({101 / percent}, {grade} + 1)))) AS INT)"


def _parts(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The members of short and of long parts, without parts of one node or of no node of their own grade."""
    sizes = members.groupBy(*[F.col(c).alias(f"l_{c}") for c in _PART]).agg(F.count("*").alias("members"), F.sum(F.expr("CAST(grade = own_grade AS INT)")).alias("owners"))
    sizes = durable(sizes.where("members > 1 AND owners > 0").drop("owners").withColumn("is_long", F.expr(f"members > {_limit('l_grade', percent)}")))
    same = (F.col("level") == F.col("l_level")) & (F.col("key") == F.col("l_key")) & (F.col("grade") == F.col("l_grade"))
    listed = members.join(sizes, same).select(*_PART, "node", "is_long")
    short, long = listed.where("NOT is_long"), sizes.where("is_long")
    return short.drop("is_long"), None if long.isEmpty() else durable(listed.where("is_long").drop("is_long"))


def _inside(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The members of parts of several classes, with their class, the part's largest one, and both their sizes."""
    named = members.withColumn("label", F.col("node"))
    if labels is not None:
        named = members.join(labels.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left").select(*_PART, "node", F.coalesce("label", "node").alias("label"))
    named = durable(named)
    sizes = named.groupBy(*_PART, "label").agg(F.count("*").alias("n"))
    main = F.max_by(F.struct("label", "n"), F.struct("n", "label")).alias("m")
    parts = sizes.groupBy(*[F.col(c).alias(f"k_{c}") for c in _PART]).agg(main, F.sum("n").alias("total"), F.count("*").alias("classes"))
    parts = parts.where("classes > 1").selectExpr("k_level", "k_key", "k_grade", "m.label AS main", "m.n AS n_main", "total - m.n AS n_rest")
    same = (F.col("level") == F.col("k_level")) & (F.col("key") == F.col("k_key")) & (F.col("grade") == F.col("k_grade"))
    return durable(named.join(parts, same).drop("k_level", "k_key", "k_grade"))


def _stars(members: DataFrame, compared: _Compared) -> DataFrame:
    """The groups that compare the members of long parts with their parts' pivots."""
    chosen = [F.min_by("node", F.xxhash64("node", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = members.groupBy(*[F.col(c).alias(f"q_{c}") for c in _PART]).agg(*chosen)
    pivots = durable(pivots.withColumn("pivots", F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))))
    same = (F.col("level") == F.col("q_level")) & (F.col("key") == F.col("q_key")) & (F.col("grade") == F.col("q_grade"))
    pairs = members.join(pivots, same).select("grade", "node", F.explode("pivots").alias("pivot"))
    pairs = durable(pairs.where("node <> pivot").groupBy("pivot", "node").agg(F.max("grade").alias("grade")))
    counts = durable(pairs.groupBy(F.col("pivot").alias("n_pivot")).agg(F.expr(f"ceil(count(*) / min({_limit('grade', compared.percent)}))").alias("n")))
    dealt = pairs.join(counts, F.col("pivot") == F.col("n_pivot")).selectExpr("pivot", "node", "CAST(pmod(xxhash64(node), n) AS INT) AS x")
    others = dealt.selectExpr("0 AS level", "xxhash64(pivot) AS key", "0 AS grade", "x", f"{_STAR} AS y", "1 AS block", "xxhash64(node) AS label", "node AS p_node")
    every = counts.selectExpr("n_pivot AS pivot", "explode(sequence(0, CAST(n AS INT) - 1)) AS x")
    heads = every.selectExpr("0 AS level", "xxhash64(pivot) AS key", "0 AS grade", "x", f"{_STAR} AS y", "0 AS block", "xxhash64(pivot) AS label", "pivot AS p_node")
    return others.unionByName(heads)


def _split(sparse: DataFrame, values: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The members of the lists by one further value, and the parts (s_ columns) for which these do not pay.

    ``values``: v_node, own_grade, keys. A list is known by its values, in whatever order they were taken.
    """
    rows = sparse.join(values, F.col("node") == F.col("v_node")).select(*_PART, "node", "own_grade", "held", F.explode("keys").alias("w"))
    rows = rows.where("NOT array_contains(held, w)").withColumn("now", F.expr("array_sort(concat(held, array(w)))"))
    rows = durable(rows.select(*[F.col(c).alias(f"s_{c}") for c in _PART], F.expr("level + 1").alias("level"), F.xxhash64("now").alias("key"), "grade", "node", "own_grade", F.col("now").alias("held")))
    of_part = [f"s_{c}" for c in _PART]
    cost = rows.groupBy(*of_part, "key").agg(F.count("*").cast("double").alias("n")).groupBy(*of_part).agg(F.sum(F.expr("IF(n > 1, n * n, 0D)")).alias("split"))
    whole = sparse.groupBy(*[F.col(c).alias(f"w_{c}") for c in _PART]).agg(F.pow(F.count("*").cast("double"), F.lit(2)).alias("whole"))
    same = F.lit(True)
    for c in _PART:
        same &= F.col(f"s_{c}") == F.col(f"w_{c}")
    dear = durable(whole.join(cost, same, "left").where("split > 0.25D * whole").select(*[F.col(f"w_{c}") for c in _PART]))
    return rows.join(dear, same, "left_anti").drop(*of_part), dear


def _blocks(inside: DataFrame, percent: int) -> DataFrame:
    """The groups that compare every node outside its part's largest class with all nodes of the part."""
    size = _limit("grade", percent)
    blocks = inside.selectExpr(*_PART, "node", "label", "label <> main AS rest", f"CAST(ceil(n_rest / {size}) AS INT) AS r", f"CAST(ceil(n_main / {size}) AS INT) AS m")
    blocks = blocks.withColumn("block", F.expr("CAST(IF(rest, pmod(xxhash64(node), r), r + pmod(xxhash64(node), m)) AS INT)"))
    blocks = blocks.withColumn("other", F.explode(F.expr("sequence(0, IF(rest, r + m, r) - 1)")))
    return blocks.selectExpr(*_PART, "least(block, other) AS x", "greatest(block, other) AS y", "block", "xxhash64(label) AS label", "node AS p_node")


def _classified(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node (null without words), label (of the class), component_id, kept of every row."""
    source = docs.select("doc_id", "text")
    sketched = durable(source.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(_sketcher(width), "doc_id long, null_rep long, n_shingles long, node binary, keys array<long>, sketch binary"))

    named = sketched.where("node IS NOT NULL")
    reps = durable(named.groupBy(F.col("node").alias("r_node")).agg(F.min("doc_id").alias("rep"), F.min(F.when(F.col("doc_id").isNull(), F.col("null_rep"))).alias("r_null")))
    one = F.expr("node = r_node AND IF(rep IS NULL, null_rep = r_null, doc_id = rep)")
    nodes = named.join(reps, one).select("node", "rep", "null_rep", "n_shingles", "keys", "sketch")
    # sizes of linked documents differ by at most 100 / percent: a document meets those of its own size grade and the next
    graded = durable(nodes.withColumn("own_grade", F.expr(f"CAST(floor(ln(n_shingles) / ln({101 / percent})) AS INT)")))
    postings = graded.select("node", "own_grade", F.explode(F.slice("keys", 1, KEYS)).alias("key"))
    members = postings.select(F.lit(1).alias("level"), "key", F.explode(F.array("own_grade", F.col("own_grade") + 1)).alias("grade"), "node", "own_grade")
    compared = _Compared(source, graded.drop("keys"), width, percent)

    groups, long = _parts(members, percent)
    plain = lambda rows: rows.selectExpr(*_PART, "0 AS x", "0 AS y", "0 AS block", "xxhash64(node) AS label", "node AS p_node")
    groups, held, links = plain(groups), None, None
    values = graded.select(F.col("node").alias("v_node"), "own_grade", "keys")
    while long is not None:
        # the values that name the lists of this level
        named_by = long.select(*_PART).distinct().withColumn("held", F.expr("array(key)")) if held is None else held
        found = durable(compared.links(_stars(_inside(long, connected_components(links) if links is not None else None).select(*_PART, "node"), compared)))
        links = found if links is None else durable(links.unionByName(found))
        inside = _inside(long, connected_components(links))
        dense = (F.col("n_main") >= COPIES * (F.col("n_main") + F.col("n_rest"))) | (F.col("level") >= DEPTH)
        sparse, blocks = inside.where(~dense), inside.where(dense)
        long = None
        if not sparse.isEmpty():
            same = [F.col(c) == F.col(f"h_{c}") for c in _PART]
            told = sparse.select(*_PART, "node").join(named_by.toDF("h_level", "h_key", "h_grade", "held"), same).select(*_PART, "node", "held")
            further, dear = _split(told, values, percent)
            as_whole = [F.col(c) == F.col(f"w_{c}") for c in _PART]
            blocks = blocks.unionByName(sparse.join(dear, as_whole, "left_semi"))
            # a list that several parts give is one list
            further = durable(further.dropDuplicates([*_PART, "node"]))
            short, long = _parts(further.select(*_PART, "node", "own_grade"), percent)
            held = further.select(*_PART, "held").dropDuplicates(_PART)
            groups = groups.unionByName(plain(short))
        groups = groups.unionByName(_blocks(blocks, percent))
    last = compared.links(groups)
    links = last if links is None else links.unionByName(last)
    classes = connected_components(links)

    ids = reps.join(classes.withColumnRenamed("node", "c_node"), F.col("r_node") == F.col("c_node"), "left").selectExpr("r_node", "rep", "coalesce(label, r_node) AS label")
    least = durable(ids.groupBy(F.col("label").alias("l_label")).agg(F.min("rep").alias("component_id")))
    by_node = durable(ids.join(least, F.col("label") == F.col("l_label")).select(F.col("r_node").alias("i_node"), "label", "component_id"))
    out = sketched.select("doc_id", "n_shingles", "node").join(by_node, F.col("node") == F.col("i_node"), "left")
    out = out.selectExpr("doc_id", "n_shingles", "node", "label", "IF(node IS NULL, doc_id, component_id) AS component_id")
    return out.withColumn("kept", F.expr("doc_id <=> component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are what ASCII white space separates, with A-Z lower-cased; a document's set holds its distinct
    ``width``-word shingles, or its whole word sequence if it is shorter. Documents are linked if
    100 * |intersection| >= percent * |union|; component_id is the least doc_id reachable and
    kept = (doc_id = component_id). Texts without words (null and empty too) have an empty set and are
    linked with nothing. Rows that repeat a doc_id are all reported. A row with a null doc_id is compared like
    others but never names its class: a class of such rows alone has the component_id null, and all of them
    are kept. Very long texts are compared whole. An empty table gives no rows; extra columns are ignored.
    """
    return _classified(docs, width, percent).drop("node", "label")


def _teller(width: int, at: int, name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [_node(hashes) if len(hashes) else None for hashes in _texts(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], names=[*batch.schema.names, name])

    return run


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class of near-duplicates, with all its columns: the one with the least doc_id.

    Where no doc_id repeats (nulls count as one; a light aggregation tells) the dropped ids alone are joined.
    Otherwise rows are told apart by doc_id and word sequence; of several rows that could stay for a class,
    one does, and rows whose class has no doc_id stay once for each word sequence.
    """
    found = durable(_classified(docs, width, percent))
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return without_ids(docs, found.where("NOT kept").select("doc_id"))
    node, kept_id, kept_node = (free_name(docs, n) for n in ("node", "kept_id", "kept_node"))
    told = docs.mapInArrow(_teller(width, docs.columns.index("text"), node), T.StructType([*docs.schema.fields, T.StructField(node, T.BinaryType())]))
    stay = found.where("kept AND node IS NOT NULL")
    named = stay.where("component_id IS NOT NULL").groupBy("component_id").agg(F.min(F.struct("doc_id", "node")).alias("m")).select("m.doc_id", "m.node")
    nameless = stay.where("component_id IS NULL").groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("m")).select("m.doc_id", "m.node")
    stay = named.unionByName(nameless).toDF(kept_id, kept_node)
    chosen = told.join(stay, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(node) == F.col(kept_node)), "left_semi").dropDuplicates(["doc_id", node])
    return chosen.unionByName(told.where(F.col(node).isNull())).select(*docs.columns)
