"""The greedy fold with reset: a group closes at the row where its running size reaches the limit.

Where one group ends decides where the next begins, yet the fold of one long log needs no single task. The
rows are parted by order ranges. What a partition does to the size left open before it is a short step
function: only rows in its first ``limit`` bytes can close the group it takes over, and from each of those
the rest of the partition follows. A first pass finds these functions, the driver chains them (one row a
partition), and a second pass folds every partition from its own start. Logs kept apart by ``by`` columns are
folded stream by stream instead, many in parallel, in constant memory.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltlog.operators.ordered import dealt, ranged


def fold(sizes: np.ndarray, limit: int, held: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row whether it closes its group, and the group's size before it; then the size left open."""
    ends = np.cumsum(sizes, dtype=np.int64)
    closes, before = np.zeros(len(sizes), dtype=bool), np.empty(len(sizes), dtype=np.int64)
    start, base = 0, -held
    while start < len(sizes):
        at = int(np.searchsorted(ends, base + limit))  # the first row at which the size reaches the limit
        at = max(at, start)
        stop = min(at + 1, len(sizes))
        before[start:stop] = ends[start:stop] - sizes[start:stop] - base
        if at < len(sizes):
            closes[at] = True
            base = int(ends[at])
        start = stop
    left = int(ends[-1]) - base if len(sizes) else held
    return closes, before, left


def _folder(by: Sequence[str], size: str, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, held, group, place = None, 0, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            streams = list(zip(*[batch.column(c).to_pylist() for c in by]))
            sizes = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = [0, *[i for i in range(1, n) if streams[i] != streams[i - 1]], n]
            parts: list[list[np.ndarray]] = [[], [], [], []]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if streams[a] != stream:
                    stream, held, group, place = streams[a], 0, 0, 0
                closes, before, held = fold(sizes[a:b], limit, held)
                groups = group + np.concatenate(([0], np.cumsum(closes)[:-1]))
                for column, values in zip(parts, (groups, before, closes, place + np.arange(b - a))):
                    column.append(values)
                group += int(closes.sum())
                place += b - a
            columns = [pa.array(np.concatenate(p)) for p in parts]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "grp", "grp_before", "closes", "pos"])

    return run


def steps(sizes: np.ndarray, limit: int) -> tuple[list[int], list[int], list[int]]:
    """The step function of a partition: from a size a left open before it, the first k with reached[k] >= limit - a
    is the row that closes the group; then left[k] is open at the end and closed[k] more groups have closed."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    firsts = np.flatnonzero((sizes > 0) & (ends - sizes < limit))
    known: dict[int, tuple[int, int]] = {}
    for first in firsts.tolist():
        start, path = first + 1, []
        while start not in known:
            base = int(ends[start - 1])
            at = int(np.searchsorted(ends, base + limit))
            if at >= len(ends):
                known[start] = total - base, 0
            else:
                path.append(start)
                start = at + 1
        left, closed = known[start]
        for passed in reversed(path):
            closed += 1
            known[passed] = left, closed
    ends_of = [known[first + 1] for first in firsts.tolist()]
    return ends[firsts].tolist(), [e[0] for e in ends_of], [e[1] for e in ends_of]


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(part, rows) of each stretch of rows of one part."""
    for batch in batches:
        if batch.num_rows:
            parts = batch.column("part_").to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield int(parts[a]), batch.slice(a, b - a)


def _summary(size: str, limit: int) -> Callable:
    def row(part: int, sizes: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(sizes)
        columns = [[part], [len(every)], [int(every.sum())], *[[x] for x in steps(every, limit)]]
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "n", "total", "reached", "left", "closed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sizes = None, []
        for part, rows in _by_part(batches):
            if sizes and part != last:
                yield row(last, sizes)
                sizes = []
            last = part
            sizes.append(rows.column(size).to_numpy(zero_copy_only=False).astype(np.int64))
        if sizes:
            yield row(last, sizes)

    return run


def _starts(summaries: list, limit: int) -> dict[int, tuple[int, int, int]]:
    """part -> (size left open, groups closed, rows) before it."""
    starts, held, group, place = {}, 0, 0, 0
    for s in sorted(summaries, key=lambda s: s.part):
        starts[s.part] = held, group, place
        k = bisect_left(s.reached, limit - held)
        if k == len(s.reached):
            held += s.total
        else:
            held, group = s.left[k], group + 1 + s.closed[k]
        place += s.n
    return starts


def _restarter(size: str, limit: int, starts: dict[int, tuple[int, int, int]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for part, batch in _by_part(batches):
            n = batch.num_rows
            held, group, place = state if part == last else starts[part]
            last = part
            closes, before, held = fold(batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64), limit, held)
            groups = group + np.concatenate(([0], np.cumsum(closes)[:-1]))
            state = held, group + int(closes.sum()), place + n
            added = [pa.array(groups), pa.array(before), pa.array(closes), pa.array(place + np.arange(n))]
            kept = [c for c, name in zip(batch.columns, batch.schema.names) if name != "part_"]
            yield pa.RecordBatch.from_arrays([*kept, *added], names=[*[x for x in batch.schema.names if x != "part_"], "grp", "grp_before", "closes", "pos"])

    return run


def fold_with_reset(df: DataFrame, order: Sequence[str], size: str, limit: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``grp`` (from 0), ``grp_before`` (its size before the row), ``closes`` and ``pos`` (from 0)."""
    schema = T.StructType([*df.schema.fields, T.StructField("grp", T.LongType()), T.StructField("grp_before", T.LongType()), T.StructField("closes", T.BooleanType()), T.StructField("pos", T.LongType())])
    if by:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(partitions, *by).sortWithinPartitions(*by, *order).mapInArrow(_folder(by, size, limit), schema)
    rows = dealt(ranged(df, [F.col(c) for c in order]), order)
    found = rows.select("part_", size).mapInArrow(_summary(size, limit), "part int, n long, total long, reached array<long>, left array<long>, closed array<long>").collect()
    return rows.mapInArrow(_restarter(size, limit, _starts(found, limit)), schema)
