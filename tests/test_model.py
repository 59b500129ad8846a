"""Random op logs against a dict; flushing and compacting change nothing that is read."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from siltlog.config import KEY_TYPES, TableConfig
from siltlog.operators import bloom, memtable, merge, oplog, ordered, runs
from siltlog.operators.fold import fold

EDGES = {"int32": [-(2**31), -1, 0, 7, 2**31 - 1], "int64": [-(2**63), -1, 0, 7, 2**63 - 1], "string": ["", "a", "ñ", "Z", "zz"], "float64": [-1.5, 0.0, 2.5, float("inf"), -float("inf")]}


def random_log(spark, kind: str, n: int, seed: int):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        key = rng.choice(EDGES[kind])
        rows.append((seq, key, "del", None) if rng.random() < 0.3 else (seq, key, "put", "v" * rng.randint(0, 9)))
    return rows, spark.createDataFrame(rows, f"seq long, key {KEY_TYPES[kind].spark.simpleString()}, op string, value string")


def model(rows):
    state = {}
    for _, key, op, value in rows:
        state[key] = value if op == "put" else None
    return state


@pytest.mark.parametrize("kind", list(EDGES))
def test_state_survives_flush_and_compaction(spark, kind):
    rows, log = random_log(spark, kind, 120, seed=len(kind))
    want = {k: v for k, v in model(rows).items() if v is not None}
    assert {r.key: r.value for r in oplog.live_state(log).collect()} == want
    assert {r.key for r in oplog.tombstones(log).collect()} == {k for k, v in model(rows).items() if v is None}

    flushed = runs.flush(memtable.with_generations(log, KEY_TYPES[kind], 300)).cache()
    generations = sorted(r.gen for r in flushed.select("gen").distinct().collect())
    assert len(generations) > 3
    for compacted in (flushed, merge.compact(flushed, generations[1:3]), merge.compact(flushed, generations), merge.compact(flushed, generations, purge=True)):
        tiers = compacted.withColumn("op", F.when(F.col("is_tombstone"), "del").otherwise("put"))
        read = oplog.merge_on_read(tiers).where(~F.col("deleted"))
        assert {r.key: r.value for r in read.collect()} == want
    with pytest.raises(ValueError):
        merge.compact(flushed, generations[1:], purge=True)


def test_tri_state_and_history(spark):
    log = spark.createDataFrame([(0, 1, "put", "a"), (1, 1, "del", None), (2, 2, "put", ""), (3, 3, "del", None), (4, 3, "del", None)], "seq long, key long, op string, value string")
    probes = spark.createDataFrame([(1,), (2,), (3,), (9,)], "key long")
    assert {r.key: (r.status, r.value) for r in oplog.get_many(log, probes).collect()} == {1: ("deleted", None), 2: ("found", ""), 3: ("deleted", None), 9: ("absent", None)}
    assert {r.seq: r.existed for r in oplog.deletes_with_history(log).collect()} == {1: True, 3: False, 4: True}
    assert {r.key: (r.in_memory, r.in_run) for r in oplog.empty_values(log).collect()}[2] == ("found", "deleted")
    assert oplog.overwrites(log.limit(0)).first().n_puts == 0


def test_fullness_at_the_exact_limit(spark):
    log = spark.createDataFrame([(i, i, "put", "12345678") for i in range(10)], "seq long, key int, op string, value string")
    total = memtable.totals(log, KEY_TYPES["int32"]).first()
    assert (total.entries, total.bytes) == (10, 420)
    assert [(r.gen, r.seq, r.mem_bytes) for r in memtable.flush_points(log, KEY_TYPES["int32"], 420).collect()] == [(0, 9, 420)]
    assert memtable.flush_points(log, KEY_TYPES["int32"], 421).count() == 0


def test_fold_matches_a_loop():
    import numpy as np

    rng = random.Random(5)
    for _ in range(300):
        sizes = [rng.choice([0, 0, 1, 3, 9, 40]) for _ in range(rng.randint(0, 30))]
        limit, held = rng.randint(1, 30), 0
        held = rng.randint(0, limit - 1)
        closes, before, left = fold(np.array(sizes, dtype=np.int64), limit, held)
        running, want = held, []
        for s in sizes:
            want.append((running + s >= limit, running))
            running = 0 if running + s >= limit else running + s
        assert list(zip(closes.tolist(), before.tolist())) == want and left == running


@pytest.mark.parametrize("limit", [1, 7, 40, 1000])
def test_fold_over_partitions_and_streams(spark, limit):
    from siltlog.operators.fold import fold_with_reset

    rng = random.Random(limit)
    rows = [(stream, i, rng.choice([0, 0, 1, 3, 9, 40])) for stream in range(3) for i in range(rng.choice([0, 1, 50, 200]))]
    want, held, group, place = {}, {}, {}, {}
    for stream, i, s in rows:
        before = held.get(stream, 0)
        want[stream, i] = (group.get(stream, 0), before, before + s >= limit, place.get(stream, 0))
        held[stream] = 0 if before + s >= limit else before + s
        group[stream] = group.get(stream, 0) + (before + s >= limit)
        place[stream] = place.get(stream, 0) + 1
    log = spark.createDataFrame(rows + [(9, 0, 1)], "stream int, i int, size long").repartition(5)
    for found in (fold_with_reset(log, ["i"], "size", limit, by=["stream"]), *[fold_with_reset(log.where(f"stream = {k}"), ["i"], "size", limit).withColumn("stream", F.lit(k)) for k in range(3)]):
        for r in found.where("stream < 9").collect():
            assert (r.grp, r.grp_before, r.closes, r.pos) == want[r.stream, r.i]


def test_blocks_of_a_multi_block_run(spark):
    rows = spark.createDataFrame([(i, "abcdefghij") for i in range(5120)], "key int, value string")
    placed = runs.blocks(rows, KEY_TYPES["int32"], 5120).cache()
    sizes = sorted(r["count"] for r in placed.groupBy("block").count().collect())
    assert sizes == [227] + [233] * 21
    assert runs.sparse_index(placed, 128).count() == 61


def test_blocks_of_a_compaction(spark):
    halves = [spark.createDataFrame([(2 * i + r, "abcdefghij") for i in range(204)], "key int, value string") for r in (0, 1)]
    for rows, blocks, entries in ((halves[0], 5, 6), (merge.merge_keep_all(*halves, ["key", "value"]), 9, 12)):
        placed = runs.blocks(rows.select("key", "value"), KEY_TYPES["int32"], 1024).cache()
        assert placed.select("block").distinct().count() == blocks and runs.sparse_index(placed, 128).count() == entries


@pytest.mark.parametrize("backward", [True, False])
def test_as_of(spark, backward):
    rng = random.Random(2)
    keys = [rng.randint(0, 60) for _ in range(25)]
    probes = [(i, rng.choice([None, *range(-5, 70)])) for i in range(200)]
    found = ordered.as_of(spark.createDataFrame(probes, "id int, p int"), "p", spark.createDataFrame([(k,) for k in keys], "k int"), "k", backward)
    for r in found.collect():
        fitting = [k for k in keys if r.p is not None and (k <= r.p if backward else k >= r.p)]
        assert r.found_key == ((max if backward else min)(fitting) if fitting else None)


def test_neighbours_and_nan_order(spark):
    values = [3.0, float("nan"), -1.0, float("inf"), -0.5]
    rows = ordered.scan(spark.createDataFrame([(v,) for v in values], "key double"), "key", KEY_TYPES["float64"]).orderBy("pos").collect()
    assert [r.key for r in rows][1:] == [-1.0, -0.5, 3.0, float("inf")] and rows[0].key != rows[0].key
    beside = ordered.neighbours(spark.createDataFrame([(c,) for c in "bdac"], "key string"), "key", KEY_TYPES["string"])
    assert {r.key: (r.prev_key, r.next_key) for r in beside.collect()} == {"a": (None, "b"), "b": ("a", "c"), "c": ("b", "d"), "d": ("c", None)}


def test_multiset(spark):
    ops = "aarrraar"
    log = spark.createDataFrame([(i, 1, "put" if o == "a" else "del", "") for i, o in enumerate(ops)], "seq long, key long, op string, value string")
    assert oplog.multiset_counts(log).first().copies == 1


def test_bloom_has_no_false_negative(spark):
    bits, functions = bloom.parameters(500, 0.1)
    members = spark.range(500).select((F.col("id") * 3).alias("key"))
    built = bloom.build(members, F.col("key"), bits, functions)
    tested = bloom.test(spark.range(3000).select(F.col("id").alias("key")), F.col("key"), built, bits, functions).collect()
    assert all(r.maybe for r in tested if r.key % 3 == 0 and r.key < 1500)
    others = [r.maybe for r in tested if not (r.key % 3 == 0 and r.key < 1500)]
    assert sum(others) / len(others) < 0.3


def test_config():
    config = TableConfig("t", key_type="", block_size=0)
    assert (config.key_type, config.block_size, config.max_summary_bytes) == ("int64", 16384, 5242880)
    assert TableConfig.from_json(config.to_json()) == config == TableConfig.from_toml(config.to_toml())
    for bad in ({"name": ""}, {"name": "t", "key_type": "decimal"}, {"name": "t", "memtable": "skiplist"}):
        with pytest.raises(ValueError):
            TableConfig(**bad)


def test_random_letters(spark):
    from siltlog.functions.values import random_letters, type_name

    rows = spark.range(50).select(random_letters(10, F.col("id"), 7).alias("v"), type_name(F.col("id")).alias("t")).collect()
    assert all(len(r.v) == 10 and r.v.isalpha() and r.v.isascii() and r.t == "bigint" for r in rows) and len({r.v for r in rows}) == 50


@pytest.mark.parametrize("nested", [0, 64])
def test_ranges_by_either_search(spark, monkeypatch, nested):
    monkeypatch.setattr(ordered, "NESTED", nested)
    rows = spark.range(3000).selectExpr("id", "IF(id % 7 = 0, NULL, id * 37 % 1000) AS k", "IF(id % 5 = 0, DOUBLE('NaN'), id / 3.0D) AS x")
    order = [F.col("k"), F.col("x"), F.col("id")]
    assert ordered.ranged(rows, order).select("part_").distinct().count() == ordered.PARTS_EACH * 4
    got = [r.id for r in ordered.with_position(rows, order).orderBy("pos").collect()]
    assert got == [r.id for r in rows.orderBy(*order).collect()]
    assert ordered.with_position(rows.limit(0), order).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_many_ranges_are_searched_in_generated_code(spark, hot):
    rows = spark.range(6000).selectExpr(f"IF({hot} AND id % 3 = 0, 7, IF(id % 500 = 0, NULL, id * 37 % 6007)) AS k", "IF(id % 5 = 0, DOUBLE('NaN'), id / 3.0D) AS x", "id")
    order = [F.col("k"), F.col("x"), F.col("id")]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        ranged = ordered.ranged(rows, order).select("part_")
        plan = ranged._jdf.queryExecution().executedPlan().toString()
        sizes = [r["count"] for r in ranged.groupBy("part_").count().collect()]
        got = [(r.pos, r.id) for r in ordered.with_position(rows, order).orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert "lambda" not in plan and not re.search(r"\n *[+:]- Project", plan), plan
    assert ("struct(" in plan) == hot  # the key alone is compared unless one value fills several ranges
    assert len(sizes) > ordered.NESTED and max(sizes) < 6000 * 3 / len(sizes)
    assert got == [(k, r.id) for k, r in enumerate(rows.orderBy(*order).collect())]
