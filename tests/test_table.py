from __future__ import annotations

import gzip
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from siltlog.config import KEY_TYPES, TableConfig
from siltlog.plans.table import Node
from siltlog.sources import native, oplog_text
from siltlog.streaming import live_state


def test_node_lifecycle(spark, tmp_path):
    node = Node(spark, str(tmp_path / "node"))
    table = node.create_table(TableConfig("t1", key_type="int32"))
    table.put(spark.createDataFrame([(i, b"v%d" % i) for i in range(10)], "key int, value binary"))
    table.delete_item(5)
    assert table.get_item(4) == ("found", b"v4") and table.get_item(5)[0] == "deleted" and table.get_item(99)[0] == "absent"
    assert table.byte_size() == sum(4 + 2 + 30 for _ in range(10)) and not table.is_full()
    assert table.flush() == 0 and table.flush() is None and table.byte_size() == 0

    table.put_item(4, b"new")
    table.put_item(5, b"back")
    table.update(spark.createDataFrame([(1, b"u"), (77, b"u")], "key int, value binary"))
    asked = spark.createDataFrame([(4,), (6,), (77,)], "key int")
    assert {r.key: (r.status, r.found_in, r.found_run) for r in table.get(asked).collect()} == {4: ("found", 1, -1), 6: ("found", 3, 0), 77: ("absent", 0, None)}
    table.flush()
    assert table.generations() == [0, 1] and table.compact([0, 1], purge=True) == 2 and table.generations() == [2]
    want = {r.key: bytes(r.value) for r in table.items().collect()}
    assert want[4] == b"new" and want[5] == b"back" and want[1] == b"u" and len(want) == 10

    again = Node(spark, str(tmp_path / "node"))
    assert again.list_tables() == ["t1"]
    assert {r.key: bytes(r.value) for r in again.table("t1").items().collect()} == want
    again.register_views()
    assert spark.sql("SELECT count(*) FROM t1").first()[0] == 10
    again.alter_table("t1", block_size=4096)
    assert again.table("t1").describe()["block_size"] == 4096
    with pytest.raises(ValueError):
        again.create_table(TableConfig("t1"))
    with pytest.raises(KeyError):
        again.table("none")
    again.drop_table("t1")
    assert Node(spark, str(tmp_path / "node")).list_tables() == []


def test_auto_flush_and_json(spark, tmp_path):
    table = Node(spark, str(tmp_path)).create_table(TableConfig("j", max_memtable_bytes=150), auto_flush=True)
    value = json.dumps({"price": 17, "sizes": [1, 2, 3], "place": {"row": "B", "shelf": 4}}).encode()
    table.put_item(31, value)
    assert table.get_item(31) == ("found", value) and table.generations() == []
    table.put_item(2, value)
    assert table.generations() == [0] and table.get_item(2) == ("found", value)


def rows_of(spark, pairs):
    return spark.createDataFrame(pairs, "key long, value binary")


def test_tail_outlives_the_session_object(spark, tmp_path):
    table = Node(spark, str(tmp_path)).create_table(TableConfig("t"))
    table.put(rows_of(spark, [(1, b"a"), (2, b"b"), (2, b"c")]))
    table.delete_item(1)
    again = Node(spark, str(tmp_path)).table("t")
    assert again.get_item(1)[0] == "deleted" and again.get_item(2) == ("found", b"c") and again.byte_size() == table.byte_size()
    again.put_item(3, b"d")
    assert again.flush() == 0 and Node(spark, str(tmp_path)).table("t").flush() is None
    assert {r.key: bytes(r.value) for r in Node(spark, str(tmp_path)).table("t").items().collect()} == {2: b"c", 3: b"d"}


def test_compaction_survives_a_lost_writer(spark, tmp_path, monkeypatch):
    from siltlog.sources import run_store

    table = Node(spark, str(tmp_path)).create_table(TableConfig("t"))
    for k in range(4):
        table.put(rows_of(spark, [(k, b"x"), (10, b"%d" % k)]))
        if k == 2:
            table.delete_item(0)
        table.flush()
    want = {r.key: bytes(r.value) for r in table.items().collect()}

    def lost(*_):
        raise OSError("lost")

    def state():
        return {r.key: bytes(r.value) for r in Node(spark, str(tmp_path)).table("t").items().collect()}

    for step in ("publish", "drop_runs"):
        with monkeypatch.context() as m:
            m.setattr(run_store, step, lost)
            with pytest.raises(OSError):
                table.compact([0, 1, 2], purge=True)
        assert state() == want
    table = Node(spark, str(tmp_path)).table("t")
    assert table.generations() == [4, 3] and table.compact([4, 3], keep_inputs=True) == 5 and table.generations() == [5]
    assert state() == want and (tmp_path / "t" / "runs" / "gen=4").exists()
    table.put_item(7, b"y")
    table.flush()
    for wrong, purge in (([99], False), ([], False), ([6], True)):
        with pytest.raises(ValueError):
            table.compact(wrong, purge)
    asked = spark.createDataFrame([(10,), (7,)], "key long")
    assert {r.key: r.found_run for r in table.get(asked).collect()} == {10: 0, 7: 1}


def test_middle_runs_keep_their_place(spark, tmp_path):
    table = Node(spark, str(tmp_path)).create_table(TableConfig("t"))
    for k in range(4):
        table.put(rows_of(spark, [(10, b"%d" % k), (k, b"x")]))
        table.flush()
    assert table.compact([1, 2]) == 4 and table.generations() == [0, 4, 3] and table.get_item(10) == ("found", b"3")
    with pytest.raises(ValueError):
        table.compact([0, 3])


def test_bloom_files_and_mismatch(spark, tmp_path):
    from siltlog.operators import bloom

    keys = spark.range(300).withColumnRenamed("id", "key")
    built = bloom.build(keys, F.col("key"), 3000, 7)
    bloom.write(built, str(tmp_path / "f"), 3000, 7)
    loaded, bits, functions = bloom.load(spark, str(tmp_path / "f"))
    assert (bits, functions) == (3000, 7) and {r.bit for r in loaded.collect()} == {r.bit for r in built.collect()}
    with pytest.raises(bloom.MismatchError):
        bloom.merge(built, loaded, parameters=[(3000, 7), (3001, 7)])


@pytest.mark.parametrize("literal", [0, 1 << 19])
def test_bloom_keeps_repeated_probes(spark, monkeypatch, literal):
    from siltlog.operators import bloom

    monkeypatch.setattr(bloom, "LITERAL_BITS", literal)
    built = bloom.build(spark.range(50), F.col("id"), 700, 5)
    probes = spark.createDataFrame([(1, "a"), (1, "a"), (999, "b"), (None, "c")], "k long, x string")
    got = sorted((str(r.k), r.x, r.maybe) for r in bloom.test(probes, F.col("k"), built, 700, 5).collect())
    assert got == [("1", "a", True), ("1", "a", True), ("999", "b", False), ("None", "c", False)]
    words = spark.createDataFrame([(f"w{k}",) for k in range(200)], "w string").withColumn("k", bloom.whole_number("w", whole=False))
    text = bloom.build(words, F.col("k"), 2000, 5)
    assert bloom.test(words, F.col("k"), text, 2000, 5).where("NOT maybe").isEmpty()
    others = spark.range(2000).select(bloom.whole_number(F.concat(F.lit("v"), "id"), whole=False).alias("k"))
    assert bloom.test(others, F.col("k"), text, 2000, 5).where("maybe").count() < 100


def test_native_files(spark, tmp_path):
    rng = random.Random(4)
    records = [(struct.pack(">i", k), bytes(rng.choice(b"abcdef") for _ in range(10))) for k in range(-100, 2000)]
    records[7] = (records[7][0], b"")
    data, index = native.encode_run(records, 1024, 128)
    (tmp_path / "g0.dat").write_bytes(data)
    (tmp_path / "g0.idx").write_bytes(index)
    (tmp_path / "g0.sum").write_text("gen=0\nsparse_type=idx\n------\nrecords=2100\n------\n")
    rows = native.read_data(spark, str(tmp_path / "g0.dat"), KEY_TYPES["int32"]).cache()
    found = [(r.key, bytes(r.value)) for r in rows.orderBy("block", "inner_offset").collect()]
    assert found == [(struct.unpack(">i", k)[0], v) for k, v in records]
    assert rows.where("is_tombstone").count() == 1 and native.find(rows, -100).count() == 1
    assert native.dump_blocks(rows, 2).count() == 2
    entries = native.read_index(spark, str(tmp_path / "g0.idx"), KEY_TYPES["int32"])
    blocks = rows.select("block").distinct().count()
    assert entries.count() >= blocks and entries.join(rows, ["key", "block_offset", "inner_offset"]).count() == entries.count()
    assert {(r.section, r.name): r.value for r in native.read_summary(spark, str(tmp_path / "g0.sum")).collect()}["statistics", "records"] == "2100"
    assert gzip.decompress(data[4 : 4 + struct.unpack(">I", data[:4])[0]])


def test_native_encoding_of_a_frame(spark):
    rows = spark.range(4000).select(F.concat(F.lit("k"), F.lpad("id", 6, "0")).alias("key"), F.encode(F.repeat(F.lit("v"), (F.col("id") % 50).cast("int")), "UTF-8").alias("value"), (F.col("id") % 10 == 3).alias("is_tombstone"))
    files = native.encode(rows, TableConfig("t", key_type="string", block_size=2048), 3).cache()
    back = native.decode_data(files.select(F.col("part").cast("string").alias("path"), F.col("dat").alias("content")), KEY_TYPES["string"])
    assert back.count() == 4000 and back.where("is_tombstone").count() == 480
    assert back.selectExpr("key", "value").exceptAll(rows.selectExpr("key", "IF(is_tombstone, CAST('' AS BINARY), value) AS value")).isEmpty()
    sums = [dict(line.split("=") for line in r.sum.splitlines() if "=" in line) for r in files.collect()]
    assert sum(int(s["records"]) for s in sums) == 4000 and {s["gen"] for s in sums} == {"3"} and files.count() > 1
    assert all(int(s["flushed_at_mem_size"]) == int(s["total_key_size"]) + int(s["total_data_size"]) + 30 * int(s["records"]) for s in sums)


def test_op_log_text(spark, tmp_path):
    (tmp_path / "ops.txt").write_text("a 5\na -3\nr 5\nnoise\na 9\nr 7\n")
    log = oplog_text.read(spark, str(tmp_path / "ops.txt"))
    from siltlog.operators import oplog

    assert {r.key for r in oplog.live_state(log).collect()} == {-3, 9}
    (tmp_path / "many").mkdir()
    for k in range(6):  # larger files are read first
        (tmp_path / "many" / f"{k}.txt").write_text(f"{'ra'[k % 2]} 1\n" + "noise\n" * (1000 * (k % 3)))
    assert [r.key for r in oplog.live_state(oplog_text.read(spark, str(tmp_path / "many"))).collect()] == [1]


def test_stream(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "seq long, key long, op string, value string"
    for k, rows in enumerate([[(0, 1, "put", "a"), (1, 2, "put", "b")], [(2, 1, "del", None), (3, 2, "put", "c")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        live_state.write_changelog(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert {r.key: r.value for r in live_state.read_state(spark.read.parquet(str(tmp_path / "out"))).collect()} == {2: "c"}
