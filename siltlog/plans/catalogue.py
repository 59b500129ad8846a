"""The registered queries over the driver's tables, and for each an oracle in another formulation.

``events`` is read as an op log: seq is event_id, key is user_id, an 'error' event deletes the key and any
other puts ``props``. Generations cut the log by event_id where a query needs tiers.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.config import KEY_TYPES, TableConfig, compare, compare_floats, key_size
from siltlog.functions import codec
from siltlog.operators import bloom, memtable, merge, oplog, ordered, runs
from siltlog.plans.materialize import durable, shared_folder
from siltlog.plans.table import Node
from siltlog.sources import native, oplog_text, run_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

INT64, FLOAT64, STRING = KEY_TYPES["int64"], KEY_TYPES["float64"], KEY_TYPES["string"]
GEN_ROWS = 2500
#: The default memtable and block sizes and the default index interval.
MEMORY_LIMIT = 65536
BLOCK_SIZE = 16384
INDEX_INTERVAL = 128

_S = "S AS (SELECT event_id AS seq, user_id AS key, CASE WHEN event_type = 'error' THEN 'del' ELSE 'put' END AS op, props AS value FROM events)"
_LATEST = f"{_S}, W AS (SELECT * FROM S QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"


def query(name: str, oracle: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", oplog.DEL).otherwise(oplog.PUT)
    return oplog.as_log(table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id"), op, F.col("props"))


def tiered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).withColumn("gen", F.expr(f"seq DIV {GEN_ROWS}"))


# --- key-value reads and writes ---------------------------------------------------------------------


@query("kv_live_state", f"WITH {_LATEST} SELECT key, value FROM W WHERE op = 'put'")
def kv_live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.live_state(event_log(spark, sf_dir))


@query(
    "kv_state_tristate",
    f"""WITH {_S}, P AS (SELECT DISTINCT user_id AS key FROM events UNION SELECT -1 - c_custkey FROM customer),
    M AS (SELECT key, (SELECT max(seq) FROM S WHERE S.key = P.key) AS seq FROM P)
    SELECT M.key, CASE WHEN M.seq IS NULL THEN 'absent' WHEN S.op = 'del' THEN 'deleted' ELSE 'found' END AS status,
           CASE WHEN S.op = 'put' THEN S.value END AS value FROM M LEFT JOIN S ON S.seq = M.seq""",
)
def kv_state_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    absent = table(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).alias("key"))
    return oplog.get_many(log, log.select("key").distinct().union(absent))


@query("kv_point_get", "SELECT o_orderkey AS key, o_orderstatus || o_orderpriority AS value FROM orders WHERE o_orderkey = 77")
def kv_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", "concat(o_orderstatus, o_orderpriority) AS value")
    return state.where(F.col("key") == 77)


@query("kv_batch_get", "SELECT o_orderkey AS key, o_orderpriority AS value FROM orders WHERE o_orderkey IN (SELECT c_custkey * 7 FROM customer)")
def kv_batch_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", "o_orderpriority AS value")
    return oplog.get_rows(state, table(spark, sf_dir, "customer").selectExpr("c_custkey * 7 AS key"))


@query("kv_tombstones", f"WITH {_LATEST} SELECT key, seq FROM W WHERE op = 'del'")
def kv_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.tombstones(event_log(spark, sf_dir))


@query("kv_delete_existed", f"WITH {_S} SELECT seq, key, EXISTS (SELECT 1 FROM S b WHERE b.key = S.key AND b.seq < S.seq) AS existed FROM S WHERE op = 'del'")
def kv_delete_existed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.deletes_with_history(event_log(spark, sf_dir))


@query(
    "kv_overwrites",
    f"""WITH {_S}, R AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS r FROM S)
    SELECT count(*) FILTER (op = 'put') AS n_puts, count(DISTINCT key) AS n_keys, count(*) FILTER (op = 'put' AND r > 1) AS n_overwrites FROM R""",
)
def kv_overwrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.overwrites(event_log(spark, sf_dir))


@query("kv_tiered_get", f"WITH {_S}, G AS (SELECT *, seq // {GEN_ROWS} AS gen FROM S) SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gen DESC, seq DESC) AS r FROM G) WHERE r = 1 AND op = 'put'")
def kv_tiered_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = oplog.merge_on_read(oplog.reduce_tiers(tiered_events(spark, sf_dir)))
    return read.where(~F.col("deleted")).select("key", "value")


@query(
    "kv_found_in",
    f"""WITH {_LATEST}, N AS (SELECT max(event_id) // {GEN_ROWS} AS last FROM events),
    G AS (SELECT key, op, CASE WHEN seq // {GEN_ROWS} < 3 THEN least(2, last) ELSE seq // {GEN_ROWS} END AS gen, last FROM W, N)
    SELECT key, CASE WHEN gen = last THEN 1 ELSE 3 END AS found_in, CASE WHEN gen = last THEN -1 ELSE greatest(gen - 2, 0) END AS found_run, op = 'del' AS deleted FROM G""",
)
def kv_found_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three generations are compacted into one, so places among the runs are not generations."""
    tiered = tiered_events(spark, sf_dir)
    newest = tiered.agg(F.max("gen")).first()[0]
    merged = tiered.withColumn("gen", F.when(F.col("gen") < 3, min(2, newest or 0)).otherwise(F.col("gen")))
    return oplog.merge_on_read(oplog.reduce_tiers(merged), newest).select("key", "found_in", "found_run", "deleted")


@query(
    "kv_empty_value_tombstone",
    """WITH S AS (SELECT event_id AS seq, user_id AS key, event_type, CASE WHEN event_type = 'view' THEN '' ELSE props END AS value FROM events),
    W AS (SELECT * FROM S QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
    SELECT key, CASE event_type WHEN 'error' THEN 'deleted' ELSE 'found' END AS in_memory, CASE WHEN event_type = 'error' OR value = '' THEN 'deleted' ELSE 'found' END AS in_run FROM W""",
)
def kv_empty_value_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", oplog.DEL).otherwise(oplog.PUT)
    value = F.when(F.col("event_type") == "view", "").otherwise(F.col("props"))
    return oplog.empty_values(oplog.as_log(table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id"), op, value))


@query("multiset_counts", f"WITH {_S}, R AS (SELECT key, seq, sum(CASE op WHEN 'put' THEN 1 ELSE -1 END) OVER (PARTITION BY key ORDER BY seq) AS s FROM S) SELECT key, CAST(arg_max(s, seq) - least(0, min(s)) AS BIGINT) AS copies FROM R GROUP BY key")
def multiset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.multiset_counts(event_log(spark, sf_dir))


@query("bulk_put", "SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE o_orderpriority END AS value FROM orders UNION ALL SELECT -1 - c_custkey, 'new' FROM customer")
def bulk_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    state = orders.selectExpr("o_orderkey AS key", "o_orderpriority AS value")
    rows = orders.where("o_orderstatus = 'F'").selectExpr("o_orderkey", "'new' AS value").union(table(spark, sf_dir, "customer").selectExpr("-1 - c_custkey", "'new'")).toDF("key", "value")
    return oplog.put_rows(state, rows)


@query("bulk_update", "SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE o_orderpriority END AS value FROM orders")
def bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    state = orders.selectExpr("o_orderkey AS key", "o_orderpriority AS value")
    rows = orders.where("o_orderstatus = 'F'").selectExpr("o_orderkey", "'new' AS value").union(table(spark, sf_dir, "customer").selectExpr("-1 - c_custkey", "'new'")).toDF("key", "value")
    return oplog.update_rows(state, rows)


@query("bulk_delete", "SELECT o_orderkey AS key, o_orderpriority AS value FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_orderkey)")
def bulk_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", "o_orderpriority AS value")
    return oplog.delete_rows(state, table(spark, sf_dir, "customer").selectExpr("c_custkey AS key"))


# --- ordered map ------------------------------------------------------------------------------------


@query("map_scan", "SELECT p_partkey AS key, p_name AS value, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part")
def map_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.scan(table(spark, sf_dir, "part").selectExpr("p_partkey AS key", "p_name AS value"), "key", INT64)


@query("map_min_max", "(SELECT 'min' AS side, o_orderkey AS key, o_orderpriority AS value FROM orders ORDER BY key LIMIT 1) UNION ALL (SELECT 'max', o_orderkey AS key, o_orderpriority FROM orders ORDER BY key DESC LIMIT 1)")
def map_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", "o_orderpriority AS value")
    low, high = ordered.least(rows, "key", INT64), ordered.greatest(rows, "key", INT64)
    return low.selectExpr("'min' AS side", "*").union(high.selectExpr("'max' AS side", "*"))


_PRICES = "U AS (SELECT DISTINCT p_retailprice AS k FROM part)"


@query("map_floor", f"WITH {_PRICES} SELECT c_custkey AS probe_id, c_acctbal AS probe, U.k AS found_key FROM customer ASOF LEFT JOIN U ON c_acctbal >= U.k")
def map_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "customer").selectExpr("c_custkey AS probe_id", "c_acctbal AS probe")
    return ordered.as_of(probes, "probe", table(spark, sf_dir, "part").select("p_retailprice"), "p_retailprice")


@query("map_ceiling", f"WITH {_PRICES} SELECT c_custkey AS probe_id, c_acctbal AS probe, U.k AS found_key FROM customer ASOF LEFT JOIN U ON c_acctbal <= U.k")
def map_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "customer").selectExpr("c_custkey AS probe_id", "c_acctbal AS probe")
    return ordered.as_of(probes, "probe", table(spark, sf_dir, "part").select("p_retailprice"), "p_retailprice", backward=False)


@query("map_floor_single", "SELECT 'floor' AS side, max(o_orderkey) AS key FROM orders WHERE o_orderkey <= 101 UNION ALL SELECT 'ceiling', min(o_orderkey) FROM orders WHERE o_orderkey >= 101")
def map_floor_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key")
    return ordered.floor(rows, "key", 101).selectExpr("'floor' AS side", "key").union(ordered.ceiling(rows, "key", 101).selectExpr("'ceiling'", "key"))


@query("map_next_prev", "WITH R AS (SELECT c_name AS key, row_number() OVER (ORDER BY c_name) AS r FROM customer) SELECT R.key, p.key AS prev_key, n.key AS next_key FROM R LEFT JOIN R p ON p.r = R.r - 1 LEFT JOIN R n ON n.r = R.r + 1")
def map_next_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.neighbours(table(spark, sf_dir, "customer").selectExpr("c_name AS key"), "key", STRING)


@query("map_seek_scan", "SELECT o_orderkey AS key, o_orderpriority AS value FROM orders WHERE o_orderkey >= 500 ORDER BY o_orderkey LIMIT 25")
def map_seek_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.seek(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", "o_orderpriority AS value"), "key", 500, 25)


@query("map_next_to", "SELECT min(o_orderkey) AS key FROM orders WHERE o_orderkey > 500 AND o_totalprice > 100000")
def map_next_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", "o_totalprice")
    return ordered.next_to(rows, "key", 500, F.col("o_totalprice") > 100000).select("key")


@query("map_prev_to", "SELECT max(o_orderkey) AS key FROM orders WHERE o_orderkey < 500 AND o_totalprice > 100000")
def map_prev_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", "o_totalprice")
    return ordered.prev_to(rows, "key", 500, F.col("o_totalprice") > 100000).select("key")


@query("map_size", f"WITH {_S} SELECT count(DISTINCT key) AS n_keys, count(DISTINCT key) = 0 AS is_empty FROM S")
def map_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).agg(F.count_distinct("key").alias("n_keys")).withColumn("is_empty", F.col("n_keys") == 0)


@query("map_float_order", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey % 10 <> 0, s_acctbal, s_suppkey) - 1 AS pos FROM supplier WHERE s_suppkey % 10 <> 0 UNION ALL SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 - 1000000 FROM supplier WHERE s_suppkey % 10 = 0")
def map_float_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth supplier's balance is NaN: those sort first (numbered from -1000000), then the others."""
    keyed = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal")).alias("key"))
    placed = ordered.with_position(keyed, [~F.isnan("key"), F.col("key"), F.col("s_suppkey")])
    gone = keyed.where(F.isnan("key")).count()
    return placed.select("s_suppkey", F.when(F.isnan("key"), F.col("pos") - 1000000).otherwise(F.col("pos") - gone).alias("pos"))


@query("compare_keys", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE sign(c_acctbal - 1000) END AS INTEGER) AS to_float, CAST(CASE WHEN c_name < 'Customer#000000500' THEN -1 WHEN c_name = 'Customer#000000500' THEN 0 ELSE 1 END AS INTEGER) AS to_text FROM customer")
def compare_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", compare_floats(balance, F.lit(1000.0)).alias("to_float"), compare(F.col("c_name"), F.lit("Customer#000000500")).alias("to_text"))


# --- memtable and flush -----------------------------------------------------------------------------

_SIZED = f"{_S}, Z AS (SELECT *, CASE op WHEN 'put' THEN 8 + strlen(value) + 30 ELSE 0 END AS size FROM S)"
_FLUSHES = f"""{_SIZED}, C AS (SELECT seq, CAST(sum(size) OVER (ORDER BY seq) AS BIGINT) AS cs FROM Z),
    B(gen, seq, base, mem_bytes) AS (SELECT CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL
      SELECT b.gen + 1, n.seq, n.cs, n.cs - b.base FROM B b, LATERAL (SELECT min(C.seq) AS seq, min(C.cs) AS cs FROM C WHERE C.seq > b.seq AND C.cs - b.base >= {MEMORY_LIMIT}) n WHERE n.seq IS NOT NULL)"""


@query("mem_accounting", f"WITH {_SIZED} SELECT seq, key, CAST(size AS BIGINT) AS size, CAST(sum(size) OVER (ORDER BY seq) AS BIGINT) AS total FROM Z")
def mem_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memtable.running_bytes(event_log(spark, sf_dir), INT64)


@query("mem_totals", f"WITH {_S} SELECT count(DISTINCT key) AS entries, 8 * count(*) FILTER (op = 'put') AS key_bytes, CAST(sum(strlen(value) + 30) FILTER (op = 'put') AS BIGINT) AS value_bytes, CAST(sum(strlen(value) + 38) FILTER (op = 'put') AS BIGINT) AS bytes FROM S")
def mem_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memtable.totals(event_log(spark, sf_dir), INT64)


@query("mem_flush_points", f"WITH RECURSIVE {_FLUSHES} SELECT gen, seq, mem_bytes FROM B WHERE gen >= 0")
def mem_flush_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memtable.flush_points(event_log(spark, sf_dir), INT64, MEMORY_LIMIT)


@query(
    "flush_runs",
    f"""WITH RECURSIVE {_FLUSHES}, G AS (SELECT S.*, (SELECT count(*) FROM B WHERE B.gen >= 0 AND B.seq < S.seq) AS gen FROM S)
    SELECT gen, key, CASE op WHEN 'put' THEN value END AS value, op = 'del' AS is_tombstone FROM G QUALIFY row_number() OVER (PARTITION BY gen, key ORDER BY seq DESC) = 1""",
)
def flush_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.flush(memtable.with_generations(event_log(spark, sf_dir), INT64, MEMORY_LIMIT))


@query("run_generation", f"SELECT max(event_id) // {GEN_ROWS} AS current_gen, max(event_id) // {GEN_ROWS} + 1 AS next_gen FROM events")
def run_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.next_generation(tiered_events(spark, sf_dir))


@query(
    "run_stats",
    """SELECT 'documents' AS run, count(*) AS records, 8 * count(*) AS total_key_size, CAST(sum(strlen(text)) AS BIGINT) AS total_data_size, CAST(8 AS BIGINT) AS avg_key_size FROM documents
    UNION ALL SELECT 'customer', count(*), CAST(sum(strlen(c_name)) AS BIGINT), CAST(sum(strlen(c_mktsegment)) AS BIGINT), CAST(sum(strlen(c_name)) // count(*) AS BIGINT) FROM customer""",
)
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = runs.statistics(table(spark, sf_dir, "documents"), INT64, "doc_id", "text")
    customers = runs.statistics(table(spark, sf_dir, "customer"), STRING, "c_name", "c_mktsegment")
    return documents.selectExpr("'documents' AS run", "*").union(customers.selectExpr("'customer'", "*"))


def _order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", "concat(o_orderstatus, o_orderpriority) AS value")
    return runs.blocks(rows, INT64, BLOCK_SIZE)


_BLOCKS = f"""Z AS (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, 16 + strlen(o_orderstatus) + strlen(o_orderpriority) AS size FROM orders),
    C AS (SELECT *, CAST(sum(size) OVER (ORDER BY pos) AS BIGINT) AS cs FROM Z),
    B(block, pos, base) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL
      SELECT b.block + 1, n.pos + 1, n.cs FROM B b, LATERAL (SELECT min(C.pos) AS pos, min(C.cs) AS cs FROM C WHERE C.pos >= b.pos AND C.cs - b.base >= {BLOCK_SIZE}) n WHERE n.pos IS NOT NULL),
    R AS (SELECT C.key, C.pos, B.block, C.cs - C.size - B.base AS inner_offset FROM C ASOF JOIN B ON C.pos >= B.pos)"""


@query("run_blocks", f"WITH RECURSIVE {_BLOCKS} SELECT key, pos, block, CAST(inner_offset AS BIGINT) AS inner_offset FROM R")
def run_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_blocks(spark, sf_dir)


@query("run_sparse_index", f"WITH RECURSIVE {_BLOCKS} SELECT key, pos, block, CAST(inner_offset AS BIGINT) AS inner_offset FROM R WHERE pos % {INDEX_INTERVAL} = 0 OR inner_offset = 0")
def run_sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.sparse_index(_order_blocks(spark, sf_dir), INDEX_INTERVAL)


@query(
    "run_index_search",
    f"""WITH RECURSIVE {_BLOCKS}, P AS (SELECT c_custkey * 11 - 5 AS probe FROM customer), I AS (SELECT key, block FROM R WHERE pos % {INDEX_INTERVAL} = 0 OR inner_offset = 0)
    SELECT P.probe, I.key AS start_key, I.block, EXISTS (SELECT 1 FROM R WHERE R.key = P.probe AND R.block = I.block) AS found FROM P ASOF LEFT JOIN I ON P.probe >= I.key""",
)
def run_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    block_rows = durable(_order_blocks(spark, sf_dir))
    probes = table(spark, sf_dir, "customer").selectExpr("c_custkey * 11 - 5 AS probe")
    return runs.index_lookup(probes, "probe", runs.sparse_index(block_rows, INDEX_INTERVAL), block_rows)


@query(
    "run_index_level",
    """WITH T AS (SELECT 'documents' AS run, count(*) AS records, CAST(8 AS BIGINT) AS k FROM documents UNION ALL SELECT 'customer', count(*), CAST(sum(strlen(c_name)) // count(*) AS BIGINT) FROM customer)
    SELECT run, records, 64 // k AS summary_entries, (records // 16) // (64 // k) AS summary_interval, CASE WHEN (records // 16) // (64 // k) > 2 THEN 'sum' ELSE 'idx' END AS sparse_type FROM T""",
)
def run_index_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = TableConfig("t", max_summary_bytes=64, min_index_interval=16)
    documents = runs.statistics(table(spark, sf_dir, "documents"), INT64, "doc_id", "text").selectExpr("'documents' AS run", "*")
    customers = runs.statistics(table(spark, sf_dir, "customer"), STRING, "c_name", "c_mktsegment").selectExpr("'customer' AS run", "*")
    return runs.index_level(documents.union(customers), config).select("run", "records", "summary_entries", "summary_interval", "sparse_type")


@query("run_second_level", f"WITH RECURSIVE {_BLOCKS}, I AS (SELECT key, block, row_number() OVER (ORDER BY key) - 1 AS entry FROM R WHERE pos % {INDEX_INTERVAL} = 0 OR inner_offset = 0) SELECT key, block, entry FROM I WHERE entry % 8 = 0")
def run_second_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.second_level(runs.sparse_index(_order_blocks(spark, sf_dir), INDEX_INTERVAL), 8).select("key", "block", "entry")


@query(
    "run_two_level_search",
    f"""WITH RECURSIVE {_BLOCKS}, P AS (SELECT c_custkey * 11 - 5 AS probe FROM customer), I AS (SELECT key, block, row_number() OVER (ORDER BY key) - 1 AS entry FROM R WHERE pos % {INDEX_INTERVAL} = 0 OR inner_offset = 0),
    Q AS (SELECT P.probe, S.key AS sum_key FROM P ASOF LEFT JOIN (SELECT * FROM I WHERE entry % 8 = 0) S ON P.probe >= S.key)
    SELECT Q.probe, Q.sum_key, I.key AS start_key, I.block, EXISTS (SELECT 1 FROM R WHERE R.key = Q.probe AND R.block = I.block) AS found FROM Q ASOF LEFT JOIN I ON Q.probe >= I.key""",
)
def run_two_level_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    block_rows = durable(_order_blocks(spark, sf_dir))
    index = durable(runs.numbered(runs.sparse_index(block_rows, INDEX_INTERVAL)))
    probes = table(spark, sf_dir, "customer").selectExpr("c_custkey * 11 - 5 AS probe")
    return runs.two_level_lookup(probes, "probe", index.where("entry % 8 = 0"), index, block_rows, 8)


@query("run_dump_blocks", f"WITH RECURSIVE {_BLOCKS} SELECT block, count(*) AS n_records, min(key) AS first_key, max(key) AS last_key FROM R GROUP BY block")
def run_dump_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.dump_blocks(_order_blocks(spark, sf_dir).withColumn("path", F.lit("orders"))).drop("path")


@query(
    "run_native_files",
    """WITH E AS (SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS value FROM orders)
    SELECT key, value, value = '' AS is_tombstone FROM E""",
)
def run_native_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as data, index and summary files, and the data files read back."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.encode("o_orderpriority", "UTF-8").alias("value"), (F.col("o_orderstatus") == "F").alias("is_tombstone"))
    files = native.encode(rows, TableConfig("orders", block_size=BLOCK_SIZE), 0)
    return native.decode_data(files.select(F.col("part").cast("string").alias("path"), F.col("dat").alias("content")), INT64).select("key", F.decode("value", "UTF-8").alias("value"), "is_tombstone")


# --- bloom filters ----------------------------------------------------------------------------------

_BITS, _FUNCTIONS = 8192, 4


def _positions(key: str) -> str:
    half = lambda a, b: f"((({key}) % 2147483647) * {a} + {b}) % 2147483647"
    h1, h2 = (f"(({half(*x)}) * 2147483648 + {half(*y)}) % {_BITS}" for x, y in (((1103515245, 12345), (1664525, 1013904223)), ((22695477, 1), (1140671485, 12820163))))
    return f"SELECT ({h1} + i * ({h2})) % {_BITS} AS bit"


@query(
    "bloom_params",
    """WITH N AS (SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'documents', count(*) FROM documents),
    M AS (SELECT t, n, CAST(ceil(-n * ln(0.1) / 0.4804530139182014) AS BIGINT) AS bits FROM N) SELECT t, n, bits, CAST(ceil(bits / n * 0.6931471805599453) AS BIGINT) AS functions FROM M""",
)
def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = None
    for name in ("orders", "customer", "part", "documents"):
        row = table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        counts = row if counts is None else counts.union(row)
    bits, functions = bloom.parameter_columns(F.col("n"), F.lit(0.1))
    return counts.select("t", "n", bits.alias("bits"), functions.alias("functions"))


@query("bloom_bits", f"SELECT DISTINCT bit FROM customer, range({_FUNCTIONS}) r(i), LATERAL ({_positions('c_custkey')})")
def bloom_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.build(table(spark, sf_dir, "customer"), F.col("c_custkey"), _BITS, _FUNCTIONS)


@query(
    "bloom_test",
    f"""WITH B AS (SELECT DISTINCT bit FROM customer, range({_FUNCTIONS}) r(i), LATERAL ({_positions('c_custkey')}))
    SELECT o_custkey AS key, NOT EXISTS (SELECT 1 FROM range({_FUNCTIONS}) r(i), LATERAL ({_positions('o_custkey * 7 % 4001')}) p WHERE p.bit NOT IN (SELECT bit FROM B)) AS maybe FROM orders""",
)
def bloom_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = bloom.build(table(spark, sf_dir, "customer"), F.col("c_custkey"), _BITS, _FUNCTIONS)
    probes = table(spark, sf_dir, "orders").selectExpr("o_custkey AS key")
    return bloom.test(probes, F.col("key") * 7 % 4001, built, _BITS, _FUNCTIONS)


@query("bloom_merge", f"SELECT word, CAST(sum(CAST(1 AS BIGINT) << CAST(bit % 32 AS INTEGER)) AS BIGINT) AS value FROM (SELECT DISTINCT bit, bit // 32 AS word FROM customer, range({_FUNCTIONS}) r(i), LATERAL ({_positions('c_custkey')})) GROUP BY word")
def bloom_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer")
    halves = [bloom.build(keys.where(F.col("c_custkey") % 2 == r), F.col("c_custkey"), _BITS, _FUNCTIONS) for r in (0, 1)]
    return bloom.words(bloom.merge(*halves))


# --- compaction -------------------------------------------------------------------------------------

_ORDER = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


def _half(spark: SparkSession, sf_dir: str, rest: int) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_partkey") % 2 == rest).select(*_ORDER)


@query("merge_keep_all", f"SELECT {', '.join(_ORDER)}, CAST(l_partkey % 2 + 1 AS INTEGER) AS src, row_number() OVER (ORDER BY l_orderkey, l_partkey % 2, {', '.join(_ORDER[1:])}) - 1 AS pos FROM lineitem")
def merge_keep_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_keep_all(_half(spark, sf_dir, 0), _half(spark, sf_dir, 1), _ORDER)


@query("merge_lww", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey % 2 DESC, {', '.join(f'{c} DESC' for c in _ORDER[2:])}) = 1")
def merge_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _half(spark, sf_dir, 0).withColumn("gen", F.lit(0)).union(_half(spark, sf_dir, 1).withColumn("gen", F.lit(1)))
    return merge.merge_lww(both, ["l_orderkey", "l_linenumber"], ["gen", *_ORDER[2:]], ["l_partkey", "l_suppkey", "l_extendedprice"])


@query("merge_stats", "SELECT count(*) AS records, 8 * count(*) AS total_key_size, CAST(sum(strlen(l_returnflag || l_linestatus)) AS BIGINT) AS total_data_size FROM lineitem")
def merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS key", "concat(l_returnflag, l_linestatus) AS value", "l_partkey % 2 AS half")
    halves = [runs.statistics(rows.where(F.col("half") == r), INT64) for r in (0, 1)]
    return merge.merged_statistics(halves[0].union(halves[1]))


@query("merge_purge", f"WITH {_LATEST} SELECT (SELECT max(seq) // {GEN_ROWS} FROM S) AS gen, key, value, false AS is_tombstone FROM W WHERE key NOT IN (SELECT key FROM W WHERE op = 'del')")
def merge_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    flushed = runs.flush(tiered_events(spark, sf_dir))
    return merge.compact_through(flushed, flushed.agg(F.max("gen")).first()[0], purge=True)


@query(
    "merge_partial",
    f"""WITH {_S}, G AS (SELECT *, seq // {GEN_ROWS} AS g FROM S), M AS (SELECT max(g) AS last FROM G),
    T AS (SELECT CASE WHEN g = last THEN last ELSE greatest(last - 1, 0) END AS gen, key, seq, op, value FROM G, M)
    SELECT gen, key, CASE op WHEN 'put' THEN value END AS value, op = 'del' AS is_tombstone FROM T QUALIFY row_number() OVER (PARTITION BY gen, key ORDER BY seq DESC) = 1""",
)
def merge_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All generations but the newest merged into one; tombstones stay."""
    flushed = runs.flush(tiered_events(spark, sf_dir))
    return merge.compact_through(flushed, max(0, flushed.agg(F.max("gen")).first()[0] - 1))


# --- codecs -----------------------------------------------------------------------------------------


@query("codec_int_be", "SELECT o_orderkey, printf('%016X', CASE WHEN o_orderkey % 2 = 0 THEN -o_orderkey ELSE o_orderkey END) AS wide, right(printf('%016X', CASE WHEN o_orderkey % 2 = 0 THEN -o_orderkey ELSE o_orderkey END), 8) AS narrow, CASE WHEN o_orderkey % 2 = 0 THEN -o_orderkey ELSE o_orderkey END AS back, CASE WHEN o_orderkey % 2 = 0 THEN -o_orderkey ELSE o_orderkey END AS narrow_back FROM orders")
def codec_int_be(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("o_orderkey") % 2 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    wide, narrow = codec.int_to_bytes(value), codec.int_to_bytes(value, 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(wide).alias("wide"), F.hex(narrow).alias("narrow"), codec.bytes_to_int(wide).alias("back"), codec.bytes_to_int(narrow, 4).alias("narrow_back"))


@query("codec_frame", "SELECT c_custkey, printf('%08X', strlen(c_name)) || hex(encode(c_name)) AS framed, c_name AS back FROM customer")
def codec_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = codec.frame(codec.text_to_bytes(F.col("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.hex(framed).alias("framed"), codec.bytes_to_text(codec.unframe(framed)).alias("back"))


@query("codec_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(strlen(props) AS INTEGER) AS n_bytes FROM events")
def codec_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = codec.text_to_bytes(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", codec.bytes_to_json(data, "k string")["k"].alias("k"), F.octet_length(data).alias("n_bytes"))


@query("codec_utf8_size", "SELECT doc_id, strlen(text) AS n_bytes, length(text) AS n_points FROM documents")
def codec_utf8_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.length("text").cast("bigint").alias("n_points"))


@query("codec_float_be", "SELECT c_custkey, c_acctbal AS back, hex(CAST(CAST(CAST(c_acctbal AS DOUBLE) AS BIT) AS BLOB)) AS wide, hex(CAST(CAST(CAST(c_acctbal AS FLOAT) AS BIT) AS BLOB)) AS narrow FROM customer")
def codec_float_be(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, narrow = (codec.float_to_bytes(F.col("c_acctbal"), width) for width in (8, 4))
    return table(spark, sf_dir, "customer").select("c_custkey", codec.bytes_to_float(wide).alias("back"), F.hex(wide).alias("wide"), F.hex(narrow).alias("narrow"))


@query("codec_short_frame", "SELECT p_partkey, printf('%02X', strlen(p_name)) || hex(encode(p_name)) AS framed, p_name AS back FROM part WHERE strlen(p_name) < 128")
def codec_short_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose length is one byte, for names that fit."""
    framed = codec.frame(codec.text_to_bytes(F.col("p_name")), 1)
    return table(spark, sf_dir, "part").where(F.octet_length("p_name") < 128).select("p_partkey", F.hex(framed).alias("framed"), codec.bytes_to_text(codec.unframe(framed, 1)).alias("back"))


# --- catalog and sources ----------------------------------------------------------------------------


def _node(spark: SparkSession) -> Node:
    """A new node in the shared folder."""
    return Node(spark, f"{shared_folder(spark)}/node-{uuid.uuid4().hex}")


_CATALOG = """WITH T AS (SELECT 'events' AS name, typeof(any_value(user_id)) AS kind, 0 AS block_size, 0 AS interval, 0.0 AS rate FROM events
    UNION ALL SELECT 'names', typeof(any_value(c_name)), 4096, 0, 0.0 FROM customer UNION ALL SELECT 'prices', typeof(any_value(p_retailprice)), 0, 64, 0.01 FROM part)"""


@query(
    "table_catalog",
    f"""{_CATALOG} SELECT name, CASE kind WHEN 'BIGINT' THEN 'int64' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'float64' END AS key_type, 'redblack' AS memtable, 65536 AS max_memtable_bytes,
    CAST(CASE block_size WHEN 0 THEN 16384 ELSE block_size END AS INTEGER) AS block_size, CAST(CASE interval WHEN 0 THEN 128 ELSE interval END AS INTEGER) AS min_index_interval, 4096 AS max_index_interval, 5242880 AS max_summary_bytes, CAST(CASE rate WHEN 0 THEN 0.1 ELSE rate END AS DOUBLE) AS bloom_rate FROM T""",
)
def table_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings that a node reads back from its files, with key types after the tables' columns; 0 stands for the default."""
    kinds = {k.spark: k.name for k in KEY_TYPES.values()}
    node = _node(spark)
    for name, (source, column), given in (("events", ("events", "user_id"), {}), ("names", ("customer", "c_name"), {"block_size": 4096}), ("prices", ("part", "p_retailprice"), {"block_size": 0, "min_index_interval": 64, "bloom_rate": 0.01})):
        node.create_table(TableConfig(name, key_type=kinds[table(spark, sf_dir, source).schema[column].dataType], **given))
    stored = Node(spark, node.root)
    schema = "name string, key_type string, memtable string, max_memtable_bytes int, block_size int, min_index_interval int, max_index_interval int, max_summary_bytes int, bloom_rate double"
    return spark.createDataFrame([tuple(dataclasses.asdict(stored.table(n).config).values()) for n in stored.list_tables()], schema)


_KEY_COLUMNS = {"customer": ("c_custkey", "c_name", "c_acctbal"), "orders": ("o_orderkey", "o_orderpriority", "o_totalprice")}


@query(
    "key_types",
    " UNION ALL ".join(
        f"SELECT '{c}' AS source, CASE typeof(any_value({c})) WHEN 'BIGINT' THEN 'int64' WHEN 'VARCHAR' THEN 'string' ELSE 'float64' END AS name, typeof(any_value({c})) = 'VARCHAR' AS is_dynamic, "
        f"CAST(sum(CASE typeof({c}) WHEN 'VARCHAR' THEN strlen(CAST({c} AS VARCHAR)) ELSE 8 END) AS BIGINT) AS key_bytes FROM {t}"
        for t, columns in _KEY_COLUMNS.items()
        for c in columns
    ),
)
def key_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key type of a column and the bytes that its values take as keys."""
    kinds = {k.spark: k for k in KEY_TYPES.values()}
    out = None
    for source, columns in _KEY_COLUMNS.items():
        rows = table(spark, sf_dir, source)
        for c in columns:
            kind = kinds[rows.schema[c].dataType]
            row = rows.agg(F.sum(key_size(c, kind)).alias("key_bytes")).select(F.lit(c).alias("source"), F.lit(kind.name).alias("name"), F.lit(kind.dynamic).alias("is_dynamic"), "key_bytes")
            out = row if out is None else out.union(row)
    return out


@query("oplog_text", f"WITH {_LATEST} SELECT key FROM W WHERE op = 'put'")
def oplog_text_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a written text log, one file in order, read back."""
    path = f"{shared_folder(spark)}/oplog-{uuid.uuid4().hex}"
    log = event_log(spark, sf_dir)
    line = F.concat(F.when(F.col("op") == oplog.PUT, "a ").otherwise("r "), F.col("key").cast("string"))
    log.orderBy("seq").select(line.alias("value")).write.text(path)
    return oplog.live_state(oplog_text.read(spark, path)).select("key")


# --- the facade -------------------------------------------------------------------------------------


def _orders_node(spark: SparkSession, sf_dir: str) -> Node:
    """All orders in a table of a new node, by bulk writes, flushes and a compaction, opened anew."""
    node = _node(spark)
    orders = table(spark, sf_dir, "orders")
    made = node.create_table(TableConfig("orders"))
    value = lambda text: text.cast("binary").alias("value")
    made.put(orders.select(F.col("o_orderkey").alias("key"), value(F.col("o_orderpriority"))))
    made.flush()
    made.delete(orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key")))
    made.flush()
    made.compact([0, 1])
    made.put(orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("key"), value(F.lit("third"))))
    made.flush()
    made.update(orders.select((F.col("o_orderkey") * 2).alias("key"), value(F.lit("double"))))
    node.create_table(TableConfig("names", key_type="string"))
    return Node(spark, node.root)


_ORDERS = """A AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'third' WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS value, o_orderkey % 3 = 0 AS late FROM orders),
    U AS (SELECT key, value, late, value IS NOT NULL AND key IN (SELECT o_orderkey * 2 FROM orders) AS fresh FROM A)"""


@query("node_items", f"WITH {_ORDERS} SELECT key, CASE WHEN fresh THEN 'double' ELSE value END AS value FROM U WHERE value IS NOT NULL")
def node_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_node(spark, sf_dir).table("orders").items().select("key", F.decode("value", "UTF-8").alias("value"))


@query(
    "node_get",
    f"""WITH {_ORDERS} SELECT key, CASE WHEN value IS NULL THEN 'deleted' ELSE 'found' END AS status, CASE WHEN fresh THEN 1 ELSE 3 END AS found_in, CASE WHEN fresh THEN -1 WHEN late THEN 1 ELSE 0 END AS found_run FROM U
    UNION ALL SELECT -1 - c_custkey, 'absent', 0, NULL FROM customer""",
)
def node_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key").union(table(spark, sf_dir, "customer").selectExpr("-1 - c_custkey"))
    return _orders_node(spark, sf_dir).table("orders").get(asked).select("key", "status", "found_in", "found_run")


@query(
    "node_tables",
    f"""WITH {_ORDERS} SELECT 'names' AS name, 'string' AS key_type, '' AS runs, CAST(0 AS BIGINT) AS memtable_bytes
    UNION ALL SELECT 'orders', 'int64', '2,3', CAST(coalesce(sum(8 + 6 + 30), 0) AS BIGINT) FROM U WHERE fresh""",
)
def node_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = _orders_node(spark, sf_dir)
    rows = [(name, d["key_type"], ",".join(map(str, d["generations"])), d["memtable_bytes"]) for name in node.list_tables() for d in [node.table(name).describe()]]
    return spark.createDataFrame(rows, "name string, key_type string, runs string, memtable_bytes long")


@query(
    "node_runs",
    f"""WITH {_ORDERS}, F AS (SELECT key, CASE WHEN key IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN NULL ELSE (SELECT any_value(o_orderpriority) FROM orders o WHERE o.o_orderkey = A.key) END AS value FROM A)
    SELECT CAST(2 AS BIGINT) AS gen, count(*) AS records, 8 * count(*) AS total_key_size, CAST(coalesce(sum(strlen(value)), 0) AS BIGINT) AS total_data_size FROM F
    UNION ALL SELECT 3, count(*), 8 * count(*), CAST(5 * count(*) AS BIGINT) FROM A WHERE late""",
)
def node_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored statistics of the runs that count."""
    made = _orders_node(spark, sf_dir).table("orders")
    return run_store.read_stats(spark, made.path).select(F.col("gen").cast("bigint").alias("gen"), "records", "total_key_size", "total_data_size")


@query("item_projection", f"WITH {_LATEST} SELECT key AS part_key, CAST(NULL AS VARCHAR) AS sort_key, value FROM W WHERE op = 'put'")
def item_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = oplog.merge_on_read(oplog.reduce_tiers(tiered_events(spark, sf_dir))).where(~F.col("deleted"))
    return read.select(F.col("key").alias("part_key"), F.lit(None).cast("string").alias("sort_key"), "value")


