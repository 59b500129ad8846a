"""The op log and the key-value state that follows from it.

A log has the columns ``seq``, ``key``, ``op`` ('put' or 'del') and ``value``; ``seq`` is unique and orders it.
The row of greatest ``seq`` decides a key: it is found (put), deleted (del), or absent if it has no row. Every
reduction is a partial aggregate, so a hot key costs one row a task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltlog.operators.ordered import ranged
from siltlog.plans.materialize import durable

PUT, DEL = "put", "del"
FOUND, DELETED, ABSENT = "found", "deleted", "absent"
#: Where a read was answered.
IN_NOTHING, IN_MEMORY, IN_RUN = 0, 1, 3


def as_log(df: DataFrame, seq: Column, key: Column, op: Column, value: Column) -> DataFrame:
    return df.select(seq.alias("seq"), key.alias("key"), op.alias("op"), value.alias("value"))


def latest(log: DataFrame) -> DataFrame:
    """key, seq, op, value of each key's deciding row."""
    won = log.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("w"))
    return won.select("key", "w.seq", "w.op", "w.value")


def live_state(log: DataFrame) -> DataFrame:
    return latest(log).where(F.col("op") == PUT).select("key", "value")


def tombstones(log: DataFrame) -> DataFrame:
    """Deleted keys and the seq of their tombstone."""
    return latest(log).where(F.col("op") == DEL).select("key", "seq")


def get_many(log: DataFrame, probes: DataFrame) -> DataFrame:
    """key, status, value for every probed key; a deleted key is told from an absent one."""
    state = latest(log).select(F.col("key").alias("s_key"), "op", "value")
    status = F.when(F.col("op").isNull(), ABSENT).when(F.col("op") == DEL, DELETED).otherwise(FOUND)
    joined = probes.select("key").join(state, F.col("key") == F.col("s_key"), "left")
    return joined.select("key", status.alias("status"), F.when(F.col("op") == PUT, F.col("value")).alias("value"))


def get(log: DataFrame, key: object) -> DataFrame:
    """The deciding row of one key: no row if absent. The equality reaches the scan."""
    return latest(log.where(F.col("key") == F.lit(key)))


def deletes_with_history(log: DataFrame) -> DataFrame:
    """seq, key, existed for each delete: whether the key had an entry, tombstones included, when it came.

    That is so exactly if an earlier row names the key, so the least seq of each key decides and no window
    has to sort a key's rows.
    """
    first = durable(log.groupBy(F.col("key").alias("f_key")).agg(F.min("seq").alias("first_seq")))
    deletes = log.where(F.col("op") == DEL).select("seq", "key")
    return deletes.join(first, F.col("key") == F.col("f_key")).select("seq", "key", (F.col("seq") > F.col("first_seq")).alias("existed"))


def overwrites(log: DataFrame) -> DataFrame:
    """n_puts, n_keys and how many puts replaced an entry of their key, over the whole log."""
    per_key = log.groupBy("key").agg(F.count_if(F.col("op") == PUT).alias("puts"), F.min("seq").alias("first"), F.min(F.when(F.col("op") == PUT, F.col("seq"))).alias("first_put"))
    fresh = F.count_if(F.col("first") == F.col("first_put"))
    return per_key.agg(F.coalesce(F.sum("puts"), F.lit(0)).alias("n_puts"), F.count("*").alias("n_keys"), (F.coalesce(F.sum("puts"), F.lit(0)) - fresh).alias("n_overwrites"))


def reduce_tiers(tiered: DataFrame) -> DataFrame:
    """key, gen, op, value: within each generation the last row of a key counts."""
    won = tiered.groupBy("gen", "key").agg(F.max_by(F.struct("op", "value"), "seq").alias("w"))
    return won.select("gen", "key", "w.op", "w.value")


def merge_on_read(tiers: DataFrame, memory_gen: int | None = None) -> DataFrame:
    """Reads through all tiers, newest generation first: key, op, value, gen, found_in, found_run, deleted.

    ``tiers`` has one row per (gen, key). The generation ``memory_gen`` is the memtable; found_run is the
    position of the run among the stored runs, from the oldest (0), -1 for memory.
    """
    won = tiers.groupBy("key").agg(F.max_by(F.struct("gen", "op", "value"), "gen").alias("w")).select("key", "w.*")
    memory = F.lit(False) if memory_gen is None else F.col("gen") == memory_gen
    stored = tiers.where(~memory).select(F.col("gen").alias("r_gen")).distinct()  # one row a run
    index = stored.withColumn("place", F.row_number().over(Window.orderBy("r_gen")) - 1)
    won = won.join(index, F.col("gen") == F.col("r_gen"), "left")
    return won.select(
        "key",
        "op",
        "value",
        "gen",
        F.when(memory, IN_MEMORY).otherwise(IN_RUN).alias("found_in"),
        F.when(memory, F.lit(-1)).otherwise(F.col("place")).cast("bigint").alias("found_run"),
        (F.col("op") == DEL).alias("deleted"),
    )


def empty_values(log: DataFrame) -> DataFrame:
    """key, in_memory, in_run for each key: an empty value is alive in memory and a tombstone in a run."""
    state = latest(log)
    gone = F.col("op") == DEL
    return state.select("key", F.when(gone, DELETED).otherwise(FOUND).alias("in_memory"), F.when(gone | (F.octet_length("value") == 0), DELETED).otherwise(FOUND).alias("in_run"))


def multiset_counts(log: DataFrame) -> DataFrame:
    """key, copies: each put adds a copy, each delete takes one if there is any.

    With s the running sum of +1 and -1, the copies at the end are s_end - min(0, min s). Range partitions of
    (key, seq) split a hot key's history; each gives its sum and its least running sum, and a key's few such
    rows are put together in order.
    """
    steps = ranged(log.select("key", "seq", F.when(F.col("op") == PUT, 1).otherwise(-1).cast("bigint").alias("d")), [F.col("key"), F.col("seq")])
    running = steps.withColumn("s", F.sum("d").over(Window.partitionBy("part_", "key").orderBy("seq")))
    pieces = running.groupBy("key", "part_").agg(F.sum("d").alias("total"), F.min("s").alias("low"))
    ordered_pieces = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part_", "total", "low"))).alias("p"))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("low"))
    folded = F.aggregate("p", start, lambda a, x: F.struct((a["sum"] + x["total"]).alias("sum"), F.least(a["low"], a["sum"] + x["low"]).alias("low")))
    return ordered_pieces.withColumn("f", folded).select("key", (F.col("f.sum") - F.col("f.low")).alias("copies"))


def put_rows(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Bulk put: the rows replace or join the state (key, value)."""
    both = state.select("key", "value", F.lit(0).alias("t")).unionByName(rows.select("key", "value", F.lit(1).alias("t")))
    return both.groupBy("key").agg(F.max_by(F.struct("value"), "t").alias("w")).select("key", "w.value")


def update_rows(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Bulk update: as put, for keys that are there."""
    new = rows.select(F.col("key").alias("n_key"), F.struct("value").alias("n"))
    joined = state.join(new, F.col("key") == F.col("n_key"), "left")
    return joined.select("key", F.when(F.col("n").isNotNull(), F.col("n.value")).otherwise(F.col("value")).alias("value"))


def delete_rows(state: DataFrame, keys: DataFrame) -> DataFrame:
    return state.join(keys.select("key"), "key", "left_anti")


def get_rows(state: DataFrame, keys: DataFrame) -> DataFrame:
    """Bulk get of the keys that are there."""
    return state.join(keys.select("key"), "key", "left_semi")
