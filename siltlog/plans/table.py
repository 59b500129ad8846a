"""The facade: a node with tables, each a tail of written batches over numbered runs in a directory."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltlog.config import TableConfig
from siltlog.operators import memtable, merge, oplog, runs
from siltlog.plans.materialize import durable
from siltlog.sources import run_store

#: Rows of one batch have the batch's number times this, and on, as seq.
BATCH_SEQ = 1 << 32


class KVTable:
    """Writes add batches to the tail; reads merge the tail with the runs; flush turns the tail into a run.

    Each write is one small directory of the table, so a table that is opened again has all of them. With
    ``auto_flush`` a put that fills the memtable flushes it. Writes are bulk: a row by row client would plan one
    job a row.
    """

    def __init__(self, spark: SparkSession, path: str, config: TableConfig, auto_flush: bool = False) -> None:
        self.spark, self.path, self.config, self.auto_flush = spark, path, config, auto_flush
        self._number, self._manifest = run_store.read_manifest(spark, path)
        self._batch, _ = run_store.read_tail(spark, path, config, self._manifest.flushed_batch)

    @property
    def name(self) -> str:
        return self.config.name

    def _tail(self) -> DataFrame:
        return run_store.read_tail(self.spark, self.path, self.config, self._manifest.flushed_batch)[1]

    def _append(self, rows: DataFrame) -> None:
        shaped = rows.select(F.col("key").cast(self.config.key.spark).alias("key"), "op", F.col("value").cast("binary").alias("value"))
        batch = self._batch + 1
        within = F.row_number().over(Window.partitionBy("key").orderBy("op", "value")) - 1
        run_store.append_tail(shaped.withColumn("seq", (F.lit(batch * BATCH_SEQ) + within).cast("bigint")).select("seq", "key", "op", "value"), self.path, batch)
        self._batch = batch
        if self.auto_flush and self.is_full():
            self.flush()

    def put(self, rows: DataFrame) -> None:
        """Bulk upsert of (key, value); of rows with the same key in one call the greatest value wins."""
        self._append(rows.select("key", F.lit(oplog.PUT).alias("op"), "value"))

    def put_item(self, key: object, value: bytes) -> None:
        self.put(self.spark.createDataFrame([(key, value)], f"key {self.config.key.spark.simpleString()}, value binary"))

    def update(self, rows: DataFrame) -> None:
        """Bulk put restricted to keys that are there."""
        self.put(rows.join(self.items().select("key"), "key", "left_semi"))

    def delete(self, keys: DataFrame) -> None:
        self._append(keys.select("key", F.lit(oplog.DEL).alias("op"), F.lit(None).cast("binary").alias("value")))

    def delete_item(self, key: object) -> None:
        self.delete(self.spark.createDataFrame([(key,)], f"key {self.config.key.spark.simpleString()}"))

    def truncate(self) -> None:
        self.delete(self.items().select("key"))

    def tiers(self) -> DataFrame:
        """gen (place of the run, oldest first), key, op, value: the runs, and the tail as the newest generation."""
        tail = oplog.latest(self._tail()).select(F.lit(self._memory_gen()).alias("gen"), "key", "op", "value")
        stored = run_store.read_runs(self.spark, self.path, self.config, self._manifest.generations)
        return stored.select(F.col("place").alias("gen"), "key", F.when(F.col("is_tombstone"), oplog.DEL).otherwise(oplog.PUT).alias("op"), "value").unionByName(tail)

    def _memory_gen(self) -> int:
        return len(self._manifest.generations)

    def generations(self) -> list[int]:
        """The runs, oldest first."""
        return list(self._manifest.generations)

    def next_generation(self) -> int:
        return self._manifest.next_generation

    def _publish(self, **changes: object) -> None:
        manifest = dataclasses.replace(self._manifest, **changes)
        run_store.publish(self.spark, self.path, self._number, manifest)
        self._number, self._manifest = self._number + 1, manifest

    def items(self) -> DataFrame:
        """key, value of every live key."""
        return oplog.merge_on_read(self.tiers()).where(~F.col("deleted")).select("key", "value")

    def get(self, keys: DataFrame) -> DataFrame:
        """key, status, value, found_in, found_run of each asked key."""
        read = oplog.merge_on_read(self.tiers(), self._memory_gen()).withColumnRenamed("key", "r_key")
        joined = keys.select("key").join(read, F.col("key") == F.col("r_key"), "left")
        status = F.when(F.col("op").isNull(), oplog.ABSENT).when(F.col("deleted"), oplog.DELETED).otherwise(oplog.FOUND)
        return joined.select("key", status.alias("status"), F.when(~F.col("deleted"), F.col("value")).alias("value"), F.coalesce("found_in", F.lit(oplog.IN_NOTHING)).alias("found_in"), "found_run")

    def get_item(self, key: object) -> tuple[str, bytes | None]:
        """(status, value) of one key; the equality is pushed to every tier's scan."""
        tiers = self.tiers().where(F.col("key") == F.lit(key).cast(self.config.key.spark))
        row = oplog.merge_on_read(tiers).first()
        if row is None:
            return oplog.ABSENT, None
        return (oplog.DELETED, None) if row.deleted else (oplog.FOUND, None if row.value is None else bytes(row.value))

    def byte_size(self) -> int:
        return memtable.totals(self._tail(), self.config.key).first().bytes

    def is_full(self) -> bool:
        return self.byte_size() >= self.config.max_memtable_bytes

    def flush(self) -> int | None:
        """Writes the tail as the next generation, then lets it count in the tail's place; an empty tail writes nothing."""
        tail = self._tail()
        if tail.isEmpty():
            return None
        gen = self.next_generation()
        rows = runs.flush(tail.withColumn("gen", F.lit(gen))).drop("gen")
        run_store.write_run(durable(rows), self.path, self.config, gen)
        self._publish(generations=(*self._manifest.generations, gen), flushed_batch=self._batch, next_generation=gen + 1)
        run_store.drop_tail(self.spark, self.path, self._batch)
        return gen

    def compact(self, generations: list[int], purge: bool = False, keep_inputs: bool = False) -> int:
        """Merges neighbouring runs into a new generation that takes their place; then the merged ones are removed.

        Until the new run is whole and published the old ones count, afterwards it alone does. With ``keep_inputs``
        the files of the merged runs stay, though they no longer count. Tombstones can be purged only if the oldest
        run is among those merged.
        """
        order, chosen = list(self._manifest.generations), set(generations)
        if not chosen or not chosen <= set(order):
            raise ValueError(f"table {self.name!r} has the runs {order}, not {sorted(chosen - set(order))}")
        first = min(order.index(g) for g in chosen)
        if set(order[first : first + len(chosen)]) != chosen:
            raise ValueError("the generations to merge have to be neighbours")
        if purge and first:
            raise ValueError("tombstones can be purged only if no older generation is left out of the merge")
        gen, inputs = self.next_generation(), tuple(order[first : first + len(chosen)])
        stored = run_store.read_runs(self.spark, self.path, self.config, inputs)
        merged = merge.compact_through(stored.select(F.col("place").alias("gen"), "key", "value", "is_tombstone"), len(inputs), purge)
        run_store.write_run(durable(merged.select("key", "value", "is_tombstone")), self.path, self.config, gen)
        self._publish(generations=(*order[:first], gen, *order[first + len(chosen) :]), next_generation=gen + 1)
        if not keep_inputs:
            run_store.drop_runs(self.spark, self.path, list(inputs))
        return gen

    def describe(self) -> dict:
        return dataclasses.asdict(self.config) | {"generations": self.generations(), "memtable_bytes": self.byte_size()}


class Node:
    """A directory of tables."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.tables = {name: KVTable(spark, f"{root}/{name}", run_store.read_config(spark, f"{root}/{name}")) for name in run_store.list_tables(spark, root)}

    def list_tables(self) -> list[str]:
        return sorted(self.tables)

    def create_table(self, config: TableConfig, auto_flush: bool = False) -> KVTable:
        if config.name in self.tables:
            raise ValueError(f"table {config.name!r} is there already")
        run_store.write_config(self.spark, f"{self.root}/{config.name}", config)
        self.tables[config.name] = KVTable(self.spark, f"{self.root}/{config.name}", config, auto_flush)
        return self.tables[config.name]

    def table(self, name: str) -> KVTable:
        if name not in self.tables:
            raise KeyError(f"no table {name!r}")
        return self.tables[name]

    def alter_table(self, name: str, **changes: object) -> KVTable:
        """Changes settings other than name and key type."""
        if {"name", "key_type"} & set(changes):
            raise ValueError("name and key type of a table are fixed")
        table = self.table(name)
        table.config = dataclasses.replace(table.config, **changes)
        run_store.write_config(self.spark, table.path, table.config)
        return table

    def drop_table(self, name: str) -> None:
        table = self.table(name)
        target = self.spark._jvm.org.apache.hadoop.fs.Path(table.path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        del self.tables[name]

    def register_views(self) -> None:
        """Each table's live items as a temporary view of its name."""
        for name, table in self.tables.items():
            table.items().createOrReplaceTempView(name)
