"""Runs as sorted Parquet: one directory a table, partitioned by generation, with side tables.

``<table>/runs/gen=<n>/`` holds the records in key order with min/max statistics and a Parquet bloom filter
on the key, so an equality on the key opens few row groups; ``<table>/stats`` has one row a generation;
``<table>/config`` the settings. ``<table>/manifest/<n>.json`` names the runs that count, oldest first, and the last
write of the tail that they hold; the highest number is valid, and each is made by one rename. What no
manifest names does not count, so a writer may be lost at any time. ``<table>/tail/batch=<n>`` holds the writes that
are in no run yet. All files go through Spark's readers and writers or its file systems, so the directory may be in
any store Spark reaches.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.config import TableConfig, order_columns
from siltlog.operators import runs as run_ops


@dataclass(frozen=True)
class Manifest:
    """The runs that count, oldest first, the last write batch they hold, and the generation to use next."""

    generations: tuple[int, ...] = ()
    flushed_batch: int = -1
    next_generation: int = 0


def _place(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _place(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def read_manifest(spark: SparkSession, path: str) -> tuple[int, Manifest]:
    """(number, manifest) of the newest one; -1 and an empty one if there is none."""
    numbers = [int(n.removesuffix(".json")) for n in _names(spark, f"{path}/manifest") if n.endswith(".json")]
    if not numbers:
        return -1, Manifest()
    text = spark.read.text(f"{path}/manifest/{max(numbers)}.json", wholetext=True).first()[0]
    found = json.loads(text)
    return max(numbers), Manifest(tuple(found["generations"]), found["flushed_batch"], found["next_generation"])


def publish(spark: SparkSession, path: str, known: int, manifest: Manifest) -> None:
    """Makes the manifest valid in place of number ``known``; fails if another writer was faster."""
    fs, draft = _place(spark, f"{path}/manifest/.{known + 1}.draft")
    final = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{known + 1}.json")
    out = fs.create(draft, True)
    text = json.dumps({"generations": list(manifest.generations), "flushed_batch": manifest.flushed_batch, "next_generation": manifest.next_generation})
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"another writer has changed {path}")


def append_tail(rows: DataFrame, path: str, batch: int) -> None:
    """Writes seq, key, op, value as one batch of the tail."""
    rows.write.mode("overwrite").parquet(f"{path}/tail/batch={batch}")


def read_tail(spark: SparkSession, path: str, config: TableConfig, flushed_batch: int) -> tuple[int, DataFrame]:
    """(last batch, rows) of the written batches that are in no run; a batch that was cut off does not count."""
    schema = f"seq bigint, key {config.key.spark.simpleString()}, op string, value binary"
    batches = sorted(int(n.removeprefix("batch=")) for n in _names(spark, f"{path}/tail") if n.startswith("batch="))
    whole = [b for b in batches if b > flushed_batch and "_SUCCESS" in _names(spark, f"{path}/tail/batch={b}")]
    last = max(batches, default=flushed_batch)
    if not whole:
        return max(last, flushed_batch), spark.createDataFrame([], schema)
    return last, spark.read.schema(schema).parquet(*[f"{path}/tail/batch={b}" for b in whole])


def drop_tail(spark: SparkSession, path: str, last: int) -> None:
    """Deletes the batches up to ``last``."""
    for name in _names(spark, f"{path}/tail"):
        if name.startswith("batch=") and int(name.removeprefix("batch=")) <= last:
            fs, target = _place(spark, f"{path}/tail/{name}")
            fs.delete(target, True)


def write_run(rows: DataFrame, path: str, config: TableConfig, gen: int, partitions: int | None = None) -> DataFrame:
    """Writes key, value, is_tombstone as generation ``gen``; returns its statistics row.

    The count read back must equal the count of the rows; the statistics are written only then.
    """
    order = order_columns("key", config.key)
    target = f"{path}/runs/gen={gen}"
    parts = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shaped = rows.select("key", "value", "is_tombstone").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    writer = shaped.write.mode("overwrite").option("compression", "zstd").option("parquet.bloom.filter.enabled#key", "true")
    writer.option("parquet.bloom.filter.fpp#key", str(config.bloom_rate)).parquet(target)
    written = rows.sparkSession.read.parquet(target)
    stats = run_ops.statistics(written, config.key).select(F.lit(gen).cast("bigint").alias("gen"), "*")
    expected, found = rows.count(), written.count()
    if expected != found:
        raise RuntimeError(f"run {gen} has {found} records, {expected} were to be written")
    run_ops.index_level(stats, config).drop("gen").write.mode("overwrite").parquet(f"{path}/stats/gen={gen}")
    return stats


def read_runs(spark: SparkSession, path: str, config: TableConfig, generations: tuple[int, ...] | None = None) -> DataFrame:
    """gen, place, key, value, is_tombstone of the runs in the manifest (or of those given); place counts from the oldest."""
    schema = f"key {config.key.spark.simpleString()}, value binary, is_tombstone boolean"
    chosen = read_manifest(spark, path)[1].generations if generations is None else generations
    columns = ["gen", "place", "key", "value", "is_tombstone"]
    if not chosen:
        return spark.createDataFrame([], f"gen bigint, place int, {schema}").select(columns)
    paths = [f"{path}/runs/gen={g}" for g in chosen]
    rows = spark.read.schema(f"{schema}, gen bigint").option("basePath", f"{path}/runs").parquet(*paths)
    place = F.array_position(F.lit(list(chosen)).cast("array<bigint>"), F.col("gen")) - 1
    return rows.withColumn("place", place.cast("int")).select(columns)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row a generation that counts; the table has at least one run."""
    chosen = read_manifest(spark, path)[1].generations
    return spark.read.option("basePath", f"{path}/stats").parquet(*[f"{path}/stats/gen={g}" for g in chosen])


def drop_runs(spark: SparkSession, path: str, generations: list[int]) -> None:
    for gen in generations:
        for part in ("runs", "stats"):
            fs, target = _place(spark, f"{path}/{part}/gen={gen}")
            fs.delete(target, True)


def write_config(spark: SparkSession, path: str, config: TableConfig) -> None:
    spark.createDataFrame([(config.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def read_config(spark: SparkSession, path: str) -> TableConfig:
    return TableConfig.from_json(spark.read.text(f"{path}/config").first()[0])


def list_tables(spark: SparkSession, root: str) -> list[str]:
    """Names of the tables below a node's directory."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(base) if s.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "config")))
