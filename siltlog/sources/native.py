"""Reader and writer of the block file formats of runs (``.dat`` data, ``.idx`` sparse index, ``.sum`` summary).

``.dat`` is a row of blocks, each a u32 length and a gzip member; a decompressed block is a row of records
``[u32 key length][key][u32 value length][value]``; all numbers are big-endian. ``.idx`` is a row of
``[u32 key length][key][u32 block offset][u32 offset in block]``. ``.sum`` is text: metadata lines ``k=v``, a
line of six hyphens, statistics lines, a line of hyphens. A file is one unit of reading, and files are read
in parallel.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.config import KeyType, TableConfig, order_columns
from siltlog.functions import codec
from siltlog.operators.memtable import ENTRY_BYTES
from siltlog.operators.ordered import dealt, ranged

_WORD = struct.Struct(">I")


def _take(data: bytes, at: int) -> tuple[bytes, int]:
    (n,) = _WORD.unpack_from(data, at)
    return data[at + 4 : at + 4 + n], at + 4 + n


def blocks_of(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(number, offset in the file, decompressed bytes) of each block."""
    at = number = 0
    while at < len(data):
        packed, after = _take(data, at)
        yield number, at, gzip.decompress(packed)
        at, number = after, number + 1


def records_of(block: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset in the block, key, value) of each record."""
    at = 0
    while at < len(block):
        start = at
        key, at = _take(block, at)
        value, at = _take(block, at)
        yield start, key, value


def _key(kind: KeyType, raw: str = "key_bytes"):
    if kind.name == "string":
        return codec.bytes_to_text(F.col(raw))
    if kind.name == "bytes":
        return F.col(raw)
    if kind.floating:
        return codec.bytes_to_float(F.col(raw), kind.width).cast(kind.spark)
    return codec.bytes_to_int(F.col(raw), kind.width).cast(kind.spark)


def read_data(spark: SparkSession, path: str, kind: KeyType) -> DataFrame:
    """path, block, block_offset, inner_offset, key, value, is_tombstone of every record."""
    return decode_data(spark.read.format("binaryFile").load(path).select("path", "content"), kind)


def decode_data(files: DataFrame, kind: KeyType) -> DataFrame:
    """The same from path and content of data files."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                for number, offset, block in blocks_of(content):
                    rows = [(name, number, offset, inner, key, value) for inner, key, value in records_of(block)]
                    yield pd.DataFrame(rows, columns=["path", "block", "block_offset", "inner_offset", "key_bytes", "value"])

    rows = files.mapInPandas(decode, "path string, block long, block_offset long, inner_offset long, key_bytes binary, value binary")
    return rows.select("path", "block", "block_offset", "inner_offset", _key(kind).alias("key"), "value", (F.octet_length("value") == 0).alias("is_tombstone"))


def read_index(spark: SparkSession, path: str, kind: KeyType) -> DataFrame:
    """path, entry, key, block_offset, inner_offset of every index entry."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                rows, at = [], 0
                while at < len(content):
                    key, at = _take(content, at)
                    block, inner = struct.unpack_from(">II", content, at)
                    at += 8
                    rows.append((name, len(rows), key, block, inner))
                yield pd.DataFrame(rows, columns=["path", "entry", "key_bytes", "block_offset", "inner_offset"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(decode, "path string, entry long, key_bytes binary, block_offset long, inner_offset long")
    return rows.select("path", "entry", _key(kind).alias("key"), "block_offset", "inner_offset")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """path, section ('metadata' or 'statistics'), name, value of each line."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                rows = []
                for section, part in zip(("metadata", "statistics"), content.split(b"------\n")):
                    rows += [(name, section, *line.split("=", 1)) for line in part.decode("utf-8", "replace").splitlines() if "=" in line]
                yield pd.DataFrame(rows, columns=["path", "section", "name", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, section string, name string, value string")


def encode_run(records: Iterable[tuple[bytes, bytes]], block_size: int, interval: int) -> tuple[bytes, bytes]:
    """The ``.dat`` and ``.idx`` bytes of records in key order."""
    data, index, held, offset, number = bytearray(), bytearray(), bytearray(), 0, 0
    for key, value in records:
        if number % interval == 0 or not held:
            index += _WORD.pack(len(key)) + key + struct.pack(">II", offset, len(held))
        held += _WORD.pack(len(key)) + key + _WORD.pack(len(value)) + value
        number += 1
        if len(held) >= block_size:
            packed = gzip.compress(bytes(held), mtime=0)
            data += _WORD.pack(len(packed)) + packed
            offset, held = len(data), bytearray()
    if held:
        packed = gzip.compress(bytes(held), mtime=0)
        data += _WORD.pack(len(packed)) + packed
    return bytes(data), bytes(index)


def summary_text(metadata: dict[str, object], statistics: dict[str, object]) -> str:
    """The text of a ``.sum`` file."""
    lines = lambda d: "".join(f"{k}={v}\n" for k, v in d.items())
    return f"{lines(metadata)}------\n{lines(statistics)}------\n"


def encode(rows: DataFrame, config: TableConfig, gen: int) -> DataFrame:
    """part, dat, idx, sum: the files of a run (``rows``: key, value, is_tombstone), a set for each key range.

    Ranges are written apart, in parallel; a range has to fit in a task, and its files below 2 GB. A tombstone is an
    empty value.
    """
    kind = config.key
    order = order_columns("key", kind)
    key_bytes = codec.text_to_bytes(F.col("key")) if kind.name == "string" else F.col("key") if kind.name == "bytes" else codec.float_to_bytes(F.col("key"), kind.width) if kind.floating else codec.int_to_bytes(F.col("key"), kind.width)
    value = F.when(F.col("is_tombstone"), F.lit(b"")).otherwise(F.coalesce("value", F.lit(b"")))
    parts = dealt(ranged(rows, order), order).select(F.col("part_").alias("part"), key_bytes.alias("key_bytes"), value.alias("value"))

    def files(part: int, keys: list[bytes], values: list[bytes]) -> list:
        data, index = encode_run(zip(keys, values), config.block_size, config.min_index_interval)
        sizes = sum(map(len, keys)), sum(map(len, values))
        metadata = {"gen": gen, "part": part, "sparse_type": "idx", "interval": config.min_index_interval}
        statistics = {"records": len(keys), "total_key_size": sizes[0], "total_data_size": sizes[1], "flushed_at_mem_size": sum(sizes) + ENTRY_BYTES * len(keys)}
        return [part, data, index, summary_text(metadata, statistics)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, keys, values = None, [], []
        for frame in frames:
            for part, group in frame.groupby("part", sort=True):
                if keys and part != last:
                    yield pd.DataFrame([files(last, keys, values)], columns=["part", "dat", "idx", "sum"])
                    keys, values = [], []
                last = part
                keys += group["key_bytes"].tolist()
                values += group["value"].tolist()
        if keys:
            yield pd.DataFrame([files(last, keys, values)], columns=["part", "dat", "idx", "sum"])

    return parts.mapInPandas(run, "part int, dat binary, idx binary, sum string")


def dump_blocks(records: DataFrame, limit: int | None = None) -> DataFrame:
    """block, n_records, first_key, last_key of each block, the first ``limit`` blocks if given."""
    out = records.groupBy("path", "block").agg(F.count("*").alias("n_records"), F.min_by("key", "inner_offset").alias("first_key"), F.max_by("key", "inner_offset").alias("last_key")).orderBy("path", "block")
    return out if limit is None else out.limit(limit)


def find(records: DataFrame, key: object) -> DataFrame:
    """Every record of a key."""
    return records.where(F.col("key") == F.lit(key))
