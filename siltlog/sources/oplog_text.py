"""Text op logs: one ``a <key>`` (add) or ``r <key>`` (remove) a line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(lines: DataFrame) -> DataFrame:
    """A log from (seq, line); lines that are neither operation are left out."""
    parts = lines.select("seq", F.regexp_extract("line", r"^\s*([ar])\s+(-?\d+)\s*$", 1).alias("o"), F.regexp_extract("line", r"^\s*([ar])\s+(-?\d+)\s*$", 2).alias("k"))
    return parts.where("o <> ''").select("seq", F.col("k").cast("bigint").alias("key"), F.when(F.col("o") == "a", "put").otherwise("del").alias("op"), F.lit("").alias("value"))


def from_lines(spark: SparkSession, lines: Sequence[str]) -> DataFrame:
    return parse(spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "seq long, line string"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A log from text files; seq (file, place of the split, number in it) follows the files' names and lines."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number"))
    return parse(spark.read.text(path).select(place.alias("seq"), F.col("value").alias("line")))
