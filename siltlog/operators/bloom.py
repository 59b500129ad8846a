"""Bloom filters as sets of bit positions, computed with whole-number arithmetic that any engine repeats.

Position i of a key is (h1 + i * h2) mod m. h1 and h2 have 62 bits, two times (a * key + b) mod 2**31 - 1 each, so
filters of any size fill evenly. Keys that are no whole numbers are hashed to one of 64 bits first. A filter
is a table of set bits; merging filters is a union, testing a join, so no filter has to fit in one row; one of
at most ``LITERAL_BITS`` bits is tested in place, from words that stand in the plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PRIME = (1 << 31) - 1
_FIRST = ((1_103_515_245, 12_345), (1_664_525, 1_013_904_223))
_SECOND = ((22_695_477, 1), (1_140_671_485, 12_820_163))
LITERAL_BITS = 1 << 19


def parameters(items: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions for a number of items and a false-positive rate."""
    bits = max(1, math.ceil(-items * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, math.ceil(bits / max(1, items) * math.log(2)))


def parameter_columns(items: Column, rate: Column) -> tuple[Column, Column]:
    bits = F.greatest(F.lit(1), F.ceil(-items * F.ln(rate) / F.lit(math.log(2) ** 2))).cast("bigint")
    return bits, F.greatest(F.lit(1), F.ceil(bits / F.greatest(F.lit(1), items) * F.lit(math.log(2)))).cast("bigint")


def _hash(key: Column, pairs: tuple[tuple[int, int], tuple[int, int]]) -> Column:
    # both halves of the key count
    low, high = F.pmod(key, F.lit(_PRIME)), F.pmod(F.shiftright(key, 31), F.lit(_PRIME))
    halves = [F.pmod(F.pmod(low * a + b, F.lit(_PRIME)) + F.pmod(high * b, F.lit(_PRIME)), F.lit(_PRIME)) for a, b in pairs]
    return halves[0] * F.lit(1 << 31) + halves[1]


def whole_number(key: Column | str, whole: bool = True) -> Column:
    """The key itself if it is a whole number, else a hash of 64 bits."""
    key = F.col(key) if isinstance(key, str) else key
    return key.cast("bigint") if whole else F.xxhash64(key)


def positions(key: Column, bits: int, functions: int) -> Column:
    """array<bigint> of the bit positions of a whole-number key."""
    h1, h2 = _steps(key, bits)
    return F.array(*[F.pmod(h1 + i * h2, F.lit(bits)) for i in range(functions)])


def _steps(key: Column, bits: int) -> tuple[Column, Column]:
    h1, h2 = (F.pmod(_hash(key.cast("bigint"), pairs), F.lit(bits)) for pairs in (_FIRST, _SECOND))
    return h1, h2


def build(keys: DataFrame, key: Column, bits: int, functions: int) -> DataFrame:
    """bit: the set positions. Partial aggregation reduces each task to at most ``bits`` rows."""
    return keys.select(F.explode(positions(key, bits, functions)).alias("bit")).distinct()


class MismatchError(ValueError):
    """Filters of different parameters do not go together."""


def merge(*filters: DataFrame, parameters: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """The union of filters; ``parameters``, if given, are their (bits, functions), which have to be the same."""
    if len(set(parameters)) > 1:
        raise MismatchError(f"filters of {sorted(set(parameters))} bits and functions cannot be merged")
    out = filters[0]
    for other in filters[1:]:
        out = out.unionByName(other)
    return out.distinct()


def test(probes: DataFrame, key: Column, bloom: DataFrame, bits: int, functions: int) -> DataFrame:
    """The probe rows, repeated ones too, with ``maybe``: False is certain, True may be wrong at about the filter's rate."""
    if bits <= LITERAL_BITS:
        packed = dict(words(bloom).collect())  # at most LITERAL_BITS / 32 numbers
        text = ",".join(str(packed.get(k, 0)) for k in range(bits // 32 + 1))
        table = F.split(F.lit(text), ",").cast("array<bigint>")
        first, second = _steps(key, bits)
        stepped = probes.withColumns({"h1_": first, "h2_": second})
        maybe = F.lit(True)
        for i in range(functions):
            p = F.pmod(F.col("h1_") + i * F.col("h2_"), F.lit(bits))
            maybe &= F.getbit(F.element_at(table, (F.shiftright(p, 5) + 1).cast("int")), p.bitwiseAND(F.lit(31)).cast("int")) == 1
        return stepped.withColumn("maybe", F.coalesce(maybe, F.lit(False))).drop("h1_", "h2_")
    asked = probes.select(key.cast("bigint").alias("k_")).distinct()
    places = asked.withColumn("bit_", F.explode(F.array_distinct(positions(F.col("k_"), bits, functions))))
    set_bits = bloom.select(F.col("bit").alias("b_bit_"), F.lit(True).alias("hit_"))
    tested = places.join(set_bits, F.col("bit_") == F.col("b_bit_"), "left").groupBy("k_").agg(F.min(F.coalesce("hit_", F.lit(False))).alias("m_"))
    return probes.join(tested, key.cast("bigint") == F.col("k_"), "left").select(*[probes[c] for c in probes.columns], F.coalesce("m_", F.lit(False)).alias("maybe"))


def write(bloom: DataFrame, path: str, bits: int, functions: int) -> None:
    """The filter's words as Parquet, with its parameters in every row."""
    words(bloom).withColumn("bits", F.lit(bits).cast("bigint")).withColumn("functions", F.lit(functions)).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """(filter, bits, functions) of a written filter; an empty filter has no parameters to read."""
    rows = spark.read.parquet(path)
    first = rows.select("bits", "functions").first()
    if first is None:
        raise ValueError(f"no filter in {path}")
    return rows.select(F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(F.getbit("value", i) == 1, F.col("word") * 32 + i)), lambda b: b.isNotNull())).alias("bit")), first.bits, first.functions


def words(bloom: DataFrame, width: int = 32) -> DataFrame:
    """The filter packed: word number and its bits as a whole number."""
    return bloom.groupBy(F.floor(F.col("bit") / width).cast("bigint").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, CAST(bit % {width} AS INT)))").alias("value"))
