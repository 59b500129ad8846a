"""Small value functions: type names, seeded random letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def type_name(value: Column) -> Column:
    return F.typeof(value)


def random_letters(length: int, key: Column, seed: int = 0) -> Column:
    """``length`` ASCII letters that follow from key and seed, so a rerun gives the same ones."""
    place = lambda i: F.pmod(F.xxhash64(key, F.lit(seed), i), F.lit(len(_LETTERS))).cast("int") + 1
    letters = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substring(F.lit(_LETTERS), place(i), F.lit(1)))
    return F.array_join(letters, "") if length else F.lit("")
