"""Key types and table configuration."""

from __future__ import annotations

import dataclasses
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclasses.dataclass(frozen=True)
class KeyType:
    """``width`` is the encoded size in bytes, None for keys of varying size."""

    name: str
    spark: T.DataType
    width: int | None
    floating: bool = False

    @property
    def dynamic(self) -> bool:
        return self.width is None


KEY_TYPES = {
    k.name: k
    for k in (
        KeyType("int32", T.IntegerType(), 4),
        KeyType("int64", T.LongType(), 8),
        KeyType("float32", T.FloatType(), 4, floating=True),
        KeyType("float64", T.DoubleType(), 8, floating=True),
        KeyType("string", T.StringType(), None),
        KeyType("bytes", T.BinaryType(), None),
        KeyType("timestamp", T.TimestampNTZType(), 8),
    )
}


def key_type(name: str) -> KeyType:
    if name not in KEY_TYPES:
        raise ValueError(f"unknown key type {name!r}; known: {', '.join(KEY_TYPES)}")
    return KEY_TYPES[name]


def order_columns(key: Column | str, kind: KeyType) -> list[Column]:
    """Sort columns for a key. NaN sorts before every number, where Spark alone would sort it last."""
    key = F.col(key) if isinstance(key, str) else key
    return [~F.isnan(key), key] if kind.floating else [key]


def key_size(key: Column | str, kind: KeyType) -> Column:
    """Bytes of the encoded key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.octet_length(key).cast("bigint") if kind.dynamic else F.lit(kind.width).cast("bigint")


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; NaN is below every other value and equal to itself."""
    order = F.when(a.eqNullSafe(b), 0).when(a < b, -1).otherwise(1)
    return order


def compare_floats(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) & F.isnan(b), 0).when(F.isnan(a), -1).when(F.isnan(b), 1).when(a == b, 0).when(a < b, -1).otherwise(1)


_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
MEMTABLES = ("redblack",)


@dataclasses.dataclass(frozen=True)
class TableConfig:
    """A table's settings; defaults apply to whatever is not given (or given as 0 or an empty string)."""

    name: str
    key_type: str = "int64"
    memtable: str = "redblack"
    max_memtable_bytes: int = 65536
    block_size: int = 16384
    min_index_interval: int = 128
    max_index_interval: int = 4096
    max_summary_bytes: int = 5242880
    bloom_rate: float = 0.1

    def __post_init__(self) -> None:
        for field in dataclasses.fields(self)[1:]:
            if not getattr(self, field.name):
                object.__setattr__(self, field.name, field.default)
        if not _NAME.match(self.name or ""):
            raise ValueError(f"a table needs a name of letters, digits and underscores, not {self.name!r}")
        key_type(self.key_type)
        if self.memtable not in MEMTABLES:
            raise ValueError(f"unknown memtable {self.memtable!r}")
        if not 0 < self.bloom_rate < 1:
            raise ValueError("bloom_rate lies between 0 and 1")

    @property
    def key(self) -> KeyType:
        return key_type(self.key_type)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    @classmethod
    def from_json(cls, text: str) -> TableConfig:
        return cls(**json.loads(text))

    def to_toml(self) -> str:
        return "".join(f"{k} = {json.dumps(v)}\n" for k, v in dataclasses.asdict(self).items())

    @classmethod
    def from_toml(cls, text: str) -> TableConfig:
        import tomllib

        return cls(**tomllib.loads(text))
