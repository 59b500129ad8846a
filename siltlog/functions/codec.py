"""Byte codecs as expressions: big-endian numbers, length-prefixed frames, JSON values.

All stay in the JVM except floats, which have no built-in byte conversion and go through an Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def int_to_bytes(value: Column, width: int = 8) -> Column:
    """Big-endian two's complement."""
    digits = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    return F.unhex(F.substring(digits, 17 - 2 * width, 2 * width))


def bytes_to_int(data: Column, width: int = 8) -> Column:
    """The signed number in ``width`` big-endian bytes."""
    digits = F.hex(data)
    if width == 8:
        return F.conv(digits, 16, -10).cast("bigint")
    unsigned = F.conv(digits, 16, 10).cast("bigint")
    half, whole = 1 << (8 * width - 1), 1 << (8 * width)
    return F.when(unsigned >= half, unsigned - whole).otherwise(unsigned)


def frame(data: Column, length_width: int = 4) -> Column:
    """The bytes behind their length."""
    return F.concat(int_to_bytes(F.octet_length(data), length_width), data)


def unframe(data: Column, length_width: int = 4) -> Column:
    """The bytes of the first frame."""
    length = bytes_to_int(F.substring(data, 1, length_width), length_width).cast("int")
    return data.substr(F.lit(length_width + 1), length)


def text_to_bytes(value: Column) -> Column:
    return F.encode(value, "UTF-8")


def bytes_to_text(data: Column) -> Column:
    return F.decode(data, "UTF-8")


def json_to_bytes(value: Column) -> Column:
    """A struct, map or array as JSON in UTF-8."""
    return F.encode(F.to_json(value), "UTF-8")


def bytes_to_json(data: Column, schema: str) -> Column:
    return F.from_json(F.decode(data, "UTF-8"), schema)


def float_to_bytes(value: Column, width: int = 8) -> Column:
    """IEEE-754 big-endian, a batch at once."""

    @F.pandas_udf(T.BinaryType())
    def pack(s: pd.Series) -> pd.Series:
        data = s.to_numpy(dtype=np.float64, na_value=np.nan).astype(f">f{width}").tobytes()
        out = pd.Series([data[k : k + width] for k in range(0, len(data), width)], index=s.index, dtype=object)
        return out

    # null and NaN are the same in a pandas column, so null stays outside
    number = value.cast("double")
    return F.when(number.isNotNull(), pack(F.coalesce(number, F.lit(0.0))))


def bytes_to_float(data: Column, width: int = 8) -> Column:
    """The number in ``width`` bytes; null and bytes of another length give null."""

    @F.pandas_udf(T.DoubleType())
    def unpack(s: pd.Series) -> pd.Series:
        return pd.Series(np.frombuffer(b"".join(s), dtype=f">f{width}").astype(np.float64), index=s.index)

    good = data.isNotNull() & (F.octet_length(data) == width)
    return F.when(good, unpack(F.when(good, data).otherwise(F.lit(bytes(width)))))
