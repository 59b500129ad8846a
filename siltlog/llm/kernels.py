"""Vectorised text kernels over Arrow string buffers.

Texts stay UTF-8 bytes: word separators are ASCII, so no separator byte occurs inside a multi-byte
character. A batch is walked in slices of about ``SLICE_BYTES``, so temporaries stay small whatever the
batch size; only one text longer than that makes a longer slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _U(0xD6E8FEB86659FD93)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32

_powers = np.ones(1, dtype=_U)
_inverses = np.ones(1, dtype=_U)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, 2 * SLICE_BYTES)

        def column(base: int) -> np.ndarray:
            factors = np.full(size, base, dtype=_U)
            factors[0] = 1
            return np.cumprod(factors, dtype=_U)

        _powers, _inverses = column(_BASE), column(_BASE_INVERSE)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of the result depends on every bit of the input."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of each slice; a null counts as empty."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    _, starts, data = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(starts, dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    pa.default_memory_pool().release_unused()


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums S and inverse powers; ``(S[e] - S[s]) * inverse[s]`` is the hash of bytes s..e."""
    powers, inverses = _tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * powers[: len(data)], out=sums[1:])
    return sums, inverses


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _ASCII_LOWER[data]


#: Separators for classifiers: every ASCII byte that is neither a letter nor a digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _IS_SPACE, prefixes: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words, and for each text the number of words before it.

    A word is a maximal run of bytes that are no separators (by default 0x20 and 0x09-0x0D); it never
    crosses a text boundary. ``prefixes``: what ``prefix_hashes`` gives for the data, if known.
    """
    if not len(data):
        zero = np.zeros(0, dtype=np.int64)
        return zero.astype(_U), zero, zero, np.zeros(len(offsets), dtype=np.int64)
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[(cuts > 0)] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums, inverses = prefixes or prefix_hashes(data)
    hashes = mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(_U))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` consecutive words; the caller cuts at text boundaries."""
    if len(hashes) < width:
        return np.zeros(0, dtype=_U)
    out = hashes[: len(hashes) - width + 1].copy()
    for j in range(1, width):
        out *= _STEP
        out += hashes[j : len(hashes) - width + 1 + j]
    return mix(out)


def whole_sequence(hashes: np.ndarray) -> np.ndarray:
    """One hash for a text with fewer words than a shingle needs."""
    out = _U(len(hashes))
    with np.errstate(over="ignore"):
        for h in hashes:
            out = out * _STEP + h
    return mix(np.array([out], dtype=_U))
