"""Operator 5: benchmark decontamination by greedy string tiling.

Benchmark items are a query set, matched in blocks: each block of at most ``BLOCK_BYTES`` of item text is
broadcast (so what is broadcast is bounded however large the benchmark is) and one pass over the documents
is made for each block. In a pass, a document's rolling hashes of ``seed`` words are looked up among the
block's. Every tile is made of seeds, so an item can only be covered where its seeds stand in the document;
where that suffices for the threshold the two are tiled: the longest non-overlapping matches are marked
first, found by running Karp-Rabin over the unmarked words with a falling search length. A line that many
items and documents share so costs no tiling. An item whose
words are covered by tiles to the threshold marks the document as contaminated, in whatever order its
passages stand. Documents never move; only found pairs leave a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltlog.llm import kernels

SEED_WORDS = 5
COVERAGE = 0.5
BLOCK_BYTES = 16 << 20
_START_LENGTH = 20
_BASE = 1_000_003
_MASK = (1 << 61) - 1
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def word_ids(text: bytes, known: dict[bytes, int]) -> list[int]:
    """A number for each word; equal numbers mean equal words (A-Z lower-cased)."""
    return [known.setdefault(w, len(known)) for w in _WORD.findall(text.lower())]


def _windows(words: list[int], marked: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of each run of ``length`` unmarked words."""
    top = pow(_BASE, length - 1, _MASK)
    value = run = 0
    for i, word in enumerate(words):
        if marked[i]:
            value = run = 0
            continue
        if run == length:
            value -= (words[i - length] + 1) * top
            run -= 1
        value = (value * _BASE + word + 1) % _MASK
        run += 1
        if run == length:
            yield i - length + 1, value


def _scan(item: list[int], item_marked: list[bool], doc: list[int], doc_marked: list[bool], length: int) -> tuple[int, list[tuple[int, int, int]]]:
    """The maximal matches of at least ``length`` words; stops early at one over twice as long."""
    places: dict[int, list[int]] = {}
    for start, value in _windows(doc, doc_marked, length):
        places.setdefault(value, []).append(start)
    longest, found = 0, []
    for p, value in _windows(item, item_marked, length):
        for t in places.get(value, ()):
            n = 0
            while p + n < len(item) and t + n < len(doc) and item[p + n] == doc[t + n] and not item_marked[p + n] and not doc_marked[t + n]:
                n += 1
            if n > 2 * length:
                return n, []
            if n >= length:
                found.append((n, p, t))
                longest = max(longest, n)
    return longest, found


def tiles(item: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, start in item, start in doc) of each tile of at least ``least`` words."""
    item_marked, doc_marked, out = [False] * len(item), [False] * len(doc), []
    length = max(least, _START_LENGTH)
    while True:
        longest, found = _scan(item, item_marked, doc, doc_marked, length)
        if longest > 2 * length:
            length = longest
            continue
        for n, p, t in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if not any(item_marked[p : p + n]) and not any(doc_marked[t : t + n]):
                item_marked[p : p + n] = [True] * n
                doc_marked[t : t + n] = [True] * n
                out.append((n, p, t))
            # what is left of a match that another tile cuts is found again with a smaller length
        if length > 2 * least:
            length //= 2
        elif length > least:
            length = least
        elif any(True for n, p, t in found if _left_over(n, p, t, item_marked, doc_marked, least)):
            continue
        else:
            return out


def _left_over(n: int, p: int, t: int, item_marked: list[bool], doc_marked: list[bool], least: int) -> bool:
    run = 0
    for k in range(n):
        run = 0 if item_marked[p + k] or doc_marked[t + k] else run + 1
        if run >= least:
            return True
    return False


class _Block:
    """The seeds of a block of items: hashes of every run of ``seed`` words, or of a shorter item's words."""

    def __init__(self, items: list[tuple[int, str]], seed: int) -> None:
        self.items = [(i, (t or "").encode()) for i, t in items]
        self.short: dict[int, list[int]] = {}
        values, owners, starts = [], [], []
        self.lengths = np.zeros(len(items), dtype=np.int64)
        column = pa.array([t or "" for _, t in items], pa.large_string())
        for lo, hi, data, offsets in kernels.text_slices(column):
            hashes, _, _, first = kernels.words(kernels.ascii_lower(data), offsets)
            for k in range(hi - lo):
                own = hashes[first[k] : first[k + 1]]
                self.lengths[lo + k] = len(own)
                if len(own):
                    if len(own) < seed:
                        self.short.setdefault(len(own), []).append(lo + k)
                    values.append(kernels.shingles(own, min(seed, len(own))))
                    owners.append(np.full(len(values[-1]), lo + k))
                    starts.append(np.arange(len(values[-1])))
        self.values = np.concatenate(values) if values else np.zeros(0, dtype=np.uint64)
        self.owners = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
        order = np.argsort(self.values, kind="stable")
        self.values, self.owners = self.values[order], self.owners[order]
        self.starts = np.concatenate(starts)[order] if starts else np.zeros(0, dtype=np.int64)
        # a bit for each value's low bits: most of a document's hashes end there
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[(self.values & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``hashes``, number of the seed) of every hash that is a seed."""
        maybe = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.values, hashes[maybe], "left"), np.searchsorted(self.values, hashes[maybe], "right")
        counts = hi - lo
        at = np.repeat(maybe, counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return at, np.repeat(lo, counts) + inside

    def reachable(self, docs: np.ndarray, seeds: np.ndarray, coverage: float, seed: int) -> Iterator[tuple[int, int]]:
        """(document, item) where the item's words in seeds that stand in the document reach the threshold."""
        items, starts = self.owners[seeds], self.starts[seeds]
        order = np.lexsort((starts, items, docs))
        docs, items, starts = docs[order], items[order], starts[order]
        if not len(docs):
            return
        new = np.ones(len(docs), dtype=bool)
        new[1:] = (docs[1:] != docs[:-1]) | (items[1:] != items[:-1])
        width = np.minimum(seed, self.lengths[items])
        fresh = width.copy()
        same = ~new[1:]
        fresh[1:][same] = np.minimum(width[1:], starts[1:] - starts[:-1])[same]
        heads = np.flatnonzero(new)
        words = np.add.reduceat(fresh, heads)
        for k in heads[words >= coverage * self.lengths[items[heads]]].tolist():
            yield int(docs[k]), int(items[k])


_built: dict[tuple[str, int], _Block] = {}


def _block_of(shared, seed: int) -> _Block:
    """The block in a broadcast (its digest, its items), built once in a worker."""
    digest, items = shared.value
    if (digest, seed) not in _built:
        while len(_built) >= 4:
            _built.pop(next(iter(_built)))
        _built[digest, seed] = _Block(items, seed)
    return _built[digest, seed]


def _matches(texts: pa.Array, block: _Block, seed: int, coverage: float) -> Iterator[tuple]:
    """(row, item_id, item words, covered words, tiles) of every covered item of every text."""
    for lo, hi, data, offsets in kernels.text_slices(texts):
        lowered = kernels.ascii_lower(data)
        hashes, _, _, first = kernels.words(lowered, offsets)
        every_doc, every_seed = [], []
        for n in {seed, *block.short}:
            at, hit = block.hits(kernels.shingles(hashes, n))
            doc = np.searchsorted(first, at, side="right") - 1
            good = (at + n <= first[doc + 1]) & (np.minimum(seed, block.lengths[block.owners[hit]]) == n)
            every_doc.append(doc[good])
            every_seed.append(hit[good])
        last, known, doc_words = -1, {}, []
        for k, item in block.reachable(np.concatenate(every_doc), np.concatenate(every_seed), coverage, seed):
            if k != last:
                last, known = k, {}
                doc_words = word_ids(lowered[offsets[k] : offsets[k + 1]].tobytes(), known)
            number, text = block.items[item]
            words = word_ids(text, known)
            found = tiles(words, doc_words, min(seed, len(words)))
            covered = sum(n for n, _, _ in found)
            if found and covered >= coverage * len(words):
                yield lo + k, number, len(words), covered, found


def _matcher(shared, seed: int, coverage: float) -> Callable:
    names = ["doc_id", "item_id", "item_words", "covered_words", "n_tiles", "longest_tile", "tiles"]
    kinds = [pa.int64()] * 6 + [pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _block_of(shared, seed)
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for row, number, n_words, covered, found in _matches(batch.column(1), block, seed, coverage):
                spans = [{"start": t, "words": n} for n, _, t in sorted(found, key=lambda m: m[2])]
                for column, value in zip(columns, (batch.column(0)[row].as_py(), number, n_words, covered, len(found), max(n for n, _, _ in found), spans)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return run


def _cleaner(shared, seed: int, coverage: float, at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _block_of(shared, seed)
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for row, *_ in _matches(batch.column(at), block, seed, coverage):
                keep[row] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame) -> Iterator[tuple[str, list[tuple[int, str]]]]:
    """(digest, items) of blocks of about ``BLOCK_BYTES``, read a partition at a time."""
    block, held, digest = [], 0, hashlib.sha256()
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        digest.update(repr((row.item_id, row.text)).encode())
        held += 4 * len(row.text or "") + 64
        if held >= BLOCK_BYTES:
            yield digest.hexdigest(), block
            block, held, digest = [], 0, hashlib.sha256()
    if block:
        yield digest.hexdigest(), block


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document and benchmark item that the document covers to the threshold.

    doc_id, item_id, item_words, covered_words, n_tiles, longest_tile, tiles array<struct<start, words>>
    (word positions in the document). Words are what ASCII white space separates, A-Z lower-cased. A tile has
    at least ``seed`` words, or all of a shorter item. Items and documents without words (null, empty) match
    nothing; repeated rows are reported for each, very long texts are read whole; an empty table on either side
    gives no rows; extra columns are ignored.
    """
    schema = "doc_id long, item_id long, item_words long, covered_words long, n_tiles long, longest_tile long, tiles array<struct<start: long, words: long>>"
    source, out = docs.select("doc_id", "text"), None
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found = source.mapInArrow(_matcher(shared, seed, coverage), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else source.limit(0).selectExpr("doc_id", *[f"CAST(NULL AS LONG) AS {c}" for c in ("item_id", "item_words", "covered_words", "n_tiles", "longest_tile")], "CAST(NULL AS array<struct<start: long, words: long>>) AS tiles")


def clean_documents(docs: DataFrame, benchmark: DataFrame, seed: int = SEED_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """The documents that cover no item, with all their columns; each block filters rows where they are.

    Null and empty texts cover nothing and stay; rows are judged one by one, so repeated rows and ids do no harm.
    """
    out, at = docs, docs.columns.index("text")
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(_cleaner(shared, seed, coverage, at), docs.schema)
    return out
