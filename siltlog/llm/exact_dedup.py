"""Operator 9: exact dedup by content-defined chunk recipes.

Each text is normalised (A-Z lower-cased, nothing else) and cut where a rolling hash of the last
``WINDOW`` bytes hits a mask, so equal passages give equal chunks wherever they stand. A chunk's identifier
is the first bytes of its SHA-256, and it is verified: each task gives each of its distinct chunks once, they
meet by identifier, and their contents are compared byte by byte. A document's recipe is its ordered
identifier list; documents are equal if their recipes are. Where an identifier should stand for several
contents, recipes spell those contents out instead. A distinct chunk moves once a task however many
documents hold it, after that only recipes do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltlog.llm import kernels
from siltlog.llm.frames import durable, free_name, without_ids

WINDOW = 48
CUT_BITS = 11
MIN_CHUNK = 512
MAX_CHUNK = 16384
ID_BYTES = 16
#: Bytes of chunks a task remembers, so that it gives them once.
SEEN_BYTES = 32 << 20
#: More identifiers than these that stand for several contents mean that ``ID_BYTES`` is too small for the table.
MOST_DISPUTED = 100_000

_RECIPES = "doc_id long, n_bytes long, text_sha256 string, recipe binary"


def _boundaries(data: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash allows a cut."""
    if len(data) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    sums, inverses = kernels.prefix_hashes(data)
    rolled = (sums[WINDOW:] - sums[:-WINDOW]) * inverses[: len(data) - WINDOW + 1]
    return np.flatnonzero((kernels.mix(rolled) >> np.uint64(64 - CUT_BITS)) == 0) + WINDOW


def chunk_cuts(allowed: np.ndarray, n: int) -> list[int]:
    """Ends of the chunks of a text of ``n`` bytes, from the allowed cuts in it."""
    cuts, last = [], 0
    for at in allowed.tolist():
        while at - last > MAX_CHUNK:
            last += MAX_CHUNK
            cuts.append(last)
        if at - last >= MIN_CHUNK and at < n:
            cuts.append(at)
            last = at
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        cuts.append(last)
    return [*cuts, n]


def _chunks(texts: pa.Array) -> Iterator[tuple[bytes, list[int]]]:
    """The normalised text of each row and the ends of its chunks."""
    for lo, hi, data, offsets in kernels.text_slices(texts):
        lowered = data.tobytes().lower()
        allowed = _boundaries(np.frombuffer(lowered, dtype=np.uint8))
        for k in range(hi - lo):
            start, end = int(offsets[k]), int(offsets[k + 1])
            # a cut counts only if the whole window lies in this text
            inside = allowed[np.searchsorted(allowed, start + WINDOW) : np.searchsorted(allowed, end)] - start
            yield lowered[start:end], chunk_cuts(inside, end - start)


def _identifier(chunk: bytes, id_bytes: int) -> bytes:
    return hashlib.sha256(chunk).digest()[:id_bytes]


def _reciper(id_bytes: int, disputed: frozenset[bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, recipes = [], [], []
            for text, cuts in _chunks(batch.column(1)):
                begin, ids = 0, []
                for cut in cuts:
                    ids.append(_identifier(text[begin:cut], id_bytes))
                    if ids[-1] in disputed:
                        ids.append((cut - begin).to_bytes(4, "little") + text[begin:cut])
                    begin = cut
                sizes.append(len(text))
                digests.append(hashlib.sha256(text).hexdigest())
                recipes.append(b"".join(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(recipes, pa.binary())], names=["doc_id", "n_bytes", "text_sha256", "recipe"])

    return run


def _chunker(id_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        held = 0
        for batch in batches:
            for text, cuts in _chunks(batch.column(0)):
                begin = 0
                for cut in cuts:
                    chunk = text[begin:cut]
                    begin = cut
                    if chunk in seen:
                        seen[chunk] += 1
                    else:
                        seen[chunk] = 1
                        held += len(chunk) + 100
                if held > SEEN_BYTES:
                    yield _given(seen, id_bytes)
                    seen, held = {}, 0
        yield _given(seen, id_bytes)

    return run


def _given(seen: dict[bytes, int], id_bytes: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_identifier(c, id_bytes) for c in seen], pa.binary()), pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["chunk_id", "content", "n_uses"])


def recipes(docs: DataFrame, id_bytes: int = ID_BYTES, disputed: frozenset[bytes] = frozenset()) -> DataFrame:
    """doc_id, n_bytes, text_sha256, recipe (the identifiers, joined; a disputed one has its content behind it)."""
    return docs.select("doc_id", "text").mapInArrow(_reciper(id_bytes, disputed), _RECIPES)


def chunk_table(docs: DataFrame, id_bytes: int = ID_BYTES) -> DataFrame:
    """chunk_id, n_bytes (of all its contents), n_uses, n_contents of every identifier.

    Contents meet by identifier and are told apart by comparing them; n_contents is 1 where the identifier stands
    for one content alone. The sizes show what storing chunks once saves.
    """
    given = docs.select("text").mapInArrow(_chunker(id_bytes), "chunk_id binary, content binary, n_uses long").repartition("chunk_id")
    contents = given.groupBy("chunk_id", "content").agg(F.sum("n_uses").alias("n_uses"))
    return contents.groupBy("chunk_id").agg(F.sum(F.octet_length("content")).alias("n_bytes"), F.sum("n_uses").alias("n_uses"), F.count("*").alias("n_contents"))


def _disputed(docs: DataFrame, id_bytes: int) -> frozenset[bytes]:
    """The identifiers that stand for several contents: none, unless the digest is cut too short."""
    found = chunk_table(docs, id_bytes).where("n_contents > 1").select("chunk_id").limit(MOST_DISPUTED + 1).collect()
    if len(found) > MOST_DISPUTED:
        raise ValueError(f"identifiers of {id_bytes} bytes are too short for these texts")
    return frozenset(bytes(r.chunk_id) for r in found)


def exact_dedup(docs: DataFrame, id_bytes: int = ID_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts are those identical after lower-casing A-Z; the row with the largest doc_id stays.
    A null text counts as empty, so nulls and empty texts form one group. Rows repeated with the same
    doc_id are all reported, all count in group_size and are kept alike. A null doc_id never wins over a
    number. Very long texts have long recipes and are treated like others. An empty table gives no rows. Extra
    columns are ignored.

    The recipes are reduced on the map side before they are shuffled, so a group that holds a third of all
    rows costs one row per task; joining the group's figures back is a plain equi-join of two
    checkpointed light tables, whose hot partition adaptive execution splits.
    """
    light = durable(recipes(docs, id_bytes, _disputed(docs, id_bytes)).select("doc_id", "text_sha256", "recipe"))
    groups = light.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = durable(groups.select(F.col("recipe").alias("g_recipe"), "keep_id", "group_size"))
    joined = light.join(groups, light.recipe == groups.g_recipe)
    return joined.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def unique_documents(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns.

    Where no doc_id repeats (one light aggregation tells) the dropped ids alone are joined; otherwise rows are
    told apart by doc_id and digest, and one of several equal ones stays.
    """
    verdicts = durable(exact_dedup(docs).select("doc_id", "text_sha256", "kept"))
    if not verdicts.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return without_ids(docs, verdicts.where("NOT kept").select("doc_id"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    digest, kept_id, kept_digest = (free_name(docs, n) for n in ("digest", "kept_id", "kept_digest"))
    told = docs.withColumn(digest, F.sha2(F.encode(F.translate(F.coalesce("text", F.lit("")), upper, lower), "UTF-8"), 256))
    kept = verdicts.where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_digest)).distinct()
    stays = told.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(digest) == F.col(kept_digest)), "left_semi")
    return stays.dropDuplicates(["doc_id", digest]).select(*docs.columns)
