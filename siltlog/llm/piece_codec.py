"""Operator 8: SentencePiece encoding and decoding through a distinct-chunk table.

The model's pieces never hold a white-space marker after another character (checked on load), so a
segmentation never crosses the point before a marker run. Each text is cut there into marked words. A first
pass counts the distinct marked words of all documents; those that occur again, the most frequent first as
far as ``TABLE_BYTES`` holds them, are segmented once for the whole table and sent to all workers with their
ids (packed) and what they decode to. A text's ids are its words' packed ids joined in order, where the text
stands, so no text is shuffled. A word beside the table is segmented where it occurs: most occur once, and a
worker keeps up to ``LOCAL_ENTRIES`` from one batch to the next. Neither bound changes a result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Callable, Collection, Iterator, Sequence
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltlog.llm.frames import durable

MARK = "▁"
#: The broadcast table's words have so many bytes at most, counting ``WORD_BYTES`` more for each.
TABLE_BYTES = 16 << 20
WORD_BYTES = 64
#: Words that a worker keeps besides the table.
LOCAL_ENTRIES = 100_000
#: Longer words, in characters, are segmented where they occur.
LONGEST_KEPT = 256
#: A task hands on its counts after so many distinct words, or so many characters.
COUNTED_WORDS = 250_000
COUNTED_CHARS = 1 << 26
#: A marked word: a run of spaces or markers and what follows it up to the next such run.
_MARKED = re.compile(f"[ {MARK}]+[^ {MARK}]*")

_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: words, their packed ids, and their decoded surfaces
Entries = tuple[list[str], list[bytes], list[bytes]]


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first marker; the text's own first marker is added."""
    if "  " in text or MARK in text or text[:1] == " ":
        return [w[1:] for w in _MARKED.findall(" " + text)]
    return text.split(" ") if text else []


class ChunkTable:
    """marked word -> ids as little-endian u32, and -> decoded surface in UTF-8."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        crossing = [p for p in pieces if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross white-space markers: {crossing[:5]}")
        # what decoding gives for each id inside a text; byte pieces stand for their byte
        self.surfaces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.lead = len(self.model.encode("a"))
        self.begin = array("I", [self.model.bos_id()]).tobytes()
        self.end = array("I", [self.model.eos_id()]).tobytes()
        self.source: str | None = None
        self.load(None, ([], [], []))

    def load(self, source: str | None, entries: Entries) -> None:
        """Starts from a broadcast table, which ``source`` tells apart from others."""
        words, ids, surfaces = entries
        self.source, self.local = source, []
        self.ids, self.decoded = dict(zip(words, ids)), dict(zip(words, surfaces))

    def segment(self, words: Collection[str]) -> tuple[list[bytes], list[bytes]]:
        # behind a one-letter word a marked word keeps all its markers; the library adds its own only in front
        packed, decoded, surfaces, unknown = [], [], self.surfaces, self.model.unk_id()
        for ids in self.model.encode(["a " + w for w in words], num_threads=1):
            ids = ids[self.lead :]
            if unknown in ids:
                raise ValueError("the model has pieces for less than all bytes")
            packed.append(array("I", ids).tobytes())
            decoded.append(b"".join([surfaces[i] for i in ids]))
        return packed, decoded

    def encode(self, texts: Sequence[str]) -> list[tuple[bytes, bytes]]:
        """For each text the packed ids with begin and end, and the decoded text in UTF-8."""
        marked = [marked_words(t) for t in texts]
        fresh = list(set().union(*marked).difference(self.ids))
        packed, decoded = self.segment(fresh)
        self.ids.update(zip(fresh, packed))
        self.decoded.update(zip(fresh, decoded))
        out = []
        for words in marked:
            out.append((b"".join((self.begin, *map(self.ids.__getitem__, words), self.end)), b"".join(map(self.decoded.__getitem__, words))[1:]))
        self.local += [w for w in fresh if len(w) <= LONGEST_KEPT]
        leaving = [w for w in fresh if len(w) > LONGEST_KEPT]
        if len(self.local) > LOCAL_ENTRIES:
            leaving, self.local = leaving + self.local, []
        for w in leaving:
            del self.ids[w], self.decoded[w]
        return out


_tables: dict[str, ChunkTable] = {}


def table_of(model_path: str) -> ChunkTable:
    if model_path not in _tables:
        _tables[model_path] = ChunkTable(model_path)
    return _tables[model_path]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted() -> pa.RecordBatch:
        words = [w for w in counts if len(w) <= LONGEST_KEPT]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "n"])

    counts, chars = Counter(), 0
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py() or ""
            counts.update(marked_words(text))
            chars += len(text)
            if len(counts) > COUNTED_WORDS or chars > COUNTED_CHARS:
                yield counted()
                counts, chars = Counter(), 0
    yield counted()


def repeated_words(docs: DataFrame) -> DataFrame:
    """word, n: the marked words of up to ``LONGEST_KEPT`` characters that occur more than once, without their first marker."""
    counts = docs.select("text").mapInArrow(_count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")


def _segmenter(model_path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, decoded = table_of(model_path).segment(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["word", "ids", "decoded"])

    return run


def chunk_table(docs: DataFrame, model_path: str) -> Entries:
    """The most frequent repeated words of all documents that fit ``TABLE_BYTES``, each segmented once.

    Frequencies are parted in levels of a sixteenth of an octave; a level is in the table as a whole or not.
    """
    words = durable(repeated_words(docs)).select("word", F.floor(F.log2("n") * 16).cast("int").alias("level"))
    sizes = words.groupBy("level").agg(F.sum(F.octet_length("word") + WORD_BYTES).alias("bytes")).collect()
    total, least = 0, 0
    for r in sorted(sizes, key=lambda r: -r.level):
        total += r.bytes
        if total > TABLE_BYTES:
            least = r.level + 1
            break
    found = words.where(F.col("level") >= least).select("word").mapInArrow(_segmenter(model_path), "word string, ids binary, decoded binary").toArrow()
    return tuple(found.column(k).to_pylist() for k in range(3))


def _mapper(model_path: str, full: bool, shared: Broadcast, source: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model_path)
        if table.source != source:
            table.load(source, shared.value)
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(lo, 256)
                coded = table.encode([text or "" for text in part.column(1).to_pylist()])
                counts = np.array([len(ids) // 4 for ids, _ in coded], dtype=np.int64)
                columns = [part.column(0).cast(pa.int64()), pa.array(counts), pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in coded], pa.string()), pa.array([hashlib.sha256(s).hexdigest() for _, s in coded], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    ids = np.frombuffer(b"".join([ids for ids, _ in coded]), dtype="<i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids)))
                    columns.append(pa.array([s.decode() for _, s in coded], pa.string()))
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _encode(docs: DataFrame, model_path: str | None, full: bool, schema: str) -> DataFrame:
    model_path = model_path or default_model_path()
    shared = docs.sparkSession.sparkContext.broadcast(chunk_table(docs, model_path))
    return docs.select("doc_id", "text").mapInArrow(_mapper(model_path, full, shared, uuid4().hex), schema)


def encode_decode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids array<int> (with begin and end), decoded.

    A null text counts as empty: its ids are begin and end, and it decodes to an empty text. Repeated rows
    give repeated rows, an empty table none; extra columns are ignored. A literal marker in a text is the
    same symbol as a space to the model, and decodes to a space, as in the library. A very long text is encoded
    whole, a very long word where it stands.
    """
    return _encode(docs, model_path, True, _SCHEMA + ", ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """The same rows with SHA-256 digests in place of ids and text, so that neither leaves the task."""
    return _encode(docs, model_path, False, _SCHEMA)
