"""Operator 6: personal data, and the terms that give it away.

Base spans are the matches of four fixed patterns; secrets (keys, tokens, passwords: values of high information
content that are called so, or bear a well-known prefix) are found beside them. Their values are the protected entities. For an entity e
with generalisation g(e) (an address's domain, a network, an issuer, a country) a term t in a document that
holds e discloses it if PMI(e; t) = log2(p(e, t) / (p(e) p(t))) reaches the information content of g(e), -log2 p(g(e)): whoever
reads t then learns more about e than its generalisation tells. Such a term is generalised; it is removed if
the disclosure reaches the information content of e itself. A secret has no generalisation but itself. All probabilities are document frequencies over
the whole table, and a pair counts only if it is seen in two documents of different words, so that copies of
one text prove nothing. Every word of a document that holds e counts, short words and numbers too, but for
those a base span touches; a disclosing term is marked at all its places in the document.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltlog.llm import kernels
from siltlog.llm.frames import durable

KINDS = ("email", "ip", "card", "phone")
SECRET, TERM = "secret", "term"
#: A secret has so many bits of information at least: its length times the entropy of its characters.
SECRET_BITS = 48
#: How far before a value its name may start.
NAME_REACH = 24
#: So many candidate terms are sent to the tasks (16 MB); with more, all terms are counted and joined.
BROADCAST_TERMS = 2_000_000
#: Tasks of the counting pass for each core.
TASKS_A_CORE = 2
#: So many disclosing pairs, or terms marked in different texts, are joined by broadcast; more by shuffle.
BROADCAST_PAIRS = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that fails at its start fails inside too, so only starts of runs are tried
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}")
#: What well-known secrets are called, and how some start.
_SECRET_NAME = re.compile(r"(?i:token|secret|password|passwd|pwd|credential|bearer|(?:api|access|private|auth|encryption|signing|client)[ _-]?key)[\"']?(?:\s*[:=]\s*|\s+)[\"']?\Z")
_SECRET_START = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{12}|gh[pousr]_[A-Za-z0-9]{16}|sk_live_[A-Za-z0-9]{8}|xox[abprs]-[A-Za-z0-9-]{8}|AIza[A-Za-z0-9_-]{16}")
_TOKEN = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: an address starts where its local part's run starts, after the last match."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base spans, by start and kind."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(found)


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all secrets."""
    out = []
    if len(text) >= 16:
        for m in _SECRET.finditer(text):
            value = m[0]
            if not _DIGITS.search(value) or value.isdigit():
                continue
            counts = [value.count(c) for c in set(value)]
            bits = sum(n * math.log2(len(value) / n) for n in counts)
            if bits >= SECRET_BITS and (_SECRET_START.match(value) or _SECRET_NAME.search(text, max(0, m.start() - NAME_REACH), m.start())):
                out.append((m.start(), len(KINDS), m.end()))
    return out


def entity_of(kind: int, value: str) -> tuple[str, str]:
    """The entity a span names, and its generalisation."""
    if kind == 0:
        value = value.lower()
        return f"email:{value}", f"email:@{value.rpartition('@')[2]}"
    if kind == 1:
        parts = [str(int(p)) for p in value.split(".")]
        return "ip:" + ".".join(parts), "ip:" + ".".join(parts[:2])
    if kind == len(KINDS):
        return f"secret:{value}", f"secret:{value}"
    digits = "".join(_DIGITS.findall(value))
    return (f"card:{digits}", f"card:{digits[:6]}") if kind == 2 else (f"phone:{digits}", f"phone:{digits[:3]}")


def _free(text: str, taken: list[tuple[int, int, int]]) -> str:
    """The text with base spans, and the words they touch, as spaces: places stay the same."""
    out, last = [], 0
    for a, _, b in taken:
        while a > last and _TOKEN.match(text[a]) and _TOKEN.match(text[a - 1]):
            a -= 1
        while b < len(text) and _TOKEN.match(text[b - 1]) and _TOKEN.match(text[b]):
            b += 1
        if b > last:
            a = max(a, last)
            out += [text[last:a], " " * (b - a)]
            last = b
    return "".join([*out, text[last:]])


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _term_numbers(terms: list[str]) -> np.ndarray:
    """The kernel's word hashes of single words, as the counting pass computes them."""
    out = np.zeros(len(terms), dtype=np.int64)
    for lo, hi, data, offsets in kernels.text_slices(pa.array(terms, pa.string())):
        out[lo:hi] = kernels.words(kernels.ascii_lower(data), offsets, kernels.NOT_ALNUM)[0].astype(np.int64)
    return out


_FOUND = "row_id long, doc_id long, text_hash long, counts array<long>, base array<struct<start: int, kind: int, end: int>>, secrets array<struct<start: int, kind: int, end: int>>, entities array<struct<entity: long, wide: long>>, context long, terms array<long>"


def _word_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The different word numbers of each text."""
    for lo, hi, data, offsets in kernels.text_slices(pa.array(texts, pa.string())):
        hashes, _, _, first = kernels.words(kernels.ascii_lower(data), offsets, kernels.NOT_ALNUM)
        for k in range(hi - lo):
            yield np.unique(hashes[first[k] : first[k + 1]].astype(np.int64))


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row_id = (TaskContext.get().partitionId() << 36) - 1
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    entity = pa.struct([("entity", pa.int64()), ("wide", pa.int64())])
    none = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for lo in range(0, max(1, batch.num_rows), 512):
            part = batch.slice(lo, 512)
            ids, counts, bases, secrets, entities, free = [], [], [], [], [], []
            for text in part.column(1).to_pylist():
                text = text or ""
                row_id += 1
                found = base_spans(text)
                ids.append(row_id)
                counts.append([sum(k == n for _, k, _ in found) for n in range(len(KINDS))])
                bases.append([{"start": a, "kind": k, "end": b} for a, k, b in found])
                hidden = secret_spans(text)
                secrets.append([{"start": a, "kind": k, "end": b} for a, k, b in hidden])
                found = sorted(found + hidden)
                named = dict.fromkeys(entity_of(k, text[a:b]) for a, k, b in found)
                entities.append([{"entity": _number(name), "wide": _number(wide)} for name, wide in named])
                if found:
                    free.append(_free(text, found))
            sets = _word_sets(free)
            terms = [next(sets) if row else none for row in entities]
            contexts = [int.from_bytes(hashlib.blake2b(t.tobytes(), digest_size=8).digest(), "little", signed=True) for t in terms]
            places = np.cumsum([0, *map(len, terms)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    part.column(0).cast(pa.int64()),
                    part.column(2),
                    pa.array(counts, pa.list_(pa.int64())),
                    pa.array(bases, pa.list_(span)),
                    pa.array(secrets, pa.list_(span)),
                    pa.array(entities, pa.list_(entity)),
                    pa.array(contexts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(np.concatenate([none, *terms]), pa.int64())),
                ],
                names=["row_id", "doc_id", "text_hash", "counts", "base", "secrets", "entities", "context", "terms"],
            )


def _counter(wanted: Callable[[], np.ndarray | None]) -> Callable:
    """Document frequencies of the wanted terms (all, if None), in partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = wanted()
        bits = None
        if terms is not None:
            bits = np.zeros(1 << 22, dtype=bool)
            bits[terms & ((1 << 22) - 1)] = True
        held: list[np.ndarray] = []
        size = 0
        sums = np.zeros(0 if terms is None else len(terms), dtype=np.int64)

        def flush() -> pa.RecordBatch:
            if terms is not None:
                seen = np.flatnonzero(sums)
                return pa.RecordBatch.from_arrays([pa.array(terms[seen], pa.int64()), pa.array(sums[seen])], names=["term", "n"])
            values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(counts, pa.int64())], names=["term", "n"])

        for batch in batches:
            for lo, hi, data, offsets in kernels.text_slices(batch.column(0)):
                hashes, _, _, first = kernels.words(kernels.ascii_lower(data), offsets, kernels.NOT_ALNUM)
                owner, values = np.repeat(np.arange(hi - lo), np.diff(first)), hashes.astype(np.int64)
                if terms is not None:
                    maybe = np.flatnonzero(bits[values & ((1 << 22) - 1)])
                    at = np.searchsorted(terms, values[maybe])
                    hit = maybe[(at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == values[maybe])] if len(terms) else maybe[:0]
                    owner, values = owner[hit], values[hit]
                order = np.lexsort((values, owner))
                owner, values = owner[order], values[order]
                new = np.ones(len(values), dtype=bool)
                new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
                if terms is not None:
                    sums += np.bincount(np.searchsorted(terms, values[new]), minlength=len(terms))
                    continue
                held.append(values[new])
                size += int(new.sum())
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        yield flush()

    return run


def find(docs: DataFrame) -> DataFrame:
    """The first pass, checkpointed: base spans, entities, and where there are any the words, of every row."""
    return durable(docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(_finder, _FOUND))


def _entries(found: DataFrame) -> DataFrame:
    return found.select("row_id", "context", F.explode("entities").alias("e")).select("row_id", "context", "e.*")


def _near(found: DataFrame) -> DataFrame:
    """row_id, context, entity, wide, term for the entities of two contexts or more; no other can have a pair.

    Words meet entities by row, so a hot entity's documents stay spread.
    """
    entries = _entries(found)
    known = entries.groupBy(F.col("entity").alias("k_entity")).agg(F.min("context").alias("k1"), F.max("context").alias("k2")).where("k1 <> k2").select("k_entity")
    held = entries.join(known, F.col("entity") == F.col("k_entity"), "left_semi")
    words = found.where("size(entities) > 0").select(F.col("row_id").alias("w_row_id"), "terms")
    return held.join(words, F.col("row_id") == F.col("w_row_id")).select("row_id", "context", "entity", "wide", F.explode("terms").alias("term"))


def disclosing_pairs(docs: DataFrame, found: DataFrame) -> DataFrame:
    """entity, term, n_pair, n_entity, n_wide, n_term, disclosure, action ('generalise' or 'remove')."""
    total = found.count()
    entries = _entries(found)
    pairs = _near(found).groupBy("entity", "wide", "term").agg(F.count("*").alias("n_pair"), F.min("context").alias("c1"), F.max("context").alias("c2"))
    pairs = pairs.where("c1 <> c2").drop("c1", "c2")
    n_entity = entries.groupBy(F.col("entity").alias("e_entity")).agg(F.count("*").alias("n_entity"))
    wides = found.select(F.explode(F.array_distinct(F.expr("transform(entities, e -> e.wide)"))).alias("w_wide")).groupBy("w_wide").agg(F.count("*").alias("n_wide"))
    # a term stands in at least the rows with entities that hold it: what fails with that few fails with all
    least = found.select(F.explode("terms").alias("l_term")).groupBy("l_term").agg(F.count("*").alias("n_least"))
    pairs = pairs.join(n_entity, F.col("entity") == F.col("e_entity")).join(wides, F.col("wide") == F.col("w_wide")).join(least, F.col("term") == F.col("l_term"))
    pairs = durable(pairs.where("n_pair * n_wide >= n_entity * n_least * (1 - 1e-6D)").select("entity", "term", "n_pair", "n_entity", "n_wide"))
    candidates = durable(pairs.select(F.col("term").alias("c_term")).distinct())
    # a task counts a candidate once, so few long tasks send far less than many short ones
    texts = docs.select("text").coalesce(TASKS_A_CORE * docs.sparkSession.sparkContext.defaultParallelism)
    if candidates.count() <= BROADCAST_TERMS:
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.c_term for r in candidates.collect()], dtype=np.int64)))
        counted = texts.mapInArrow(_counter(lambda: shared.value), "term long, n long")
    else:
        counted = texts.mapInArrow(_counter(lambda: None), "term long, n long").join(candidates, F.col("term") == F.col("c_term"), "left_semi")
    n_term = counted.groupBy(F.col("term").alias("t_term")).agg(F.sum("n").alias("n_term"))
    rated = pairs.join(n_term, F.col("term") == F.col("t_term"))
    log2 = lambda c: F.ln(c) / math.log(2)
    rated = rated.withColumn("disclosure", log2(F.col("n_pair") * float(max(1, total)) / (F.col("n_entity").cast("double") * F.col("n_term"))))
    rated = rated.withColumn("of_wide", log2(float(max(1, total)) / F.col("n_wide"))).withColumn("of_entity", log2(float(max(1, total)) / F.col("n_entity")))
    action = F.when(F.col("disclosure") >= F.col("of_entity") - 1e-9, "remove").otherwise("generalise")
    return rated.where("disclosure >= of_wide - 1e-9").select("entity", "term", "n_pair", "n_entity", "n_wide", "n_term", "disclosure", action.alias("action"))


def protect(docs: DataFrame) -> DataFrame:
    """One row per row of docs, in no order: doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_term, base_sha256,
    spans, terms.

    spans: kind:start:end (code points, end exclusive) by start, then kind, joined by commas; terms: the same
    spans of the disclosing terms with their action, array<struct<start, end, action>>. base_sha256 covers the
    base spans alone. A null text counts as empty: no spans, digest of the empty string. Repeated rows and
    doc_ids are reported each, very long texts are read whole; an empty table gives no rows; extra columns are ignored.
    """
    return _protected(docs).drop("text_hash")


def _sized(frame: DataFrame, weight: str = "1") -> DataFrame:
    """Checkpointed, and marked for broadcast if it is small."""
    frame = durable(frame)
    return F.broadcast(frame) if (frame.selectExpr(f"sum({weight})").first()[0] or 0) <= BROADCAST_PAIRS else frame


_PLACED = "p_hash long, terms array<struct<start: int, end: int, action: string>>"


def _placer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All places of each text's marked terms that no base span or secret touches."""
    place = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("action", pa.string())])
    for batch in batches:
        for lo in range(0, max(1, batch.num_rows), 512):
            part = batch.slice(lo, 512)
            rows = []
            for text, marks in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                actions = {m["term"]: m["action"] for m in marks}
                found = list(_TOKEN.finditer(_free(text, sorted(base_spans(text) + secret_spans(text)))))
                numbers = _term_numbers([m[0] for m in found]).tolist()
                rows.append([{"start": m.start(), "end": m.end(), "action": actions[w]} for m, w in zip(found, numbers) if w in actions])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(place))], names=["p_hash", "terms"])


def _protected(docs: DataFrame) -> DataFrame:
    found = find(docs)
    flagged = _sized(disclosing_pairs(docs, found).select(F.col("entity").alias("f_entity"), F.col("term").alias("f_term"), "action"))
    hits = _near(found).join(flagged, (F.col("entity") == F.col("f_entity")) & (F.col("term") == F.col("f_term")))
    marks = hits.groupBy("row_id", "term").agg(F.max("action").alias("action"))
    marks = marks.groupBy(F.col("row_id").alias("m_row_id")).agg(F.collect_list(F.struct("term", "action")).alias("marks"))
    marked = durable(found.select("row_id", "text_hash").join(marks, F.col("row_id") == F.col("m_row_id")).select("row_id", "text_hash", "marks"))
    sought = _sized(marked.select(F.col("text_hash").alias("s_hash"), "marks").dropDuplicates(["s_hash"]), "size(marks)")
    texts = docs.select("text", F.xxhash64("text").alias("h")).join(sought, F.col("h") == F.col("s_hash"))
    placed = texts.select("h", "text", "marks").mapInArrow(_placer, _PLACED).dropDuplicates(["p_hash"])
    added = marked.join(placed, F.col("text_hash") == F.col("p_hash")).select(F.col("row_id").alias("a_row_id"), "terms")
    rows = found.select("row_id", "doc_id", "text_hash", "counts", "base", "secrets").join(added, F.col("row_id") == F.col("a_row_id"), "left")
    names = ", ".join(f"'{k}'" for k in (*KINDS, SECRET, TERM))
    written = lambda c: f"array_join(transform(array_sort({c}), s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')"
    term_spans = f"transform(terms, t -> struct(t.start AS start, {len(KINDS) + 1} AS kind, t.end AS end))"
    counts = [f"counts[{k}] AS n_{name}" for k, name in enumerate(KINDS)]
    counts += ["CAST(size(secrets) AS BIGINT) AS n_secret", "CAST(coalesce(size(terms), 0) AS BIGINT) AS n_term"]
    every = f"concat(base, secrets, IF(terms IS NULL, array(), {term_spans}))"
    return rows.selectExpr("doc_id", "text_hash", *counts, f"sha2(encode({written('base')}, 'UTF-8'), 256) AS base_sha256", f"{written(every)} AS spans", "coalesce(terms, array()) AS terms")


def redact(text: str, spans: str, actions: dict[tuple[int, int], str] | None = None) -> str:
    """The text with base spans and generalised terms replaced by their kind and removed terms left out.

    ``spans`` is the column of ``protect``; of overlapping spans the first, and of those the first kind, counts.
    """
    out, last = [], 0
    for item in filter(None, spans.split(",")):
        kind, a, b = item.split(":")
        start, end = int(a), int(b)
        if start < last:
            continue
        out.append(text[last:start])
        if kind != TERM or (actions or {}).get((start, end)) != "remove":
            out.append(f"[{kind}]")
        last = end
    return "".join([*out, text[last:]])


def _redactor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, max(1, batch.num_rows), 512):
            part = batch.slice(lo, 512)
            columns = (part.column(k).to_pylist() for k in (1, 2, 3))
            texts = [redact(text or "", spans, {(t["start"], t["end"]): t["action"] for t in terms}) for text, spans, terms in zip(*columns)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and the sanitised text of every row: base spans and generalised terms stand as their kind in
    brackets, removed terms are left out. A null text gives an empty one. Rows are matched by doc_id and text."""
    spans = _protected(docs).select(F.col("doc_id").alias("p_doc_id"), F.col("text_hash").alias("p_hash"), "spans", "terms").dropDuplicates(["p_doc_id", "p_hash"])
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    joined = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("h") == F.col("p_hash")))
    return joined.select("doc_id", "text", "spans", "terms").mapInArrow(_redactor, "doc_id long, text string")
