"""Operator 10: quality classifier by co-training.

Two views of a document are learned apart. The text view has its hashed words and word beginnings, with how
often each occurs; the metadata view has the page's record (language, source, length) and the figures of its
layout (shares of capitals, digits, symbols and line breaks, repetition, word length). There are two heads,
bad quality and toxicity.

Each view starts from the labelled documents. In each of ``ROUNDS`` rounds both views then score all other
documents of the table; of each class, the share a view is most confident about teaches the other view. What
is taught is each document's calibrated probability, summed on the executors per feature of the other view, so
the whole pool teaches and only sums of a fixed number of features reach the driver. A view takes what it
was taught as the log-odds of its features, whose weight is learned with its own ones. In the end a logistic
combination of both views' margins, fitted on labelled documents held out from training, scores every
document; accuracy is taken on labelled documents that neither step has seen. A document is rejected if
either head's probability reaches the threshold.

The labelled documents used are bounded (``LABELLED``, those with the least hash of doc_id); their features
are narrowed on the executors to those that tell the classes apart before any reach the driver. What is
broadcast is the model, whose size is fixed by ``TABLE_BITS``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltlog.llm import kernels
from siltlog.llm.frames import durable

LABELLED = 12_000
ROUNDS = 2
#: The share of a class, as far as its prior tells, that a view teaches.
CONFIDENT_SHARE = 0.5
#: Of so many parts of the labelled documents one calibrates, one tests and the others train.
PARTS = 10
TEXT_DECAY, META_DECAY = 1e-4, 1e-4
TABLE_BITS = 18
#: A word is a feature by being there, and by the level, parted by these bounds, of its share of the words.
RATES = np.array([0.004, 0.01, 0.025])
LEVELS = len(RATES) + 2
PREFIX_BYTES = 6
#: A text feature gets a weight if its log-odds are so many standard errors from 0.
SIGNIFICANT = 4.0
#: Probability of bad quality or of toxicity from which on a document is rejected.
THRESHOLD = 0.5
HEADS = ("bad", "toxic")
_FEATURES = 1 << TABLE_BITS
_SHAPES = 8
_SHAPE_BINS = 16
_RECORDS = 4096
_METAS = _RECORDS + _SHAPES * _SHAPE_BINS
_TEXTS = _FEATURES * LEVELS
_BYTES = np.arange(256)
#: Kinds of bytes: capitals, printed signs but the full stop and the comma, digits, line ends.
_CAPITAL, _SYMBOL, _DIGIT, _LINE_END = 1, 2, 3, 4
_KINDS = np.select(
    [(_BYTES >= 65) & (_BYTES <= 90), kernels.NOT_ALNUM & (_BYTES > 32) & (_BYTES != 44) & (_BYTES != 46), (_BYTES >= 48) & (_BYTES <= 57), _BYTES == 10],
    [_CAPITAL, _SYMBOL, _DIGIT, _LINE_END],
).astype(np.uint8)


def _bin(values: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip(((values - low) / (high - low) * _SHAPE_BINS).astype(np.int64), 0, _SHAPE_BINS - 1)


def features(texts: pa.Array, lang: pa.Array, source: pa.Array, n_chars: np.ndarray) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """(first row, row after the last, (document, feature) of the text view, the same of the metadata view)."""
    for lo, hi, data, offsets in kernels.text_slices(texts):
        n = hi - lo
        lowered = kernels.ascii_lower(data)
        prefixes = kernels.prefix_hashes(lowered)
        hashes, starts, ends, first = kernels.words(lowered, offsets, kernels.NOT_ALNUM, prefixes)
        owner = np.repeat(np.arange(n), np.diff(first))
        docs = found = np.zeros(0, dtype=np.int64)
        if len(hashes):
            sums, inverses = prefixes
            long = np.flatnonzero(ends - starts >= PREFIX_BYTES)
            heads = kernels.mix((sums[starts[long] + PREFIX_BYTES] - sums[starts[long]]) * inverses[starts[long]])
            every = np.concatenate((hashes, heads)) >> np.uint64(64 - TABLE_BITS)
            pairs = np.concatenate((owner, owner[long])) << TABLE_BITS | every.astype(np.int64)
            pairs, counts = np.unique(pairs, return_counts=True)
            docs = pairs >> TABLE_BITS
            rates = counts / np.diff(first)[docs]
            present = (pairs & (_FEATURES - 1)) * LEVELS
            found = np.concatenate((present, present + 1 + np.searchsorted(RATES, rates, side="right")))
            docs = np.concatenate((docs, docs))
        shape_docs, shapes = _shapes(data, offsets, hashes, owner, starts, ends, n)
        record_docs, records = _records(lang.slice(lo, n), source.slice(lo, n), n_chars[lo:hi])
        yield lo, hi, (docs, found), (np.concatenate((record_docs, shape_docs)), np.concatenate((records, shapes + _RECORDS)))


def _shapes(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, owner: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's shape figures, each in one of ``_SHAPE_BINS`` bins."""
    size = np.maximum(np.diff(offsets), 1).astype(float)

    kinds = _KINDS[data]

    def share(kind: int) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(kinds == kind), offsets)) / size

    words = np.bincount(owner, minlength=n).astype(float)
    many = np.maximum(words, 1)
    held = np.sort(owner << 40 | (hashes >> np.uint64(24)).astype(np.int64))
    held = held[np.concatenate(([True], held[1:] != held[:-1]))] if len(held) else held
    distinct = np.bincount(held >> 40, minlength=n)
    again = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    columns = [
        _bin(share(_CAPITAL), 0, 0.8),
        _bin(share(_SYMBOL), 0, 0.3),
        _bin(share(_DIGIT), 0, 0.3),
        _bin(share(_LINE_END), 0, 0.1),
        _bin(distinct / many, 0, 1.0001),
        _bin(np.bincount(owner[1:][again], minlength=n) / many, 0, 0.5),
        _bin(np.bincount(owner, weights=ends - starts, minlength=n) / many, 2, 12),
        _bin(np.log2(words + 1), 0, 16),
    ]
    values = np.concatenate([c + k * _SHAPE_BINS for k, c in enumerate(columns)])
    return np.tile(np.arange(n), _SHAPES), values


def _records(lang: pa.Array, source: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature): hashed language, source and their pair, and the length's octave."""
    docs, out = [], []
    for k, (a, b, c) in enumerate(zip(lang.to_pylist(), source.to_pylist(), n_chars.tolist())):
        parts = (f"l{a}", f"s{b}", f"p{a}/{b}", f"n{int(c).bit_length()}")
        docs += [k] * len(parts)
        out += [crc32(p.encode()) % _RECORDS for p in parts]
    return np.array(docs, dtype=np.int64), np.array(out, dtype=np.int64)


@dataclass
class Sparse:
    """Rows of active features."""

    rows: np.ndarray
    features: np.ndarray
    n: int

    def take(self, keep: np.ndarray) -> Sparse:
        place = np.full(self.n, -1, dtype=np.int32)
        place[keep] = np.arange(len(keep))
        hit = place[self.rows] >= 0
        return Sparse(place[self.rows[hit]], self.features[hit], len(keep))

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.rows, weights=weights[self.features], minlength=self.n) + bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: Sparse, y: np.ndarray, size: int, decay: float = 1e-5, taught: np.ndarray | None = None, steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch AdaGrad; half the weight is shared out equally between the classes.

    ``taught``: a weight for each feature; the margin these give is one more input, and what is returned holds its share.
    """
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w, b = np.zeros(size), float(np.log(rate / (1 - rate)))
    if not x.n or y.min() == y.max():
        return w, b
    lesson = x.margins(taught, 0.0) if taught is not None else np.zeros(x.n)
    mean, spread = float(lesson.mean()), float(lesson.std()) or 1.0
    lesson = (lesson - mean) / spread
    c, gc2 = 0.0, 1e-8
    importance = np.where(y > 0.5, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * 0.5 + 0.5 / len(y)
    g2, gb2 = np.full(size, 1e-8), 1e-8
    for _ in range(steps):
        error = (_sigmoid(x.margins(w, b) + c * lesson) - y) * importance
        g = np.bincount(x.features, weights=error[x.rows], minlength=size) + decay * w
        g2 += g * g
        w -= 0.3 * g / np.sqrt(g2)
        gb2 += error.sum() ** 2
        b -= 0.3 * error.sum() / gb2**0.5
        slope = float(error @ lesson)
        gc2 += slope**2
        c -= 0.3 * slope / gc2**0.5
    if taught is not None:
        w, b = w + c / spread * taught, b - c / spread * mean
    return w, float(b)


def _platt(columns: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (one a column, and the bias) of a logistic fit by Newton's method with a weak prior."""
    a = np.column_stack((columns, np.ones(len(y))))
    beta = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(beta)), a.T @ (y - p) - 1e-2 * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


@dataclass
class View:
    """One view of one head: its margin, and what makes it a probability."""

    weights: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    #: Probabilities up to the first and from the second on are the ones it teaches.
    sure: tuple[float, float] = (-1.0, 2.0)

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale[0] * margins + self.scale[1])


@dataclass
class Head:
    text: View
    meta: View
    combine: np.ndarray

    def probability(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return _sigmoid(self.combine[0] * text + self.combine[1] * meta + self.combine[2])


@dataclass
class Model:
    heads: dict[str, Head]
    #: per head and round: how many documents the text and the metadata view taught the other one
    log: dict[str, list[tuple[int, int]]] = field(default_factory=dict)
    #: per head, on labelled documents that were used for nothing else
    accuracy: dict[str, float] = field(default_factory=dict)


VIEWS = ("text", "meta")


class _Student:
    """One head's labelled documents, by view, and what both views were taught so far."""

    def __init__(self, views: dict[str, Sparse], sizes: dict[str, int], y: np.ndarray, part: np.ndarray) -> None:
        self.views, self.sizes, self.y = views, sizes, y
        known = ~np.isnan(y)
        self.fitted, self.held, self.tested = (np.flatnonzero(known & m) for m in (part > 1, part == 0, part == 1))
        if not len(self.fitted):
            self.fitted = np.flatnonzero(known)
        if not len(self.held):
            self.held = self.fitted
        self.decay = {"text": TEXT_DECAY, "meta": META_DECAY}

    def learn(self, taught: dict[str, np.ndarray | None]) -> dict[str, View]:
        out = {}
        y = self.y[self.fitted]
        for view, x in self.views.items():
            weights, bias = fit(x.take(self.fitted), y, self.sizes[view], self.decay[view], taught[view])
            margins = x.take(self.held).margins(weights, bias)
            beta = _platt(margins[:, None], self.y[self.held])
            out[view] = View(weights, bias, (float(beta[0]), float(beta[1])))
            p, prior = out[view].probability(x.margins(weights, bias)), float(y.mean())
            if len(p):
                out[view].sure = float(np.quantile(p, CONFIDENT_SHARE * (1 - prior))), float(np.quantile(p, 1 - CONFIDENT_SHARE * prior))
        return out

    def lesson(self, view: str, positive: np.ndarray, negative: np.ndarray, n_positive: float, n_negative: float) -> np.ndarray:
        """The log-odds of a view's features: its labelled documents' counts and the sums taught."""
        x, y = self.views[view].take(self.fitted), self.y[self.fitted]
        own = [np.bincount(x.features, weights=w[x.rows], minlength=self.sizes[view]) for w in (y, 1 - y)]
        p = (own[0] + positive + 0.5) / (y.sum() + n_positive + 1)
        q = (own[1] + negative + 0.5) / ((1 - y).sum() + n_negative + 1)
        return np.log(p / q)

    def head(self, views: dict[str, View]) -> tuple[Head, float]:
        margins = [self.views[v].margins(views[v].weights, views[v].bias) for v in VIEWS]
        columns = np.column_stack(margins)
        combine = _platt(columns[self.held], self.y[self.held])
        if combine[:2].min() < 0:  # a view that tells nothing gets no weight
            use = int(combine[1] > combine[0])
            single = _platt(columns[self.held, use : use + 1], self.y[self.held])
            combine = np.array([single[0] * (use == 0), single[0] * (use == 1), single[1]])
        made = Head(views["text"], views["meta"], combine)
        right = (made.probability(*columns[self.tested].T) >= THRESHOLD) == self.y[self.tested]
        return made, float(right.mean()) if len(right) else float("nan")


def _n_chars(given: pa.Array, texts: pa.Array) -> np.ndarray:
    own = pc.utf8_length(pc.fill_null(texts, ""))
    return pc.coalesce(given.cast(pa.int64()), own.cast(pa.int64())).to_numpy(zero_copy_only=False)


def _columns(batch: pa.RecordBatch, places: Sequence[int] = (1, 2, 3, 4)) -> tuple:
    texts, lang, source, n_chars = (batch.column(k) for k in places)
    return texts, lang, source, _n_chars(n_chars, texts)


def _by_row(docs: np.ndarray, found: np.ndarray, n: int) -> list[bytes]:
    order = np.argsort(docs, kind="stable")
    bounds = np.searchsorted(docs[order], np.arange(n + 1))
    packed = found[order].astype(np.int32)
    return [packed[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, text, meta in features(*_columns(batch)):
            part = batch.slice(lo, hi - lo)
            columns = [part.column(0).cast(pa.int64()), part.column(5).cast(pa.float64()), part.column(6).cast(pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(_by_row(*text, hi - lo), pa.binary()), pa.array(_by_row(*meta, hi - lo), pa.binary())], names=["doc_id", *HEADS, "t", "m"])


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, and for each head in how many documents of either class it stands."""
    sums = np.zeros((4, _TEXTS), dtype=np.float32)
    for batch in batches:
        labels = [batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)]
        for k, packed in enumerate(batch.column(3).to_pylist()):
            found = np.frombuffer(packed, dtype=np.int32)
            for h in range(2):
                if not np.isnan(labels[h][k]):
                    sums[2 * h + (labels[h][k] < 0.5), found] += 1
    used = np.flatnonzero(sums.any(axis=0))
    names = ["feature", "p_bad", "n_bad", "p_toxic", "n_toxic"]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *[pa.array(s[used].astype(np.float64)) for s in sums]], names=names)


def _significant(rows: DataFrame, name: str, classes: tuple[float, float]) -> np.ndarray:
    """The text features that tell a head's known classes apart by ``SIGNIFICANT`` standard errors."""
    p, n = f"p_{name}", f"n_{name}"
    odds = f"ln(({p} + 0.5) / {classes[0] + 1}) - ln(({n} + 0.5) / {classes[1] + 1})"
    chosen = rows.where(f"{p} + {n} >= 5 AND abs({odds}) >= {SIGNIFICANT} * sqrt(1 / ({p} + 0.5) + 1 / ({n} + 0.5))")
    return np.sort(np.array([r.feature for r in chosen.select("feature").collect()], dtype=np.int64))


def _narrower(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            packed = [np.frombuffer(t, dtype=np.int32) for t in batch.column(3).to_pylist()]
            kept = [p[np.isin(p, wanted)].tobytes() for p in packed]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(kept, pa.binary()), batch.column(5)], names=["doc_id", *HEADS, "m", "t", "part"])

    return run


_TAUGHT = "head int, view int, feature int, positive double, negative double, n long"


def _teacher(shared) -> Callable:
    """Sums what each view teaches the other over a task's documents; feature -1 has the totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, known = shared.value
        sums = {(h, v): np.zeros((3, _METAS if v else len(heads[h][2]) or 1)) for h in range(len(heads)) for v in (0, 1)}
        totals = {key: np.zeros(3) for key in sums}
        places = []
        for _, _, chosen in heads:
            place = np.full(_TEXTS, -1, dtype=np.int32)
            place[chosen] = np.arange(len(chosen))
            places.append(place)
        for batch in batches:
            ids = pc.fill_null(batch.column(0).cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
            free = ~np.isin(ids, known) | np.asarray(batch.column(0).is_null())
            for lo, hi, text, meta in features(*_columns(batch)):
                n = hi - lo
                for h, (views, whole, chosen) in enumerate(heads):
                    near = (np.bincount(text[0], weights=whole[text[1]], minlength=n) if len(text[0]) else np.zeros(n)) + views["text"].bias
                    far = np.bincount(meta[0], weights=views["meta"].weights[meta[1]], minlength=n) + views["meta"].bias
                    for v, p in ((1, views["text"].probability(near)), (0, views["meta"].probability(far))):
                        low, high = views[VIEWS[1 - v]].sure
                        sure = ((p <= low) | (p >= high)) & free[lo:hi]
                        docs, found = meta if v else text
                        if not v:
                            found = places[h][found]
                            docs, found = docs[found >= 0], found[found >= 0]
                        here = sure[docs]
                        docs, found = docs[here], found[here]
                        into = sums[h, v]
                        into[0] += np.bincount(found, weights=p[docs], minlength=into.shape[1])
                        into[1] += np.bincount(found, weights=1 - p[docs], minlength=into.shape[1])
                        totals[h, v] += (p[sure].sum(), (1 - p[sure]).sum(), sure.sum())
        for (h, v), into in sums.items():
            used = np.flatnonzero(into[:2].any(axis=0))
            one = lambda x: pa.array(np.full(len(used) + 1, x, dtype=np.int32))
            positive, negative = (np.concatenate((totals[h, v][k : k + 1], into[k][used])) for k in (0, 1))
            counts = np.zeros(len(used) + 1, dtype=np.int64)
            counts[0] = int(totals[h, v][2])
            yield pa.RecordBatch.from_arrays([one(h), one(v), pa.array(np.concatenate(([-1], used)).astype(np.int32)), pa.array(positive), pa.array(negative), pa.array(counts)], names=["head", "view", "feature", "positive", "negative", "n"])

    return run


def _whole(view: View, chosen: np.ndarray) -> np.ndarray:
    out = np.zeros(_TEXTS, dtype=np.float32)
    out[chosen] = view.weights
    return out


def _teach(pool: DataFrame, heads: list[tuple[dict[str, View], np.ndarray]], known: np.ndarray) -> dict[tuple[int, int], tuple]:
    """(head, view): the sums the view is taught by the whole pool: positive, negative, their totals, documents."""
    packed = [(views, _whole(views["text"], chosen), chosen) for views, chosen in heads]
    shared = pool.sparkSession.sparkContext.broadcast((packed, known))
    rows = pool.mapInArrow(_teacher(shared), _TAUGHT).groupBy("head", "view", "feature").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"), F.sum("n").alias("n")).toArrow()
    shared.destroy()
    head, view, feature = (rows.column(c).to_numpy() for c in ("head", "view", "feature"))
    values = np.column_stack([rows.column(c).to_numpy() for c in ("positive", "negative", "n")]) if rows.num_rows else np.zeros((0, 3))
    out = {}
    for h, (_, chosen) in enumerate(heads):
        for v in (0, 1):
            sums, totals = np.zeros((2, _METAS if v else len(chosen))), np.zeros(3)
            here = (head == h) & (view == v)
            totals += values[here & (feature < 0)].sum(axis=0)
            inner = here & (feature >= 0)
            if sums.shape[1]:
                sums[:, feature[inner]] = values[inner, :2].T
            out[h, v] = sums[0], sums[1], totals
    return out


def fit_model(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on the labelled documents and the whole pool; repeated labels of a document count once (the worst one).

    Of rows that repeat a doc_id one is used as labelled document. Every other row is in the pool.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("l_doc_id")).agg((1 - F.min("quality")).cast("double").alias("bad"), F.max("toxic").cast("double").alias("toxic"))
    pool = docs.select("doc_id", "text", "lang", "source", "n_chars")
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().join(marks, F.col("doc_id") == F.col("l_doc_id"))
    picked = ids.orderBy(F.xxhash64("doc_id"), F.col("doc_id")).limit(LABELLED).selectExpr("doc_id AS c_doc_id", "bad", "toxic")
    found = pool.join(F.broadcast(picked), F.col("doc_id") == F.col("c_doc_id")).drop("c_doc_id").mapInArrow(_featurise, "doc_id long, bad double, toxic double, t binary, m binary")
    one = found.groupBy("doc_id").agg(F.min(F.struct("bad", "toxic", "t", "m")).alias("o")).select("doc_id", "o.*")
    found = durable(one.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)).cast("int")))
    fitted = found.where("part > 1")
    counts = durable(fitted.mapInArrow(_feature_counts, "feature long, p_bad double, n_bad double, p_toxic double, n_toxic double").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("p_bad", "n_bad", "p_toxic", "n_toxic")]))
    totals = fitted.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{k}_{c}") for c in HEADS for k, x in (("p", F.col(c)), ("n", 1 - F.col(c)))]).first()
    chosen = {c: _significant(counts, c, (totals[f"p_{c}"], totals[f"n_{c}"])) for c in HEADS}
    wanted = docs.sparkSession.sparkContext.broadcast(np.unique(np.concatenate(list(chosen.values()))))
    got = found.select("doc_id", *HEADS, "t", "m", "part").mapInArrow(_narrower(wanted), "doc_id long, bad double, toxic double, m binary, t binary, part int").toArrow().sort_by("doc_id")
    return _exchange(pool, got, chosen)


def _exchange(pool: DataFrame, got: pa.Table, chosen: dict[str, np.ndarray]) -> Model:
    def sparse(name: str, only: np.ndarray | None = None) -> Sparse:
        parts = [np.frombuffer(v, dtype=np.int32) for v in got.column(name).to_pylist()]
        rows = np.repeat(np.arange(got.num_rows, dtype=np.int32), [len(p) for p in parts])
        found = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        if only is not None:
            at = np.minimum(np.searchsorted(only, found), max(len(only) - 1, 0))
            hit = only[at] == found if len(only) else np.zeros(len(found), dtype=bool)
            rows, found = rows[hit], at[hit]
        return Sparse(rows, found, got.num_rows)

    part, known = got.column("part").to_numpy(), got.column("doc_id").to_numpy()
    meta, students = sparse("m"), {}
    model = Model({})
    for name in HEADS:
        y = got.column(name).to_numpy(zero_copy_only=False).astype(float)
        if np.isnan(y).all():
            nothing = View(np.zeros(_TEXTS, dtype=np.float32), -30.0), View(np.zeros(_METAS), -30.0)
            model.heads[name] = Head(*nothing, np.array([0.0, 0.0, -30.0]))
            continue
        students[name] = _Student({"text": sparse("t", chosen[name]), "meta": meta}, {"text": len(chosen[name]), "meta": _METAS}, y, part)
    views = {name: s.learn({"text": None, "meta": None}) for name, s in students.items()}
    for _ in range(ROUNDS if students else 0):
        sums = _teach(pool, [(views[name], chosen[name]) for name in students], known)
        for h, (name, student) in enumerate(students.items()):
            taught = {}
            for v, view in enumerate(VIEWS):
                positive, negative, totals = sums[h, v]
                taught[view] = student.lesson(view, positive, negative, totals[0], totals[1])
            views[name] = student.learn(taught)
            model.log.setdefault(name, []).append((int(sums[h, 1][2][2]), int(sums[h, 0][2][2])))
    for name, student in students.items():
        head, model.accuracy[name] = student.head(views[name])
        head.text = View(_whole(head.text, chosen[name]), head.text.bias)
        model.heads[name] = head
    return model


def _packed(model: Model) -> dict:
    return {name: (h.text.weights, h.text.bias, np.asarray(h.meta.weights, dtype=np.float32), h.meta.bias, h.combine) for name, h in model.heads.items()}


def _probabilities(heads: dict, texts: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> dict[str, np.ndarray]:
    out = {name: np.zeros(len(texts)) for name in heads}
    for lo, hi, text, meta in features(texts, lang, source, _n_chars(n_chars, texts)):
        for name, (weights, bias, others, other_bias, combine) in heads.items():
            near = (np.bincount(text[0], weights=weights[text[1]], minlength=hi - lo) if len(text[0]) else np.zeros(hi - lo)) + bias
            far = np.bincount(meta[0], weights=others[meta[1]], minlength=hi - lo) + other_bias
            out[name][lo:hi] = np.round(_sigmoid(combine[0] * near + combine[1] * far + combine[2]), 6)
    return out


def _good(p: dict[str, np.ndarray]) -> np.ndarray:
    return ~np.logical_or.reduce([p[name] >= THRESHOLD for name in HEADS])


def _scorer(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _probabilities(shared.value, *batch.columns[1:5])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(p[name], pa.float64()) for name in HEADS], pa.array(_good(p))], names=["doc_id", "p_bad", "p_toxic", "kept"])

    return run


def _sieve(shared, places: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _probabilities(shared.value, *[batch.column(k) for k in places])
            yield batch.filter(pa.array(_good(p)))

    return run


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, p_bad, p_toxic, kept.

    Null texts count as empty, null metadata as values of their own; documents without words are scored by
    metadata alone, and very long ones like others. Repeated rows get equal scores. Without labels nothing is
    rejected; an empty table gives no rows; extra columns are ignored.
    """
    model = model or fit_model(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(_packed(model))
    return docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(_scorer(shared), "doc_id long, p_bad double, p_toxic double, kept boolean")


def good_documents(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that ``score`` would not reject, with all their columns, filtered where they are."""
    model = model or fit_model(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(_packed(model))
    places = [docs.columns.index(c) for c in ("text", "lang", "source", "n_chars")]
    return docs.mapInArrow(_sieve(shared, places), docs.schema)
