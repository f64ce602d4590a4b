"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Each document is the set of its n-grams of 3, 5 and 7 characters (code points,
A-Z lower-cased), known by 64-bit hashes.  On labelled
rows the share of toxic and of clean documents that hold an n-gram gives its
log-count ratio r; the n-grams that tell the classes apart best (by G-test)
become features with value r, and an L2-regularised logistic regression over
them gives weights and a probability.

Fitting reads a bounded sample of the labelled rows (``max_rows``, the rows
with the smallest hashes of their ids); counting and choosing of n-grams run
on the executors, only ``n_features`` n-grams, a histogram of their scores and
the sample's feature lists reach the driver.  Scoring reads every text whole, without a shuffle.

Defined results: null and empty texts get the model's score for no features;
very long texts are scored whole; ties between n-grams are broken by the
n-gram; repeated label rows count once (toxic if any is); labels that are null
and labels without a document are left out; with one class or no labels at all
the score is the smoothed share of toxic labels; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.batches import LOWER, chunks, mix, text_buffer
from strataloom.llm.samples import lowest_hashes
from strataloom.llm.storage import Scratch, map_rows

ORDERS = (3, 5, 7)
#: Labelled rows that a fit reads at most.
MAX_ROWS = 8_000
N_FEATURES = 4_096
#: Documents of the sample that must hold an n-gram.
LEAST_DOCS = 4
ALPHA = 1.0
L2 = 0.5
THRESHOLD = 0.7
_SLOTS = 20
_BINS = 64
_K = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class ToxicModel:
    """N-gram keys (sorted), weights times ratio, bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    orders: tuple[int, ...] = ORDERS

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, feats = self.features(raw, offsets)
        z = self.bias + np.bincount(rows, weights=self.weights[feats], minlength=len(offsets) - 1)[: len(offsets) - 1]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))

    def features(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) pairs, each once."""
        n = max(1, len(self.keys))
        if not len(self.keys):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        slot = self._slots()
        found = []
        points, starts = code_points(raw, offsets)
        for _, at, key in grams(points, starts, self.orders):
            near = np.flatnonzero(slot[_slot(key)])
            pos = np.searchsorted(self.keys, key[near])
            pos[pos == len(self.keys)] = 0
            hit = self.keys[pos] == key[near]
            row = np.searchsorted(starts, at[near[hit]], side="right") - 1
            found.append(np.unique(row * n + pos[hit]))
        pair = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        return pair // n, pair % n

    def _slots(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = np.zeros(1 << _SLOTS, dtype=bool)
            self._table[_slot(self.keys)] = True
        return self._table

    def __getstate__(self):
        return {"keys": self.keys, "weights": self.weights, "bias": self.bias, "orders": self.orders}


def _slot(key: np.ndarray) -> np.ndarray:
    return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a UTF-8 buffer (A-Z lower-cased) and the row offsets among them."""
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    points = np.frombuffer(LOWER[raw].tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    return points, lead[offsets]


def grams(points: np.ndarray, starts: np.ndarray, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per order: start positions and keys (64-bit hashes) of all n-grams that lie inside one row."""
    n = len(points)
    room = np.repeat(starts[1:], np.diff(starts)) - np.arange(n)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(max(orders)):
        h[: max(0, n - k)] = h[: max(0, n - k)] * _K + points[k:] + np.uint64(1)
        if k + 1 in orders:
            at = np.flatnonzero(room > k)
            yield k + 1, at, mix(h[at] ^ np.uint64((k + 1) << 56))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, n_features: int = N_FEATURES, orders: tuple[int, ...] = ORDERS) -> ToxicModel:
    """Train on ``labels`` (doc_id, toxic) joined with ``docs`` (doc_id, text)."""
    clean = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    scratch = Scratch(docs.sparkSession)
    try:
        return _fit(docs, clean, scratch, max_rows, n_features, orders)
    finally:
        scratch.clear()


def _fit(docs: DataFrame, clean: DataFrame, scratch: Scratch, max_rows: int, n_features: int, orders: tuple[int, ...]) -> ToxicModel:
    # the bound makes this side small enough to send everywhere: max_rows rows of two numbers
    chosen = scratch.settle(lowest_hashes(clean, "doc_id", max_rows))
    sample = scratch.settle(
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .select((F.col("toxic") > 0).cast("int").alias("toxic"), "text")
    )
    n_rows = sample.count()
    positive = sample.where("toxic = 1").count()
    if not 0 < positive < n_rows:
        share = (positive + 0.5) / (n_rows + 1.0)
        return ToxicModel(np.zeros(0, dtype=np.uint64), np.zeros(0), float(np.log(share / (1 - share))), orders)
    negative = n_rows - positive

    counts = (
        sample.mapInArrow(lambda it: _count(it, orders), "key long, pos long, neg long")
        .groupBy("key")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where(F.col("pos") + F.col("neg") >= LEAST_DOCS)
    )
    p, n = F.col("pos").cast("double"), F.col("neg").cast("double")

    def term(seen, of_class: int, both) -> F.Column:
        expected = both * of_class / n_rows
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    both, neither = p + n, F.lit(float(n_rows)) - p - n
    g = term(p, positive, both) + term(n, negative, both) + term(positive - p, positive, neither) + term(negative - n, negative, neither)
    scored = scratch.settle(counts.select("key", "pos", "neg", g.alias("g"), F.floor(F.log2(F.greatest(g, F.lit(0.0)) + 1) * _BINS).cast("int").alias("bin")))
    # the bins that hold the best n_features, so that few more than those are ordered in one place
    seen, least = 0, 0
    for r in scored.groupBy("bin").count().orderBy(F.desc("bin")).collect():  # some 64 bins for each doubling of a score
        seen, least = seen + r["count"], r["bin"]
        if seen >= n_features:
            break
    top = scored.where(F.col("bin") >= least).orderBy(F.desc("g"), "key").limit(n_features).select("key", "pos", "neg").toArrow()
    keys = top.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    pos, neg = (top.column(c).to_numpy().astype(float)[order] for c in ("pos", "neg"))
    ratio = np.log((pos + ALPHA) / (positive + 2 * ALPHA)) - np.log((neg + ALPHA) / (negative + 2 * ALPHA))

    lists = ToxicModel(keys, np.zeros(len(keys)), 0.0, orders)
    sent = sample.sparkSession.sparkContext.broadcast(lists)
    data = sample.mapInArrow(lambda it: _lists(it, sent.value), "toxic int, feats binary").toArrow()
    sent.unpersist()
    rows = [np.frombuffer(b, dtype=np.uint16 if len(keys) <= 1 << 16 else np.uint32).astype(np.int64) for b in data.column("feats").to_pylist()]
    y = data.column("toxic").to_numpy().astype(float)
    weights, bias = _logistic(rows, y, ratio)
    return ToxicModel(keys, weights * ratio, bias, orders)


#: N-grams of one task that are counted before they go on.
_HELD = 700_000


def _count(batches: Iterator[pa.RecordBatch], orders: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold an n-gram, summed in the task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []  # keys, once for each document that has them, and the document's class
    size = 0
    for batch in batches:
        for part in chunks(batch):
            points, starts = code_points(*text_buffer(part.column("text")))
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            for _, at, key in grams(points, starts, orders):
                row = np.searchsorted(starts, at, side="right") - 1
                order = np.argsort(key, kind="stable")  # rows ascend within a key
                k, r = key[order], row[order]
                first = np.ones(len(k), dtype=bool)
                first[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
                held.append((k[first], toxic[r[first]].astype(np.int8)))
                size += len(held[-1][0])
            if size >= _HELD:
                yield from _summed(held)
                held, size = [], 0
    if size:
        yield from _summed(held)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    key, toxic = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(key)
    key, toxic = key[order], toxic[order].astype(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    pos = np.add.reduceat(toxic, edge[:-1])
    data = {"key": key[edge[:-1]].view(np.int64), "pos": pos, "neg": np.diff(edge) - pos}
    for i in range(0, len(pos), 1 << 16):
        yield pa.RecordBatch.from_pydict({k: v[i : i + (1 << 16)] for k, v in data.items()})


def _lists(batches: Iterator[pa.RecordBatch], model: ToxicModel) -> Iterator[pa.RecordBatch]:
    kind = np.uint16 if len(model.keys) <= 1 << 16 else np.uint32
    for batch in batches:
        for part in chunks(batch):
            raw, offsets = text_buffer(part.column("text"))
            rows, feats = model.features(raw, offsets)
            order = np.argsort(rows, kind="stable")
            cuts = np.searchsorted(rows[order], np.arange(part.num_rows + 1))
            feats = feats[order].astype(kind)
            yield pa.RecordBatch.from_pydict(
                {
                    "toxic": part.column("toxic"),
                    "feats": pa.array([np.sort(feats[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                }
            )


def _logistic(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias by Nesterov's accelerated gradient steps; row order doesn't matter beyond rounding."""
    order = sorted(range(len(rows)), key=lambda i: (y[i], len(rows[i]), rows[i].tobytes()))
    rows, y = [rows[i] for i in order], y[order]
    sizes = np.array([len(r) for r in rows])
    cols = np.concatenate(rows) if sizes.sum() else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    value = ratio[cols]
    n, f = len(rows), len(ratio)
    norm = np.bincount(owner, weights=value**2, minlength=n).mean() + 1.0
    w, b = np.zeros(f), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    vw, vb = w.copy(), b
    rate = 1.0 / (0.5 * norm + L2 / n)
    for k in range(steps):
        z = vb + np.bincount(owner, weights=vw[cols] * value, minlength=n)
        err = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - y
        gw = np.bincount(cols, weights=err[owner] * value, minlength=f) / n + L2 / n * vw
        gb = err.mean()
        nw, nb = vw - rate * gw, vb - rate * norm * gb
        m = k / (k + 3.0)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w, float(b)


def score_documents(docs: DataFrame, model: ToxicModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                scores = sent.value.score(*text_buffer(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores, pa.float64())], names=[id_col, "score"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {id_type}, score double")


def drop_documents(docs: DataFrame, model: ToxicModel, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with the columns that they have, that score below ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at):
                yield part.filter(pa.array(sent.value.score(*text_buffer(part.column(at))) < threshold))

    return map_rows(docs, run, docs.schema)
