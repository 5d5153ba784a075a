"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. A passage is encoded from
its text alone: shares of byte classes, word lengths, repetition, and a hashed bag
of words, through a tanh layer. Gated attention, learned from document labels,
weighs the passages; the weighted sum gives the document's score.

Training fits on at most ``max_train`` labelled documents, those of smallest hash
of id (the driver gets their passages' features, no texts); scoring covers all.

Cases: null or empty text is one empty passage; without a labelled document, or
with labels of one kind only, every score is the share of label 1, or 0.5; labels
other than 0 and 1 are left out, and of several labels of an id the largest holds;
rows with equal ids are rows of their own; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .textbytes import RangeHash, column_slices, lower, words

PASSAGE, MAX_TRAIN, EPOCHS = 64, 6000, 150
_WORD = RangeHash(81)
_BAG = 48
_CLASS = np.zeros(256, np.int64)
for _name, _members in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b"#*$%&|<>", b".,;:", b"!?", b"\"'()[]{}-_/\\@=+~^`", range(128, 256)), 1):
    _CLASS[list(_members)] = _name
_CLASSES = int(_CLASS.max()) + 1
FEATURES = _CLASSES + 8 + _BAG


def encode_passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages, and each document's first passage and their number."""
    starts, ends, row_words = words(data, offsets)
    counts = np.diff(row_words)
    n_passages = np.maximum(-(-counts // PASSAGE), 1)
    base = np.concatenate([[0], np.cumsum(n_passages)])
    total = int(base[-1])
    doc = np.repeat(np.arange(len(counts)), n_passages)
    k = np.arange(total) - base[doc]
    begin = offsets[:-1][doc].copy()
    later = k > 0
    begin[later] = starts[row_words[:-1][doc[later]] + PASSAGE * k[later]]
    size = np.diff(np.append(begin, len(data)))
    of_byte = np.repeat(np.arange(total), size)
    shares = np.bincount(of_byte * _CLASSES + _CLASS[data], minlength=total * _CLASSES).reshape(total, _CLASSES) / np.maximum(size, 1)[:, None]
    owner = np.repeat(np.arange(len(counts)), counts)
    passage = base[owner] + (np.arange(len(starts)) - row_words[owner]) // PASSAGE
    n = np.bincount(passage, minlength=total)
    each = np.maximum(n, 1)
    length = (ends - starts).astype(float)
    low = lower(data)
    h = _WORD.of(_WORD.prefix(low), starts, ends)
    bag = np.bincount(passage * _BAG + (h % np.uint64(_BAG)).astype(np.int64), minlength=total * _BAG).reshape(total, _BAG) / each[:, None]
    key = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[first] >> np.uint64(40)).astype(np.int64), minlength=total)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    mean = np.bincount(passage, length, total) / each
    spread = np.sqrt(np.maximum(np.bincount(passage, length**2, total) / each - mean**2, 0))
    more = [np.log1p(n), mean, spread, np.bincount(passage, length <= 2, total) / each, np.bincount(passage, length > 14, total) / each, distinct / each, np.bincount(passage, again, total) / each, np.log1p(counts)[doc]]
    return np.column_stack([shares, *more, bag]).astype(np.float32), base


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """tanh encoder, gated attention over a bag, logistic output."""

    def __init__(self, share: float = 0.5, hidden: int = 32, gate: int = 16, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.constant = np.zeros(FEATURES), np.ones(FEATURES), share
        self.p = {"W": rng.normal(0, FEATURES**-0.5, (FEATURES, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate)), "w": rng.normal(0, 0.1, gate), "c": rng.normal(0, 0.1, hidden), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, base: np.ndarray):
        p, doc = self.p, np.repeat(np.arange(len(base) - 1), np.diff(base))
        h = np.tanh((x - self.mean) / self.scale @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        e = np.exp(s - np.maximum.reduceat(s, base[:-1])[doc])
        a = e / np.add.reduceat(e, base[:-1])[doc]
        z = np.add.reduceat(a[:, None] * h, base[:-1])
        return doc, h, t, g, a, z, _sigmoid(z @ p["c"] + p["d"])

    def score(self, x: np.ndarray, base: np.ndarray) -> np.ndarray:
        return np.full(len(base) - 1, self.constant) if self.constant is not None else self.forward(x, base)[-1]

    def fit(self, x: np.ndarray, base: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, decay: float = 1e-4) -> GatedAttention:
        x = x.astype(float)
        self.constant, self.mean, self.scale = None, x.mean(axis=0), x.std(axis=0) + 1e-3
        p, first, second = self.p, {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for step in range(1, epochs + 1):
            doc, h, t, g, a, z, out = self.forward(x, base)
            error = (out - y) / len(y)
            dz = error[:, None] * p["c"]
            dh = a[:, None] * dz[doc]
            da = (dz[doc] * h).sum(axis=1)
            ds = a * (da - np.add.reduceat(a * da, base[:-1])[doc])
            dt, dg = ds[:, None] * p["w"] * g * (1 - t**2), ds[:, None] * p["w"] * t * g * (1 - g)
            pre = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
            grad = {"W": ((x - self.mean) / self.scale).T @ pre, "b": pre.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ error, "d": np.array([error.sum()])}
            for k, v in grad.items():
                v = v + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v**2
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in column_slices(batch["text"]):
            x, base = encode_passages(data, offsets)
            yield pa.record_batch([batch["label"].slice(row, len(base) - 1), pa.array([x[a:b].tobytes() for a, b in zip(base[:-1], base[1:], strict=True)], pa.binary())], ["label", "features"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, max_train: int = MAX_TRAIN, epochs: int = EPOCHS) -> GatedAttention:
    """The model of the labelled documents (id, label)."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64(F.col("label_id").cast("string")), "label_id").limit(max_train)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(sample, F.col("doc_id") == F.col("label_id"))
    rows = own.select("text", "label").mapInArrow(_passages, "label int, features binary").collect()
    rows = sorted(((r.label, bytes(r.features)) for r in rows), key=lambda r: r[1])
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return GatedAttention(float(y.mean()) if len(y) else 0.5)
    x = [np.frombuffer(r[1], np.float32).reshape(-1, FEATURES) for r in rows]
    base = np.concatenate([[0], np.cumsum([len(v) for v in x])])
    return GatedAttention().fit(np.concatenate(x), base, y, epochs)


def score_quality(docs: DataFrame, model: GatedAttention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in column_slices(batch["text"], 500_000):
                x, base = encode_passages(data, offsets)
                yield pa.record_batch([batch["doc_id"].slice(row, len(base) - 1), pa.array(model.score(x, base), pa.float64())], ["doc_id", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double")


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def op1_attention_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, fit_quality(docs, labels.where(~_fold(F.col("doc_id")))))
    return scored.select("doc_id", F.coalesce(_fold(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


SQL = None
