"""Language-model scores by prediction by partial matching over byte contexts.

The model is a trie of byte contexts up to ``order`` with the counts of what
follows; A-Z are lower-cased and a byte that no text holds stands before and after
each text. A byte's probability is (2c-1)/2T in the longest context that has it, T
being the context's count; every context that lacks it costs an escape of q/2T, q
being the symbols it has. After an escape the symbols of the longer context are
excluded from both sums.

Buckets of documents send each distinct string of order + 1 bytes once, with its
count in the training rows, to the shard of its last two context bytes. That shard
holds whole branches of the trie from the second order on, and answers with log
probabilities. The orders 0 and 1 are one table of at most 256 * 256 counts that
every shard gets. Words go the same way for the unigram base score: shards sum the
buckets' counts and answer with totals.

Cases: null text counts as empty, and still has its end; rows with equal ids are
rows of their own; a null id is a training row; if there is no training row, all
counts are 0; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .buckets import bucketed, from_planes, partitions, planes
from .textbytes import RangeHash, column_slices, lower, mix, words

ORDER = 5
_EDGE = 0xFF  # no byte of UTF-8
_WORD = RangeHash(71)
_END = np.uint64(0x2545F4914F6CDD1D)  # the key of the end token
_ROW = "kind int, shard int, bucket int, body binary"


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


def _strings(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the order + 1 bytes that end at each byte and at each text's end, and the texts' offsets in them."""
    n = len(offsets) - 1
    size = np.diff(offsets) + order + 1
    at = np.cumsum(size) - size
    padded = np.full(int(size.sum()) + order, _EDGE, np.uint8)
    if len(data):
        padded[np.arange(len(data)) + np.repeat(at + order - offsets[:-1], np.diff(offsets))] = lower(data)
    key = np.zeros(len(padded) - order, np.uint64)
    for k in range(order + 1):
        key |= padded[k : k + len(key)].astype(np.uint64) << np.uint64(8 * (order - k))
    own = np.arange(int(size.sum())) - np.repeat(at, size) <= np.repeat(np.diff(offsets), size)
    return key[own], np.concatenate([[0], np.cumsum(np.diff(offsets) + 1)]) if n else np.zeros(1, np.int64)


def low_orders(pairs: np.ndarray) -> dict[str, np.ndarray]:
    """Counts, totals, symbols and exclusions of the orders 1 and 0 from the 256 x 256 pair counts."""
    single = pairs.sum(axis=0)
    return {"c2": pairs, "t1": pairs.sum(axis=1), "q1": (pairs > 0).sum(axis=1), "x1": (pairs > 0) @ single, "c1": single, "t0": single.sum(), "q0": (single > 0).sum()}


def log_probabilities(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int) -> np.ndarray:
    """log10 probability of the last byte after the others, for sorted distinct keys with training counts.

    All keys that share their last two context bytes must be there.
    """
    base = low_orders(pairs)
    levels: dict[int, tuple] = {}
    for n in range(3, order + 2):  # strings of n bytes: contexts of n - 1
        uniq, inverse = np.unique(keys & _mask(n), return_inverse=True)
        c = np.bincount(inverse, counts, len(uniq))
        context = uniq >> np.uint64(8)
        head = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(uniq) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(uniq))))
        if n == 3:
            shorter = base["c2"][(uniq >> np.uint64(8) & np.uint64(255)).astype(int), (uniq & np.uint64(255)).astype(int)]
        else:
            u, lc = levels[n - 1][0], levels[n - 1][1]
            shorter = lc[np.searchsorted(u, uniq & _mask(n - 1))]
        sums = [np.bincount(of, x, len(head)) for x in (c, c > 0, shorter * (c > 0))]
        levels[n] = (uniq, c, inverse, *(x[of] for x in sums))
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    x_before, q_before = np.zeros(len(keys)), np.zeros(len(keys))
    symbol, last = (keys & np.uint64(255)).astype(int), (keys >> np.uint64(8) & np.uint64(255)).astype(int)
    for n in range(order + 1, 0, -1):
        if n > 2:
            _, c, inverse, t, q, x = levels[n]
            c, t, q, x = c[inverse], t[inverse], q[inverse], x[inverse]
        elif n == 2:
            c, t, q, x = base["c2"][last, symbol], base["t1"][last], base["q1"][last], base["x1"][last]
        else:
            c, t, q, x = base["c1"][symbol], np.full(len(keys), base["t0"]), np.full(len(keys), base["q0"]), np.zeros(len(keys))
        total, kinds = t - x_before, q - q_before
        hit = open_ & (c > 0)
        out[hit] += np.log10((2 * c[hit] - 1) / (2 * total[hit]))
        open_ &= ~hit
        miss = open_ & (kinds > 0)
        out[miss] += np.log10(kinds[miss] / (2 * total[miss]))
        x_before, q_before = x, q
    out[open_] -= np.log10(256 - base["q0"])
    return out


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for _, data, offsets in column_slices(batch["text"]):
            key, _ = _strings(data, offsets, 1)
            total += np.bincount(key.astype(np.int64), minlength=1 << 16)
    seen = np.flatnonzero(total)
    yield pa.record_batch([pa.array(seen, pa.int32()), pa.array(total[seen])], ["pair", "n"])


def _tally(chunks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    if not chunks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = (np.concatenate(x) for x in zip(*chunks, strict=True))
    uniq, inverse = np.unique(keys, return_inverse=True)
    return uniq, np.bincount(inverse, counts, len(uniq)).astype(np.int64)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each text's words and its end, and their offsets."""
    data = lower(data)
    starts, ends, row_words = words(data, offsets)
    key = _WORD.of(_WORD.prefix(data), starts, ends)
    return np.insert(key, row_words[1:], _END), row_words + np.arange(len(row_words))


def _in_chunks(table: pa.Table, order: int):
    """For chunks of rows: the first row and (keys, offsets) of strings and of tokens."""
    for row, data, offsets in column_slices(table["text"]):
        yield row, _strings(data, offsets, order), _tokens(data, offsets)


def _bucket_keys(table: pa.Table, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    train = table["train"].to_numpy(zero_copy_only=False).astype(bool)
    found: list[list] = [[], []]
    for row, *kinds in _in_chunks(table, order):
        for out, (key, offsets) in zip(found, kinds, strict=True):
            own = np.repeat(train[row : row + len(offsets) - 1], np.diff(offsets))
            uniq, inverse = np.unique(key, return_inverse=True)
            out.append((uniq, np.bincount(inverse, own, len(uniq))))
    return [_tally(x) for x in found]


def _shards(kind: int, keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by shard, and where each shard begins and ends in it."""
    h = mix(keys >> np.uint64(8) & np.uint64(0xFFFF)) if kind == 0 else keys
    own = ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    order = np.argsort(own, kind="stable")
    return order, np.searchsorted(own[order], np.arange(shards + 1))


def _ask(order: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        rows = []
        for kind, (keys, counts) in enumerate(_bucket_keys(table, order)):
            by, cuts = _shards(kind, keys, shards)
            for s in range(shards):
                own = by[cuts[s] : cuts[s + 1]]
                if kind or len(own):  # each bucket hears from each shard of words
                    rows.append((kind, s, table["bucket"][0].as_py(), planes(keys[own]) + planes(counts[own])))
        return _table(rows)

    return run


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    kind, shard, bucket, body = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.table({"kind": pa.array(kind, pa.int32()), "shard": pa.array(shard, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "body": pa.array(body, pa.binary())})


def _answer(order: int, pairs: dict[int, int]):
    def run(table: pa.Table) -> pa.Table:
        kind, shard = table["kind"][0].as_py(), table["shard"][0].as_py()
        sent = []
        for body in table["body"].to_pylist():
            half = len(body) // 2
            sent.append((from_planes(body[:half], np.uint64), from_planes(body[half:], np.int64)))
        keys, counts = _tally(sent)
        if kind == 0:
            grid = np.zeros(1 << 16)
            grid[list(pairs)] = list(pairs.values())
            value, head = log_probabilities(keys, counts, grid.reshape(256, 256), order).astype(np.float32), b""
        else:
            value, head = counts, np.array([counts.sum(), (counts > 0).sum()], np.int64).tobytes()
        return _table([(kind, shard, b, head + planes(value[np.searchsorted(keys, x)])) for b, (x, _) in zip(table["bucket"].to_pylist(), sent, strict=True)])

    return run


def _score(order: int, shards: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys = [x for x, _ in _bucket_keys(table, order)]
        value = [np.zeros(len(keys[0])), np.zeros(len(keys[1]), np.int64)]
        places = [_shards(k, keys[k], shards) for k in range(2)]
        seen = np.zeros(2, np.int64)
        for kind, s, body in zip(answers["kind"].to_pylist(), answers["shard"].to_pylist(), answers["body"].to_pylist(), strict=True):
            by, cuts = places[kind]
            own = by[cuts[s] : cuts[s + 1]]
            if kind:
                seen += np.frombuffer(body, np.int64, 2)
                value[1][own] = from_planes(body[16:], np.int64)
            else:
                value[0][own] = from_planes(body, np.float32)
        n, v = (int(x) for x in seen)
        n_tokens, n_known, base, score = [], [], [], []
        for _, *kinds in _in_chunks(table, order):
            (string, at), (token, to) = kinds
            score.append(np.add.reduceat(value[0][np.searchsorted(keys[0], string)], at[:-1]))
            c = value[1][np.searchsorted(keys[1], token)]
            n_tokens.append(np.diff(to))
            n_known.append(np.add.reduceat((c > 0).astype(np.int64), to[:-1]))
            base.append(np.add.reduceat(np.log10((c + 0.5) / (n + 0.5 * (v + 1))), to[:-1]))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return pa.table({"doc_id": table["doc_id"], "train": table["train"], "n_tokens": join(n_tokens, np.int64), "n_known": join(n_known, np.int64), "train_tokens": np.full(len(table), n), "base_score": join(base, float), "score": join(score, float)})

    return run


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", *, order: int = ORDER, buckets: int | None = None, shards: int | None = None) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score (both log10); see the module's text."""
    shards = shards or partitions(docs)
    flag = F.coalesce(train, F.lit(True))
    texts = docs.where(flag).select(F.col(text_col).cast("string").alias("text"))
    pairs = {r.pair: r.n for r in texts.mapInArrow(_pair_counts, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    own = bucketed(docs, id_col, text_col, buckets or shards, train=flag).groupBy("bucket")
    answers = own.applyInArrow(_ask(order, shards), _ROW).groupBy("kind", "shard").applyInArrow(_answer(order, pairs), _ROW)
    return own.cogroup(answers.groupBy("bucket")).applyInArrow(_score(order, shards), "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_ppm_lm_scoring(spark, sf_dir: str) -> DataFrame:
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1
    out = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), train)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


SQL = None
