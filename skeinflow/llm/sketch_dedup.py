"""Substring dedup with a count-min prefilter.

A window is ``width`` consecutive words of one document; a word is a maximal run
of bytes other than 0x20 and 0x09-0x0D. A word goes if it lies in a window whose
word sequence also starts in a document with a smaller id.

1. Each bucket of documents sends every hash shard a sparse sketch of its
   windows; the shard merges the sketches into count-min rows and answers with one
   bit for each window: estimated in two buckets or more. Counts are never too
   small, so no repeat is lost. The rows are as wide as the shard's share needs.
2. Only windows estimated repeated go on, as 128-bit digests with the bucket's
   smallest id; a shard groups them exactly and tells each bucket which start in a
   smaller document elsewhere. Repeats inside a bucket are settled there.

Cases: null text counts as empty; documents shorter than the window stay whole;
rows with equal ids don't remove from one another; a null id counts as the
largest; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .buckets import bucketed, by_shard, pack_sorted, partitions, place, unpack_sorted
from .textbytes import RangeHash, column_slices, covered, mix, run_hash, windows, words

WIDTH = 13
_LAST = np.iinfo(np.int64).max
_HASHES = (RangeHash(11), RangeHash(12))


def _bucket_windows(table: pa.Table, width: int, both: bool):
    """For the rows in order of id: ids, window hashes (one or two), their rows, and each row's word offsets."""
    table = table.set_column(table.schema.get_field_index("doc_id"), "doc_id", table["doc_id"].fill_null(_LAST)).sort_by("doc_id")
    h1, h2, owner, first, counts = [], [], [], [], []
    for row, data, offsets in column_slices(table["text"]):
        starts, ends, row_words = words(data, offsets)
        at, rows = windows(row_words, width)
        for k, out in ((0, h1), (1, h2))[: 1 + both]:
            w = _HASHES[k].of(_HASHES[k].prefix(data), starts, ends)
            out.append(run_hash(w, width, 21 + k)[at] if len(at) else np.zeros(0, np.uint64))
        owner.append(rows + row)
        first.append(at - row_words[rows])
        counts.append(np.diff(row_words))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return table, join(h1, np.uint64), join(h2, np.uint64), join(owner, np.int64), join(first, np.int64), join(counts, np.int64)


def _sketches(width: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        unique = np.unique(_bucket_windows(table, width, False)[1])
        low = place(unique, shards).astype(np.uint32)
        runs = by_shard(unique, shards)
        return pa.table({"shard": pa.array([s for s, _, _ in runs], pa.int32()), "bucket": pa.array([bucket] * len(runs), pa.int32()), "cells": pa.array([pack_sorted(low[a:b]) for _, a, b in runs], pa.binary())})

    return run


def _merge(table: pa.Table) -> pa.Table:
    """The shard's count-min rows from its buckets' sketches, and what they say of each bucket's windows."""
    sent = [unpack_sorted(x.as_py()) for x in table["cells"]]
    cells = max(1 << 10, 1 << (4 * sum(map(len, sent))).bit_length())
    rows = [np.zeros(cells, np.uint8) for _ in range(2)]

    def at(k: int, x: np.ndarray) -> np.ndarray:
        return (mix(x.astype(np.uint64) + np.uint64((k + 1) << 40)) & np.uint64(cells - 1)).astype(np.int64)

    for x in sent:
        for k, row in enumerate(rows):
            cell = at(k, x)
            row[cell] = np.minimum(row[cell], 2) + 1  # two is all that is asked for
    flags = [np.packbits(np.minimum(rows[0][at(0, x)], rows[1][at(1, x)]) >= 2).tobytes() for x in sent]
    return pa.table({"bucket": table["bucket"], "shard": table["shard"], "flags": pa.array(flags, pa.binary())})


def _candidates(width: int, shards: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        empty = {"shard": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "first": pa.array([], pa.binary())}
        if not len(table):
            return pa.table(empty)
        bucket = table["bucket"][0].as_py()
        table, h1, h2, owner, _, _ = _bucket_windows(table, width, True)
        unique, index = np.unique(h1, return_index=True)
        repeated = np.zeros(len(unique), bool)
        told = dict(zip(answers["shard"].to_pylist(), answers["flags"].to_pylist(), strict=True))
        for s, a, b in by_shard(unique, shards):
            repeated[a:b] = np.unpackbits(np.frombuffer(told[s], np.uint8), count=b - a)
        unique, index = unique[repeated], index[repeated]
        ids = table["doc_id"].to_numpy()[owner[index]].astype(np.int64)
        second = h2[index]
        runs = by_shard(unique, shards)
        return pa.table({"shard": pa.array([s for s, _, _ in runs], pa.int32()), "bucket": pa.array([bucket] * len(runs), pa.int32()), "first": pa.array([unique[a:b].tobytes() + second[a:b].tobytes() + ids[a:b].tobytes() for _, a, b in runs], pa.binary())})

    return run


def _exact(table: pa.Table) -> pa.Table:
    """Of each bucket's windows, those that start in a smaller document of another bucket."""
    parts, size = [], []
    for x in table["first"]:
        parts.append(np.frombuffer(x.as_py(), np.uint64).reshape(3, -1))
        size.append(parts[-1].shape[1])
    h1, h2, ids = np.concatenate(parts, axis=1)
    ids = ids.astype(np.int64)
    order = np.lexsort((ids, h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    smallest = np.empty(len(order), np.int64)
    smallest[order] = ids[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = smallest < ids
    out, at = [], 0
    for n in size:
        own = later[at : at + n]
        out.append(h1[at : at + n][own].tobytes() + h2[at : at + n][own].tobytes())
        at += n
    return pa.table({"bucket": table["bucket"], "later": pa.array(out, pa.binary())})


def _apply(width: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, h1, h2, owner, first, counts = _bucket_windows(table, width, True)
        ids = table["doc_id"].to_numpy().astype(np.int64)
        sent = [np.frombuffer(x.as_py(), np.uint64).reshape(2, -1) for x in answers["later"]]
        a, b = np.concatenate(sent, axis=1) if sent else np.zeros((2, 0), np.uint64)
        order = np.argsort(a)
        a, b = a[order], b[order]
        gone = np.zeros(len(h1), bool)
        if len(a):
            near = np.minimum(np.searchsorted(a, h1), len(a) - 1)
            gone = (a[near] == h1) & (b[near] == h2)
        _, index, inverse = np.unique(h1, return_index=True, return_inverse=True)
        if len(h1):
            lead = index[inverse]
            gone |= (ids[owner] > ids[owner[lead]]) & (h2 == h2[lead])
        base = np.cumsum(counts) - counts
        marks = covered(base[owner[gone]] + first[gone], width, int(counts.sum()))
        removed = np.add.reduceat(np.append(marks, False), np.minimum(base, len(marks)), dtype=np.int64) if len(base) else base
        removed[counts == 0] = 0
        texts = []
        for k, text in enumerate(table["text"]):
            own = (text.as_py() or "").encode().split()
            if removed[k]:
                own = itertools.compress(own, ~marks[base[k] : base[k] + counts[k]])
            texts.append(b" ".join(own))
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=ids == _LAST), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.binary()).cast(pa.string())})

    return run


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, buckets: int | None = None, shards: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): kept words joined by one space; see the module's text."""
    shards = shards or partitions(docs)
    dealt = bucketed(docs, id_col, text_col, buckets)
    own = dealt.groupBy("bucket")
    flags = own.applyInArrow(_sketches(width, shards), "shard int, bucket int, cells binary").groupBy("shard").applyInArrow(_merge, "bucket int, shard int, flags binary")
    later = own.cogroup(flags.groupBy("bucket")).applyInArrow(_candidates(width, shards), "shard int, bucket int, first binary").groupBy("shard").applyInArrow(_exact, "bucket int, later binary")
    return own.cogroup(later.groupBy("bucket")).applyInArrow(_apply(width), "doc_id long, n_words long, n_removed long, kept_text string")


def op4_count_min_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeated_windows(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


#: A window's first document is the smallest id among the documents where it starts.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT g, min(doc_id) AS owner FROM p GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, i + k AS at FROM (SELECT p.doc_id, p.i, unnest(range(0, 13)) AS k FROM p JOIN f USING (g) WHERE f.owner < p.doc_id)),
t AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS at FROM w),
k AS (SELECT t.doc_id, count(*) FILTER (r.at IS NOT NULL) AS n_removed, string_agg(t.x, ' ' ORDER BY t.at) FILTER (r.at IS NULL) AS kept FROM t LEFT JOIN r ON t.doc_id = r.doc_id AND t.at = r.at GROUP BY t.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
