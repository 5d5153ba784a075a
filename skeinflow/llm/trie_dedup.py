"""Exact dedup by the owners of texts in Patricia tries.

Texts are equal when identical after lower-casing A-Z only; null counts as empty.

1. Each task inserts its texts into a compressed radix trie, whose terminal nodes
   hold the smallest and largest id and the number of rows, and sends every
   distinct text on once. A group of copies, however large, thus reaches the next
   step once for each task.
2. Partitions by length and content hash insert those byte strings into tries of
   their own; the terminal node names the owner. A trie whose strings outgrow
   ``memory_bytes`` writes its largest subtrees to disk and merges them one by one.
3. Owners of groups of two rows or more are joined back by content hash; Spark
   splits a hot hash in that join.

Cases: rows with equal ids count as rows of their own; a null id owns a group only
if all its ids are null; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

MEMORY_BYTES = 64_000_000


class PatriciaTrie:
    """Byte strings on compressed edges; a terminal holds (smallest, largest, rows).

    A node is [edge, terminal or None, children by first byte]. Strings under the
    root are counted by first byte; beyond ``memory_bytes`` the largest of these
    subtrees is written out, and later strings of it start a new one.
    """

    def __init__(self, memory_bytes: int = MEMORY_BYTES) -> None:
        self.memory_bytes = memory_bytes
        self.root: list = [b"", None, {}]
        self.held: dict[int, int] = {}
        self.total = 0
        self.spilled: dict[int, list] = {}

    @staticmethod
    def _merged(a, b):
        if a is None or b is None:
            return a or b
        low = [x for x in (a[0], b[0]) if x is not None]
        high = [x for x in (a[1], b[1]) if x is not None]
        return (min(low) if low else None, max(high) if high else None, a[2] + b[2])

    def add(self, key: bytes, value: tuple) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[2].get(key[at])
            if child is None:
                node[2][key[at]] = [key[at:], value, {}]
                self._count(key, len(key) - at)
                return
            edge = child[0]
            if key.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            same, most = 1, min(len(edge), len(key) - at)
            step = most
            while same < most:  # length of the common part, by halves
                step = max(1, (most - same + 1) // 2)
                if edge[same : same + step] == key[at + same : at + same + step]:
                    same += step
                else:
                    most = same + step - 1
            split = [edge[:same], None, {edge[same]: child}]
            child[0] = edge[same:]
            node[2][key[at]] = split
            node, at = split, at + same
        new = node[1] is None
        node[1] = self._merged(node[1], value)
        if new:  # only now, as counting may write the node out
            self._count(key, 0)

    def _count(self, key: bytes, size: int) -> None:
        if not key:
            return
        self.held[key[0]] = self.held.get(key[0], 0) + size + 200
        self.total += size + 200
        if self.total > self.memory_bytes:
            self._spill(max(self.held, key=self.held.get))

    def _spill(self, first: int) -> None:
        out = tempfile.TemporaryFile()
        for item in self._walk(self.root[2].pop(first), b""):
            pickle.dump(item, out)
        self.spilled.setdefault(first, []).append(out)
        self.total -= self.held.pop(first)

    def _walk(self, node: list, before: bytes) -> Iterator[tuple[bytes, tuple]]:
        stack = [(node, before)]
        while stack:
            node, before = stack.pop()
            key = before + node[0]
            if node[1] is not None:
                yield key, node[1]
            stack.extend((x, key) for x in node[2].values())

    @staticmethod
    def _read(runs: list) -> Iterator[tuple[bytes, tuple]]:
        for run in runs:
            run.seek(0)
            while True:
                try:
                    yield pickle.load(run)
                except EOFError:
                    break

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        """All strings with their terminals; spilled subtrees one by one."""
        for first in list(self.spilled):
            if first in self.root[2]:
                self._spill(first)
        yield from self._walk(self.root, b"")
        self.root = [b"", None, {}]
        for runs in self.spilled.values():
            lead = None
            for key, _ in self._read(runs):
                lead = key if lead is None else os.path.commonprefix([lead, key])
            part = PatriciaTrie(self.memory_bytes)
            for key, value in self._read(runs):
                part.add(key[len(lead) :], value)
            yield from ((lead + key, value) for key, value in part.items())
            for run in runs:
                run.close()
        self.spilled = {}


def _folded(column: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(column, "")).cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())


def _local(memory_bytes: int):
    """One row for each distinct text of the task (or of what fits its memory)."""

    def rows(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for key, (low, high, n) in trie.items():
            sha = hashlib.sha256(key).hexdigest()
            out.append((len(key), sha, key, low, high, n))
            size += len(key)
            if size > 8_000_000:
                yield _batch(out)
                out, size = [], 0
        yield _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(1 << 62)
        for batch in batches:
            for key, i in zip(_folded(batch["text"]), batch["doc_id"].to_pylist(), strict=True):
                trie.add(key.as_py(), (i, i, 1))
                if trie.total > memory_bytes:  # what comes later is merged by the owners
                    yield from rows(trie)
                    trie = PatriciaTrie(1 << 62)
        yield from rows(trie)

    return run


_LOCAL = "length long, sha string, body binary, low long, high long, n long"


def _batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["length", "sha", "body", "low", "high", "n"])


def _owners(memory_bytes: int, keep_largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(memory_bytes)
        for batch in batches:
            for key, low, high, n in zip(batch["body"], *(batch[c].to_pylist() for c in ("low", "high", "n")), strict=True):
                trie.add(key.as_py(), (low, high, n))
        out = [(hashlib.sha256(key).hexdigest(), high if keep_largest else low, n) for key, (low, high, n) in trie.items() if n > 1]
        sha, keep, n = zip(*out, strict=True) if out else ((), (), ())
        yield pa.record_batch([pa.array(sha, pa.string()), pa.array(keep, pa.int64()), pa.array(n, pa.int64())], ["owner_sha", "owner_id", "rows_n"])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sha = [hashlib.sha256(x.as_py()).hexdigest() for x in _folded(batch["text"])]
        yield pa.record_batch([batch["doc_id"], pa.array(sha, pa.string())], ["doc_id", "text_sha256"])


def text_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "smallest", memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """(owner_sha, owner_id, rows_n) of every text that two rows or more hold."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    local = own.mapInArrow(_local(memory_bytes), _LOCAL)
    dealt = local.repartition("length", F.substring("sha", 1, 16)).select("body", "low", "high", "n")
    return dealt.mapInArrow(_owners(memory_bytes, keep == "largest"), "owner_sha string, owner_id long, rows_n long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "smallest", memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; see the module's text."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = own.mapInArrow(_hashed, "doc_id long, text_sha256 string")
    owners = text_owners(docs, id_col, text_col, keep=keep, memory_bytes=memory_bytes)
    found = hashed.join(owners, hashed.text_sha256 == owners.owner_sha, "left")
    keep_id = F.when(F.col("rows_n").isNull(), F.col("doc_id")).otherwise(F.col("owner_id"))
    return found.select("doc_id", keep_id.alias("keep_id"), F.coalesce("rows_n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def op2_patricia_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""
