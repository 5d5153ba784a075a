"""Documents dealt into buckets that can ask questions of hash shards.

A bucket holds the documents whose id falls into it, so no group of copies
gathers in one. What a bucket asks or is told travels as one binary row for each
(bucket, shard), already reduced to distinct values; a hot value therefore
reaches its shard once for each bucket. All stages that group the documents by
bucket use the same columns, so that Spark shuffles the texts once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucketed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, **more) -> DataFrame:
    """(bucket, doc_id, text) and more columns; by default two buckets for each shuffle partition."""
    buckets = buckets or 2 * partitions(docs)
    spread = F.xxhash64(F.col(id_col).cast("string"), F.length(text_col), F.lit(7))
    return docs.select(
        F.pmod(spread, F.lit(buckets)).cast("int").alias("bucket"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        *[c.alias(name) for name, c in more.items()],
    )


def place(h: np.ndarray, shards: int) -> np.ndarray:
    """h * shards / 2**32 of 64-bit hashes: the shard in the high half, the place in the shard in the low half."""
    low = np.uint64(0xFFFFFFFF)
    return (h >> np.uint64(32)) * np.uint64(shards) + (((h & low) * np.uint64(shards)) >> np.uint64(32))


def by_shard(sorted_h: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of the runs of sorted hashes, without empty ones."""
    own = (place(sorted_h, shards) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(own, np.arange(shards + 1))
    return [(int(s), int(cuts[s]), int(cuts[s + 1])) for s in np.flatnonzero(np.diff(cuts))]


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint32 values as gaps, the low halves first, so that the block compresses."""
    gaps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack_sorted(block: bytes) -> np.ndarray:
    planes = np.frombuffer(block, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that slowly changing or small numbers compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def from_planes(block: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
