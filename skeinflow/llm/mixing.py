"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A document's size is its number of words (runs of characters other than 0x20 and
0x09-0x0D). All sizes together are shared by weight; a target stops at
``max_epochs`` times its source's size, and the excess is shared again.

A source's documents are dealt by hash into ``blocks`` blocks. Permuted by hash, its
blocks are drawn one after the other, again from the first when all are drawn, until
the next one's middle would lie beyond the target: so many are the source's quota. A
binary tree over the output shards splits all quotas exactly, by multivariate
hypergeometric draws. Each shard draws as many blocks as it was given, the next ones
in the permuted order, so that shards have disjoint blocks of an epoch; a document is
taken once for each draw of its block, and a shard orders what it got by hash. Whole
blocks are drawn, so a source is off its target by half a block at most; while there
are more blocks than documents that is half a document.

Blocks are dealt by source and hash, so a source with a third of all rows is spread
over as many groups; a window sees one row for each block. The driver sees one row for
each source (the table of weights and quotas), no document.

Cases: null text has size 0; null is a source of its own, last in order; sources
without words get target 0; rows with equal ids are rows of their own, rows with equal
ids and sizes share a block; equal hashes of blocks are ordered by block; a text of
any length is one document; an empty table gives an empty result; other columns are
carried along, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .buckets import partitions
from .session import cut


def targets(sizes: list[int], weights: list[float], max_epochs: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none above max_epochs times its size."""
    out, free = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    left = float(sum(sizes))
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > max_epochs * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = max_epochs * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) block counts: each column sums to its quota, each row to an even share."""
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, np.asarray(quotas, np.int64))]
    while stack:
        low, high, own = stack.pop()
        if high - low == 1:
            out[low] = own
            continue
        mid = (low + high) // 2
        total = int(own.sum())
        rng = np.random.default_rng([seed, low, high])
        left = _hypergeometric(rng, own, total * (mid - low) // (high - low))
        stack += [(low, mid, left), (mid, high, own - left)]
    return out


def _hypergeometric(rng: np.random.Generator, colors: np.ndarray, draws: int) -> np.ndarray:
    if not len(colors) or not draws:
        return np.zeros(len(colors), np.int64)
    return rng.multivariate_hypergeometric(colors, draws, method="marginals")


def _size(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), "")), F.lit(0)).cast("long")


def _drawn(docs: DataFrame, weights: list[float], id_col: str, text_col: str, source_col: str, max_epochs: float, shards: int | None, blocks: int, seed: int) -> DataFrame:
    """(row: all columns of docs, mix_size, mix_source_size, mix_target, mix_draws)."""
    shards = shards or partitions(docs)
    name = F.col(f"row.{source_col}").cast("string")
    size = F.when(F.col(f"row.{text_col}").isNull(), F.lit(0).cast("long")).otherwise(_size(F.col(f"row.{text_col}")))
    sized = docs.select(F.struct(*docs.columns).alias("row")).select("row", size.alias("mix_size"), F.concat(F.when(name.isNull(), "-").otherwise("+"), F.coalesce(name, F.lit(""))).alias("key"))
    sized = sized.withColumn("hash", F.xxhash64(F.lit(seed), F.col(f"row.{id_col}").cast("string"), "mix_size")).withColumn("block", F.pmod("hash", F.lit(blocks)).cast("int"))
    words = cut(sized.groupBy("key", "block").agg(F.sum("mix_size").alias("words")))
    rows = words.groupBy("key").agg(F.sum("words").alias("n"), F.count("*").alias("b")).collect()
    rows = sorted(rows, key=lambda r: (r.key[0] == "-", r.key[1:].encode()))
    goal = targets([r.n for r in rows], [weights[i % len(weights)] for i in range(len(rows))], max_epochs)
    whole = [math.floor(t / r.n) if r.n else 0 for t, r in zip(goal, rows, strict=True)]
    spark = docs.sparkSession
    plan = spark.createDataFrame([(r.key, int(r.n), t, int(r.b), float(t - w * r.n)) for r, t, w in zip(rows, goal, whole, strict=True)], "key string, mix_source_size long, mix_target double, own_blocks long, rest double")
    order = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "key", "block"), "block")
    placed = words.withColumns({"turn": F.row_number().over(order) - 1, "middle": F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words") / 2})
    part = {r.key: r.r for r in placed.join(plan, "key").groupBy("key").agg(F.sum(F.when(F.col("middle") < F.col("rest"), 1).otherwise(0)).alias("r")).collect()}
    quota = [w * r.b + part[r.key] for w, r in zip(whole, rows, strict=True)]
    cuts = split_quotas(np.array(quota, np.int64), shards, seed).cumsum(axis=0)
    given = spark.createDataFrame([(r.key, [int(x) for x in cuts[:, i]]) for i, r in enumerate(rows)], "key string, cuts array<long>")
    # draw number epoch * blocks + turn belongs to the shard whose share of the quota it falls into
    draws = F.filter(F.transform(F.sequence(F.lit(0), F.lit(math.ceil(max_epochs) - 1)), lambda e: e * F.col("own_blocks") + F.col("turn")), lambda k: k < F.element_at("cuts", -1))
    shard_of = F.transform(draws, lambda k: F.size(F.filter("cuts", lambda x: x <= k)))
    drawn = placed.join(plan, "key").join(given, "key").select("key", "block", "mix_source_size", "mix_target", shard_of.alias("shards"))
    out = sized.join(drawn, ["key", "block"])
    place = lambda s, e: F.struct(s.alias("shard"), F.xxhash64(F.lit(seed), "hash", e, F.lit("place")).alias("place"))
    return out.select("row", "mix_size", "mix_source_size", "mix_target", F.transform("shards", place).alias("mix_draws"))


def mixing_plan(docs: DataFrame, weights: list[float] = (1.0, 2.0, 3.0), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, max_epochs: float = 3.0, shards: int | None = None, blocks: int = 65_536, seed: int = 8) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_draws, an array of (shard, place) for each copy taken.

    ``weights`` repeat over the sources in order of code point, null last. Columns of
    docs with one of the four names are replaced.
    """
    drawn = _drawn(docs, weights, id_col, text_col, source_col, max_epochs, shards, blocks, seed)
    new = ["mix_size", "mix_source_size", "mix_target", "mix_draws"]
    return drawn.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new], *new)


def mixed_documents(docs: DataFrame, weights: list[float] = (1.0, 2.0, 3.0), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, max_epochs: float = 3.0, shards: int | None = None, blocks: int = 65_536, seed: int = 8) -> DataFrame:
    """The rows of docs that the mix takes, once for each copy, dealt by shard and shuffled inside."""
    drawn = _drawn(docs, weights, id_col, text_col, source_col, max_epochs, shards, blocks, seed)
    taken = drawn.where(F.size("mix_draws") > 0).select("row", F.explode("mix_draws").alias("draw"))
    return taken.repartition("draw.shard").sortWithinPartitions("draw.shard", "draw.place").select("row.*")


def op8_hypergeometric_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    plan = mixing_plan(docs)
    return plan.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.size("mix_draws")).alias("taken"))


SQL = None
