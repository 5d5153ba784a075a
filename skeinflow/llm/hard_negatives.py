"""Hard negatives by exact integer scores from float32 products of residues.

A score is the inner product of two integer vectors. Vectors are reduced modulo
several small primes; residue matrices are multiplied in float32, ``DEPTH``
components at once, so that each sum stays below 2**24 and is exact; the signed
score is put together from its residues by the Chinese remainder theorem, digit by
digit in mixed radix. As many primes are taken as the largest component met and the
longest vector need.

Rows go into blocks of about ``block_rows``, anchors into blocks of about
``anchor_rows``; each block of rows meets each block of anchors once in each of two
passes and gives only the best rows of each anchor: first those of its own label,
then, below each positive's score, those of other labels. Windows over an anchor's
best rows of all blocks pick the result. Neither pass gathers the rows of a label,
and equal rows are counted before they are dealt out, so a hot vector or label
weighs on no task.

Cases: rows with a null id, label or vector, or a null component, take no part. A
vector shorter than others is continued by zeros. Ties of score go to the smaller
id; repeated rows are rows of their own, as positives, negatives and anchors, but a
row with the anchor's id is never its positive. A table that is empty or has no
anchors gives an empty result; columns other than the named ones are not looked at,
whatever their names. Vectors of any length are used whole; components so large that
a score could pass 2**56 are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .session import cut

DEPTH = 64
#: The largest primes whose residues, at most half of them in size, give exact sums of DEPTH products in float32. Fixed values.
PRIMES = (1021, 1019, 1013, 1009, 997, 991)
BLOCK_ROWS = 8192
ANCHOR_ROWS = 512
_LOW = np.iinfo(np.int64).min


def primes_for(bound: int) -> tuple[int, ...]:
    """As many primes as tell apart all numbers from -bound to bound."""
    if bound >= 1 << 56:
        raise ValueError("scores could pass 2**56")
    return next(PRIMES[:n] for n in range(1, len(PRIMES) + 1) if prod(PRIMES[:n]) > 2 * bound)


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, from -(p-1)/2 to (p-1)/2, as float32."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def exact_scores(a: np.ndarray, b: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """a @ b.T of integer matrices of equal width; scores must lie within half the product of the primes."""
    out, radix = np.zeros((len(a), len(b)), np.int64), 1
    for p in primes:
        left, right = residues(a, p), residues(b, p)
        total = np.zeros(out.shape, np.int64)
        for k in range(0, a.shape[1], DEPTH):
            total += (left[:, k : k + DEPTH] @ right[:, k : k + DEPTH].T).astype(np.int64)
        digit = np.mod(np.mod(total - out, p) * pow(radix, -1, p), p)
        out += np.where(digit > p // 2, digit - p, digit) * radix
        radix *= p
    return out


def _best(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best scores that fit in each row; of equal ones the first columns."""
    masked = np.where(fits, scores, _LOW)
    least = np.partition(masked, -k, axis=1)[:, -k][:, None] if masked.shape[1] > k else _LOW
    row, column = np.nonzero((masked >= least) & (masked > _LOW))
    order = np.lexsort((column, -masked[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _packed(keys: tuple[str, ...], lists: tuple[str, ...]):
    """One row for a group: its id and other long columns, and its lists, each with its width, as matrices; ids ascend."""

    def matrix(column: pa.ChunkedArray) -> bytes:
        column = column.combine_chunks()
        flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
        sizes = np.diff(offsets)
        out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
        out[np.arange(out.shape[1]) < sizes[:, None]] = flat
        return out.tobytes()

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table[keys[0]].to_numpy(), kind="stable")))
        out = {"block": pa.array([table["block"][0].as_py()], pa.int32()), "n": pa.array([len(table)], pa.int32())}
        out |= {name: pa.array([table[name].to_numpy().astype(np.int64).tobytes()], pa.binary()) for name in keys}
        return pa.table(out | {name: pa.array([matrix(table[name])], pa.binary()) for name in lists})

    return run


def _read(row: dict, names: tuple[str, ...], n: int) -> list[np.ndarray]:
    return [np.frombuffer(row[name], np.int64).reshape(n, -1) for name in names]


def _scored(row: dict, primes: tuple[int, ...]):
    """Ids and labels of a pair of blocks, and the scores of its anchors with its rows."""
    ids, labels, vectors = _read(row, ("vec_id", "label", "vector"), row["n"])
    own, variant, own_labels, own_vectors = _read(row, ("anchor_id", "variant", "anchor_label", "anchor_vector"), row["anchors"])
    wide = max(vectors.shape[1], own_vectors.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (own_vectors, vectors))
    return ids.ravel(), own_labels == labels.ravel(), own.ravel(), variant.ravel(), exact_scores(a, b, primes)


def _each_pair(work):
    """work on one pair of blocks after the other; it gives columns of longs by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                out = work({name: batch[name][k].as_py() for name in batch.schema.names})
                yield pa.record_batch([pa.array(x, pa.int64()) for x in out.values()], list(out))

    return run


def _positives(primes: tuple[int, ...], k: int):
    def work(pair: dict) -> dict:
        ids, same, own, variant, scores = _scored(pair, primes)
        i, j = _best(scores, same & (ids != own[:, None]), k)
        return {"anchor_id": own[i], "variant": variant[i], "vec_id": ids[j], "score": scores[i, j]}

    return _each_pair(work)


def _negatives(primes: tuple[int, ...], k: int, low: int, high: int):
    def work(pair: dict) -> dict:
        ids, same, own, variant, scores = _scored(pair, primes)
        (bars,) = _read(pair, ("bars",), pair["anchors"])
        (counts,) = _read(pair, ("n_bars",), pair["anchors"])
        out = []
        for b in range(bars.shape[1]):
            bar = bars[:, b : b + 1]
            i, j = _best(scores, ~same & (counts > b) & (100 * scores >= low * bar) & (100 * scores <= high * bar), k)
            out.append((own[i], variant[i], bars[i, b], ids[j], scores[i, j]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return dict(zip(("anchor_id", "variant", "bar", "vec_id", "score"), columns, strict=True))

    return _each_pair(work)


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each key with their rank."""
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "vector",
    *,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    block_rows: int = BLOCK_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors of whole numbers.

    ``anchors`` tells by the column ``vec_id`` which rows are anchors. An anchor's
    positives are the best rows of its label; to each belong the best rows of other
    labels whose score is between low and high hundredths of its own.
    """
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<bigint>").alias("vector"))
    whole = named.where("vec_id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
    # equal rows once, with their number
    found = cut(whole.groupBy("vec_id", "label", "vector").agg(F.count("*").alias("copies")))
    largest = F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector")))
    n, n_anchors, size, wide = found.agg(F.count("*"), F.count_if(anchors), F.max(largest), F.max(F.size("vector"))).first()
    primes = primes_for(int(wide or 0) * int(size or 0) ** 2)
    blocks, anchor_blocks = n // block_rows + 1, n_anchors // anchor_rows + 1

    place = lambda *columns: F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int")
    several = F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(max(positives, negatives))).cast("int")))
    dealt = found.select("vec_id", "label", "vector", several.alias("copy")).withColumn("block", place("vec_id", "vector", "copy"))
    row_blocks = cut(dealt.groupBy("block").applyInArrow(_packed(("vec_id", "label"), ("vector",)), "block int, n int, vec_id binary, label binary, vector binary"))

    variant = F.row_number().over(Window.partitionBy("vec_id").orderBy("label", "vector")).cast("long")
    chosen = found.where(anchors).select(F.col("vec_id").alias("anchor_id"), variant.alias("variant"), F.col("label").alias("anchor_label"), F.col("vector").alias("anchor_vector"), "copies")
    chosen = cut(chosen.withColumn("block", F.pmod(F.xxhash64("anchor_id", "variant"), F.lit(anchor_blocks)).cast("int")))
    keys, each_row_block = ("anchor_id", "variant", "anchor_label"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def pairs(own: DataFrame, more: tuple[str, ...], lists: tuple[str, ...]) -> DataFrame:
        names = (*keys, *more, "anchor_vector", *lists)
        packed = own.groupBy("block").applyInArrow(_packed((*keys, *more), ("anchor_vector", *lists)), "block int, n int, " + ", ".join(f"{x} binary" for x in names))
        sent = packed.select(F.col("n").alias("anchors"), *names, each_row_block.alias("block"))
        return sent.join(row_blocks.hint("shuffle_merge"), "block").drop("block")

    best = pairs(chosen.drop("copies"), (), ()).mapInArrow(_positives(primes, positives), "anchor_id bigint, variant bigint, vec_id bigint, score bigint")
    positive = cut(_first(best, ["anchor_id", "variant"], positives).select("anchor_id", "variant", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("positive_rank")))
    bars = positive.groupBy("anchor_id", "variant").agg(F.collect_set("positive_score").alias("bars"))
    barred = chosen.drop("copies").join(bars, ["anchor_id", "variant"]).withColumn("n_bars", F.size("bars").cast("long"))
    near = pairs(barred, ("n_bars",), ("bars",)).mapInArrow(_negatives(primes, negatives, low, high), "anchor_id bigint, variant bigint, bar bigint, vec_id bigint, score bigint")
    negative = _first(near, ["anchor_id", "variant", "bar"], negatives).withColumnRenamed("bar", "positive_score")
    out = positive.join(negative, ["anchor_id", "variant", "positive_score"]).join(chosen.select("anchor_id", "variant", "copies"), ["anchor_id", "variant"])
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return out.withColumn("time", times).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_rns_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    finite = "vec_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    ready = rows.where(finite).select("vec_id", label.alias("label"), vector.alias("vector"))
    return hard_negatives(ready, F.col("vec_id") % 100 == 0)


SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS own, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a, r b WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT own AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""
