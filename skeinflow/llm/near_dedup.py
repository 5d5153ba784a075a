"""MinHash near-dedup by inverted lists of signature coordinates.

A document's set is its distinct runs of ``width`` words after lower-casing A-Z; a
text of fewer words is one run, a text without words has the empty set and is
linked with nothing. Documents are linked if 100 * intersection >= 75 * union.

1. Documents with the same set are one node, so copies count once.
2. A node is posted under its (coordinate, value) pairs. Nodes that share J of their
   shingles agree in about J of ``coordinates`` pairs; a pair of nodes is a candidate
   if it agrees in ``matches`` or more. At J = 0.75 fewer than 20 of 48 has a chance
   of about one in ten million.
3. Prefix and skip: a node with fewer than ``matches`` pairs that any other node has
   cannot be a candidate and is skipped; others are posted under their rarest
   coordinates - matches + 1 pairs only, which two candidates cannot both miss.
4. In each list every node is compared with the list's first node only, on the full
   sets. Verified links give components.
5. ``star_rounds`` times, nodes outside a list's largest component are compared with
   another node of that component.
6. Lists that still hold several components are gone through exactly: candidates
   across components that were not compared yet, in blocks of ``block`` nodes, are
   verified too. Pairs inside a component need no look, so a large group of near
   copies costs a comparison for each of its nodes, not for each of its pairs.

Cases: null text counts as empty; rows with equal ids are rows of their own; null
ids take part, and a component's id is its smallest non-null id; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .buckets import by_shard, partitions
from .components import connected_components
from .session import cut
from .textbytes import RangeHash, column_slices, lower, mix, run_hash, windows, words

WIDTH, COORDINATES, MATCHES = 5, 48, 20
_WORD = RangeHash(41)
_ROW_BITS = 52
_NONE = np.iinfo(np.int64).max
_MASK = np.uint64((1 << _ROW_BITS) - 1)


def _sets(column, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, set elements row by row in ascending order, their offsets); elements are 52-bit hashes."""
    for row, data, offsets in column_slices(column):
        while len(offsets) - 1 > 4000:  # the row must fit above the hash
            yield from _sets_of(row, data[: offsets[4000]], offsets[:4001], width)
            data, row = data[offsets[4000] :], row + 4000
            offsets = offsets[4000:] - offsets[4000]
        yield from _sets_of(row, data, offsets, width)


def _sets_of(row: int, data: np.ndarray, offsets: np.ndarray, width: int):
    data = lower(data)
    starts, ends, row_words = words(data, offsets)
    h = _WORD.of(_WORD.prefix(data), starts, ends)
    at, rows = windows(row_words, width)
    grams = [run_hash(h, width, 50)[at] if len(at) else np.zeros(0, np.uint64)]
    owner = [rows]
    counts = np.diff(row_words)
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        if len(short):
            grams.append(run_hash(h, n, 50 + n)[row_words[short]])
            owner.append(short)
    key = np.sort((np.concatenate(owner).astype(np.uint64) << np.uint64(_ROW_BITS)) | (np.concatenate(grams) >> np.uint64(12)))
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    yield row, key & _MASK, np.searchsorted(key, np.arange(len(offsets), dtype=np.uint64) << np.uint64(_ROW_BITS))


def _signatures(width: int, coordinates: int):
    odd = np.random.PCG64(60).random_raw(2 * coordinates).astype(np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [c for c in batch.schema.names if c != "text"]
            for row, values, offsets in _sets(batch["text"], width):
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                sums = np.zeros((2, len(n)), np.uint64)
                signature = np.zeros((len(n), coordinates), np.uint64)
                if len(full):
                    begin = offsets[:-1][full]
                    for k, seed in enumerate((0x1234567, 0x7654321)):
                        sums[k, full] = mix(np.add.reduceat(mix(values ^ np.uint64(seed)), begin) + n[full].astype(np.uint64))
                    for k in range(coordinates):
                        least = np.minimum.reduceat(values * odd[2 * k] + odd[2 * k + 1], begin)
                        signature[full, k] = mix(least + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
                yield pa.record_batch(
                    [*(batch[c].slice(row, len(n)) for c in own), pa.array(n, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array([x.tobytes() for x in signature], pa.binary())],
                    [*own, "n_shingles", "node", "check", "signature"],
                )

    return run


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _ask(shards: int):
    def run(table: pa.Table) -> pa.Table:
        items, counts = np.unique(_matrix(table["signature"]).ravel(), return_counts=True)
        runs = by_shard(items, shards)
        return pa.table({"shard": pa.array([s for s, _, _ in runs], pa.int32()), "bucket": pa.array([table["bucket"][0].as_py()] * len(runs), pa.int32()), "body": pa.array([items[a:b].tobytes() + counts[a:b].astype(np.int64).tobytes() for _, a, b in runs], pa.binary())})

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    sent = [np.frombuffer(x.as_py(), np.uint64).reshape(2, -1) for x in table["body"]]
    items, counts = np.concatenate(sent, axis=1)
    _, inverse = np.unique(items, return_inverse=True)
    total = np.bincount(inverse, counts.astype(np.float64)).astype(np.int64)[inverse]
    cuts = np.cumsum([0, *(x.shape[1] for x in sent)])
    return pa.table({"bucket": table["bucket"], "shard": table["shard"], "body": pa.array([total[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _post(shards: int, matches: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"item": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "weight": pa.array([], pa.int64())})
        matrix = _matrix(table["signature"])
        items, inverse = np.unique(matrix.ravel(), return_inverse=True)
        total = np.zeros(len(items), np.int64)
        told = dict(zip(answers["shard"].to_pylist(), answers["body"].to_pylist(), strict=True))
        for s, a, b in by_shard(items, shards):
            total[a:b] = np.frombuffer(told[s], np.int64)
        often = total[inverse].reshape(matrix.shape)
        order = np.lexsort((matrix, often))[:, : matrix.shape[1] - matches + 1]
        rows = np.arange(len(matrix))[:, None]
        use = (often[rows, order] > 1) & ((often > 1).sum(axis=1) >= matches)[:, None]
        # nodes like many others have often seen values: the less is left over, the nearer to what its group has in common
        weight = np.log2(often).sum(axis=1).astype(np.int64)
        node, weight = (np.broadcast_to(x[:, None], order.shape) for x in (table["node"].to_numpy(), weight))
        return pa.table({"item": matrix[rows, order][use].view(np.int64), "node": node[use], "weight": weight[use]})

    return run


def _compare(width: int, percent: int):
    """Links of a leader with the members of its group."""

    def run(table: pa.Table) -> pa.Table:
        leader = table["leader"][0].as_py()
        sets, sizes = [], []
        for _, values, offsets in _sets(table["text"], width):
            sets.append(values)
            sizes.append(np.diff(offsets))
        values, sizes = np.concatenate(sets), np.concatenate(sizes)
        nodes = table["node"].to_numpy()
        ends = np.cumsum(sizes)
        first = int(np.flatnonzero(nodes == leader)[0])
        own = values[ends[first] - sizes[first] : ends[first]]
        near = np.minimum(np.searchsorted(own, values), len(own) - 1)
        hits = np.concatenate([[0], np.cumsum(own[near] == values)])
        both = hits[ends] - hits[ends - sizes]
        linked = (100 * both >= percent * (sizes + len(own) - both)) & (nodes != leader)
        return pa.table({"a": nodes[linked], "b": np.full(int(linked.sum()), leader)})

    return run


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int, group: int = 256) -> DataFrame:
    """The pairs (a, leader) whose sets are linked. A leader's members are split into groups of about ``group``."""
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count("*") / group).cast("int").alias("parts"))
    dealt = pairs.join(sizes, "leader").select("leader", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.col("a").alias("member"))
    need = dealt.unionByName(dealt.select("leader", "part", F.col("leader").alias("member")).distinct())
    sent = need.join(texts, need.member == texts.node).select("leader", "part", "node", "text")
    return sent.groupBy("leader", "part").applyInArrow(_compare(width, percent), "a long, b long")


def _outsiders(posted: DataFrame, roots: DataFrame, seed: int, lists: int = 8) -> DataFrame:
    """Pairs of each list's nodes outside its largest component with one node of that, another one each round.

    A node is tried in ``lists`` of its lists at most in one round; what is left is for later rounds and the exact pass.
    """
    labelled = posted.join(roots, "node", "left").select("item", "node", F.coalesce("root", "node").alias("root"))
    parts = labelled.groupBy("item", "root").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64(F.lit(seed), "node")).alias("leader"))
    largest = parts.groupBy("item").agg(F.max_by(F.struct("root", "leader"), F.struct("n", "root")).alias("top"), F.count("*").alias("k")).where("k > 1")
    pairs = labelled.join(largest, "item").where(F.col("root") != F.col("top.root")).select("item", "node", F.col("top.leader").alias("leader"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64(F.lit(seed), "item")))
    pairs = pairs.withColumn("place", place).where(F.col("place") <= lists)
    return pairs.select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("leader")).distinct()


def _stars(roots: DataFrame) -> DataFrame:
    """Edges that stand for all links so far, from which components settle in fewer rounds."""
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _across(matches: int, wide: int, percent: int):
    """Candidates across components in one block, or in two blocks, of a list.

    They agree in ``matches`` coordinates, and in as many bits of the wide signature
    as linked nodes do but for a chance of one in ten million (5.3 deviations). Of
    these the short hashes of the sets are counted, with room for two collisions; what
    is left goes to the comparison of full sets.
    """
    share = (1 + percent / 100) / 2  # bits of different values agree half the time
    most_apart = wide * (1 - share) + 5.3 * (wide * share * (1 - share)) ** 0.5

    def run(table: pa.Table) -> pa.Table:
        node, root, side = (table[c].to_numpy() for c in ("node", "root", "side"))
        short = np.ascontiguousarray(np.frombuffer(b"".join(table["short"].to_pylist()), np.uint8).reshape(len(node), -1).T)
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(len(node), -1)
        sets = [np.frombuffer(x, np.uint32) for x in table["hashes"].to_pylist()]
        sizes_of = np.array([len(x) for x in sets])
        item, column = table["item"][0].as_py(), table["lists"].combine_chunks()
        counts = column.value_lengths().to_numpy()
        lists = np.full((len(node), counts.max()), _NONE)
        lists[np.arange(lists.shape[1]) < counts[:, None]] = column.flatten().to_numpy()
        a, b = [], []
        names, sizes = np.unique(root, return_counts=True)
        rest = root != names[np.argmax(sizes)]
        two = side.max() > side.min()
        for i in np.flatnonzero(rest):
            other = (root != root[i]) & (~rest | (node > node[i]))
            if two:
                other &= side != side[i]
            other &= (short == short[:, i : i + 1]).sum(axis=0, dtype=np.uint8) >= matches
            hit = np.flatnonzero(other)
            hit = hit[np.bitwise_count(bits[hit] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most_apart]
            # of the lists that both are in, the first one tells of the pair
            both = np.isin(lists[hit], lists[i]) & (lists[hit] != _NONE)
            hit = hit[np.where(both, lists[hit], _NONE).min(axis=1, initial=_NONE) == item]
            if len(hit):
                values, sizes, own = np.concatenate([sets[k] for k in hit]), sizes_of[hit], sets[i]
                found = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
                common = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes) - sizes) + 2
                hit = hit[100 * common >= percent * (sizes + len(own) - common)]
            a.append(np.maximum(node[hit], node[i]))
            b.append(np.minimum(node[hit], node[i]))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"a": join(a), "leader": join(b)})

    return run


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, percent: int = 75, coordinates: int = COORDINATES, matches: int = MATCHES, block: int = 16_384, star_rounds: int = 1, wide: int = 1536) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_key (hash of the text), root (the component, null without words); see the module's text."""
    shards = partitions(docs)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = own.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    rows = cut(keyed.mapInArrow(_signatures(width, coordinates), "doc_id long, text_key long, n_shingles long, node long, check long, signature binary"))
    nodes = rows.where("n_shingles > 0").groupBy("node", "check").agg(F.min("doc_id").alias("first_id"), F.first("signature").alias("signature"))
    dealt = nodes.select(F.pmod("node", F.lit(2 * shards)).cast("int").alias("bucket"), "node", "signature").groupBy("bucket")
    asked = dealt.applyInArrow(_ask(shards), "shard int, bucket int, body binary").groupBy("shard").applyInArrow(_frequencies, "bucket int, shard int, body binary")
    posted = cut(dealt.cogroup(asked.groupBy("bucket")).applyInArrow(_post(shards, matches), "item long, node long, weight long"))

    active = posted.select(F.col("node").alias("active")).distinct()
    named = nodes.join(active, F.col("node") == F.col("active")).select("node", "first_id")
    # several rows may have the id of a node's first document: the set tells them apart
    keyed = own.join(named.select(F.col("first_id").alias("fid")).distinct(), F.col("doc_id").eqNullSafe(F.col("fid"))).select("doc_id", "text")
    texts = cut(keyed.mapInArrow(_named(width), "node long, text string").dropDuplicates(["node"]))

    leaders = posted.groupBy("item").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"))
    tried = cut(posted.join(leaders, "item").where("node <> leader").select(F.col("node").alias("a"), "leader").distinct())
    roots = cut(connected_components(_verified(tried, texts, width, percent)))
    for seed in range(star_rounds):
        more = cut(_outsiders(posted, roots, seed).join(tried, ["a", "leader"], "left_anti"))
        if more.isEmpty():
            break
        tried = cut(tried.unionByName(more))
        roots = cut(connected_components(_stars(roots).unionByName(_verified(more, texts, width, percent))))

    labelled = posted.join(roots, "node", "left").select("item", "node", F.coalesce("root", "node").alias("root"))
    mixed = labelled.groupBy("item").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high and n > 2")
    left = labelled.join(mixed.select("item", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "item")
    # only nodes of such lists need the wide signature
    need = texts.join(left.select("node").distinct(), "node", "left_semi")
    left = left.join(need.mapInArrow(_wide(width, coordinates, wide), "node long, short binary, bits binary, hashes binary"), "node")
    left = left.join(posted.groupBy("node").agg(F.collect_list("item").alias("lists")), "node")
    left = left.withColumn("side", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    left = left.select("item", "node", "root", "short", "bits", "hashes", "lists", "side", other).select("item", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "node", "root", "short", "bits", "hashes", "lists", "side")
    missed = left.groupBy("item", "x", "y").applyInArrow(_across(matches, wide, percent), "a long, leader long").distinct()
    missed = cut(missed.join(tried, ["a", "leader"], "left_anti"))
    more = cut(_verified(missed, texts, width, percent))
    if not more.isEmpty():
        roots = cut(connected_components(_stars(roots).unionByName(more)))

    classes = nodes.join(roots, "node", "left").select("node", "check", "first_id", F.coalesce("root", "node").alias("root"))
    ids = classes.groupBy("root").agg(F.min("first_id").alias("component"))
    known = classes.join(ids, "root").select(F.col("node").alias("known_node"), F.col("check").alias("known_check"), "component", "root")
    found = rows.drop("signature").join(known, (F.col("node") == F.col("known_node")) & (F.col("check") == F.col("known_check")), "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key", "root")


def _named(width: int):
    sign = _signatures(width, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.concat_arrays([x["node"] for x in sign(iter([batch]))]), batch["text"]], ["node", "text"])

    return run


def _wide(width: int, coordinates: int, wide: int):
    """Of each text the low bytes of the first coordinates, the low bits of ``wide`` coordinates, and 32-bit hashes of its set."""
    sign = _signatures(width, wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 250):
                part = whole.slice(at, 250)
                hashes: list[bytes] = []
                for _, values, offsets in _sets(part["text"], width):
                    small = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    hashes += [np.unique(small[x:y]).tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                done = 0
                for x in sign(iter([pa.record_batch([part["node"], part["text"]], ["doc_id", "text"])])):
                    values = _matrix(x["signature"])
                    short = values[:, :coordinates].astype(np.uint8)
                    bits = np.packbits((values & np.uint64(1)).astype(np.uint8), axis=1)
                    yield pa.record_batch([x["doc_id"], pa.array([y.tobytes() for y in short], pa.binary()), pa.array([y.tobytes() for y in bits], pa.binary()), pa.array(hashes[done : done + len(x)], pa.binary())], ["node", "short", "bits", "hashes"])
                    done += len(x)

    return run


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key", "root")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n AS x ON x.doc_id = p.a JOIN n AS y ON y.doc_id = p.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m.c, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) AS m ON m.a = w.doc_id
"""
