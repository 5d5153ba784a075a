"""Hard negatives against brute force with whole numbers of any size; the query's SQL is compared with all others."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, vector array<bigint>, block int, copies int"


def brute(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    out = []
    for a in rows:
        if not is_anchor(a[0]):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2], strict=False)), r[0], r[1]) for r in rows)
        for s, i, label in [x for x in scored if x[2] == a[1] and x[1] != a[0]][:positives]:
            fit = [x for x in scored if x[2] != a[1] and low * -s <= 100 * -x[0] <= high * -s]
            out += [(a[0], i, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("size", [1, 300, 30_000, 2_000_000])
def test_scores_are_exact(size):
    rng = np.random.default_rng(size)
    for wide in (0, 1, 63, 64, 65, 300):
        a, b = (rng.integers(-size, size + 1, (n, wide)) for n in (7, 11))
        a[:1], b[:1], b[1:2] = size, size, -size
        assert (hn.exact_scores(a, b, hn.primes_for(wide * size * size)) == a @ b.T).all()


def test_primes_fit_float32_and_ranges():
    assert all((p // 2) ** 2 * hn.DEPTH < 2**24 for p in hn.PRIMES)
    assert len(hn.primes_for(500)) == 1 and len(hn.primes_for(2**55)) == 6
    with pytest.raises(ValueError, match="2\\*\\*56"):
        hn.primes_for(2**56)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, rng.randrange(3), [rng.randrange(-4, 5) for _ in range(5)], 1, 2) for i in range(120)]
    hot = [(i, i % 2, [2, 2, 1, 0, 1], 1, 2) for i in range(200, 260)]
    odd = [(10, 1, [1, 2, 3, 4, 5], 1, 2), (10, 1, [1, 2, 3, 4, 5], 1, 2), (10, 2, [5, 4, 3, 2, 1], 1, 2), (300, None, [1] * 5, 1, 2), (310, 1, None, 1, 2), (320, 1, [1, None], 1, 2), (None, 1, [3] * 5, 1, 2), (330, 1, [4], 1, 2), (340, 1, [], 1, 2)]
    return out + hot + odd + [(401, 0, [3, 3, 3, 3, 3], 1, 2)] * 9


@pytest.mark.parametrize(("block_rows", "anchor_rows"), [(8192, 512), (17, 3)])
def test_blocks_of_any_size_equal_brute_force(spark, rows, block_rows, anchor_rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hn.hard_negatives(docs, F.col("vec_id") % 10 == 0, block_rows=block_rows, anchor_rows=anchor_rows).collect()
    want = brute(rows, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got)) == want and len(want) > 100


def test_other_counts_and_bounds(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = hn.hard_negatives(docs, F.col("vec_id") % 20 == 0, positives=2, negatives=7, low=50, high=110).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 20 == 0, 2, 7, 50, 110)


def test_empty_tables_and_tables_without_anchors(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert hn.hard_negatives(docs.where(F.lit(False)), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(docs, F.lit(False)).count() == 0


def test_query_leaves_out_rows_that_are_not_finite(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.randrange(10), [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(400)]
    bad = [(400, 1, [float("nan")] * 8), (500, 1, [float("inf")] * 8), (600, 1, [-float("inf")] * 8), (700, None, [1.0] * 8), (800, 2, None), (900, 2, [None] * 8)]
    spark.createDataFrame(rows + bad, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    ready = [(i, (y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, y, v in rows]
    assert sorted(map(tuple, hn.op13_rns_hard_negatives(spark, str(tmp_path)).collect())) == brute(ready, lambda i: i % 100 == 0)
