"""Ranks, quantiles, rank tests and spatial nulls against brute force on small tables."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.operators import inference


@pytest.fixture(scope="module")
def legs():
    rng = random.Random(8)
    return [(i, g, round(rng.gauss(m, s), 1)) for g, m, s, n in (("a", 0, 1, 90), ("b", 0.9, 1, 70), ("c", 0, 3, 50)) for i in range(n)] + [(0, "a", None), (1, None, 2.0)]


def ranks(values):
    return [sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in values]


def test_ranks_and_quantiles_equal_brute_force(spark, legs):
    df = spark.createDataFrame(legs, "i int, g string, v double").dropna()
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    own = {g: [v for _, h, v in legs if h == g and v is not None] for g in "abc"}
    want = {(g, v): r for g, vs in own.items() for v, r in zip(vs, ranks(vs), strict=True)}
    assert {(r.g, r.v): r["rank"] for r in inference.value_ranks(counts, ["g"], "v").collect()} == want
    whole = [v for vs in own.values() for v in vs]
    pooled = inference.value_ranks(counts.groupBy("v").agg(F.sum("n").alias("n")), [], "v").collect()
    assert {r.v: r["rank"] for r in pooled} == dict(zip(whole, ranks(whole), strict=True))
    for r in inference.quantiles(counts, ["g"], "v", (0.0, 0.25, 0.5, 0.9, 1.0)).collect():
        assert list(r)[2:] == pytest.approx(np.quantile(own[r.g], (0.0, 0.25, 0.5, 0.9, 1.0)).tolist())


def test_one_value_may_hold_most_rows(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1500, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    r = inference.value_ranks(df.groupBy("v").agg(F.count("*").alias("n")), [], "v").where("v = 5.0").first()
    assert (r.before, r.total, r["rank"]) == (0, 2000, 750.5)


def test_normal_tail():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    for z in (0.0, 0.3, -1.96, 3.5, 7.0):
        got = spark.range(1).select(inference.two_sided(F.lit(z)).alias("p")).first().p
        assert got == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=2e-7)


def test_few_groups_do_not_gather_in_tasks(spark, monkeypatch):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(20_000).select((F.col("id") % 2).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
        ranked = inference.value_ranks(df.groupBy("g", "v").agg(F.count("*").alias("n")), ["g"], "v")
        assert ranked.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 5_000  # of 10,000 in a group
        seen = []
        monkeypatch.setattr(inference, "cut", lambda d: seen.append(d) or d)
        inference.pairwise_rank_tests(df, "g", "v")
        plan = seen[0]._jdf.queryExecution().executedPlan().toString().split("\n")
        depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
        for i, line in enumerate(plan):
            if "BroadcastExchange" in line:
                inside = itertools.takewhile(lambda x: depth(x) > depth(line), plan[i + 1 :])
                assert not any("count(1)" in x for x in inside)  # the groups are sent to the counts
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rank_tests_equal_brute_force(spark, legs):
    df = spark.createDataFrame(legs, "i int, g string, v double")
    got = {(r.group_a, r.group_b): r for r in inference.pairwise_rank_tests(df, "g", "v").collect()}
    own = {g: [v for _, h, v in legs if h == g and v is not None] for g in "abc"}
    p = {}
    for a, b in itertools.combinations("abc", 2):
        u = sum((x > y) + (x == y) / 2 for x in own[a] for y in own[b])
        n, m = len(own[a]), len(own[b])
        counts = np.unique(own[a] + own[b], return_counts=True)[1].astype(float)
        sd = math.sqrt(n * m / 12 * (n + m + 1 - (counts**3 - counts).sum() / ((n + m) * (n + m - 1))))
        p[a, b] = math.erfc(max(abs(u - n * m / 2) - 0.5, 0) / sd / math.sqrt(2))
        assert got[a, b].u == pytest.approx(u) and got[a, b].p == pytest.approx(p[a, b], rel=1e-6)
    for k, pair in enumerate(sorted(p, key=p.get)):
        assert got[pair].p_adjusted == pytest.approx(min(1.0, p[pair] * (3 - k)), rel=1e-6)
    assert got["a", "b"].p_adjusted < 0.001 < 0.05 < got["a", "c"].p_adjusted
    r = ranks([v for vs in own.values() for v in vs])
    n, at, q = len(r), 0, 0.0
    for vs in own.values():
        q += sum(r[at : at + len(vs)]) ** 2 / len(vs)
        at += len(vs)
    ties = np.unique([v for vs in own.values() for v in vs], return_counts=True)[1].astype(float)
    h = (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - (ties**3 - ties).sum() / (n**3 - n))
    assert inference.kruskal_wallis(df, "g", "v").first().h == pytest.approx(h)


def test_groups_held_out(spark, legs):
    df = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(legs)], "i int, g string, v double")
    own = {g: [v for _, h, v in legs if h == g and v is not None] for g in "abc"}
    for r in inference.held_out_groups(df, "g", "v", "i", draws=150).collect():
        rest = [v for g, vs in own.items() if g != r.g for v in vs]
        low, mid, high = np.quantile(rest, (0.25, 0.5, 0.75))
        a1, a3 = np.quantile(own[r.g], (0.25, 0.75))
        assert r.error == pytest.approx(abs(mid - np.median(own[r.g])))
        assert r.iqr_ratio == pytest.approx((high - low) / (a3 - a1))
        assert r.coverage == pytest.approx(np.mean([low <= v <= high for v in own[r.g]]))
        rng = np.random.default_rng(1)
        drawn = np.median(rng.choice(own[r.g], (2000, len(own[r.g]))), axis=1).std(ddof=1)
        assert 0.6 * drawn < r.median_se < 1.6 * drawn


@pytest.mark.parametrize("n", (1, 2, 7, 300))
def test_drawn_medians_equal_brute_force(spark, n):
    rows = [(g, float((k * k * 7) % m) - 3.0, 10 * k + i) for i, (g, m) in enumerate((("a", 1000), ("b", 3), ("c", 1))) for k in range(n)]
    want = {}
    for g in "abc":
        for draw in range(1, 31):
            vs = []
            for _, v, i in (r for r in rows if r[0] == g):
                u = int(hashlib.md5(f"5-{draw}-{i}".encode()).hexdigest()[:8], 16) / 2**32
                vs += [v] * sum(u >= p for p in inference.POISSON)
            if vs:
                want[g, draw] = float(np.median(vs))
    got = inference._drawn_medians(spark.createDataFrame(rows, "g string, _v double, _id int"), "g", 30, 5)
    assert {(r.g, r.draw): r.median for r in got.collect()} == want


def test_spearman_of_constants_and_of_ranks(spark):
    df = spark.createDataFrame([("flat", 1.0, float(k)) for k in range(9)] + [("up", float(k), float(k) ** 3) for k in range(9)] + [("none", float(k % 3), float(k % 5)) for k in range(60)], "g string, x double, y double")
    got = {r.g: r for r in inference.spearman(df, ["g"], "x", "y").collect()}
    assert (got["flat"].rho, got["flat"].p) == (0.0, 1.0)
    assert got["up"].rho == pytest.approx(1.0) and got["up"].p < 1e-6 and got["none"].p > 0.5


def field(f, side=14):
    return [(r, c, float(f(r, c))) for r in range(side) for c in range(side) if (r * c) % 17 != 5]


def test_moran_of_a_smooth_field_and_of_noise(spark):
    rng = random.Random(6)
    smooth = spark.createDataFrame(field(lambda r, c: math.sin(r / 4) + c / 9), "r int, c int, v double")
    noise = spark.createDataFrame(field(lambda r, c: rng.random()), "r int, c int, v double")
    a, b = (inference.moran_permutations(x, "r", "c", "v", draws=999).first() for x in (smooth, noise))
    assert a.p == 0.001 and a.morans_i > 0.8 and b.p > 0.05
    assert a.morans_i == pytest.approx(inference.morans_i(smooth, "r", "c", "v").first().morans_i)
    # the mean of I over all orders is -1 / (n - 1)
    assert a.null_mean == pytest.approx(-1 / (a.n - 1), abs=0.006) and b.null_mean == pytest.approx(-1 / (b.n - 1), abs=0.006)
    assert a.p == inference.moran_permutations(smooth.repartition(5), "r", "c", "v", draws=999).first().p


def test_each_draw_is_a_permutation_and_a_flat_field_has_no_structure(spark):
    flat = spark.createDataFrame(field(lambda r, c: 2.0, 5), "r int, c int, v double")
    got = inference.moran_permutations(flat, "r", "c", "v", draws=20).first()
    assert (got.morans_i, got.p) == (0.0, 1.0)


@pytest.mark.parametrize(("change", "failed"), [("delta", None), ("delta + 2", "drift_ok"), ("hash(r, c) % 100 / 100.0", "structure_ok"), ("effort / 50", "effort_ok")])
def test_a_surface_is_drawn_only_if_every_condition_holds(spark, change, failed):
    rows = [(r, c, v, float((r * 31 + c * 17) % 23)) for r, c, v in field(lambda r, c: math.sin(r / 4) + c / 9 - 0.8)]
    d = spark.createDataFrame(rows, "r int, c int, delta double, effort double").withColumn("delta", F.expr(change)).withColumns({"delta_detected": F.col("delta") * 0.9, "steady": (F.col("r") + F.col("c")) % 13 != 0})
    grade = inference.grade_surface(d, "r", "c", draws=199).cache()
    g = grade.first()
    assert g.publishable == (failed is None) and (failed is None or not g[failed])
    assert inference.drawable(d, grade).count() == (d.where("steady").count() if failed is None else 0)


def test_toroidal_null_equals_rolled_sheets(spark):
    rng = random.Random(3)
    rows = [(r + 5, c - 3, math.sin(r / 3) + rng.random() / 9, math.sin(r / 3 + 0.2) + c / 20, rng.random()) for r in range(9) for c in range(12) if rng.random() < 0.85]
    df = spark.createDataFrame(rows, "r int, c int, y double, x double, g double")
    got = inference.toroidal_null(df, "r", "c", "y", "x", "g", draws=60).first()
    a = np.array(rows)
    at, (top, left) = a[:, :2].astype(int), a[:, :2].min(axis=0).astype(int)
    sheet = np.full(tuple(at.max(axis=0) - (top, left) + 1), np.nan)
    sheet[at[:, 0] - top, at[:, 1] - left] = a[:, 3]

    def slope(x):
        ok = ~np.isnan(x)
        design = np.column_stack([np.ones(ok.sum()), x[ok], a[ok, 4]])
        return np.linalg.lstsq(design, a[ok, 2], rcond=None)[0][1], ok.sum()

    seen, _ = slope(a[:, 3])
    draws = inference.torus_draws(df, "r", "c", 60, 0).collect()
    rolled = [slope(np.roll(sheet, (d.dy, d.dx), (0, 1))[at[:, 0] - top, at[:, 1] - left]) for d in draws]
    assert all(1 <= d.dy < 9 and 1 <= d.dx < 12 for d in draws) and len({(d.dy, d.dx) for d in draws}) > 30
    assert got.slope == pytest.approx(seen) and got.mean_cells == pytest.approx(np.mean([n for _, n in rolled]))
    assert got.p == pytest.approx((sum(abs(s) >= abs(seen) for s, _ in rolled) + 1) / 61)
