"""Occupancy from sums: no silent rows, intervals that hold the planted value, flags, expected taxa."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skeinflow.operators import atlas


def draws(seed, taxa, cells, psi, p):
    rng = random.Random(seed)
    effort = [(c, rng.randrange(1, 13)) for c in range(cells)]
    rows = []
    for t in range(taxa):
        for c, n in effort:
            k = sum(rng.random() < p for _ in range(n)) if rng.random() < psi else 0
            rows.append((t, c, k, n))
    return effort, rows


@pytest.fixture(scope="module")
def simulated(spark):
    effort, rows = draws(3, 40, 200, 0.6, 0.3)
    return spark.createDataFrame(effort, "cell int, n int"), spark.createDataFrame(rows, "t int, cell int, k int, n int").cache()


def test_sums_without_silent_rows_equal_sums_with_them(simulated):
    effort, d = simulated
    have = atlas.card_sums(d.where("k > 0"), effort, "t", [], "k", "n").orderBy("t").collect()
    want = atlas.draw_sums(d, ["t"], "k", "n").orderBy("t").select("t", "cells", "seen", "detections", "seen_cards", "silent").collect()
    assert have == want and len(have) == 40


def test_taxon_of_one_epoch_has_silent_sums_in_the_other(spark):
    effort = spark.createDataFrame([(0, 1, 4), (0, 2, 5), (1, 1, 6)], "epoch int, cell int, n int")
    seen = spark.createDataFrame([("a", 0, 1, 2, 4)], "t string, epoch int, cell int, k int, n int")
    fits = atlas.fit_occupancy(atlas.card_sums(seen, effort, "t", ["epoch"], "k", "n"), ["t", "epoch"])
    got = {r.epoch: r for r in fits.collect()}
    assert (got[1].cells, got[1].seen, got[1].psi, got[1].p, got[1].valid) == (1, 0, 0.0, None, False)
    assert (got[0].cells, got[0].seen) == (2, 1) and got[0].psi >= 0.5


def test_interval_holds_the_planted_value(simulated):
    _, d = simulated
    sums = atlas.draw_sums(d, ["t"], "k", "n")
    got = atlas.profile_interval(sums, ["t"]).collect()
    assert all(0 <= r.low <= r.psi <= r.high <= 1 for r in got)
    assert sum(r.low <= 0.6 <= r.high for r in got) >= 0.88 * len(got)
    assert all(r.high - r.low < 0.3 for r in got)


def test_interval_ends_where_the_likelihood_falls_by_the_drop(simulated):
    _, d = simulated
    sums = atlas.draw_sums(d, ["t"], "k", "n").where("t < 5")
    fine, coarse = (atlas.profile_interval(sums, ["t"], steps=s).orderBy("t").collect() for s in (400, 100))
    for a, b in zip(fine, coarse, strict=True):
        assert a.low == pytest.approx(b.low, abs=2e-3) and a.high == pytest.approx(b.high, abs=2e-3)


def test_never_seen_and_seen_everywhere(spark):
    rows = [("never", c, 0, 5) for c in range(30)] + [("always", c, 4, 5) for c in range(30)]
    sums = atlas.draw_sums(spark.createDataFrame(rows, "t string, cell int, k int, n int"), ["t"], "k", "n")
    got = {r.t: r for r in atlas.profile_interval(sums, ["t"]).collect()}
    assert tuple(got["never"])[1:] == (None, None, None)
    assert got["always"].high == 1.0 and 0.85 < got["always"].low < 1.0
    fits = {r.t: r for r in atlas.fit_occupancy(sums, ["t"]).collect()}
    assert fits["always"].converged and not fits["always"].valid and not fits["never"].converged


def test_short_folds_have_not_converged(simulated):
    sums = atlas.draw_sums(simulated[1], ["t"], "k", "n")
    count = lambda n: atlas.fit_occupancy(sums, ["t"], iterations=n).where("valid").count()
    assert count(2) == 0 and count(200) == 40


def test_expected_taxa_equal_the_sum_over_all_rows(simulated):
    effort, d = simulated
    fits = atlas.fit_occupancy(atlas.draw_sums(d, ["t"], "k", "n"), ["t"])
    got = {r.cell: (r.recorded, r.expected) for r in atlas.expected_taxa(d.where("k > 0"), effort, fits, "t", "cell", "k", "n").collect()}
    chance = F.when(F.col("k") > 0, 1.0).otherwise(atlas.silence_given(F.col("psi"), F.col("p"), F.col("n")))
    want = d.join(fits.select("t", "psi", "p"), "t").groupBy("cell").agg(F.count_if(F.col("k") > 0).alias("a"), F.sum(chance).alias("b")).collect()
    assert len(want) == len(got) == 200
    assert all(got[r.cell][0] == r.a and got[r.cell][1] == pytest.approx(r.b) for r in want)


def test_cards_are_joined_in_parts_that_grow_with_the_items(spark, monkeypatch):
    from skeinflow.plans import registry

    sf = "/root/testdata/sf0.001"
    rows = lambda name: sorted(map(tuple, registry.QUERIES[name](spark, sf).collect()))
    whole = {name: rows(name) for name in ("reporting_rates", "paired_footprint")}
    assert registry._parts(spark.range(0)) == 4 and registry._parts(spark.range(10 * registry.ITEMS_A_TASK + 1)) == 11
    monkeypatch.setattr(registry, "ITEMS_A_TASK", 500)
    assert {name: rows(name) for name in whole} == whole
    rates, _ = registry.card_cells(spark, sf)
    assert f", {registry._parts(registry._t(spark, sf, 'lineitem'))}" in rates._jdf.queryExecution().optimizedPlan().toString()


#: Queries on the cards of both epochs, whose tasks were as large as the line items made them.
CARD_QUERIES = ["dropped_by_stricter_rule", "epoch_change_summary", "epoch_changes", "occupancy_interval", "occupancy_likelihood"]


@pytest.mark.parametrize("name", CARD_QUERIES)
def test_card_queries_deal_items_and_cells_in_parts(spark, monkeypatch, name):
    from skeinflow.plans import registry

    sf = "/root/testdata/sf0.001"
    rows = lambda: sorted(map(repr, registry.QUERIES[name](spark, sf).collect()))
    whole = rows()
    monkeypatch.setattr(registry, "ITEMS_A_TASK", 500)
    parts = registry._parts(registry._t(spark, sf, "lineitem"))
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    for dealt in ("l_partkey#\\d+L", "l_orderkey#\\d+L", "cell#\\d+L, epoch#\\d+"):
        assert re.search(rf"RepartitionByExpression \[{dealt}\], {parts}\b", plan)
    assert parts > 4 and rows() == whole


def test_rates_in_parts_equal_rates_where_they_lie(spark):
    rng = random.Random(5)
    pick = lambda n: rng.choice([None, *range(n)])
    rows = [(pick(4), pick(3), pick(5), None if (t := pick(4)) is None else f"t{t}") for _ in range(400)] + [(9, 0, None, "t0"), (8, 0, 1, None), (7, 0, 2, "t1"), (7, 0, 2, "t2")]
    d = spark.createDataFrame(rows, "cell int, epoch int, card int, species string")
    have, want = (sorted(map(repr, atlas.reporting_rates(d, ["cell", "epoch"], "card", "species", parts=n).collect())) for n in (3, None))
    assert have == want and len(have) > 50


def test_card_sums_keep_taxa_without_a_detection_or_a_name(spark):
    effort = spark.createDataFrame([(0, 1, 4), (0, 2, 5), (1, 1, 6)], "epoch int, cell int, n int")
    seen = spark.createDataFrame([("a", 0, 1, 2, 4), ("a", 1, 1, 0, 6), ("b", 0, 2, 0, 5), (None, 0, 1, 1, 4)], "t string, epoch int, cell int, k int, n int")
    got = {(r.t, r.epoch): (r.cells, r.seen, r.detections, r.seen_cards, [tuple(x) for x in r.silent]) for r in atlas.card_sums(seen, effort, "t", ["epoch"], "k", "n").collect()}
    none = {0: (2, 0, 0.0, None, [(4, 1), (5, 1)]), 1: (1, 0, 0.0, None, [(6, 1)])}
    assert got == {(t, e): none[e] for t in ("a", "b", None) for e in none} | {("a", 0): (2, 1, 2.0, 4.0, [(5, 1)])}


@pytest.mark.parametrize("name", CARD_QUERIES)
def test_card_queries_join_items_once(spark, name):
    from skeinflow.plans import registry

    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    made = [x for x in plan.splitlines() if "REPARTITION_BY_NUM" in x and "ReusedExchange" not in x]
    for key in ("l_partkey", "l_orderkey", "cell"):
        assert sum(f"hashpartitioning({key}#" in x for x in made) == 1
