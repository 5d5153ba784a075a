"""Planted fixtures for operators, and every query with SQL against DuckDB on the smallest tables."""

import datetime as dt
import hashlib
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window, functions as F, types as T

from skeinflow.functions import geo
from skeinflow.operators import atlas, gate, hygiene, inference, panels, passage, ranges, tracks
from skeinflow.plans import registry
from skeinflow.sources import lake

SF = "/root/testdata/sf0.001"


def _plain(row):
    return tuple(round(x, 3) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    want = con.sql(registry.SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    want = want.select(", ".join(df.columns)).fetchall()
    assert sorted(map(repr, map(_plain, df.collect()))) == sorted(map(repr, map(_plain, want)))


def _season(spark, values, year=2020):
    rows = [("a", dt.datetime(year, 1, 1) + dt.timedelta(days=d - 1), float(v), c) for d, v, c in values]
    return spark.createDataFrame(rows, "s string, t timestamp, v double, c double")


def _q(spark, values, **more):
    return passage.passage_quantiles(_season(spark, values), ["s"], "t", "v", seasons={"x": (60, 181)}, **more).first()


def test_passage_quantiles_of_flat_spiked_and_shifted_seasons(spark):
    flat = [(d, 1, None) for d in range(60, 182)]
    assert abs(_q(spark, flat).q50_doy - 120.5) < 1.1
    moved = _q(spark, [(d + 10, 1 + d % 5, None) for d in range(70, 150)])
    still = _q(spark, [(d, 1 + d % 5, None) for d in range(70, 150)])
    assert abs(moved.q50_doy - still.q50_doy - 10) < 1e-9
    spike = _q(spark, [(d, 1e9 if d == 100 else 0, None) for d in range(60, 120)])
    assert [round(x) for x in (spike.q10_doy, spike.q50_doy, spike.q90_doy)] in ([99, 100, 100], [99, 99, 100], [99, 100, 100])
    assert _q(spark, [(d, 0, None) for d in range(60, 120)]).q50_doy is None
    assert _q(spark, flat[:19]).q50_doy is None
    covered = passage.passage_quantiles(_season(spark, [(d, 1, 0.1 if d < 80 else None) for d in range(60, 120)]), ["s"], "t", "v", seasons={"x": (60, 181)}, coverage="c").first()
    assert covered.observations == 40


def test_break_is_found_and_left_out_where_it_does_not_span(spark):
    rows = [("a", y, 0.2 * y + (3.0 if y >= 2010 else 0.0)) for y in range(2000, 2020)] + [("b", y, 0.5 * y) for y in range(2012, 2030)]
    got = {r.k: r for r in passage.trend_with_break(spark.createDataFrame(rows, "k string, y int, v double"), ["k"], "y", "v", 2010).collect()}
    assert abs(got["a"].per_decade - 2) < 1e-6 and abs(got["a"].step - 3) < 1e-6
    assert got["b"].step is None and abs(got["b"].per_decade - 5) < 1e-6


def test_permutation_null_is_centred_and_a_trend_lies_outside(spark):
    rows = [(k, y, y * 1.0 + (y * 7 + k) % 3) for k in range(6) for y in range(20)]
    null = passage.permutation_null(spark.createDataFrame(rows, "k int, y int, v double"), ["k"], "y", "v", draws=60).first()
    assert abs(null["mean"]) < 2 and null.high < 9 and null.groups == 6
    few = passage.permutation_null(spark.createDataFrame(rows, "k int, y int, v double"), ["k"], "y", "v", draws=3, min_years=21).first()
    assert (few.groups, few["mean"]) == (None, None)


def test_permutation_null_equals_brute_force_and_joins_nothing_after_the_draws(spark):
    rows = [(k, 1990 + y, float((y * 7 + k * k) % 11)) for k in range(5) for y in range(4 + k)] + [(9, 2000, float(v)) for v in range(6)] + [(None, 1990 + y, float(y)) for y in range(6)]
    out = passage.permutation_null(spark.createDataFrame(rows, "k int, y int, v double"), ["k"], "y", "v", draws=20, min_years=5, seed=3)
    means = []
    for draw in range(1, 21):
        slopes = []
        for k in range(1, 5):
            own = sorted((y, v) for g, y, v in rows if g == k)
            order = sorted(range(1, len(own) + 1), key=lambda i: (hashlib.md5(f"3-{draw}-{k}-{i}".encode()).hexdigest(), i))
            slopes.append(10 * np.polyfit([y for y, _ in own], [own[i - 1][1] for i in order], 1)[0])
        means.append(np.mean(slopes))
    got = out.first()
    # one year alone has no slope; a group without a key is none
    assert got.groups == 4 and (got["mean"], got.low, got.high) == pytest.approx((np.mean(means), *np.quantile(means, (0.025, 0.975))))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_scattered_segment_goes_and_track_stays(spark):
    t0 = dt.datetime(2020, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=i), 10 + i * 0.01, 10.0) for i in range(40)] + [("a", t0 + dt.timedelta(hours=20, minutes=30), 60.0, 10.0)]
    df = spark.createDataFrame(rows, "i string, t timestamp, la double, lo double")
    out = tracks.unreachable_removed(df, ["i"], "t", "la", "lo")
    assert out.count() == 40 and out.agg(F.max("la")).first()[0] < 11


def test_occupancy_recovers_planted_parameters(spark):
    n, psi, p = 8, 0.6, 0.4
    rows, cells = [], 4000
    silent = round(cells * (1 - psi))
    rows += [("t", 0, n)] * silent
    for k in range(n + 1):
        rows += [("t", k, n)] * round(cells * psi * math.comb(n, k) * p**k * (1 - p) ** (n - k))
    rows += [("never", 0, n)] * 5 + [("t", 9, 3), ("t", 0, 0)]
    got = {r.t: r for r in atlas.occupancy(spark.createDataFrame(rows, "t string, k int, n int"), ["t"], "k", "n").collect()}
    assert abs(got["t"].psi - psi) < 0.01 and abs(got["t"].p - p) < 0.01
    assert got["never"].psi == 0 and got["never"].p is None


def test_snap_rounds_before_floor_and_distance_is_right(spark):
    row = spark.range(1).select(geo.snap(F.lit(0.3), 0.1).alias("a"), geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("b"), geo.wrap_longitude(F.lit(190.0)).alias("c")).first()
    assert abs(row.a - 0.35) < 1e-9 and abs(row.b - math.pi * 6371.0088) < 1e-6 and row.c == -170


def test_late_cell_is_not_in_the_footprint(spark):
    rows = [("s", c, y) for c in range(3) for y in range(10)] + [("s", 9, y) for y in range(5, 10)]
    out = ranges.consistent_footprint(spark.createDataFrame(rows, "k string, c int, y int"), ["k"], ["c"], "y", 0.8)
    assert {r.c for r in out.collect()} == {0, 1, 2}


def test_gate_withholds_what_it_does_not_know(spark):
    items = spark.createDataFrame([(None, "exact", "low", "aggregate", "s"), (1, "exact", None, "aggregate", "s"), (1, "exact", "odd", "aggregate", "s"), (1, "exact", "low", "aggregate", "x"), (1, "exact", "low", "aggregate", "s")], "taxon_key int, taxon_scope string, sensitivity string, granularity string, source_id string")
    policy = spark.createDataFrame([("low", "aggregate", False)], "sensitivity string, granularity string, withhold boolean")
    sources = spark.createDataFrame([("s", True)], "source_id string, redistributable boolean")
    reasons = sorted(str(r.reason) for r in gate.decide(items, policy, sources, [7]).collect())
    assert reasons == sorted(["None", "exact scope without key", "licence", "policy", "unresolved sensitivity"])


def test_lake_replaces_touched_partitions_and_refuses_strangers(spark, tmp_path):
    schema = T.StructType([T.StructField("source_id", T.StringType(), False), T.StructField("station_id", T.StringType(), False), T.StructField("t", T.TimestampType(), True)])
    spec = lake.TableSpec("flux", schema, time="t", identity="station_id")
    make = lambda rows: spark.createDataFrame(rows, schema)
    a, b = dt.datetime(2001, 5, 1), dt.datetime(2002, 5, 1)
    lake.write(make([("s", "x", a), ("s", "y", b), ("s", "y", None)]), spec, str(tmp_path), "s")
    lake.write(make([("s", "x", a), ("s", "z", a)]), spec, str(tmp_path), "s")
    got = lake.scan(spark, spec, str(tmp_path), ["s"]).groupBy("year").count().collect()
    assert {r.year: r["count"] for r in got} == {"2001": 2, "2002": 1, "undated": 1}
    with pytest.raises(lake.LakeError):
        lake.write(make([("s", "q", a)]), spec, str(tmp_path), "s")
    with pytest.raises(lake.LakeError):
        lake.write(make([("other", "x", a)]), spec, str(tmp_path), "s")
    assert spark.read.parquet(f"{tmp_path}/_manifests").count() == 2


def test_day_gaps_by_nation_reads_all_orders(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", F.to_date("o_orderdate").alias("d")).collect()
    nation = {r.c_custkey: r.c_nationkey for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    held = {(nation[r.o_custkey], r.d) for r in orders}
    got = {(r.c_nationkey, r.year, r.month): r.days for r in registry.QUERIES["day_gaps_by_nation"](spark, SF).collect()}
    assert got and sum(got.values()) == sum((n, d.year, d.month) in got for n, d in held)
    first, last = min(d for _, d in held), max(d for _, d in held)
    months = (last.year - first.year) * 12 + last.month - first.month + 1
    assert len({n for n, _ in held}) * months - len(got) == len({(n, d.year, d.month) for n, d in held} - set(got))


def test_moran_is_high_for_a_smooth_field_and_low_for_a_checkerboard(spark):
    grid = lambda f: spark.createDataFrame([(r, c, float(f(r, c))) for r in range(8) for c in range(8)], "r int, c int, v double")
    assert inference.morans_i(grid(lambda r, c: r + c), "r", "c", "v").first().morans_i > 0.5
    assert inference.morans_i(grid(lambda r, c: (r + c) % 2), "r", "c", "v").first().morans_i < 0


def test_entry_and_queries():
    import __spark_entry__ as e

    assert "passage_quantiles" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_far_points_have_no_cell_and_are_refused(spark):
    from skeinflow.operators import grids

    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 90.0, 0.0), (3, None, 1.0)], "p int, lon double, lat double")
    cells = spark.createDataFrame([(7, 0.0, 0.0), (8, 1.0, 1.0), (9, 1.0, 0.0)], "c int, lon double, lat double")
    got = {r.p: (r.c, r.error_km) for r in grids.nearest_cells(points, cells, "p", "c", reach=2.0).collect()}
    assert got[1][0] in (7, 8, 9) and got[1][1] < 80 and got[2] == (None, None) and got[3] == (None, None)
    with pytest.raises(Exception, match="no cell near 2"):
        grids.nearest_cells(points.where("p = 2"), cells, "p", "c", reach=2.0, max_error_km=250.0).collect()


def test_rows_at_one_position_make_one_pair(spark):
    from skeinflow.operators import grids

    points = spark.range(3000).select(F.col("id").alias("p"), (F.col("id") % 2 * 3.0).alias("lon"), F.lit(0.25).alias("lat"))
    cells = spark.range(1, 3001).select((3001 - F.col("id")).alias("c"), (F.col("id") % 2 * 3.0).alias("lon"), F.lit(0.0).alias("lat"))
    cells = cells.unionByName(spark.createDataFrame([(0, 0.0, 0.5), (-1, None, 0.25)], "c long, lon double, lat double"))
    out = grids.nearest_cells(points, cells, "p", "c", reach=1.0)
    got = {(r.lon, r.c, r.error_km): r.n for r in out.join(points, "p").groupBy("lon", "c", "error_km").agg(F.count("*").alias("n")).collect()}
    assert got == {(0.0, 0, 27.75): 1500, (3.0, 2, 27.75): 1500}
    # of both sides only distinct positions meet
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    met = plan[plan.index("Join Inner, ((((_i"):] if "Join Inner, ((((_i" in plan else plan
    assert "Aggregate [_x" in met and "Aggregate [lon" in met


def test_without_takes_null_for_equal(spark):
    from skeinflow.operators import panels

    d = spark.createDataFrame([(1, None), (1, "a"), (None, "b")], "k int, v string")
    assert panels.without(d, d.where("v is null or v = 'b'"), ["k", "v"]).collect() == [(1, "a")]


def test_owners_lift_high_but_not_embargo(spark):
    from skeinflow.operators import gate

    rows = [(k, s, "policy", "withhold", 5.0, 30, True) for k, s in enumerate(["high", "embargoed", "moderate"])]
    decisions = spark.createDataFrame(rows, "k int, sensitivity string, reason string, decision string, grid double, delay_days int, drop_ids boolean")
    own = spark.createDataFrame([(k, 1.0, 0, False) for k in range(3)], "k int, own_grid double, own_delay_days int, own_drop_ids boolean")
    got = {r.k: (r.decision, r.grid, r.delay_days, r.drop_ids) for r in gate.with_permission(decisions, own, ["k"]).collect()}
    assert got == {0: ("publish", 5.0, 0, False), 1: ("withhold", 5.0, 30, True), 2: ("withhold", 5.0, 0, False)}


def test_admission_takes_blanks_for_no_name_and_collapses_spaces(spark):
    rows = [(1, None), (None, "  \u00a0 "), (None, None), (None, "Homo  sapiens"), (9, "x"), (None, " homo\tSAPIENS "), (2, ""), (None, "Homo sapiens idaltu")]
    df = spark.createDataFrame(rows, "k int, n string")
    got = [r.refusal for r in hygiene.admit_rows(df, "k", "n", [9], ["Homo sapiens "]).collect()]
    assert got == [None, "no key and no name", "no key and no name", "never stored", "never stored", "never stored", None, None]


def test_taxa_without_a_grid_keep_their_cells(spark):
    cells = spark.createDataFrame([("a", 0.1 * i, 0.2 * i, 1.0) for i in range(5)] + [("b", 0.1 * i, 0.2, 1.0) for i in range(5)], "t string, lon double, lat double, v double")
    out, left = gate.export_taxa(cells, spark.createDataFrame([("a", "publish", None), ("b", "publish", 10.0)], "t string, decision string, grid double"), "t", "lon", "lat", "v")
    assert sorted(r.lon for r in out.collect()) == pytest.approx([0.1 * i for i in range(5)])
    assert [tuple(r) for r in left.collect()] == [("b", "too small")]


def test_a_permission_without_a_delay_is_a_permission(spark):
    d = spark.createDataFrame([(1, "high", "policy", "withhold", 1.0, 30, True), (2, "low", None, "publish", 1.0, 30, True)], "k int, sensitivity string, reason string, decision string, grid double, delay_days int, drop_ids boolean")
    own = spark.createDataFrame([(1, None, None, None)], "k int, own_grid double, own_delay_days int, own_drop_ids boolean")
    got = {r.k: r for r in gate.with_permission(d, own, ["k"]).collect()}
    assert (got[1].decision, got[1].reason, got[1].delay_days, got[1].drop_ids) == ("publish", None, 0, True)
    assert (got[2].decision, got[2].delay_days) == ("publish", 30)


def test_geometry_of_cells(spark):
    row = spark.range(1).select(
        geo.floor_cell(F.lit(-0.3), 0.25).alias("floor"),
        geo.flat_km(F.lit(60.0), F.lit(0.0), F.lit(60.0), F.lit(1.0)).alias("flat"),
        F.sum(geo.cell_area_km2(F.lit(0.5), 1.0)).over(Window.partitionBy("id")).alias("area"),
        geo.cell_id(F.lit(0.5), F.lit(-1.25)).alias("id4"),
        geo.wrap_longitude(F.lit(190.0)).alias("lon"),
    ).first()
    assert (row.floor, row.id4, row.lon) == (-0.375, "0.5000_-1.2500", -170.0)
    assert row.flat == pytest.approx(55.66) and row.area == pytest.approx(12363.7, abs=1)
    globe = spark.range(180).select(F.sum(360 * geo.cell_area_km2(F.col("id") - 89.5, 1.0)).alias("a")).first().a
    assert globe == pytest.approx(4 * math.pi * geo.EARTH_KM**2)


def test_path_grows_with_fixes_and_displacement_does_not(spark):
    rng = __import__("random").Random(7)
    rows = []
    for h in range(250 * 24):
        lat = 40 + 0.002 * h / 24 * 10 + rng.gauss(0, 0.03)
        rows += [(a, dt.datetime(2020, 1, 1) + dt.timedelta(hours=h), lat, 10.0 + rng.gauss(0, 0.03)) for a, every in (("all", 1), ("thin", 6)) if h % every == 0]
    df = spark.createDataFrame(rows + [("none", dt.datetime(2020, 1, 2), 1.0, 1.0)], "a string, t timestamp, la double, lo double")
    got = {r.a: r for r in panels.seasonal_path(df, ["a"], "t", "la", "lo", (1, 30), (180, 220)).collect()}
    assert set(got) == {"all", "thin"}
    assert got["all"].displacement_km == pytest.approx(got["thin"].displacement_km, rel=0.05)
    assert got["all"].path_km > 3 * got["thin"].path_km and got["thin"].gap_days == pytest.approx(0.25)


def test_the_first_fix_has_no_step(spark):
    df = spark.createDataFrame([("a", dt.datetime(2020, 1, d), float(d), 0.0) for d in (1, 2, 3)] + [("b", dt.datetime(2020, 1, 1), None, 0.0)], "i string, t timestamp, la double, lo double")
    got = [r.step_km for r in tracks.steps(df, ["i"], "t", "la", "lo").orderBy("i", "t").collect()]
    assert got[0] is None and got[3] is None and got[1:3] == pytest.approx([111.195, 111.195], abs=1e-2)
