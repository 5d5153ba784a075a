"""Pooled trends against matrices in numpy, and on panels with planted slopes."""

import random

import numpy as np
import pytest

from skeinflow.operators import pooling


def panel(seed, sites, slope, *, step=0.0, gradient=0.0, bend=0.0, spread=0.5, noise=2.0, years=range(1996, 2016), break_year=2006):
    rng = random.Random(seed)
    rows = []
    for s in range(sites):
        lat = 30 + 20 * s / sites
        own, base = rng.gauss(slope + gradient * (lat - 40), spread), rng.gauss(120, 4)
        for y in years:
            if rng.random() < 0.9:
                t = (y - 2005.5) / 10
                rows.append((s, lat, y, base + own * t + step * (y >= break_year) + bend * t * t + rng.gauss(0, noise)))
    return rows


def moments(b, v, x):
    """Two-stage random effects with matrices."""
    b, v, x = (np.asarray(z, float) for z in (b, v, x))
    w = np.diag(1 / v)
    a = np.linalg.inv(x.T @ w @ x)
    beta = a @ x.T @ w @ b
    q = (b - x @ beta) @ w @ (b - x @ beta)
    tau2 = max(0.0, (q - (len(b) - x.shape[1])) / (np.trace(w) - np.trace(a @ x.T @ w @ w @ x)))
    w = np.diag(1 / (v + tau2))
    a = np.linalg.inv(x.T @ w @ x)
    return a @ x.T @ w @ b, np.sqrt(np.diag(a)), tau2


@pytest.mark.parametrize(("break_year", "curvature"), [(None, False), (2006, False), (None, True), (2006, True)])
def test_pooled_trend_equals_matrices(spark, break_year, curvature):
    rows = panel(4, 25, -1.0, step=1.5, gradient=0.1, bend=0.4)
    rows += [(99, 35.0, y, float(y % 3)) for y in range(1996, 2003)] + [(98, 35.0, 2000, 1.0)]  # one site before the break, one of a single year
    df = spark.createDataFrame(rows, "s int, lat double, y int, v double")
    got = pooling.population_trend(df, [], "s", "y", "v", latitude="lat", break_year=break_year, curvature=curvature).first()
    years = np.unique([r[2] for r in rows])
    fits = []
    for s in sorted({r[0] for r in rows}):
        own = np.array([r[1:] for r in rows if r[0] == s])
        t, y = (own[:, 1] - years.mean()) / 10, own[:, 2]
        terms = [np.ones(len(y)), t] + ([(own[:, 1] >= break_year) * 1.0] if break_year else []) + ([t * t] if curvature else [])
        x = np.column_stack(terms)
        if np.linalg.matrix_rank(x) < x.shape[1]:
            x = x[:, :2]
        if len(y) <= x.shape[1] or len(np.unique(t)) < 2:
            continue
        a = np.linalg.inv(x.T @ x)
        beta = a @ x.T @ y
        var = ((y - x @ beta) ** 2).sum() / (len(y) - x.shape[1]) * np.diag(a)
        fits.append((own[0, 0] - 40, beta, var))
    north = np.array([[1, f[0]] for f in fits])
    beta, se, tau2 = moments([f[1][1] for f in fits], [f[2][1] for f in fits], north)
    assert got.sites == len(fits) == 26
    assert (got.per_decade, got.per_degree) == pytest.approx(tuple(beta), rel=1e-6)
    assert (got.per_decade_se, got.per_degree_se) == pytest.approx(tuple(se), rel=1e-6)
    assert got.slope_sd == pytest.approx(np.sqrt(tau2), rel=1e-5, abs=1e-7)
    base = moments([f[1][0] for f in fits], [f[2][0] for f in fits], north)[2]
    assert got.site_sd == pytest.approx(np.sqrt(base), rel=1e-5)
    for at, name, asked in ((2, "shift", break_year), (3 if break_year else 2, "curvature", curvature)):
        if not asked:
            assert got[name] is None
            continue
        whole = [f for f in fits if len(f[1]) > at]
        b, s, _ = moments([f[1][at] for f in whole], [f[2][at] for f in whole], np.ones((len(whole), 1)))
        assert (got[name], got[f"{name}_se"]) == pytest.approx((b[0], s[0]), rel=1e-6)


def test_planted_slope_step_and_gradient_are_recovered(spark):
    df = spark.createDataFrame(panel(1, 60, -2.0, step=3.0, gradient=0.2), "s int, lat double, y int, v double")
    got = pooling.population_trend(df, [], "s", "y", "v", latitude="lat", break_year=2006).first()
    assert abs(got.per_decade + 2.0) < 3 * got.per_decade_se < 1.5 and abs(got["shift"] - 3.0) < 3 * got.shift_se
    assert abs(got.per_degree - 0.2) < 3 * got.per_degree_se and 2.5 < got.site_sd < 6 and got.p < 0.001
    plain = pooling.population_trend(df, [], "s", "y", "v").first()
    assert plain.per_decade > 0 and plain["shift"] is None  # the step is read as a trend


def test_spread_between_sites_widens_the_error(spark):
    like, unlike = (spark.createDataFrame(panel(2, 40, 1.0, spread=s), "s int, lat double, y int, v double") for s in (0.0, 3.0))
    a, b = (pooling.population_trend(x, [], "s", "y", "v").first() for x in (like, unlike))
    assert a.slope_sd < 0.5 < 2 < b.slope_sd < 4 and b.per_decade_se > 3 * a.per_decade_se


def test_too_few_sites_or_years_have_no_row_and_seasons_stay_apart(spark):
    rows = [("spring", *r) for r in panel(3, 12, 1.0)] + [("autumn", *r) for r in panel(5, 12, -1.0)] + [("winter", *r) for r in panel(6, 9, 1.0)] + [("one", *r) for r in panel(7, 12, 1.0, years=[2000])]
    df = spark.createDataFrame(rows, "season string, s int, lat double, y int, v double")
    got = {r.season: r.per_decade for r in pooling.population_trend(df, ["season"], "s", "y", "v").collect()}
    assert set(got) == {"spring", "autumn"} and got["spring"] > 0 > got["autumn"]
    assert pooling.population_trend(df.where("false"), [], "s", "y", "v").count() == 0


def test_diagnosis_by_band_has_its_variants(spark):
    rows = panel(9, 40, -1.0, step=2.0) + [(200 + k, 31.0, y, 100.0 + y % 4) for k in range(3) for y in range(1996, 2004)]
    df = spark.createDataFrame(rows, "s int, lat double, y int, v double")
    got = {(r.band, r.variant): r for r in pooling.break_diagnosis(df, {"low": (30.0, 40.0), "high": (40.0, 50.0)}, "s", "y", "v", "lat", 2006).collect()}
    assert len(got) == 8
    assert got["low", "step"].sites == 23 and got["low", "balanced step"].sites == 20
    assert got["high", "plain"]["shift"] is None and got["high", "curved step"].curvature is not None
    assert got["high", "plain"].per_decade > got["high", "step"].per_decade


def test_diagnosis_may_want_more_years_after_the_break(spark):
    short = [(300 + k, 31.0, y, 100.0 + (y * 3 + k) % 5) for k in range(12) for y in range(2003, 2009)]
    df = spark.createDataFrame(panel(9, 40, -1.0, step=2.0) + short, "s int, lat double, y int, v double")
    sites = lambda **more: pooling.break_diagnosis(df, {"low": (30.0, 40.0)}, "s", "y", "v", "lat", 2006, least=3, **more).where("variant = 'balanced step'").first().sites
    assert (sites(), sites(least_after=4)) == (32, 20)
