"""Trends of a population from the trends of its sites: random effects in two stages.

Each site is fitted by itself from sums; site estimates are then pooled with weights
1 / (their variance + the variance between sites), the latter by moments
(DerSimonian and Laird), with latitude as a moderator where asked. Likelihood fits
of a mixed model come close to this on panels of like sites and differ on others; both stages
are aggregations, so sites may be many. Everything is exact sums, nothing iterates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.lineage import cut
from .inference import two_sided
from .panels import balanced_panel

#: Least sites and years of a pooled fit, and the latitude at which its slope is given.
MIN_SITES = 10
MIN_YEARS = 2
LATITUDE_ORIGIN = 40.0


def _inverse(m: list[list[Column]]) -> tuple[list[list[Column]], Column]:
    """Inverse of a symmetric matrix of one to three rows, and its determinant; null where that is 0."""
    over = F.try_divide
    if len(m) == 1:
        return [[over(F.lit(1.0), m[0][0])]], m[0][0]
    if len(m) == 2:
        det = m[0][0] * m[1][1] - m[0][1] * m[1][0]
        return [[over(m[1][1], det), over(-m[0][1], det)], [over(-m[1][0], det), over(m[0][0], det)]], det
    cof = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = m[0][0] * cof(0, 0) + m[0][1] * cof(0, 1) + m[0][2] * cof(0, 2)
    return [[over(cof(j, i), det) for j in range(3)] for i in range(3)], det


def site_fits(panel: DataFrame, keys: Sequence[str], site: str, y: str, terms: Sequence[str]) -> DataFrame:
    """(keys, site, n, base, base_var, and for each term its coefficient b_term and variance v_term) by least squares within each site.

    A site in which the terms after the first don't vary beside it is fitted with the
    first alone (their columns are null); one whose rows don't exceed its coefficients by
    one, or whose first term doesn't vary, is left out. ``base`` is the value where all
    terms are 0.
    """
    d = panel.dropna(subset=[*keys, site, y, *terms])
    cross = {f"c_{a}_{b}": F.covar_pop(a, b) for i, a in enumerate(terms) for b in terms[i:]} | {f"c_{t}_y": F.covar_pop(t, y) for t in terms} | {f"m_{t}": F.avg(t) for t in terms}
    s = d.groupBy(*keys, site).agg(F.count("*").alias("n"), F.avg(y).alias("m_y"), F.var_pop(y).alias("c_yy"), *[e.alias(n) for n, e in cross.items()])
    at = lambda a, b: F.col(f"c_{a}_{b}") if f"c_{a}_{b}" in cross else F.col(f"c_{b}_{a}")

    def fit(used: Sequence[str]) -> tuple[Column, Column]:
        inverse, det = _inverse([[at(a, b) for b in used] for a in used])
        b = [sum((inverse[i][j] * F.col(f"c_{t}_y") for j, t in enumerate(used)), F.lit(0.0)) for i in range(len(used))]
        rest = F.greatest(F.col("c_yy") - sum((b[i] * F.col(f"c_{t}_y") for i, t in enumerate(used)), F.lit(0.0)), F.lit(0.0))
        noise = F.try_divide(F.col("n") * rest, F.col("n") - len(used) - 1)
        mean = sum((b[i] * F.col(f"m_{t}") for i, t in enumerate(used)), F.lit(0.0))
        lean = sum((F.col(f"m_{t}") * F.col(f"m_{u}") * inverse[i][j] for i, t in enumerate(used) for j, u in enumerate(used)), F.lit(0.0))
        parts = [F.col("n"), F.col("m_y") - mean, noise * (1 + lean) / F.col("n")]
        names = ["n", "base", "base_var"]
        for t in terms:
            i = list(used).index(t) if t in used else None
            parts += [b[i], noise * inverse[i][i] / F.col("n")] if i is not None else [F.lit(None).cast("double")] * 2
            names += [f"b_{t}", f"v_{t}"]
        size = F.lit(1.0)
        for t in used:
            size = size * at(t, t)
        fits = (det > 1e-9 * size) & (F.col("n") > len(used) + 1)
        return fits, F.struct(*[p.alias(n) for p, n in zip(parts, names, strict=True)])

    found = F.lit(None)
    for used in ([terms, terms[:1]] if len(terms) > 1 else [terms]):
        fits, row = fit(used)
        found = F.when(fits, row) if used is terms else F.coalesce(found, F.when(fits, row))
    return s.select(*keys, site, found.alias("fit")).where("fit is not null").select(*keys, site, "fit.*")


def pooled(estimates: DataFrame, keys: Sequence[str], b: str, v: str, moderator: str | None = None) -> DataFrame:
    """(keys, sites, tau2, estimate, se, and with a moderator gradient, gradient_se): random-effects mean of b with variances v.

    tau2 is the variance between sites beyond their own, by moments, 0 at least. With a
    moderator the estimate holds where it is 0. Estimates without a variance above 0 are
    left out.
    """
    x = F.col(moderator).cast("double") if moderator else F.lit(0.0)
    d = estimates.where((F.col(v) > 0) & F.col(b).isNotNull() & x.isNotNull()).select(*keys, F.col(b).alias("_b"), F.col(v).alias("_v"), x.alias("_x"))

    def sums(w: Column, more: dict[str, Column]) -> list[Column]:
        b, x = F.col("_b"), F.col("_x")
        parts = {"w": w, "wx": w * x, "wxx": w * x * x, "wb": w * b, "wxb": w * x * b, "wbb": w * b * b} | more
        return [F.sum(e).alias(n) for n, e in parts.items()]

    c = F.col
    det = c("w") * c("wxx") - c("wx") * c("wx")
    two = det > 1e-12 * c("w") * c("wxx") if moderator else F.lit(False)
    slope = F.when(two, F.try_divide(c("w") * c("wxb") - c("wx") * c("wb"), det)).otherwise(F.lit(0.0))
    mean = (c("wb") - slope * c("wx")) / c("w")
    w = 1 / c("_v")
    first = d.groupBy(*keys).agg(F.count("*").alias("sites"), *sums(w, {"ww": w * w, "wwx": w * w * c("_x"), "wwxx": w * w * c("_x") * c("_x")}))
    q = c("wbb") - mean * c("wb") - slope * c("wxb")
    trace = F.when(two, F.try_divide(c("wxx") * c("ww") - 2 * c("wx") * c("wwx") + c("w") * c("wwxx"), det)).otherwise(c("ww") / c("w"))
    used = F.when(two, 2).otherwise(1)
    tau2 = F.greatest(F.coalesce(F.try_divide(q - (c("sites") - used), c("w") - trace), F.lit(0.0)), F.lit(0.0))
    spread = first.select(*keys, "sites", tau2.alias("tau2"))
    again = d.join(F.broadcast(spread), list(keys)) if keys else d.crossJoin(F.broadcast(spread))
    final = again.groupBy(*keys, "sites", "tau2").agg(*sums(1 / (c("_v") + c("tau2")), {}))
    se = F.sqrt(F.when(two, F.try_divide(c("wxx"), det)).otherwise(1 / c("w")))
    out = final.select(*keys, "sites", "tau2", mean.alias("estimate"), se.alias("se"), F.when(two, slope).alias("gradient"), F.when(two, F.sqrt(F.try_divide(c("w"), det))).alias("gradient_se"))
    return out if moderator else out.drop("gradient", "gradient_se")


def population_trend(panel: DataFrame, keys: Sequence[str], site: str, year: str, y: str, *, latitude: str | None = None, break_year: int | None = None, curvature: bool = False, min_sites: int = MIN_SITES) -> DataFrame:
    """One row per key (a season, a band): the population's trend per decade with its error, p, its change with latitude, the step at break_year, the curvature, and the spread between sites.

    Time is in decades from the middle of the key's years. A key of fewer than min_sites
    sites that can be fitted, or of one year, has no row. What is not asked for is null.
    """
    k = list(keys)
    # the panel is a reduction of what it comes from, and is read several times
    d = cut(panel.dropna(subset=[*k, site, year, y]).select(*k, site, year, F.col(y).cast("double").alias(y), *([latitude] if latitude else [])))
    mid = d.select(*k, year).distinct().groupBy(*k).agg(F.avg(year).alias("_mid"))
    d = d.join(F.broadcast(mid), k) if k else d.crossJoin(F.broadcast(mid))
    d = d.withColumn("decade", (F.col(year) - F.col("_mid")) / 10)
    terms = ["decade"]
    if break_year is not None:
        d, terms = d.withColumn("post", (F.col(year) >= break_year).cast("double")), [*terms, "post"]
    if curvature:
        d, terms = d.withColumn("decade2", F.col("decade") * F.col("decade")), [*terms, "decade2"]
    fits = site_fits(d, k, site, y, terms)
    if latitude:
        place = d.groupBy(*k, site).agg((F.max(latitude) - LATITUDE_ORIGIN).alias("north"))
        fits = fits.join(place, [*k, site])
    fits = cut(fits)
    north = "north" if latitude else None
    whole = d.join(fits.select(*k, site), [*k, site], "left_semi").groupBy(*k).agg(F.count("*").alias("observations"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    none = F.lit(None).cast("double")
    parts = {"decade": pooled(fits, k, "b_decade", "v_decade", north), "base": pooled(fits, k, "base", "base_var", north)} | {t: pooled(fits, k, f"b_{t}", f"v_{t}") for t in terms[1:]}
    main = parts["decade"].select(*k, "sites", F.col("estimate").alias("per_decade"), F.col("se").alias("per_decade_se"), two_sided(F.col("estimate") / F.col("se")).alias("p"), (F.col("gradient") if latitude else none).alias("per_degree"), (F.col("gradient_se") if latitude else none).alias("per_degree_se"), F.sqrt("tau2").alias("slope_sd"))
    out = _side(whole, main, k, "inner")
    out = _side(out, parts["base"].select(*k, F.sqrt("tau2").alias("site_sd")), k, "left")
    for term, name in (("post", "shift"), ("decade2", "curvature")):
        found = parts[term].select(*k, F.col("estimate").alias(name), F.col("se").alias(f"{name}_se")) if term in parts else None
        out = _side(out, found, k, "left") if found is not None else out.withColumns({name: none, f"{name}_se": none})
    return out.where((F.col("sites") >= min_sites) & (F.col("last_year") - F.col("first_year") >= MIN_YEARS - 1))


def _side(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Tables of one row per key beside each other; without keys both have one row at most."""
    return a.join(b, keys, how) if keys else a.join(b, F.lit(True), how)


def break_diagnosis(panel: DataFrame, bands: Mapping[str, tuple[float, float]], site: str, year: str, y: str, latitude: str, break_year: int, *, least: int = 2, least_after: int | None = None, min_sites: int = MIN_SITES) -> DataFrame:
    """(band, variant, ...): the population's trend in half-open bands of latitude, plain, with a step, with a step on sites that have ``least`` years before it and as many (or ``least_after``) from it on, and with step and curvature."""
    band = F.coalesce(*[F.when((F.col(latitude) >= low) & (F.col(latitude) < high), name) for name, (low, high) in bands.items()])
    d = cut(panel.withColumn("band", band).where("band is not null").select("band", site, year, y))
    held = balanced_panel(d.dropna(subset=[y]), site, year, break_year, least, least_after)
    fit = lambda p, variant, **more: population_trend(p, ["band"], site, year, y, min_sites=min_sites, **more).withColumn("variant", F.lit(variant))
    out = fit(d, "plain")
    for more in (fit(d, "step", break_year=break_year), fit(held, "balanced step", break_year=break_year), fit(d, "curved step", break_year=break_year, curvature=True)):
        out = out.unionByName(more)
    return out
