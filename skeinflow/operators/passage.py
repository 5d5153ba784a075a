"""When movement passes: seasonal quantiles of cumulative value, and their trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def passage_quantiles(obs: DataFrame, keys: Sequence[str], time: str, value: str, *, seasons: dict[str, tuple[int, int]], quantiles: Sequence[float] = (0.1, 0.5, 0.9), coverage: str | None = None, min_coverage: float = 0.9, min_observations: int = 20) -> DataFrame:
    """Per keys, year and season, the day of year at which the summed value reaches each quantile.

    Between two observations the day is interpolated; the first observation's day
    stands for itself. Null where a season has fewer than ``min_observations`` rows or
    no positive total. Rows of one day are ordered by value. Missing coverage is kept,
    coverage below ``min_coverage`` is dropped. Seasons are closed day windows.
    """
    kept = obs.where(F.col(time).isNotNull() & F.col(value).isNotNull())
    if coverage is not None:
        kept = kept.where(F.col(coverage).isNull() | (F.col(coverage) >= min_coverage))
    windows = F.array(*[F.struct(F.lit(n).alias("season"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for n, (a, b) in seasons.items()])
    kept = kept.select(*keys, F.year(time).alias("year"), F.dayofyear(time).alias("doy"), F.col(value).cast("double").alias("v"))
    kept = kept.withColumn("w", F.explode(windows)).where(F.col("doy").between(F.col("w.lo"), F.col("w.hi"))).withColumn("season", F.col("w.season"))
    group = [*keys, "year", "season"]
    by_day = Window.partitionBy(*group).orderBy("doy", "v")
    running = kept.withColumn("cum", F.sum("v").over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    running = running.withColumns({"day_before": F.lag("doy").over(by_day), "cum_before": F.lag("cum").over(by_day), "total": F.sum("v").over(Window.partitionBy(*group))})
    span = F.col("cum") - F.col("cum_before")
    out = [F.count("*").alias("observations"), F.max("total").alias("total")]
    for q in quantiles:
        part = F.try_divide(q * F.col("total") - F.col("cum_before"), span)
        day = F.when(F.col("day_before").isNull() | (span <= 0), F.col("doy").cast("double")).otherwise(F.col("day_before") + part * (F.col("doy") - F.col("day_before")))
        reached = F.when(F.col("cum") >= q * F.col("total"), F.struct("doy", "v"))
        out.append(F.min_by(day, reached).alias(f"q{round(q * 100)}_doy"))
    found = running.groupBy(*group).agg(*out)
    usable = (F.col("observations") >= min_observations) & (F.col("total") > 0)
    return found.withColumns({c: F.when(usable, F.col(c)) for c in found.columns if c.endswith("_doy")})


def decade_trends(df: DataFrame, keys: Sequence[str], year: str, columns: Sequence[str], *, min_years: int = 15) -> DataFrame:
    """OLS slope per decade of each column on year, over years complete in all columns; at least min_years of them."""
    whole = df.dropna(subset=[year, *columns])
    out = whole.groupBy(*keys).agg(F.count("*").alias("years"), F.var_pop(year).alias("_spread"), *[(F.regr_slope(F.col(c), F.col(year)) * 10).alias(f"{c}_per_decade") for c in columns])
    return out.where((F.col("years") >= min_years) & (F.col("_spread") > 0)).drop("_spread")


def trend_with_error(df: DataFrame, keys: Sequence[str], x: str, y: str, *, min_n: int = 15) -> DataFrame:
    """slope, standard error, n, and whether |slope| > 1.96 standard errors."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = df.dropna(subset=[x, y]).groupBy(*keys).agg(F.count("*").alias("n"), F.regr_sxx(b, a).alias("sxx"), F.regr_sxy(b, a).alias("sxy"), F.regr_syy(b, a).alias("syy"))
    slope = F.col("sxy") / F.col("sxx")
    error = F.sqrt(F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2) / F.col("sxx"))
    out = sums.where((F.col("n") >= min_n) & (F.col("sxx") > 0) & (F.col("n") > 2)).select(*keys, "n", slope.alias("slope"), error.alias("se"))
    return out.withColumn("distinguishable", F.abs("slope") > 1.96 * F.col("se"))


def trend_with_break(df: DataFrame, keys: Sequence[str], year: str, y: str, break_year: Column | int, *, min_n: int = 15) -> DataFrame:
    """slope per decade and level step of y ~ year + (year >= break); no step where the break is outside the years.

    Both regressors come from one aggregation of centred sums (normal equations).
    """
    brk = break_year if isinstance(break_year, Column) else F.lit(break_year)
    d = df.dropna(subset=[year, y]).withColumns({"_x": F.col(year).cast("double"), "_y": F.col(y).cast("double"), "_s": (F.col(year) >= brk).cast("double")})
    c = lambda a, b: F.covar_pop(a, b)
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), c("_x", "_x").alias("xx"), c("_s", "_s").alias("ss"), c("_x", "_s").alias("xs"), c("_x", "_y").alias("xy"), c("_s", "_y").alias("sy"))
    det = F.col("xx") * F.col("ss") - F.col("xs") * F.col("xs")
    spans = (F.col("ss") > 0) & (det > 1e-9 * F.col("xx") * F.col("ss"))
    slope = F.when(spans, F.try_divide(F.col("ss") * F.col("xy") - F.col("xs") * F.col("sy"), det)).otherwise(F.try_divide(F.col("xy"), F.col("xx")))
    step = F.when(spans, F.try_divide(F.col("xx") * F.col("sy") - F.col("xs") * F.col("xy"), det))
    return s.where((F.col("n") >= min_n) & (F.col("xx") > 0)).select(*keys, "n", (slope * 10).alias("per_decade"), step.alias("step"))


def mean_interval(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean and 1.96 * sd / sqrt(n); one value has interval 0."""
    d = df.where(F.col(value).isNotNull())
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(1.96 * F.stddev_samp(value) / F.sqrt(F.count("*")), F.lit(0.0)).alias("ci"))


def longest_outage(obs: DataFrame, site: str, day: Column, first: str, last: str, *, min_days: int = 4, max_days: int = 40) -> DataFrame:
    """Per site the longest run of missing days in a closed window whose edges bound it; the earliest on ties."""
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    days = obs.select(F.col(site), day.cast("date").alias("d")).where(F.col("d").between(lo, hi)).distinct()
    edges = days.select(site).distinct().select(site, F.explode(F.array(F.date_sub(lo, 1), F.date_add(hi, 1))).alias("d"))
    by = Window.partitionBy(site).orderBy("d")
    gaps = days.unionByName(edges).select(site, F.date_add("d", 1).alias("start"), (F.datediff(F.lead("d").over(by), "d") - 1).alias("gap")).where(F.col("gap").between(min_days, max_days))
    return gaps.groupBy(site).agg(F.max_by("start", F.struct("gap", -F.unix_date("start"))).alias("start"), F.max("gap").alias("days"))


def permutation_null(panel: DataFrame, keys: Sequence[str], year: str, value: str, *, draws: int = 200, min_years: int = 15, seed: int = 0) -> DataFrame:
    """Mean slope per decade over groups for each draw of values shuffled within their group: groups, mean, 2.5 and 97.5 percentiles.

    Groups of fewer than min_years values, and rows without a key, are left out. A draw
    orders a group's values by the digest of seed, draw, key and place, so that it can be
    drawn again anywhere. A group is one row with the arrays of its years and values;
    draws are dealt and fitted within that row, so nothing is joined after they multiply
    it, and only sums of each draw are shuffled.
    """
    held = panel.dropna(subset=[*keys, year, value]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(year).cast("double").alias("x"), F.col(value).cast("double").alias("y")))).alias("_own")).where(F.size("_own") >= min_years)
    digest = lambda k: F.md5(F.concat_ws("-", F.lit(seed).cast("string"), *[F.col(c).cast("string") for c in ("_draw", *keys)], k.cast("string")))
    # small rows with much work each: kept apart, although their bytes would fit one task
    held = held.repartition(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    # sums about the first year and value, so that equal years give a spread of exactly 0
    x = F.transform("_own", lambda o: o["x"] - F.col("_own")[0]["x"])
    many = held.withColumn("_x", x).withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    order = F.array_sort(F.transform("_own", lambda o, i: F.struct(digest(i + 1).alias("d"), (i + 1).alias("k"), (o["y"] - F.col("_own")[0]["y"]).alias("y"))))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
    dealt = many.select("_draw", "_x", F.transform(order, lambda o: o["y"]).alias("_y"))
    n = F.size("_x")
    xy = total(F.zip_with("_x", "_y", lambda u, v: u * v)) - total(F.col("_x")) * total(F.col("_y")) / n
    xx = total(F.transform("_x", lambda u: u * u)) - total(F.col("_x")) * total(F.col("_x")) / n
    slopes = dealt.select("_draw", (F.try_divide(xy, xx) * 10).alias("b")).groupBy("_draw").agg(F.avg("b").alias("b"), F.count("b").alias("groups"))
    return slopes.agg(F.max("groups").alias("groups"), F.avg("b").alias("mean"), F.percentile("b", 0.025).alias("low"), F.percentile("b", 0.975).alias("high"))


def weekly_climatology(obs: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Median per key, year and week (days of 7, the last one longer), then the median over years and their number."""
    week = F.least(F.greatest(F.floor((F.dayofyear(time) - 1) / 7), F.lit(0)), F.lit(51)).cast("int")
    yearly = obs.where(F.col(value).isNotNull()).groupBy(*keys, F.year(time).alias("year"), week.alias("week")).agg(F.median(value).alias("m"))
    return yearly.groupBy(*keys, "week").agg(F.median("m").alias("value"), F.count("*").alias("years"))


def weekly_flow(obs: DataFrame, keys: Sequence[str], time: str, direction: str, speed: str, weight: str) -> DataFrame:
    """Weighted mean vector per key, year and week; component medians over years as bearing [0, 360) and speed."""
    week = F.least(F.floor((F.dayofyear(time) - 1) / 7), F.lit(51)).cast("int")
    w, angle = F.col(weight), F.radians(direction)
    part = lambda f: F.try_divide(F.sum(w * F.col(speed) * f(angle)), F.sum(w))
    yearly = obs.dropna(subset=[direction, speed, weight]).groupBy(*keys, F.year(time).alias("year"), week.alias("week")).agg(part(F.sin).alias("u"), part(F.cos).alias("v"))
    out = yearly.groupBy(*keys, "week").agg(F.median("u").alias("u"), F.median("v").alias("v"))
    return out.select(*keys, "week", F.pmod(F.degrees(F.atan2("u", "v")) + 360, F.lit(360.0)).alias("bearing"), F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")).alias("speed"))
