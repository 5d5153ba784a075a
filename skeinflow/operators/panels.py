"""Panels of stations by year, and series within a year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import haversine_km
from .tracks import steps


def balanced_panel(df: DataFrame, station: str, year: str, break_year: int, each_side: int = 1, after: int | None = None) -> DataFrame:
    """Rows of stations with at least so many years before the break, and so many (or ``after``) from it on."""
    sides = df.groupBy(station).agg(F.countDistinct(F.when(F.col(year) < break_year, F.col(year))).alias("a"), F.countDistinct(F.when(F.col(year) >= break_year, F.col(year))).alias("b"))
    return df.join(sides.where((F.col("a") >= each_side) & (F.col("b") >= (each_side if after is None else after))).select(station), station, "left_semi")


def era_comparison(df: DataFrame, station: str, year: str, value: str, break_year: int, each_side: int = 5) -> DataFrame:
    """Mean of station means before and from the break, on the stations that span it; and their difference."""
    d = balanced_panel(df.dropna(subset=[value]), station, year, break_year, each_side)
    per = d.groupBy(station).agg(F.avg(F.when(F.col(year) < break_year, F.col(value))).alias("a"), F.avg(F.when(F.col(year) >= break_year, F.col(value))).alias("b"))
    return per.agg(F.count("*").alias("stations"), F.avg("a").alias("before"), F.avg("b").alias("after"), F.avg(F.col("b") - F.col("a")).alias("change"))


def driver_fit(df: DataFrame, keys: Sequence[str], y: str, x1: str, x2: str, year: str, *, min_n: int = 4) -> DataFrame:
    """Least squares y ~ 1 + x1 + x2 per key, trends of y and x1 on year, and the correlation of the drivers.

    Collinear drivers give no row.
    """
    d = df.dropna(subset=[y, x1, x2])
    cov = lambda a, b, n: F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(n)
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), cov(x1, x1, "aa"), cov(x2, x2, "bb"), cov(x1, x2, "ab"), cov(x1, y, "ay"), cov(x2, y, "by"), cov(year, year, "tt"), cov(year, y, "ty"), cov(year, x1, "ta"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    s = s.where((F.col("n") >= min_n) & (F.col("tt") > 0) & (det > 1e-9 * F.col("aa") * F.col("bb")))
    return s.select(
        *keys, "n",
        ((F.col("bb") * F.col("ay") - F.col("ab") * F.col("by")) / det).alias("on_x1"),
        ((F.col("aa") * F.col("by") - F.col("ab") * F.col("ay")) / det).alias("on_x2"),
        (F.col("ty") / F.col("tt")).alias("y_trend"), (F.col("ta") / F.col("tt")).alias("x1_trend"), (F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("driver_r"),
    )


def paired_slopes(left: DataFrame, right: DataFrame, keys: Sequence[str], slope: str) -> DataFrame:
    """Mean difference of two quantities' slopes on the same keys with its interval, their correlation, and whether they differ."""
    both = left.select(*keys, F.col(slope).alias("a")).join(right.select(*keys, F.col(slope).alias("b")), list(keys))
    s = both.agg(F.count("*").alias("n"), F.avg(F.col("a") - F.col("b")).alias("difference"), (1.96 * F.stddev_samp(F.col("a") - F.col("b")) / F.sqrt(F.count("*"))).alias("ci"), F.corr("a", "b").alias("r"))
    return s.withColumn("differs", F.abs("difference") > F.col("ci"))


def without(df: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of df whose keys are not listed; null equals null."""
    own = listed.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return df.join(own, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")


def rate_of_change(df: DataFrame, keys: Sequence[str], order: str, value: str, rising: Column) -> DataFrame:
    """df with flux: the step from the row before, taken up where rising holds and down elsewhere, never below 0."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("flux", F.greatest(F.when(rising, step).otherwise(-step), F.lit(0.0)))


def peak_and_share(df: DataFrame, keys: Sequence[str], day: str, value: str, window: tuple[int, int]) -> DataFrame:
    """Day of the greatest value (the first of equals), and the window's share of the sum."""
    inside = F.sum(F.when(F.col(day).between(*window), F.col(value)).otherwise(F.lit(0.0)))
    return df.groupBy(*keys).agg(F.max_by(day, F.struct(F.col(value), -F.col(day))).alias("peak_day"), F.try_divide(inside, F.sum(value)).alias("share"))


def group_shares(df: DataFrame, keys: Sequence[str], slot: Sequence[str], value: str) -> DataFrame:
    """Mean of each slot as a share of its group's, so that a group adds its shape and not its size."""
    m = df.groupBy(*keys, *slot).agg(F.avg(value).alias("mean"))
    return m.withColumn("share", F.try_divide(F.col("mean"), F.sum("mean").over(Window.partitionBy(*keys))))


def nightly_means(df: DataFrame, keys: Sequence[str], time: str, value: str, hours: Sequence[int] = (0, 3, 6, 9)) -> DataFrame:
    """Mean over the hours of a night, named by the evening's date."""
    d = df.where(F.hour(time).isin(list(hours))).withColumn("night", F.date_sub(F.to_date(time), 1))
    return d.groupBy(*keys, "night").agg(F.count("*").alias("n"), F.avg(value).alias(value))


def seasonal_displacement(df: DataFrame, keys: Sequence[str], time: str, lat: str, winter: tuple[int, int], summer: tuple[int, int]) -> DataFrame:
    """Median winter and summer latitude of each key, and the fixes between the end of winter and the start of summer."""
    doy = F.dayofyear(time)
    edges = df.groupBy(*keys).agg(F.median(F.when(doy.between(*winter), F.col(lat))).alias("winter"), F.median(F.when(doy.between(*summer), F.col(lat))).alias("summer"), F.max(F.when(doy.between(*winter), F.col(time))).alias("_from"), F.min(F.when(doy.between(*summer), F.col(time))).alias("_to"))
    between = df.join(edges, list(keys)).where(F.col(time).between(F.col("_from"), F.col("_to"))).groupBy(*keys).agg(F.count("*").alias("fixes"))
    return edges.dropna(subset=["winter", "summer"]).join(between, list(keys), "left").select(*keys, "winter", "summer", (F.col("summer") - F.col("winter")).alias("displacement"), F.coalesce("fixes", F.lit(0)).alias("fixes"))


def seasonal_path(df: DataFrame, keys: Sequence[str], time: str, lat: str, lon: str, winter: tuple[int, int], summer: tuple[int, int], tie: str | None = None) -> DataFrame:
    """(keys, displacement_km, fixes, path_km, gap_days): from the median winter to the median summer position, and what was walked between.

    The path is the sum of steps from the last fix of winter to the first of summer;
    gap_days is the median time between its fixes, as a path grows with the number of
    fixes. Keys without both positions have no row, those with fewer than two fixes on
    the way no path.
    """
    doy = F.dayofyear(time)
    at = lambda c, days: F.median(F.when(doy.between(*days), F.col(c)))
    edges = df.groupBy(*keys).agg(at(lat, winter).alias("_la1"), at(lon, winter).alias("_lo1"), at(lat, summer).alias("_la2"), at(lon, summer).alias("_lo2"), F.max(F.when(doy.between(*winter), F.col(time))).alias("_from"), F.min(F.when(doy.between(*summer), F.col(time))).alias("_to"))
    edges = edges.dropna(subset=["_la1", "_la2"])
    way = df.join(edges.select(*keys, "_from", "_to"), list(keys)).where(F.col(time).between(F.col("_from"), F.col("_to")))
    walked = steps(way, keys, time, lat, lon, tie).groupBy(*keys).agg(F.count("*").alias("fixes"), F.sum("step_km").alias("path_km"), F.median("step_days").alias("gap_days"))
    out = edges.join(walked, list(keys), "left")
    return out.select(*keys, haversine_km(F.col("_la1"), F.col("_lo1"), F.col("_la2"), F.col("_lo2")).alias("displacement_km"), F.coalesce("fixes", F.lit(0)).alias("fixes"), "path_km", "gap_days")


def individual_years(df: DataFrame, animal: str, time: str, lat: str, sensor: str, *, min_fixes: int = 30, min_months: int = 6) -> DataFrame:
    """Years of animals with enough fixes in enough months."""
    d = df.groupBy(animal, F.year(time).alias("year")).agg(F.count("*").alias("fixes"), F.countDistinct(F.month(time)).alias("months"), F.avg(lat).alias("mean_lat"), (F.max(lat) - F.min(lat)).alias("lat_range"), F.countDistinct(sensor).alias("sensors"))
    return d.where((F.col("fixes") >= min_fixes) & (F.col("months") >= min_months))
