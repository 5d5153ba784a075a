"""Effort-controlled ranges: catch per effort, consistent footprints, weighted centroids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def catch_per_effort(count: str, effort: str) -> Column:
    return F.try_divide(F.col(count).cast("double"), F.col(effort).cast("double"))


def consistent_footprint(df: DataFrame, keys: Sequence[str], cell: Sequence[str], year: str, share: float) -> DataFrame:
    """Rows of cells sampled in max(1, round(share * years)) years or more; halves round to even."""
    cells = df.groupBy(*keys, *cell).agg(F.countDistinct(year).alias("_seen"))
    years = df.groupBy(*keys).agg(F.countDistinct(year).alias("_all")) if keys else df.agg(F.countDistinct(year).alias("_all"))
    need = F.greatest(F.lit(1), F.bround(F.col("_all") * share, 0))
    kept = (cells.join(years, list(keys)) if keys else cells.crossJoin(F.broadcast(years))).where(F.col("_seen") >= need).select(*keys, *cell)
    return df.join(kept, [*keys, *cell], "left_semi")


def weighted_centroids(df: DataFrame, keys: Sequence[str], weight: str, columns: Sequence[str]) -> DataFrame:
    """Weighted mean of each column over rows of positive weight."""
    d = df.where(F.col(weight) > 0)
    return d.groupBy(*keys).agg(F.count("*").alias("n"), *[(F.sum(F.col(c) * F.col(weight)) / F.sum(F.when(F.col(c).isNotNull(), F.col(weight)))).alias(c) for c in columns])


def gear_change_year(df: DataFrame, keys: Sequence[str], year: str, gear: str) -> DataFrame:
    """First year whose gear differs from the first gear; null if none."""
    yearly = df.groupBy(*keys, year).agg(F.min(gear).alias("g"))
    first = yearly.groupBy(*keys).agg(F.min_by("g", year).alias("g0"))
    return yearly.join(first, list(keys)).groupBy(*keys).agg(F.min(F.when(F.col("g") != F.col("g0"), F.col(year))).alias("change_year"))


def available(df: DataFrame, year: str, site: str, value: str, doy: str, *, least_share: float = 0.5) -> DataFrame:
    """Unweighted environment of each year over its sites, each once, where enough of them have a value."""
    once = df.groupBy(year, site).agg(F.avg(value).alias("v"), F.avg(doy).alias("d"))
    out = once.groupBy(year).agg(F.count("*").alias("sites"), F.avg("v").alias("ambient"), F.avg(F.col("v").isNotNull().cast("int")).alias("share"), F.avg("d").alias("mean_doy"))
    return out.where(F.col("share") >= least_share)


def tracking_index(occupied: DataFrame, ambient: DataFrame, keys: Sequence[str]) -> DataFrame:
    """1 - occupied trend / ambient trend, where the ambient trend is distinguishable; both: keys, slope, se."""
    both = occupied.select(*keys, F.col("slope").alias("o")).join(ambient.select(*keys, F.col("slope").alias("a"), "se"), list(keys))
    return both.select(*keys, F.col("o").alias("occupied"), F.col("a").alias("ambient"), F.when(F.abs("a") > 1.96 * F.col("se"), 1 - F.col("o") / F.col("a")).alias("tracking"))
