"""Tracks: steps, segmentation at impossible steps, crossings, daily paths, lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import haversine_km, snap


def steps(df: DataFrame, ids: Sequence[str], time: str, lat: str, lon: str, tie: str | None = None) -> DataFrame:
    """df with step_km and step_days from the individual's previous fix."""
    by = Window.partitionBy(*ids).orderBy(time, *([tie] if tie else [lat, lon]))
    back = lambda c: F.lag(c).over(by)
    days = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(back(F.col(time)).cast("timestamp"))) / 86_400_000_000
    return df.withColumns({"step_km": haversine_km(back(lat), back(lon), F.col(lat), F.col(lon)), "step_days": days})


def segments(df: DataFrame, ids: Sequence[str], time: str, lat: str, lon: str, *, max_kmh: Column | float = 250.0, min_km: float = 50.0, tie: str | None = None) -> DataFrame:
    """df with a running segment number; a step of over min_km at no time or above max_kmh begins a new one."""
    top = max_kmh if isinstance(max_kmh, Column) else F.lit(max_kmh)
    d = steps(df, ids, time, lat, lon, tie)
    cut = (F.col("step_km") > min_km) & ((F.col("step_days") <= 0) | (F.try_divide(F.col("step_km"), F.col("step_days") * 24) > top))
    by = Window.partitionBy(*ids).orderBy(time, *([tie] if tie else [lat, lon])).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("segment", F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(by).cast("int"))


def unreachable_removed(df: DataFrame, ids: Sequence[str], time: str, lat: str, lon: str, *, max_kmh: float = 250.0, stray_km: float = 100.0, rounds: int = 3, tie: str | None = None) -> DataFrame:
    """Fixes without segments whose mean strays from the longest segment's, or of one fix among several; repeated.

    Of equally long segments the earliest is home.
    """
    columns = df.columns
    for _ in range(rounds):
        d = segments(df, ids, time, lat, lon, max_kmh=max_kmh, tie=tie)
        per = d.groupBy(*ids, "segment").agg(F.avg(lat).alias("_la"), F.avg(lon).alias("_lo"), F.count("*").alias("_n"))
        home = per.groupBy(*ids).agg(F.max_by(F.struct("_la", "_lo"), F.struct("_n", -F.col("segment"))).alias("_home"), F.count("*").alias("_segments"))
        ok = (haversine_km(F.col("_home._la"), F.col("_home._lo"), F.col("_la"), F.col("_lo")) <= stray_km) & ((F.col("_n") > 1) | (F.col("_segments") == 1))
        df = d.join(per.join(home, list(ids)).where(ok).select(*ids, "segment"), [*ids, "segment"], "left_semi").select(*columns)
    return df


def midpoint_crossing(df: DataFrame, keys: Sequence[str], doy: str, lat: str) -> DataFrame:
    """First day at or beyond the middle of the latitude range after a day below it; null if none."""
    mid = df.groupBy(*keys).agg(((F.min(lat) + F.max(lat)) / 2).alias("_mid"))
    by = Window.partitionBy(*keys).orderBy(doy, lat).rowsBetween(Window.unboundedPreceding, -1)
    d = df.join(mid, list(keys)).withColumn("_was", F.max((F.col(lat) < F.col("_mid")).cast("int")).over(by))
    return d.groupBy(*keys).agg(F.min(F.when((F.col("_was") == 1) & (F.col(lat) >= F.col("_mid")), F.col(doy))).alias("crossing_doy"))


def daily_path(df: DataFrame, ids: Sequence[str], time: str, lat: str, lon: str, grid: float) -> DataFrame:
    """Median position of each individual's day, snapped."""
    out = df.groupBy(*ids, F.to_date(time).alias("day")).agg(F.median(lat).alias("lat"), F.median(lon).alias("lon"))
    return out.select(*ids, "day", snap(F.col("lat"), grid).alias("lat"), snap(F.col("lon"), grid).alias("lon"))


def lines(path: DataFrame, ids: Sequence[str], *, max_gap_days: int = 7) -> DataFrame:
    """Points of runs without longer gaps, without repeats of a cell; runs of one point are dropped."""
    by = Window.partitionBy(*ids).orderBy("day")
    d = path.withColumn("run", F.sum(F.coalesce(F.datediff("day", F.lag("day").over(by)) > max_gap_days, F.lit(False)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    own = Window.partitionBy(*ids, "run").orderBy("day")
    d = d.withColumn("_same", (F.lag("lat").over(own) == F.col("lat")) & (F.lag("lon").over(own) == F.col("lon"))).where(~F.coalesce("_same", F.lit(False)))
    return d.withColumn("_n", F.count("*").over(Window.partitionBy(*ids, "run"))).where("_n >= 2").drop("_n", "_same")


def anonymous_cells(df: DataFrame, cell: Sequence[str], individual: str, least: int = 3) -> DataFrame:
    """Rows of cells in which ``least`` individuals or more were ever seen."""
    kept = df.groupBy(*cell).agg(F.countDistinct(individual).alias("_k")).where(F.col("_k") >= least).select(*cell)
    return df.join(kept, list(cell), "left_semi")
