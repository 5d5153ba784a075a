"""Layers to publish: stations with a value for each week, weekly presence of individuals, and their files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import flat_km, snap
from .passage import weekly_climatology, weekly_flow
from .tracks import anonymous_cells

#: Weeks of a year, animals behind a published cell and week, cells that weekly centres must move, km a degree.
WEEKS = 52
LEAST_ANIMALS = 3
VISIBLE_CELLS = 2
KM_PER_DEGREE = 111.32


def _tenths(c: str) -> Column:
    """To one place as other engines do: a value a hair below a tie goes up if ten times it is the tie."""
    return F.round(F.col(c) * 10) / 10


def _by_week(name: str, value: Column) -> Column:
    """Map from name and week to value, of the weeks that have one; in order of weeks."""
    held = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("week", value.alias("v")))))
    return F.map_from_entries(F.transform(held, lambda x: F.struct(F.concat(F.lit(name), x["week"].cast("string")), x["v"])))


def station_series(nights: DataFrame, site: str, lon: str, lat: str, time: str, value: str, *, direction: str | None = None, speed: str | None = None, grid: Column | float | None = None, cutoff: Column | None = None, annotations: DataFrame | None = None) -> DataFrame:
    """One row per site: site, lon, lat, values, vectors, weeks_present, peak, years, and the columns of annotations (site, ...).

    ``values``: w0 to w51, the weekly median pooled over years, to one place; a week
    without any is no key. ``vectors``: dw and sw, the bearing moved toward in whole
    degrees and the speed to one place, weighted by value. Rows after the cutoff are left
    out first; positions are snapped to the grid if there is one. A site has 52 weeks at
    most, so no map grows with the data. A site has the position of its earliest row.
    """
    d = nights if cutoff is None else nights.where(F.col(time) <= cutoff)
    place = F.min_by(F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat")), F.struct(time, lon, lat))
    sites = d.groupBy(site).agg(place.alias("_at"))
    at = lambda c: F.round(F.col(f"_at.{c}") if grid is None else snap(F.col(f"_at.{c}"), grid), 4)
    weekly = weekly_climatology(d, [site], time, value).groupBy(site).agg(_by_week("w", _tenths("value")).alias("values"), F.max("years").alias("years"))
    out = sites.select(site, at("lon").alias("lon"), at("lat").alias("lat")).join(weekly, site)
    none = F.create_map().cast("map<string,double>")
    if direction is not None and speed is not None:
        flow = weekly_flow(d, [site], time, direction, speed, value).groupBy(site).agg(F.map_concat(_by_week("dw", F.pmod(F.round("bearing"), F.lit(360.0))), _by_week("sw", _tenths("speed"))).alias("vectors"))
        out = out.join(flow, site, "left").withColumn("vectors", F.coalesce("vectors", none))
    else:
        out = out.withColumn("vectors", none)
    out = out.select(site, "lon", "lat", "values", "vectors", F.size("values").alias("weeks_present"), F.array_max(F.map_values("values")).alias("peak"), "years")
    return out if annotations is None else out.join(annotations, site, "left")


def position_label(lat: Column, lon: Column) -> Column:
    """A position in words: degrees with hemisphere letters."""
    part = lambda x, plus, minus: F.concat(F.round(F.abs(x), 2).cast("string"), F.lit("\N{DEGREE SIGN}"), F.when(x >= 0, plus).otherwise(minus))
    return F.concat_ws(" ", part(lat, "N", "S"), part(lon, "E", "W"))


def seasonal_throw(df: DataFrame, keys: Sequence[str], week: str, lat: str, lon: str) -> DataFrame:
    """(keys, throw_km): the largest distance between two of the weekly mean positions; 0 if there is one only."""
    centres = df.groupBy(*keys, week).agg(F.avg(lat).alias("_la"), F.avg(lon).alias("_lo"))
    # at most one centre a week in each array
    held = centres.groupBy(*keys).agg(F.collect_list(F.struct("_la", "_lo")).alias("_c"))
    one = held.select(*keys, "_c", F.explode("_c").alias("_a"))
    far = F.array_max(F.transform("_c", lambda b: flat_km(F.col("_a._la"), F.col("_a._lo"), b["_la"], b["_lo"])))
    return one.groupBy(*keys).agg(F.max(far).alias("throw_km"))


def presence(fixes: DataFrame, individual: str, time: str, lat: str, lon: str, *, cell_deg: float, floor_deg: float | None = None, cutoff: Column | None = None, least: int = LEAST_ANIMALS) -> DataFrame:
    """Rows of ``station_series`` for cells: how many animals are in each, week by week, without saying which.

    A cell and week stays if ``least`` animals or more were ever in it, over the whole
    record. The job fails if the cell is finer than the floor that the gate gave, and
    where the weekly centres of what stays do not move by more than ``VISIBLE_CELLS``
    cells, as a still cloud shows no journey; if nothing stays, there are no rows.
    """
    if floor_deg is not None and cell_deg < floor_deg:
        raise ValueError(f"cells of {cell_deg} degrees are finer than the floor of {floor_deg}")
    week = F.least(F.floor((F.dayofyear(time) - 1) / 7), F.lit(WEEKS - 1)).cast("int")
    d = fixes if cutoff is None else fixes.where(F.col(time) <= cutoff)
    weekly = d.select(F.col(individual).alias("animal"), F.year(time).alias("year"), week.alias("week"), snap(F.col(lat), cell_deg).alias("cell_lat"), snap(F.col(lon), cell_deg).alias("cell_lon")).distinct()
    kept = anonymous_cells(weekly, ["cell_lat", "cell_lon", "week"], "animal", least)
    # centres are of fixes, each cell as often as it has them
    all_fixes = d.select(week.alias("week"), snap(F.col(lat), cell_deg).alias("cell_lat"), snap(F.col(lon), cell_deg).alias("cell_lon"))
    seen = all_fixes.join(kept.select("cell_lat", "cell_lon", "week").distinct(), ["cell_lat", "cell_lon", "week"], "left_semi")
    throw = seasonal_throw(seen, [], "week", "cell_lat", "cell_lon")
    bar = VISIBLE_CELLS * cell_deg * KM_PER_DEGREE
    still = F.raise_error(F.concat(F.lit("weekly centres move by "), F.round("throw_km", 1).cast("string"), F.lit(f" km, not by more than {bar:.1f}"))).cast("double")
    yearly = kept.groupBy("cell_lat", "cell_lon", "year", "week").agg(F.count("*").cast("double").alias("animals"))
    guarded = yearly.crossJoin(F.broadcast(throw)).withColumn("animals", F.when(F.col("throw_km") > bar, F.col("animals")).otherwise(still))
    start = F.make_timestamp_ntz(F.col("year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(F.col("week") * 7)
    rows = guarded.select(position_label(F.col("cell_lat"), F.col("cell_lon")).alias("site"), start.alias("time"), "animals", "cell_lat", "cell_lon")
    return station_series(rows, "site", "cell_lon", "cell_lat", "time", "animals")


def features(series: DataFrame, site: str) -> DataFrame:
    """(feature): each row of a series as a line of JSON, a point with its properties; weeks are properties of their own, absent ones are absent."""
    more = [c for c in series.columns if c not in (site, "lon", "lat", "values", "vectors")]
    inner = lambda text: F.substring(text, F.lit(2), F.length(text) - 2)
    fixed = inner(F.to_json(F.struct(F.col(site).alias("station"), *more)))
    weeks = inner(F.to_json(F.map_concat("values", "vectors")))
    properties = F.concat(F.lit("{"), F.concat_ws(",", fixed, F.nullif(weeks, F.lit(""))), F.lit("}"))
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    return series.select(F.concat(F.lit('{"type":"Feature","geometry":'), point, F.lit(',"properties":'), properties, F.lit("}")).alias("feature"))


def write_shards(df: DataFrame, key: str, path: str, *, shards: int = 64) -> None:
    """JSON lines in folders shard=0 to shards - 1, a row's shard being its key modulo shards; keys ascend within a file."""
    d = df.withColumn("shard", F.pmod(F.col(key), F.lit(shards)).cast("int"))
    d.repartitionByRange("shard", key).sortWithinPartitions("shard", key).write.mode("overwrite").partitionBy("shard").json(path)


def terms(source: Column, evidence: Column, sensitivity: Column, generalisation: Column, rows: Column) -> Column:
    """What goes beside every layer: where it is from and what was done to it."""
    return F.to_json(F.struct(source.alias("source_id"), evidence.alias("evidence_type"), sensitivity.alias("sensitivity"), generalisation.alias("dataGeneralizations"), rows.alias("rows")))
