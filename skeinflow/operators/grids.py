"""Points and grids: nearest cells, samples at them, coverage of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def nearest_cells(points: DataFrame, cells: DataFrame, point: str, cell: str, *, reach: float, lon: str = "lon", lat: str = "lat", max_error_km: float | None = None) -> DataFrame:
    """(point, cell, error_km): the nearest cell within ``reach`` degrees of latitude and of longitude, ties to the smaller cell.

    Points and cells meet in squares of ``reach`` degrees and the eight around, so no
    pair beyond is made; points without a cell in reach have a null one. Points at one
    position are compared once, and of cells at one position only the smallest, so pairs
    grow with the positions in reach of each other and not with rows. Longitude is
    scaled by the cosine of the point's latitude; error is 111 km a degree. With
    ``max_error_km`` a farther cell or none raises.
    """
    square = lambda c: F.floor(F.col(c) / reach).cast("long")
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    p = points.select(F.col(point).alias("_p"), F.col(lon).alias("_x"), F.col(lat).alias("_y"))
    spots = p.where("_x is not null and _y is not null").select("_x", "_y").distinct()
    near = spots.withColumn("_i", F.explode(F.transform(steps, lambda k: square("_x") + k))).withColumn("_j", F.explode(F.transform(steps, lambda k: square("_y") + k)))
    own = cells.groupBy(F.col(lon).alias("_u"), F.col(lat).alias("_v")).agg(F.min(cell).alias("_c")).where("_c is not null").select("_c", "_u", "_v", square("_u").alias("_i"), square("_v").alias("_j"))
    apart = F.hypot((F.col("_u") - F.col("_x")) * F.cos(F.radians("_y")), F.col("_v") - F.col("_y"))
    best = near.join(own, ["_i", "_j"]).where((F.abs(F.col("_u") - F.col("_x")) <= reach) & (F.abs(F.col("_v") - F.col("_y")) <= reach))
    best = best.groupBy("_x", "_y").agg(F.min(F.struct(apart.alias("d"), F.col("_c").alias("c"))).alias("b"))
    # a point given at several positions has the best of them
    best = p.join(best, ["_x", "_y"]).groupBy("_p").agg(F.min("b").alias("b"))
    out = p.select("_p").join(best, "_p", "left").select(F.col("_p").alias(point), F.col("b.c").alias(cell), (F.col("b.d") * 111).alias("error_km"))
    if max_error_km is not None:
        out = out.withColumn("error_km", F.when(F.col("error_km") <= max_error_km, F.col("error_km")).otherwise(F.raise_error(F.concat(F.lit("no cell near "), F.col(point).cast("string")))))
    return out


def match_report(matches: DataFrame, cell: str) -> DataFrame:
    return matches.agg(F.count("*").alias("points"), F.countDistinct(cell).alias("cells"), F.median("error_km").alias("median_error_km"), F.max("error_km").alias("max_error_km"))


def sampled(grid: DataFrame, matches: DataFrame, point: str, cell: str) -> DataFrame:
    """Rows of a long grid table at the points' cells."""
    return matches.select(point, cell).join(grid, cell)


def cell_coverage(df: DataFrame, cell: Sequence[str], time: str, sensor: str) -> DataFrame:
    """Years, rows, sensors and span of each cell."""
    y = F.year(time)
    return df.groupBy(*cell).agg(F.countDistinct(y).alias("years"), F.count("*").alias("rows"), F.countDistinct(sensor).alias("sensors"), (F.max(y) - F.min(y) + 1).alias("span"))


def detectability(df: DataFrame, source: str, unit: str, cell: Sequence[str], year: str, ceilings: dict[str, int], steps: Sequence[tuple[int, int]]) -> DataFrame:
    """Status of each cell, the best of its sources.

    A source's status in a cell follows from the years of its best unit there, by
    ``steps`` (years, status) in ascending order, and is at most its ceiling.
    """
    years = df.groupBy(source, unit, *cell).agg(F.countDistinct(year).alias("y")).groupBy(source, *cell).agg(F.max("y").alias("y"))
    status = F.lit(0)
    for need, value in steps:
        status = F.when(F.col("y") >= need, F.lit(value)).otherwise(status)
    ceiling = F.lit(0)
    for name, value in ceilings.items():
        ceiling = F.when(F.col(source) == name, F.lit(value)).otherwise(ceiling)
    return years.groupBy(*cell).agg(F.max(F.least(status, ceiling)).alias("status"))
