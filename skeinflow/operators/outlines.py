"""Lines reduced to the points that matter, and surfaces packed as grid indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.lineage import cut

#: Fixed value: how far from a cell's centre a position may lie, in cells.
CENTRE_TOLERANCE = 1e-6


def _off_chord(a: Column, b: Column, lat: Column, lon: Column) -> Column:
    """Distance of a point from the line through a and b (lat, lon), or from a where both are one place."""
    dy, dx = b["lat"] - a["lat"], b["lon"] - a["lon"]
    length = F.sqrt(dy * dy + dx * dx)
    ey, ex = lat - a["lat"], lon - a["lon"]
    return F.when(length == 0, F.sqrt(ey * ey + ex * ex)).otherwise(F.abs(dx * ey - ex * dy) / length)


def simplify(points: DataFrame, ids: Sequence[str], place: str, lat: str, lon: str, tolerance: float) -> DataFrame:
    """The rows of points whose removal would move their line by more than tolerance.

    Points of a line (ids) are ordered by place, which has no ties in a line. A chord
    from first to last point is split at the point farthest from it (of equally far
    ones the first) while that is farther than tolerance. All open chords of all lines
    are split in one round; only points inside open chords go to the next, chords pick
    their farthest point by partial maxima, so a long line gathers nowhere, and lineage
    is cut between rounds. Rounds are about the logarithm of a line's bends; a line of
    one or two points stays as it is.
    """
    keys = list(ids)
    at = lambda: F.struct(F.col(place).alias("place"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    ends = points.groupBy(*keys).agg(F.min_by(at(), place).alias("a"), F.max_by(at(), place).alias("b"))
    kept = ends.select(*keys, F.explode(F.array_distinct(F.array("a.place", "b.place"))).alias(place))
    inside = points.select(*keys, at().alias("p")).join(ends, keys).where("p.place > a.place and p.place < b.place")
    open_points, parts = cut(inside), [kept]
    while True:
        off = _off_chord(F.col("a"), F.col("b"), F.col("p.lat"), F.col("p.lon"))
        far = open_points.withColumn("off", off).groupBy(*keys, F.col("a.place").alias("from")).agg(F.max("off").alias("off"), F.max_by("p", F.struct("off", -F.col("p.place"))).alias("m"))
        splits = cut(far.where(F.col("off") > tolerance).select(*keys, "from", "m"))
        if splits.isEmpty():
            break
        parts.append(splits.select(*keys, F.col("m.place").alias(place)))
        halves = open_points.withColumn("from", F.col("a.place")).join(splits, [*keys, "from"]).where("p.place <> m.place")
        first = F.col("p.place") < F.col("m.place")
        open_points = cut(halves.select(*keys, "p", F.when(first, F.col("a")).otherwise(F.col("m")).alias("a"), F.when(first, F.col("m")).otherwise(F.col("b")).alias("b")))
    for more in parts[1:]:
        kept = kept.unionByName(more)
    return points.join(kept, [*keys, place], "left_semi")


def _index(value: Column, origin: float, grid: float) -> Column:
    return F.floor((value + origin) / grid)


def centre_offset(lon: Column, lat: Column, grid: float) -> Column:
    """How far a position lies from the centre of its cell, in cells, on the worse axis."""
    off = lambda value, origin: F.abs(F.pmod((value + origin) / grid, F.lit(1.0)) - 0.5)
    return F.greatest(off(lon, 180.0), off(lat, 90.0))


def off_grid_report(cells: DataFrame, keys: Sequence[str], lon: str, lat: str, grid: float) -> DataFrame:
    """(keys, worst, off_grid, n): the largest offset from a cell's centre, and how many positions lie off; a null position lies off."""
    placed = F.col(lon).isNotNull() & F.col(lat).isNotNull()
    return cells.select(*keys, F.when(placed, centre_offset(F.col(lon), F.col(lat), grid)).alias("off")).groupBy(*keys).agg(F.max("off").alias("worst"), F.count_if(F.coalesce(F.col("off") > CENTRE_TOLERANCE, F.lit(True))).alias("off_grid"), F.count("*").alias("n"))


def pack_grid(cells: DataFrame, keys: Sequence[str], lon: str, lat: str, value: str, grid: float, *, tile: int = 512) -> DataFrame:
    """(keys, tile_x, tile_y, x, y, v): cells as arrays of integer indices from the south-west corner, with their values.

    A row holds the cells of one tile of ``tile`` by ``tile``, so no array grows with the
    data; x and y count within the tile, ordered by y, then x. A position that is not the
    centre of its cell would be moved by its index: the job that packs it fails. Null
    positions fail too; null values stay in their place.
    """
    placed = F.col(lon).isNotNull() & F.col(lat).isNotNull()
    off = F.when(placed, centre_offset(F.col(lon), F.col(lat), grid)).otherwise(F.lit(1.0))
    worst = F.concat(F.lit("off the grid of "), F.lit(str(grid)), F.lit(" degrees: "), F.col(lon).cast("string"), F.lit(", "), F.col(lat).cast("string"))
    refused = F.raise_error(F.coalesce(worst, F.lit("no position"))).cast("bigint")
    d = cells.select(*keys, F.when(off <= CENTRE_TOLERANCE, _index(F.col(lon), 180.0, grid)).otherwise(refused).alias("x"), _index(F.col(lat), 90.0, grid).alias("y"), F.col(value).alias("v"))
    d = d.select(*keys, F.floor(F.col("x") / tile).cast("int").alias("tile_x"), F.floor(F.col("y") / tile).cast("int").alias("tile_y"), F.struct((F.col("y") % tile).cast("int").alias("y"), (F.col("x") % tile).cast("int").alias("x"), "v").alias("cell"))
    packed = d.groupBy(*keys, "tile_x", "tile_y").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return packed.select(*keys, "tile_x", "tile_y", *[F.col(f"cells.{c}").alias(c) for c in ("x", "y", "v")])


def unpack_grid(packed: DataFrame, keys: Sequence[str], grid: float, *, tile: int = 512) -> DataFrame:
    """(keys, lon, lat, value) of packed cells: their centres."""
    each = packed.select(*keys, "tile_x", "tile_y", F.explode(F.arrays_zip("x", "y", "v")).alias("c"))
    centre = lambda tile_of, index, origin: (F.col(tile_of) * tile + F.col(index) + 0.5) * grid - origin
    return each.select(*keys, centre("tile_x", "c.x", 180.0).alias("lon"), centre("tile_y", "c.y", 90.0).alias("lat"), F.col("c.v").alias("value"))
