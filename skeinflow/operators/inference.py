"""Rank and spatial statistics as grouped aggregations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.lineage import cut


def value_ranks(counts: DataFrame, keys: Sequence[str], value: str, count: str = "n") -> DataFrame:
    """counts (keys, value, n; a row for each value of a key) with before, total and rank.

    ``before``: rows of the key with smaller values; ``total``: its rows; ``rank``: the
    average rank of the value's rows. Values are dealt into ranges, summed within them
    and shifted by the sums of the ranges before, so no task holds a whole key.
    """
    order = [*keys, value]
    d = cut(counts.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    # as many rows as there are ranges
    whole = d.groupBy("_range").agg(F.sum(count).alias("_in"))
    shift = whole.select("_range", (F.sum("_in").over(Window.orderBy("_range")) - F.col("_in")).alias("_shift"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(F.broadcast(shift), "_range").withColumn("_below", F.col("_shift") + F.sum(count).over(within) - F.col(count))
    if keys:
        # keys may be few: a key's sums go to each of its ranges, as a join by key alone would gather the key
        own = Window.partitionBy(*[f"_{k}" for k in keys])
        parts = d.groupBy(F.col("_range").alias("_part"), *[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("_below").alias("_first"), F.sum(count).alias("_in"))
        starts = parts.select("_part", *[f"_{k}" for k in keys], F.min("_first").over(own).alias("_start"), F.sum("_in").over(own).alias("total"))
        d = d.join(starts, [F.col("_range") == F.col("_part"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]]).drop("_part", *[f"_{k}" for k in keys])
    else:
        d = d.crossJoin(F.broadcast(d.agg(F.lit(0).alias("_start"), F.sum(count).alias("total"))))
    d = d.withColumn("before", F.col("_below") - F.col("_start"))
    return d.withColumn("rank", F.col("before") + (F.col(count) + 1) / 2).drop("_range", "_shift", "_below", "_start")


def quantiles(counts: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], count: str = "n") -> DataFrame:
    """(keys, total, q1, q2, ...): exact quantiles, interpolated between neighbours, from counts as in ``value_ranks``."""
    d = value_ranks(counts, keys, value, count)
    out = [F.max("total").alias("total")]
    for i, q in enumerate(probs, 1):
        place = (F.col("total") - 1) * q
        at = lambda p: F.max(F.when((F.col("before") <= p) & (p < F.col("before") + F.col(count)), F.col(value)))
        part = F.max(place - F.floor(place))
        out.append((at(F.floor(place)) * (1 - part) + at(F.ceil(place)) * part).alias(f"q{i}"))
    return d.groupBy(*keys).agg(*out)


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation and the p of its t statistic by the normal distribution; 0 and 1 if one side is constant."""
    pairs = df.dropna(subset=[x, y]).groupBy(*keys, x, y).agg(F.count("*").alias("w"))
    side = lambda c, r: value_ranks(pairs.groupBy(*keys, c).agg(F.sum("w").alias("n")), keys, c).select(*keys, c, F.col("rank").alias(r))
    d = pairs.join(side(x, "_rx"), [*keys, x]).join(side(y, "_ry"), [*keys, y])
    mean = lambda e: F.sum(F.col("w") * e) / F.sum("w")
    rx, ry = F.col("_rx"), F.col("_ry")
    s = d.groupBy(*keys).agg(F.sum("w").alias("n"), (mean(rx * ry) - mean(rx) * mean(ry)).alias("xy"), (mean(rx * rx) - mean(rx) * mean(rx)).alias("xx"), (mean(ry * ry) - mean(ry) * mean(ry)).alias("yy"), F.min("_rx").alias("x1"), F.max("_rx").alias("x2"), F.min("_ry").alias("y1"), F.max("_ry").alias("y2"))
    flat = (F.col("x1") == F.col("x2")) | (F.col("y1") == F.col("y2"))
    rho = F.when(flat, F.lit(0.0)).otherwise(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
    return s.select(*keys, "n", rho.alias("rho"), flat.alias("_flat")).withColumn("p", F.when(F.col("_flat") | (F.col("n") < 3), 1.0).when(F.abs("rho") >= 1, 0.0).otherwise(two_sided(t))).drop("_flat")


#: Chebyshev coefficients of the complementary error function, good to 1.2e-7 of its value.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided(z: Column) -> Column:
    """The chance that a standard normal value lies at least as far out as z."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + x / 2)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def pairwise_rank_tests(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group_a, group_b, n_a, n_b, u, p, p_adjusted) for each two groups: the rank sum test, stepped down over all pairs.

    p is that of the normal approximation with corrections for ties and continuity; the
    r-th smallest of m (from 0) is multiplied by m - r, 1 at most. Rows are counted by
    group and value first, then ranked within each pair in ranges. Groups are few, as
    their pairs are the result.
    """
    counts = df.dropna(subset=[group, value]).groupBy(group, value).agg(F.count("*").alias("n"))
    names = counts.select(F.col(group).alias("g")).distinct()
    pairs = names.select(F.col("g").alias("group_a")).join(names.select(F.col("g").alias("group_b")), F.col("group_a") < F.col("group_b"))
    sides = pairs.select("group_a", "group_b", F.explode(F.array("group_a", "group_b")).alias(group))
    # the counts stay where they are; as the broadcast side they would all meet the pairs in one task
    own = counts.join(F.broadcast(sides), group)
    both = own.groupBy("group_a", "group_b", value).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(group) == F.col("group_a"), F.col("n")).otherwise(0)).alias("n1"))
    ranked = value_ranks(both, ["group_a", "group_b"], value)
    t = F.col("n").cast("double")
    s = ranked.groupBy("group_a", "group_b").agg(F.max("total").cast("double").alias("total"), F.sum("n1").cast("double").alias("a"), F.sum(F.col("n1") * F.col("rank")).alias("w"), F.sum(t * t * t - t).alias("ties"))
    b = F.col("total") - F.col("a")
    u = F.col("w") - F.col("a") * (F.col("a") + 1) / 2
    spread = F.sqrt(F.col("a") * b / 12 * ((F.col("total") + 1) - F.col("ties") / (F.col("total") * (F.col("total") - 1))))
    z = F.greatest(F.abs(u - F.col("a") * b / 2) - 0.5, F.lit(0.0)) / spread
    d = s.select("group_a", "group_b", F.col("a").cast("bigint").alias("n_a"), b.cast("bigint").alias("n_b"), u.alias("u"), F.when(spread > 0, F.least(two_sided(z), F.lit(1.0))).otherwise(1.0).alias("p"))
    order = Window.orderBy("p", "group_a", "group_b")
    step = F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1
    return d.withColumn("p_adjusted", F.least(F.col("p") * step, F.lit(1.0)))


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from the digest of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 4294967296.0


#: How likely it is that a Poisson number of mean 1 is at most 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


#: Fixed value: blocks of values in which the drawn rows of a group are counted.
BLOCKS = 64


def _drawn_medians(rows: DataFrame, group: str, draws: int, seed: int) -> DataFrame:
    """(group, draw, median) of rows (group, _v, _id), each as often in a draw as a Poisson number of mean 1."""
    # limits may be rough, as they only say which rows are counted together; -0.0 is 0.0
    limits = rows.groupBy(F.col(group).alias("_g")).agg(F.array_distinct(F.percentile_approx("_v", [i / BLOCKS for i in range(1, BLOCKS)])).alias("_limits"))
    d = rows.join(F.broadcast(limits), F.col(group) == F.col("_g")).select(group, "_v", "_id", F.size(F.filter("_limits", lambda x: x <= F.col("_v"))).alias("_block"))
    d = cut(d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    digest = F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.col("draw").cast("string"), F.col("_id").cast("string")))
    # u >= p is a comparison of eight hex digits, as u is their number over 2^32
    times = F.lit(0)
    for i, p in reversed(list(enumerate(POISSON))):
        times = F.when(F.col("_digest") < f"{math.ceil(p * 2**32):08x}", i).otherwise(times if i < len(POISSON) - 1 else len(POISSON))
    drawn = lambda x: x.withColumn("_digest", digest).withColumn("n", times)
    sums = drawn(d.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))).groupBy(group, "draw", "_block").agg(F.sum("n").alias("n")).where("n > 0")
    upto = Window.partitionBy(group, "draw")
    place = (F.col("_all") - 1) * 0.5
    sums = sums.withColumns({"_before": F.sum("n").over(upto.orderBy("_block")) - F.col("n"), "_all": F.sum("n").over(upto)}).withColumns({"_lo": F.floor(place), "_hi": F.ceil(place)})
    # a draw has one block here, or two
    held = cut(sums.where((F.col("_before") <= F.col("_hi")) & (F.col("_before") + F.col("n") > F.col("_lo"))))
    asked = held.groupBy(group, "_block").agg(F.collect_list("draw").alias("_draws"))
    again = drawn(d.join(F.broadcast(asked), [group, "_block"]).withColumn("draw", F.explode("_draws"))).groupBy(group, "draw", "_v").agg(F.sum("n").alias("n")).where("n > 0")
    ranked = value_ranks(again, [group, "draw"], "_v").join(F.broadcast(held.groupBy(group, "draw").agg(F.min("_before").alias("_start"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))), [group, "draw"])
    start = F.col("_start") + F.col("before")
    at = lambda p: F.max(F.when((start <= F.col(p)) & (F.col(p) < start + F.col("n")), F.col("_v")))
    return ranked.groupBy(group, "draw").agg(((at("_lo") + at("_hi")) / 2).alias("median"))


def held_out_groups(df: DataFrame, group: str, value: str, row_id: str, *, draws: int = 200, seed: int = 0) -> DataFrame:
    """(group, n, actual, predicted, error, iqr_ratio, coverage, median_se): each group's median beside that of all other rows.

    ``iqr_ratio``: the others' interquartile range over its own; ``coverage``: its share
    between the others' quartiles; ``median_se``: spread of its median over draws in which
    each row counts as often as a Poisson number of mean 1 made from the digest of seed,
    draw and row_id says, so no group is gathered to be drawn from. Quantiles are exact:
    drawn rows are first only counted by draw and block of values, and then taken again
    from the blocks in which a draw's median lies.
    """
    d = df.dropna(subset=[group, value])
    counts = d.groupBy(group, value).agg(F.count("*").alias("n"))
    names = counts.select(group).distinct()
    rest = counts.join(F.broadcast(names.select(F.col(group).alias("held"))), F.col("held") != F.col(group)).groupBy("held", value).agg(F.sum("n").alias("n"))
    own = quantiles(counts, [group], value, (0.25, 0.5, 0.75)).toDF(group, "n", "a1", "actual", "a3")
    other = quantiles(rest, ["held"], value, (0.25, 0.5, 0.75)).toDF(group, "others", "low", "predicted", "high")
    inside = counts.join(F.broadcast(other), group).groupBy(group).agg((F.sum(F.when(F.col(value).between(F.col("low"), F.col("high")), F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"))
    spread = _drawn_medians(d.select(group, F.col(value).alias("_v"), F.col(row_id).alias("_id")), group, draws, seed).groupBy(group).agg(F.stddev_samp("median").alias("median_se"))
    out = own.join(other, group).join(inside, group).join(spread, group)
    return out.select(group, "n", "actual", "predicted", F.abs(F.col("predicted") - F.col("actual")).alias("error"), F.try_divide(F.col("high") - F.col("low"), F.col("a3") - F.col("a1")).alias("iqr_ratio"), "coverage", "median_se")


def queen_edges(cells: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, row2, col2, weight) of touching cells; a cell's weights add to 1."""
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    own = cells.select(F.col(row).alias("r"), F.col(col).alias("c")).distinct()
    near = own.withColumn("o", F.explode(offsets)).select("r", "c", (F.col("r") + F.col("o.a")).alias("r2"), (F.col("c") + F.col("o.b")).alias("c2"))
    edges = near.join(own.select(F.col("r").alias("r2"), F.col("c").alias("c2")), ["r2", "c2"])
    return edges.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy("r", "c"))).select("r", "c", "r2", "c2", "weight")


def morans_i(cells: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Moran's I over queen neighbours with row-standardised weights; cells without neighbours count with weight 0."""
    z = cells.select(F.col(row).alias("r"), F.col(col).alias("c"), F.col(value).alias("v"))
    z = z.crossJoin(F.broadcast(z.agg(F.avg("v").alias("m")))).select("r", "c", (F.col("v") - F.col("m")).alias("z"))
    edges = queen_edges(z, "r", "c").join(z, ["r", "c"]).join(z.select(F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("z").alias("z2")), ["r2", "c2"])
    top = edges.agg(F.sum(F.col("z") * F.col("weight") * F.col("z2")).alias("top"), F.sum("weight").alias("w"))
    return top.crossJoin(z.agg(F.sum(F.col("z") * F.col("z")).alias("bottom"), F.count("*").alias("n"))).select("n", (F.col("n") / F.col("w") * F.col("top") / F.col("bottom")).alias("morans_i"))


def moran_permutations(cells: DataFrame, row: str, col: str, value: str, *, draws: int = 999, seed: int = 0) -> DataFrame:
    """(n, morans_i, p, null_mean, null_high): Moran's I, and how often values dealt anew to the cells reach it.

    p is one-sided and counts the observed value as one draw. A draw orders the cells by
    the digest of seed, draw and cell; the k-th of it gives its value to the k-th of draw
    0. Each cell gathers an array of one value for each draw, so the neighbours are
    joined once for all draws.
    """
    z = cells.where(F.col(value).isNotNull()).select(F.col(row).alias("r"), F.col(col).alias("c"), F.col(value).cast("double").alias("v"))
    z = z.crossJoin(F.broadcast(z.agg(F.avg("v").alias("m")))).select("r", "c", (F.col("v") - F.col("m")).alias("z"))
    many = z.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    key = F.md5(F.concat_ws("-", F.lit(seed).cast("string"), *[F.col(x).cast("string") for x in ("draw", "r", "c")]))
    placed = many.withColumn("k", F.row_number().over(Window.partitionBy("draw").orderBy(key, "r", "c")))
    # the observed values come first
    dealt = placed.groupBy("k").agg(F.max(F.when(F.col("draw") == 0, F.struct("r", "c", "z"))).alias("own"), F.array_sort(F.collect_list(F.when(F.col("draw") > 0, F.struct("draw", "z")))).alias("others"))
    nodes = cut(dealt.select("own.r", "own.c", F.concat(F.array("own.z"), F.transform("others", lambda x: x["z"])).alias("zs")))
    edges = queen_edges(nodes, "r", "c")
    near = edges.join(nodes.select(F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("zs").alias("near")), ["r2", "c2"]).join(nodes, ["r", "c"])
    each = near.select("weight", F.posexplode(F.zip_with("zs", "near", lambda a, b: a * b)).alias("draw", "product"))
    sums = each.groupBy("draw").agg(F.sum(F.col("weight") * F.col("product")).alias("top"), F.sum("weight").alias("w"))
    bottom = z.agg(F.sum(F.col("z") * F.col("z")).alias("bottom"), F.count("*").alias("n"))
    found = sums.crossJoin(F.broadcast(bottom)).withColumn("i", F.coalesce(F.try_divide(F.col("n") / F.col("w") * F.col("top"), F.col("bottom")), F.lit(0.0)))
    seen = found.where("draw = 0").select("n", F.col("i").alias("morans_i"))
    null = found.where("draw > 0").crossJoin(F.broadcast(seen.select("morans_i"))).agg(((F.count_if(F.col("i") >= F.col("morans_i")) + 1) / (F.count("*") + 1)).alias("p"), F.avg("i").alias("null_mean"), F.percentile("i", 0.95).alias("null_high"))
    return seen.crossJoin(null)


#: When a surface may be drawn.
MAX_MEDIAN_DRIFT = 1.5
MAX_MODEL_GAP = 1.0
STRUCTURE_ALPHA = 0.05
MAX_EFFORT_RHO = 0.3
MAX_DROP_SHARE = 0.1


def grade_surface(changes: DataFrame, row: str, col: str, *, draws: int = 999, seed: int = 0) -> DataFrame:
    """One row with the measures of a surface of changes, each stop condition, and whether it may be drawn.

    changes: row, col, delta, delta_detected (the uncorrected change), effort (change of
    cards), steady (enough taxa moved). Null deltas are left out.
    """
    d = changes.where("delta is not null")
    own = d.agg(F.count("*").alias("cells"), F.median("delta").alias("median_delta"), F.median(F.abs(F.col("delta") - F.col("delta_detected"))).alias("median_gap"), F.count_if(~F.coalesce("steady", F.lit(False))).alias("dropped"))
    moran = moran_permutations(d, row, col, "delta", draws=draws, seed=seed).select("morans_i", F.col("p").alias("morans_p"))
    effort = spearman(d.withColumn("size", F.abs("delta")), [], "size", "effort").select(F.col("rho").alias("effort_rho"), F.col("p").alias("effort_p"))
    out = own.crossJoin(moran).crossJoin(effort)
    out = out.withColumns({
        "drift_ok": F.abs("median_delta") <= MAX_MEDIAN_DRIFT,
        "model_ok": F.col("median_gap") <= MAX_MODEL_GAP,
        "structure_ok": (F.col("morans_i") > 0) & (F.col("morans_p") < STRUCTURE_ALPHA),
        "effort_ok": F.abs("effort_rho") < MAX_EFFORT_RHO,
        "drop_ok": F.col("dropped") <= MAX_DROP_SHARE * F.col("cells"),
    })
    return out.withColumn("publishable", F.col("drift_ok") & F.col("model_ok") & F.col("structure_ok") & F.col("effort_ok") & F.col("drop_ok"))


def drawable(changes: DataFrame, grade: DataFrame) -> DataFrame:
    """Steady cells of a surface that may be drawn, none of one that may not."""
    return changes.where("steady").crossJoin(F.broadcast(grade.where("publishable").select("publishable"))).drop("publishable")


def torus_draws(cells: DataFrame, row: str, col: str, draws: int, seed: int) -> DataFrame:
    """(draw, dy, dx, height, width): shifts of the cells' frame, by digests of seed and draw, none by 0."""
    frame = cells.agg((F.max(row) - F.min(row) + 1).alias("height"), (F.max(col) - F.min(col) + 1).alias("width"), F.min(row).alias("top"), F.min(col).alias("edge"))
    shift = lambda axis, size: 1 + F.floor(_unit(F.lit(seed), F.col("draw"), F.lit(axis)) * F.greatest(F.col(size) - 1, F.lit(1))).cast("bigint")
    return frame.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).select("draw", shift("y", "height").alias("dy"), shift("x", "width").alias("dx"), "height", "width", "top", "edge")


def toroidal_null(cells: DataFrame, row: str, col: str, response: str, covariate: str, given: str, *, draws: int = 999, least_cells: int = 3, seed: int = 0) -> DataFrame:
    """(cells, slope, partial_r, p, mean_cells): the slope of response on covariate given a third column, and how often the covariate's sheet, rolled over the footprint, gives one as large.

    A draw moves the whole sheet by one shift with wrap-around, so all its spatial
    structure stays; a cell whose source is no cell drops from that draw; a draw of
    fewer than least_cells counts as not extreme. p counts the observed fit as a draw.
    """
    own = cells.dropna(subset=[row, col, response, covariate, given]).select(F.col(row).cast("bigint").alias("r"), F.col(col).cast("bigint").alias("c"), F.col(response).cast("double").alias("y"), F.col(covariate).cast("double").alias("x"), F.col(given).cast("double").alias("g"))
    seen = partial_slope(own, [], "y", "x", "g").select(F.col("n").alias("cells"), "slope", "partial_r")
    shifts = torus_draws(own, "r", "c", draws, seed)
    back = lambda at, shift, least, size: F.col(least) + F.pmod(F.col(at) - F.col(least) - F.col(shift), F.col(size))
    every = shifts.agg(F.collect_list(F.struct(*shifts.columns)).alias("shifts"))
    rolled = own.crossJoin(F.broadcast(every)).select("r", "c", "y", "g", F.explode("shifts").alias("s")).select("r", "c", "y", "g", "s.*").select("draw", "y", "g", back("r", "dy", "top", "height").alias("r"), back("c", "dx", "edge", "width").alias("c"))
    drawn = rolled.join(own.select("r", "c", "x"), ["r", "c"])
    used = drawn.groupBy("draw").agg(F.count("*").alias("used"))
    fits = partial_slope(drawn, ["draw"], "y", "x", "g").where(F.col("n") >= least_cells).select("draw", F.col("slope").alias("drawn"))
    each = shifts.select("draw").join(used, "draw", "left").join(fits, "draw", "left").crossJoin(F.broadcast(seen.select("slope")))
    null = each.agg(((F.count_if(F.abs("drawn") >= F.abs("slope")) + 1) / (F.count("*") + 1)).alias("p"), F.avg(F.coalesce("used", F.lit(0))).alias("mean_cells"))
    return seen.crossJoin(null)


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """H with tie correction, over all groups; rows are counted by group and value before they are ranked."""
    counts = df.dropna(subset=[group, value]).groupBy(group, value).agg(F.count("*").alias("k"))
    ranks = value_ranks(counts.groupBy(value).agg(F.sum("k").alias("n")), [], value)
    per = counts.join(ranks.select(value, "rank"), value).groupBy(group).agg(F.sum(F.col("k") * F.col("rank")).alias("s"), F.sum("k").cast("double").alias("k"))
    t = F.col("n").cast("double")
    ties = ranks.agg(F.sum(t * t * t - t).alias("ties"))
    total = per.agg(F.sum(F.col("s") * F.col("s") / F.col("k")).alias("q"), F.sum("k").alias("n"), F.count("*").alias("groups"))
    h = (12 / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)) / (1 - F.col("ties") / (F.col("n") * F.col("n") * F.col("n") - F.col("n")))
    return total.crossJoin(ties).select(F.col("n").cast("bigint").alias("n"), "groups", h.alias("h"))


def partial_slope(df: DataFrame, keys: Sequence[str], y: str, x: str, given: str) -> DataFrame:
    """Slope and correlation of y on x, given a third column."""
    d = df.dropna(subset=[y, x, given])
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), *[F.covar_pop(a, b).alias(n) for n, a, b in (("xx", x, x), ("gg", given, given), ("xg", x, given), ("xy", x, y), ("gy", given, y))], F.corr(x, y).alias("rxy"), F.corr(x, given).alias("rxg"), F.corr(y, given).alias("ryg"))
    det = F.col("xx") * F.col("gg") - F.col("xg") * F.col("xg")
    return s.where(det > 0).select(*keys, "n", ((F.col("gg") * F.col("xy") - F.col("xg") * F.col("gy")) / det).alias("slope"), F.try_divide(F.col("rxy") - F.col("rxg") * F.col("ryg"), F.sqrt((1 - F.col("rxg") ** 2) * (1 - F.col("ryg") ** 2))).alias("partial_r"))


def staged_fraction(df: DataFrame, station: str, year: str, value: str, experiment: str, model: str, member: str, treated: str, control: str) -> DataFrame:
    """Ensemble fraction (treated - control) / treated of slopes: stations, then members, then models are averaged."""
    s = df.groupBy(station, experiment, model, member).agg(F.try_divide(F.covar_samp(year, value), F.var_samp(year)).alias("b")).where("b is not null")
    m = s.groupBy(experiment, model, member).agg(F.avg("b").alias("b")).groupBy(experiment, model).agg(F.avg("b").alias("b"))
    wide = m.groupBy(model).pivot(experiment, [treated, control]).agg(F.first("b")).dropna()
    return wide.agg(F.count("*").alias("models"), F.avg(treated).alias("treated"), F.avg(control).alias("control")).withColumn("fraction", F.try_divide(F.col("treated") - F.col("control"), F.col("treated")))
