"""Cards of an atlas: reporting rates, pooled effort, and occupancy under imperfect detection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def reporting_rates(df: DataFrame, cell: Sequence[str], card: str, species: str, *, parts: int | None = None) -> DataFrame:
    """Distinct cards with the species and distinct cards in all, per cell; never their ratio.

    With ``parts`` rows are dealt by cell into so many partitions and put in order by
    card, once for both counts, which suits cells that are many and small; without,
    they are counted where they lie first.
    """
    d = df.select(*cell, species, card)
    if parts is None:
        once = d.distinct()  # a card counts once for each species
        seen = once.groupBy(*cell, species).agg(F.count(card).alias("cards_with"))
        return seen.join(once.groupBy(*cell).agg(F.countDistinct(card).alias("cards")), list(cell))
    for c in cell:
        d = d.where(F.col(c).isNotNull())
    by_card = Window.partitionBy(*cell, card).orderBy(species)
    d = d.repartition(parts, *cell).select("*", F.row_number().over(by_card).alias("_place"), F.lag(species).over(by_card).alias("_before"))
    # a card counts once for each species, and in all where its first species stands
    first = F.col(card).isNotNull() & (F.col("_place") == 1)
    new = F.col(card).isNotNull() & ((F.col("_place") == 1) | ~F.col(species).eqNullSafe(F.col("_before")))
    seen = d.groupBy(*cell, species).agg(F.count_if(new).alias("cards_with"), F.count_if(first).alias("_first"))
    return seen.select(*cell, species, "cards_with", F.sum("_first").over(Window.partitionBy(*cell)).alias("cards"))


def pooled_effort(rates: DataFrame, period: Sequence[str], cell: Sequence[str], effort: str) -> DataFrame:
    """Effort of each period taken once, although it stands on every species' row, then summed by cell."""
    return rates.groupBy(*period).agg(F.max(effort).alias("_e")).groupBy(*cell).agg(F.sum("_e").alias("effort"))


def silence_given(psi: Column, p: Column, n: Column) -> Column:
    """Probability that a cell is occupied although n cards are silent."""
    miss = psi * F.pow(1 - p, n)
    return F.coalesce(F.try_divide(miss, miss + 1 - psi), F.lit(0.0))


#: Fixed value: half the 95 % point of a chi-square of one degree of freedom.
PROFILE_DROP = 1.920729410347062
_SILENT = "array<struct<m:bigint,c:bigint>>"


def _with_silent(sums: DataFrame, silent: DataFrame, keys: list[str]) -> DataFrame:
    """sums with silent cells as an array of (cards, cells) for each key."""
    silent = silent.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("m", "c"))).alias("silent"))
    return sums.join(silent, keys, "left").withColumn("silent", F.coalesce("silent", F.array().cast(_SILENT)))


def draw_sums(df: DataFrame, keys: Sequence[str], k: str, n: str) -> DataFrame:
    """What the fits need of each key, from a row for each cell with k detections on n cards: cells, seen, detections, cards of seen cells, silent cells by cards."""
    ok = df.where((F.col(n) > 0) & (F.col(k) <= F.col(n)) & (F.col(k) >= 0))
    seen = F.col(k) > 0
    silent = ok.where(~seen).groupBy(*keys, F.col(n).cast("bigint").alias("m")).agg(F.count("*").alias("c"))
    sums = ok.groupBy(*keys).agg(F.count("*").alias("cells"), F.sum(seen.cast("int")).alias("seen"), F.sum(k).cast("double").alias("detections"), F.sum(F.when(seen, F.col(n))).cast("double").alias("seen_cards"))
    return _with_silent(sums, silent, list(keys))


def card_sums(detections: DataFrame, effort: DataFrame, taxon: str, epoch: Sequence[str], k: str, n: str) -> DataFrame:
    """The same for every taxon in every epoch, without a row for each silent cell.

    detections: taxon, epoch, k, n of the cells with the taxon; effort: epoch and n of
    all cells. A taxon's silent cells of n cards are all cells of n cards less its own,
    so nothing is crossed but the lists of taxa and of epochs' counts.
    """
    e = list(epoch)
    whole = effort.groupBy(*e, F.col(n).cast("bigint").alias("m")).agg(F.count("*").alias("c")).groupBy(*e).agg(F.sum("c").alias("cells"), F.collect_list(F.struct("m", "c")).alias("held"))
    epochs = whole.agg(F.collect_list(F.struct(*e, "cells", "held")).alias("all"))
    own = detections.groupBy(taxon, *e, F.col(n).cast("bigint").alias("m")).agg(F.count_if(F.col(k) > 0).alias("c"), F.sum(F.when(F.col(k) > 0, F.col(k))).alias("k"))
    mine = F.map_from_entries(F.collect_list(F.when(F.col("c") > 0, F.struct("m", "c")))).alias("mine")
    own = own.groupBy(taxon, *e).agg(F.sum("c").alias("seen"), F.sum("k").cast("double").alias("detections"), F.sum(F.when(F.col("c") > 0, F.col("c") * F.col("m"))).cast("double").alias("seen_cards"), mine)
    # a taxon is one row with its epochs, so that the cards are read once for its list and its counts
    own = own.groupBy(taxon).agg(F.collect_list(F.struct(*e, "seen", "detections", "seen_cards", "mine")).alias("own"))
    every = own.crossJoin(F.broadcast(epochs)).select(taxon, "own", F.explode("all").alias("x")).select(taxon, "own", "x.*")
    same = lambda y: reduce(lambda a, b: a & b, [y[c] == F.col(c) for c in e], F.col(taxon).isNotNull())
    every = every.withColumn("own", F.try_element_at(F.filter("own", same), F.lit(1)))
    left = F.transform("held", lambda x: F.struct(x["m"].alias("m"), (x["c"] - F.coalesce(F.try_element_at("own.mine", x["m"]), F.lit(0))).alias("c")))
    silent = F.sort_array(F.filter(F.when(F.col("own").isNull(), F.col("held")).otherwise(left), lambda x: x["c"] > 0)).cast(_SILENT)
    return every.select(taxon, *e, "cells", F.coalesce("own.seen", F.lit(0)).alias("seen"), F.coalesce("own.detections", F.lit(0.0)).alias("detections"), F.col("own.seen_cards").alias("seen_cards"), silent.alias("silent"))


def _expected_silent(psi: Column, p: Column) -> Column:
    """Occupied cells among the silent ones, and their cards."""
    each = F.transform("silent", lambda x: F.struct((x["c"] * silence_given(psi, p, x["m"])).alias("z"), x["m"].alias("m")))
    return F.aggregate(each, F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("zn")), lambda a, x: F.struct((a["z"] + x["z"]).alias("z"), (a["zn"] + x["z"] * x["m"]).alias("zn")))


def sums_likelihood(psi: Column, p: Column) -> Column:
    """Log-likelihood of a row of sums, without binomial constants."""
    seen = F.col("seen") * F.log(psi) + F.col("detections") * F.log(p)
    missed = F.when(F.col("seen_cards") > F.col("detections"), (F.col("seen_cards") - F.col("detections")) * F.log1p(-p)).otherwise(0.0)
    return seen + missed + F.aggregate(F.transform("silent", lambda x: x["c"] * F.log(psi * F.pow(1 - p, x["m"]) + 1 - psi)), F.lit(0.0), lambda a, x: a + x)


def fit_occupancy(sums: DataFrame, keys: Sequence[str], *, iterations: int = 100, settled: float = 1e-6) -> DataFrame:
    """Occupancy psi and detection p of each row of sums by expectation-maximisation.

    Silent cells are counts per number of cards, so a key is one row with a short array,
    on which the closed-form updates are folded. ``converged``: the last update moved
    psi by less than settled. ``valid``: seen, converged, and psi not at its bound.
    Never seen: psi 0, p null, not valid.
    """
    start = F.struct((F.col("seen") / F.col("cells")).alias("psi"), F.least(F.col("detections") / F.col("seen_cards"), F.lit(0.999)).alias("p"), F.lit(1.0).alias("move"))

    def update(s: Column, _: Column) -> Column:
        def new(t: Column) -> Column:
            psi = (F.col("seen") + t["z"]) / F.col("cells")
            return F.struct(psi.alias("psi"), (F.col("detections") / (F.col("seen_cards") + t["zn"])).alias("p"), F.abs(psi - s["psi"]).alias("move"))

        return F.transform(F.array(_expected_silent(s["psi"], s["p"])), new)[0]

    fit = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, update)
    d = sums.withColumn("fit", F.when(F.col("seen") > 0, fit))
    psi, converged = F.coalesce("fit.psi", F.lit(0.0)), F.coalesce(F.col("fit.move") < settled, F.lit(False))
    return d.select(*keys, "cells", "seen", psi.alias("psi"), F.col("fit.p").alias("p"), converged.alias("converged"), (converged & (psi < 0.999)).alias("valid"))


def occupancy(df: DataFrame, keys: Sequence[str], k: str, n: str, *, iterations: int = 100) -> DataFrame:
    """Occupancy psi and detection p per key from k detections on n cards of each cell, silent ones included."""
    return fit_occupancy(draw_sums(df, keys, k, n), keys, iterations=iterations).drop("converged", "valid")


def profile_interval(sums: DataFrame, keys: Sequence[str], *, steps: int = 100, iterations: int = 100) -> DataFrame:
    """(keys, psi, low, high): where the likelihood of psi, with p at its best, falls by ``PROFILE_DROP`` from its peak.

    psi is held at each of steps - 1 inner points of a grid, a row for each key and
    point; p is found there by expectation-maximisation. An end lies between a point
    above the mark and its neighbour below, in proportion; without one below it is 0
    or 1. Never seen: null.
    """
    best = fit_occupancy(sums, keys, iterations=iterations)
    d = sums.join(best.where("seen > 0").select(*keys, F.col("psi").alias("top_psi"), F.col("p").alias("top_p")), list(keys))
    d = d.withColumn("mark", sums_likelihood(F.col("top_psi"), F.col("top_p")) - PROFILE_DROP)
    d = d.withColumn("psi", F.explode(F.transform(F.sequence(F.lit(1), F.lit(steps - 1)), lambda i: i / steps)))
    # small rows with much work each: kept apart, although their bytes would fit one task
    d = d.repartition(int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "psi")
    start = F.least(F.col("detections") / F.col("seen_cards"), F.lit(0.999))
    update = lambda p, _: F.transform(F.array(_expected_silent(F.col("psi"), p)), lambda t: F.col("detections") / (F.col("seen_cards") + t["zn"]))[0]
    d = d.withColumn("p", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, update))
    # the peak itself is a point of the curve
    curve = d.select(*keys, "top_psi", "psi", (sums_likelihood(F.col("psi"), F.col("p")) - F.col("mark")).alias("over"))
    peak = d.select(*keys, "top_psi", F.col("top_psi").alias("psi"), F.lit(PROFILE_DROP).alias("over")).distinct()
    near = lambda side: F.when(side & (F.col("over") < 0), F.struct("psi", "over"))
    left, right = F.col("psi") < F.col("top_psi"), F.col("psi") > F.col("top_psi")
    above = F.when(F.col("over") >= 0, F.struct("psi", "over"))
    ends = curve.unionByName(peak).groupBy(*keys).agg(
        F.max("top_psi").alias("psi"),
        F.max_by(near(left), F.when(left & (F.col("over") < 0), F.col("psi"))).alias("under_low"),
        F.min_by(above, F.when(F.col("over") >= 0, F.col("psi"))).alias("first"),
        F.max_by(above, F.when(F.col("over") >= 0, F.col("psi"))).alias("last"),
        F.min_by(near(right), F.when(right & (F.col("over") < 0), F.col("psi"))).alias("under_high"),
    )
    cross = lambda a, b: F.col(f"{a}.psi") + (F.col(f"{b}.psi") - F.col(f"{a}.psi")) * F.col(f"{a}.over") / (F.col(f"{a}.over") - F.col(f"{b}.over"))
    found = ends.select(*keys, "psi", F.when(F.col("under_low").isNull(), 0.0).otherwise(cross("under_low", "first")).alias("low"), F.when(F.col("under_high").isNull(), 1.0).otherwise(cross("last", "under_high")).alias("high"))
    return best.select(*keys).join(found, list(keys), "left")


def log_likelihood(k: Column, n: Column, psi: Column, p: Column) -> Column:
    """Of one cell, without the binomial constant; a cell with detections is occupied, a silent one may be."""
    seen = F.log(psi) + k * F.log(p) + F.when(n > k, (n - k) * F.log1p(-p)).otherwise(0.0)
    return F.when(k > 0, seen).otherwise(F.log(psi * F.pow(1 - p, n) + 1 - psi))


def paired_footprint(effort: DataFrame, cell: str, epoch: str, cards: str, *, least: int = 20) -> DataFrame:
    """Cells with enough cards in both epochs, and their cards in each."""
    e = effort.groupBy(cell, epoch).agg(F.sum(cards).alias("c")).where(F.col("c") >= least)
    both = e.groupBy(cell).agg(F.count("*").alias("k"), F.min_by("c", epoch).alias("cards_first"), F.max_by("c", epoch).alias("cards_second"))
    return both.where("k = 2").drop("k")


def epoch_changes(fits: DataFrame, taxon: str, epoch: str, *, least_seen: int = 30) -> DataFrame:
    """Change of psi, of the naive share and of p of each taxon seen in enough cells of the first epoch.

    fits: taxon, epoch (the smaller is the first), cells, seen, psi, p. A fit of psi
    above 0.999 lies on the boundary.
    """
    s = fits.groupBy(taxon).agg(F.count("*").alias("_k"), F.min_by(F.struct("cells", "seen", "psi", "p"), epoch).alias("a"), F.max_by(F.struct("cells", "seen", "psi", "p"), epoch).alias("b")).where("_k = 2")
    s = s.where(F.col("a.seen") >= least_seen)
    naive = F.col("b.seen") / F.col("b.cells") - F.col("a.seen") / F.col("a.cells")
    return s.select(taxon, F.col("a.seen").alias("seen_first"), F.col("b.seen").alias("seen_second"), (F.col("b.psi") - F.col("a.psi")).alias("d_psi"), naive.alias("d_naive"), (F.col("b.p") - F.col("a.p")).alias("d_p"), ((F.col("a.psi") > 0.999) | (F.col("b.psi") > 0.999)).alias("boundary"))


def change_summary(changes: DataFrame, *, noise: float = 0.02) -> DataFrame:
    """Medians, share of taxa whose detection rose, sign flips of psi against the naive share beyond noise, and their correlation."""
    flip = (F.abs("d_psi") > noise) & (F.abs("d_naive") > noise) & (F.signum("d_psi") != F.signum("d_naive"))
    return changes.agg(F.count("*").alias("taxa"), F.median("d_psi").alias("median_d_psi"), F.median("d_p").alias("median_d_p"), F.avg((F.col("d_p") > 0).cast("int")).alias("p_rose"), F.sum(flip.cast("int")).alias("sign_flips"), F.corr("d_psi", "d_naive").alias("r"))


def dropped_by_stricter_rule(changes: DataFrame, *, least_seen: int = 30) -> DataFrame:
    """Taxa that a rule of enough cells in both epochs would drop."""
    return changes.where(F.col("seen_second") < least_seen)


def expected_taxa(detections: DataFrame, effort: DataFrame, fits: DataFrame, taxon: str, cell: str, k: str, n: str) -> DataFrame:
    """Taxa recorded in each cell, and expected to be there: 1 if recorded, else the chance to be there in silence.

    detections: taxon, cell, k, n of the cells with the taxon; effort: cell and n of
    all cells. The chances of all taxa in a cell depend on its cards alone: they are
    summed once for each number of cards, and those of the recorded taxa taken off.
    """
    chance = silence_given(F.col("psi"), F.coalesce("p", F.lit(0.0)), F.col(n))
    counts = effort.select(n).distinct().agg(F.collect_list(n).alias("_ns"))
    all_taxa = fits.crossJoin(F.broadcast(counts)).select("psi", "p", F.explode("_ns").alias(n)).groupBy(n).agg(F.sum(chance).alias("_all"))
    own = detections.where(F.col(k) > 0).join(fits.select(taxon, "psi", "p"), taxon).groupBy(cell).agg(F.count("*").alias("recorded"), F.sum(1 - chance).alias("_more"))
    d = effort.select(cell, n).join(all_taxa, n, "left").join(own, cell, "left")
    return d.select(cell, F.coalesce("recorded", F.lit(0)).alias("recorded"), (F.coalesce("_all", F.lit(0.0)) + F.coalesce("_more", F.lit(0.0))).alias("expected"))
