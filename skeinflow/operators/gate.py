"""The disclosure gate: what may be published, and how coarse, late and nameless."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import snap

#: Order of sensitivities.
SENSITIVITIES = ["not_sensitive", "low", "moderate", "high", "embargoed"]


def _rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in SENSITIVITIES]), c)


def sensitivity(items: DataFrame, rules: DataFrame, sources: DataFrame) -> DataFrame:
    """items (source_id, taxon_key, evidence, realm) with their sensitivity.

    A rule (taxon_key, evidence or null, realm or null, sensitivity) fits if its
    non-null parts do; the most specific wins, then the most restrictive; without a
    rule the source's default_sensitivity holds.
    """
    r = rules.select(F.col("taxon_key").alias("rk"), F.col("evidence").alias("re"), F.col("realm").alias("rr"), F.col("sensitivity").alias("rs"))
    fits = (F.col("taxon_key") == F.col("rk")) & (F.col("re").isNull() | (F.col("re") == F.col("evidence"))) & (F.col("rr").isNull() | (F.col("rr") == F.col("realm")))
    weight = F.col("re").isNotNull().cast("int") + F.col("rr").isNotNull().cast("int")
    keys = ["source_id", "taxon_key", "evidence", "realm"]
    best = items.select(*keys).distinct().join(r, fits, "left").groupBy(*keys).agg(F.max_by("rs", F.when(F.col("rs").isNotNull(), F.struct(weight, _rank(F.col("rs"))))).alias("_rule"))
    best = best.select(*[F.col(k).alias(f"_{k}") for k in keys], "_rule")
    d = items.join(best, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])
    return d.join(F.broadcast(sources.select("source_id", "default_sensitivity")), "source_id", "left").withColumn("sensitivity", F.coalesce("_rule", "default_sensitivity")).drop("_rule", "default_sensitivity")


def decide(items: DataFrame, policy: DataFrame, sources: DataFrame, floor_keys: list[int]) -> DataFrame:
    """items with decision (publish or withhold), reason, grid, delay_days and drop_ids; whatever is unknown is withheld.

    items carry sensitivity and granularity; policy has a row for each pair of them;
    sources carry redistributable. The first refusal gives the reason.
    """
    d = items.join(F.broadcast(policy), ["sensitivity", "granularity"], "left").join(F.broadcast(sources.select("source_id", "redistributable")), "source_id", "left")
    reason = (
        F.when(F.coalesce(F.col("taxon_key").isin(floor_keys), F.lit(False)), "floor taxon")
        .when(~F.coalesce("redistributable", F.lit(False)), "licence")
        .when(F.col("sensitivity").isNull(), "unresolved sensitivity")
        .when((F.col("taxon_scope") == "exact") & F.col("taxon_key").isNull(), "exact scope without key")
        .when(F.coalesce("withhold", F.lit(True)), "policy")
    )
    return d.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason").isNull(), "publish").otherwise("withhold")).drop("withhold", "redistributable")


def generalise(df: DataFrame, time: str, lon: str, lat: str, ids: list[str], *, grid: float | None, cutoff: Column | None) -> DataFrame:
    """Rows up to the cutoff, snapped, without identifiers, in this order."""
    out = df if cutoff is None else df.where(F.col(time) <= cutoff)
    if grid is not None:
        out = out.withColumns({lon: snap(F.col(lon), grid), lat: snap(F.col(lat), grid)})
    return out.drop(*ids)


def merged_cells(df: DataFrame, keys: list[str], lon: str, lat: str, value: str) -> DataFrame:
    return df.groupBy(*keys, lon, lat).agg(F.sum(value).alias(value))


def statement(grid: Column, delay_days: Column, drop_ids: Column, withheld: Column | None = None) -> Column:
    """What was done to the data, in words; with ``withheld``, null counting as true, also that they are not published."""
    parts = F.concat_ws("; ", F.when(grid.isNotNull(), F.concat(F.lit("positions to "), grid.cast("string"), F.lit(" degrees"))), F.when(delay_days > 0, F.concat(F.lit("delayed by "), delay_days.cast("string"), F.lit(" days"))), F.when(drop_ids, F.lit("identifiers removed")))
    said = F.when(parts == "", F.lit("none")).otherwise(parts)
    return said if withheld is None else F.when(F.coalesce(withheld, F.lit(True)), F.lit("withheld: not published")).otherwise(said)


def with_permission(decisions: DataFrame, permissions: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions under what owners permit (keys, own_grid, own_delay_days, own_drop_ids).

    An embargo stays. Elsewhere delay and identifiers are the owner's (no delay: none;
    nothing said of identifiers: they go), the grid is the coarser of both (none of the
    owner's: the policy's), and a withholding by policy of a high sensitivity is lifted.
    """
    d = decisions.join(permissions.withColumn("_given", F.lit(True)), keys, "left")
    given = F.col("_given").isNotNull() & (F.col("sensitivity") != "embargoed")
    lifted = given & (F.col("sensitivity") == "high") & (F.col("reason") == "policy")
    return d.withColumns({
        "grid": F.when(given, F.greatest("grid", "own_grid")).otherwise(F.col("grid")),
        "delay_days": F.when(given, F.greatest(F.coalesce("own_delay_days", F.lit(0)), F.lit(0))).otherwise(F.col("delay_days")),
        "drop_ids": F.when(given, F.coalesce("own_drop_ids", F.lit(True))).otherwise(F.col("drop_ids")),
        "decision": F.when(lifted, "publish").otherwise(F.col("decision")),
        "reason": F.when(~F.coalesce(lifted, F.lit(False)), F.col("reason")),
    }).drop("own_grid", "own_delay_days", "own_drop_ids", "_given")


def export_taxa(cells: DataFrame, decisions: DataFrame, taxon: str, lon: str, lat: str, value: str, *, least_cells: int = 3) -> tuple[DataFrame, DataFrame]:
    """Published cells of each taxon on its own grid, and the taxa that are left out with the reason.

    decisions: taxon, decision, grid (degrees; null leaves positions as they are). A
    taxon of fewer than ``least_cells`` cells on its grid is too small to publish.
    """
    d = cells.join(decisions.select(taxon, "decision", "grid"), taxon)
    on_grid = lambda c: F.when(F.col("grid").isNull(), F.col(c)).otherwise(snap(F.col(c), F.col("grid")))
    own = d.where("decision = 'publish'").withColumns({lon: on_grid(lon), lat: on_grid(lat)})
    merged = merged_cells(own, [taxon], lon, lat, value)
    size = merged.groupBy(taxon).agg(F.count("*").alias("cells"))
    out = merged.join(size.where(F.col("cells") >= least_cells), taxon, "left_semi")
    left = decisions.join(size, taxon, "left").select(taxon, F.when(F.coalesce("decision", F.lit("")) != "publish", "withheld").when(F.coalesce("cells", F.lit(0)) < least_cells, "too small").alias("why"))
    return out, left.where("why is not null")
