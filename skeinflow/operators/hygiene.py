"""Admission, plausibility and coverage of rows and sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.lake import floor_match, plain_name


def plausible(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows whose values lie in closed ranges; null is not plausible."""
    for c, (low, high) in ranges.items():
        df = df.where(F.col(c).between(low, high))
    return df


def drop_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row with the number of rows, of rows kept, and of rows that each rule is the first to drop."""
    reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in rules.items()])
    d = df.select(reason.alias("r"))
    return d.agg(F.count("*").alias("rows"), F.count_if(F.col("r").isNull()).alias("kept"), *[F.count_if(F.col("r") == name).alias(f"dropped_{name}") for name in rules])


def spanning(df: DataFrame, keys: Sequence[str], time: str, years: int = 2) -> DataFrame:
    """Rows of keys that touch at least so many calendar years between their first and last."""
    span = df.groupBy(*keys).agg((F.max(F.year(time)) - F.min(F.year(time)) + 1).alias("_span")).where(F.col("_span") >= years)
    return df.join(span.select(*keys), list(keys), "left_semi")


def admit_rows(df: DataFrame, key: str, name: str, floor_keys: Sequence[int], floor_names: Sequence[str]) -> DataFrame:
    """df with refusal: null if a row may enter, else why not; a name of blanks is no name."""
    unknown = F.col(key).isNull() & plain_name(F.col(name)).isNull()
    return df.withColumn("refusal", F.when(unknown, "no key and no name").when(floor_match(F.col(key), F.col(name), floor_keys, floor_names), "never stored"))


def floor_report(df: DataFrame, source: str, label: str, year: Column) -> DataFrame:
    """Refused rows by source: how many, under which labels, in which years."""
    return df.where(F.col("refusal") == "never stored").groupBy(source).agg(F.count("*").alias("rows"), F.array_join(F.sort_array(F.collect_set(label)), ",").alias("labels"), F.array_join(F.sort_array(F.collect_set(year)), ",").alias("years"))


def admit_sources(data: DataFrame, registry: DataFrame, source: str) -> DataFrame:
    """Each source of the data with refusal; registry: source, classified, licensed."""
    r = registry.select(F.col(source).alias("_s"), "classified", "licensed")
    d = data.select(source).distinct().join(r, F.col(source).eqNullSafe(F.col("_s")), "left")
    return d.select(source, F.when(F.col("_s").isNull(), "unregistered").when(~F.coalesce("classified", F.lit(False)), "unclassified").when(~F.coalesce("licensed", F.lit(False)), "unlicensed").alias("refusal"))


def shortfall(wanted: DataFrame, landed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the catalogue that have not landed."""
    return wanted.select(*keys).distinct().join(landed.select(*keys).distinct(), list(keys), "left_anti")


def having_all(df: DataFrame, key: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Keys that have every one of the kinds."""
    return df.where(F.col(kind).isin(list(kinds))).groupBy(key).agg(F.countDistinct(kind).alias("_k")).where(F.col("_k") == len(set(kinds))).select(key)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def coverage_facts(df: DataFrame, keys: Sequence[str], site: str, time: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(site).alias("sites"), F.count("*").alias("rows"), F.min(F.year(time)).alias("first_year"), F.max(F.year(time)).alias("last_year"))


def value_kind(df: DataFrame, source: str, kind: str) -> DataFrame:
    """The only kind of each source, or mixed."""
    return df.groupBy(source).agg(F.min(kind).alias("_a"), F.max(kind).alias("_b")).select(source, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("mixed").alias("value_kind"))


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of a total order."""
    return df.orderBy(*order).limit(n)


def centred(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df with each column less its mean in the group."""
    by = Window.partitionBy(*keys)
    return df.withColumns({f"{c}_centred": F.col(c) - F.avg(c).over(by) for c in columns})
