"""Delimited text: one scan that types the wanted columns and counts what does not fit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def decoded(line: Column) -> Column:
    """The line as UTF-8, or as Latin-1 where its bytes are no UTF-8."""
    return F.when(F.is_valid_utf8(line), line).otherwise(F.decode(line.cast("binary"), "ISO-8859-1"))


def parsed(lines: DataFrame, header: Sequence[str], wanted: Mapping[str, str], *, separator: str = "\t", ragged: bool = False, seen: Observation | None = None) -> DataFrame:
    """The wanted columns (name to type) of lines (value); nothing is quoted.

    A field that is empty or does not read as its type is null. A line with more or fewer
    fields than the header goes; with ``ragged`` it stays, what it lacks being null and
    what it has too much left out. Lines equal to the header and null lines go. ``seen``
    gets, from the same scan, lines, short, long, and for each column how many filled
    fields did not read (unread_<name>). An empty line is one empty field.
    """
    head = separator.join(header)
    d = lines.select(decoded(F.col("value")).alias("value")).where(F.col("value") != head)
    d = d.select(F.split("value", rf"\Q{separator}\E", -1).alias("f")).withColumn("width", F.size("f"))
    text = lambda name: F.nullif(F.get("f", F.lit(list(header).index(name))), F.lit(""))
    fits = F.lit(True) if ragged else F.col("width") == len(header)
    columns = {name: text(name).try_cast(kind) for name, kind in wanted.items()}
    if seen is not None:
        unread = [F.count_if(fits & text(name).isNotNull() & c.isNull()).alias(f"unread_{name}") for name, c in columns.items()]
        d = d.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if(F.col("width") < len(header)).alias("short"), F.count_if(F.col("width") > len(header)).alias("long"), *unread)
    return d.where(fits).select(*[c.alias(name) for name, c in columns.items()])


def read_delimited(spark: SparkSession, path: str, wanted: Mapping[str, str], *, separator: str = "\t", ragged: bool = False, seen: Observation | None = None) -> DataFrame:
    """The wanted columns of the files at path, which all begin with the same header."""
    lines = spark.read.text(path)
    first = lines.first()
    header = first["value"].split(separator) if first else list(wanted)
    missing = [name for name in wanted if name not in header]
    if missing:
        raise ValueError(f"{path} has no column {missing}")
    return parsed(lines, header, wanted, separator=separator, ragged=ragged, seen=seen)


def project(spark: SparkSession, path: str, wanted: Mapping[str, str], out: str, *, separator: str = "\t", ragged: bool = False) -> dict[str, int]:
    """Writes the wanted columns as Parquet, so that a huge file is read as text once; gives the counts of ``parsed``."""
    seen = Observation()
    read_delimited(spark, path, wanted, separator=separator, ragged=ragged, seen=seen).write.mode("overwrite").option("compression", "zstd").parquet(out)
    return seen.get


def concatenated(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames whose columns differ in order, presence and width of numbers: by name, null where absent, each in the widest of its types."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
