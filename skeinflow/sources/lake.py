"""Partitioned Parquet tables with fixed schemas: checked writes, scans by source, run manifests."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T


class LakeError(ValueError):
    """A write or scan that the table's rules refuse."""


@dataclass(frozen=True)
class TableSpec:
    """A table's columns, its partitions, and which columns play the parts of time, value and identity."""

    name: str
    schema: T.StructType
    time: str | None = None
    value: str | None = None
    identity: str | None = None

    def violations(self, df: DataFrame) -> list[str]:
        """Missing columns, other types, and nulls where none are allowed; extra columns are fine."""
        have = {f.name: f.dataType for f in df.schema}
        out = [f"missing column {f.name}" for f in self.schema if f.name not in have]
        out += [f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in self.schema if f.name in have and have[f.name] != f.dataType]
        strict = [f.name for f in self.schema if not f.nullable and f.name in have]
        if strict:
            row = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in strict]).first()
            out += [f"{c} has {row[c]} nulls" for c in strict if row[c]]
        return out


def with_year(df: DataFrame, time: str | None) -> DataFrame:
    """df with the partition column year, a string; no time is 'undated'."""
    return df.withColumn("year", F.coalesce(F.year(time).cast("string"), F.lit("undated")) if time else F.lit("undated"))


def _stored(spec: TableSpec) -> T.StructType:
    """The spec's columns and the partition columns, which are strings."""
    have = set(spec.schema.names)
    return T.StructType([*spec.schema.fields, *[T.StructField(c, T.StringType()) for c in ("source_id", "year") if c not in have]])


def scan(spark: SparkSession, spec: TableSpec, root: str, source_id: list[str] | None) -> DataFrame:
    """Rows of the named sources; None pools all of them on purpose. Partitions are pruned by source."""
    df = spark.read.schema(_stored(spec)).parquet(f"{root}/{spec.name}")
    return df if source_id is None else df.where(F.col("source_id").isin(source_id))


def sources(spark: SparkSession, spec: TableSpec, root: str) -> DataFrame:
    """The sources that a dataset holds, from its partitions."""
    return scan(spark, spec, root, None).select("source_id").distinct()


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = []
        for uri in batch["path"].to_pylist():
            store, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
            names.append(pq.read_schema(path, filesystem=store).names)
        yield pa.record_batch([batch["path"], pa.array(names, pa.list_(pa.string()))], ["path", "names"])


def file_columns(spark: SparkSession, path: str) -> DataFrame:
    """(path, names): the columns of each Parquet file below path, from its footer, read in tasks; no two files' schemas are merged.

    Files are listed by Spark; a task opens footers through the store's own client, so a
    path that only a Hadoop file system knows needs its native library there.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")
    return listed.mapInArrow(_footers, "path string, names array<string>")


def schema_drift(spark: SparkSession, spec: TableSpec, path: str) -> DataFrame:
    """(path, missing, unexpected) of each file whose columns differ from the spec's; columns that the path holds are no part of a file."""
    held = ["source_id", "year"]
    expected = F.array(*[F.lit(c) for c in spec.schema.names if c not in held])
    found = file_columns(spark, path).select("path", F.array_sort(F.array_except(expected, "names")).alias("missing"), F.array_sort(F.array_except("names", F.concat(expected, F.array(*map(F.lit, held))))).alias("unexpected"))
    return found.where((F.size("missing") > 0) | (F.size("unexpected") > 0))


def write(df: DataFrame, spec: TableSpec, root: str, source_id: str, *, run_id: str | None = None) -> str:
    """Replaces the partitions that df touches, after checks of schema, source, identity and the other sources' files, logs the run and gives its id."""
    found = spec.violations(df)
    if found:
        raise LakeError("; ".join(found))
    others = [r[0] for r in df.select("source_id").distinct().limit(2).collect()]
    if others not in ([source_id], []):
        raise LakeError(f"rows of {others}, not of {source_id}")
    out = with_year(df, spec.time)
    spark, path, run_id = df.sparkSession, f"{root}/{spec.name}", run_id or uuid.uuid4().hex
    if _exists(spark, path):
        drifted = schema_drift(spark, spec, path).where(~F.contains("path", F.lit(f"/source_id={source_id}/"))).orderBy("path").limit(3).collect()
        if drifted:
            raise LakeError("other sources hold other columns: " + "; ".join(f"{r.path} lacks {r.missing}, has {r.unexpected}" for r in drifted))
    if spec.identity and _exists(spark, path):
        old = scan(spark, spec, root, [source_id]).select("year", F.col(spec.identity).alias("i")).distinct()
        new = out.select("year", F.col(spec.identity).alias("i")).distinct()
        both = old.join(new, ["year", "i"], "left_semi").groupBy("year").count().withColumnRenamed("count", "same")
        counts = old.groupBy("year").agg(F.count("*").alias("old")).join(new.groupBy("year").agg(F.count("*").alias("new")), "year").join(both, "year", "left")
        bad = [r.year for r in counts.where("same is null").select("year").collect()]
        if bad:
            raise LakeError(f"nothing in common with what {bad} hold")
    # counted before anything is replaced, as df may come from this table; a row for each partition
    rows = out.groupBy("year").count().orderBy("year").collect()
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("source_id", "year").parquet(path)
    log = spark.createDataFrame([(run_id, spec.name, source_id, sum(r["count"] for r in rows), [r.year for r in rows])], "run_id string, dataset string, source_id string, rows long, partitions array<string>")
    log.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/_manifests")
    return run_id


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    store, p = _store(spark, path)
    return store.exists(p)


def _remove(spark: SparkSession, path: str) -> None:
    store, p = _store(spark, path)
    store.delete(p, True)


def purge_floor(spark: SparkSession, spec: TableSpec, root: str, key: str, label: str, keys: Sequence[int], names: Sequence[str]) -> DataFrame:
    """(source_id, year, removed, kept): takes rows of taxa that must never be stored out of the partitions that hold any.

    Survivors of those partitions are staged beside the table and marked ready; then
    they replace the partitions, emptied ones are removed, and the stage goes. Other
    partitions' files are not touched. A stage without its mark is begun anew, one with
    it is carried on, so a job that ends anywhere is mended by calling this again.
    """
    stage, path = f"{root}/_purge/{spec.name}", f"{root}/{spec.name}"
    if not _exists(spark, f"{stage}/_ready"):
        _remove(spark, stage)
        df = scan(spark, spec, root, None)
        gone = floor_match(F.col(key), F.col(label), keys, names)
        counts = df.groupBy("source_id", "year").agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept")).where("removed > 0")
        counts.coalesce(1).write.parquet(f"{stage}/report")
        held = spark.read.parquet(f"{stage}/report").collect()  # a row for each partition
        for_source = {s: [r.year for r in held if r.source_id == s] for s in {r.source_id for r in held}}
        touched = F.lit(False)
        for s, years in for_source.items():
            touched = touched | ((F.col("source_id") == s) & F.col("year").isin(years))
        df.where(touched & ~gone).write.partitionBy("source_id", "year").option("compression", "zstd").parquet(f"{stage}/rows")
        store, mark = _store(spark, f"{stage}/_ready")
        store.create(mark).close()
    report = spark.read.parquet(f"{stage}/report").collect()
    if any(r.kept for r in report):
        spark.read.schema(_stored(spec)).parquet(f"{stage}/rows").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("source_id", "year").parquet(path)
    for r in report:
        if not r.kept:
            _remove(spark, f"{path}/source_id={r.source_id}/year={r.year}")
    _remove(spark, stage)
    return spark.createDataFrame([tuple(r) for r in report], "source_id string, year string, removed long, kept long")


def plain_name(label: Column) -> Column:
    """Lower case, single spaces, none at the ends; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(label), r"[\s\p{Z}]+", " ")), F.lit(""))


def floor_match(key: Column, label: Column, keys: Sequence[int], names: Sequence[str]) -> Column:
    """Whether a taxon must never be stored: by key, or by name, both names made plain."""
    wanted = [" ".join(x.lower().split()) for x in names]
    return F.coalesce(key.isin(list(keys)), F.lit(False)) | F.coalesce(plain_name(label).isin(wanted), F.lit(False))


def day_gaps(df: DataFrame, day: Column, keys: Sequence[str] = ()) -> DataFrame:
    """(year, month, days, missing) of months that lack more than one of their days, between the first and last day of the table; with ``keys``, for each of their values."""
    days = df.select(*keys, F.to_date(day).alias("d")).where("d is not null").distinct()
    span = days.agg(F.trunc(F.min("d"), "month").alias("a"), F.last_day(F.max("d")).alias("b"))
    months = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m")).select(F.year("m").alias("year"), F.month("m").alias("month"), F.dayofmonth(F.last_day("m")).alias("length"))
    held = days.groupBy(*keys, F.year("d").alias("year"), F.month("d").alias("month")).agg(F.count("*").alias("days"))
    if keys:
        months = days.select(*keys).distinct().crossJoin(F.broadcast(months))
    out = months.join(held, [*keys, "year", "month"], "left").withColumn("days", F.coalesce("days", F.lit(0)))
    return out.where(F.col("days") < F.col("length") - 1).select(*keys, "year", "month", "days", (F.col("length") - F.col("days")).alias("missing"))


def first_version(df: DataFrame, keys: list[str], order: str, keep: int) -> DataFrame:
    """The first ``keep`` rows per key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= keep).drop("_n")
