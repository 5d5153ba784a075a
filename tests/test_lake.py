"""Partitioned tables: manifests, drift by file, refused writes, and purges that survive a crash."""

import glob
import os
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F, types as T

from skeinflow.sources import lake

SPEC = lake.TableSpec("seen", T.StructType([T.StructField("source_id", T.StringType(), False), T.StructField("at", T.TimestampType()), T.StructField("taxon_key", T.LongType()), T.StructField("label", T.StringType()), T.StructField("value", T.DoubleType())]), time="at")


def rows(spark, source, years, *, taxa=(1, 2, 3), n=40):
    df = spark.range(n * len(years)).select(F.lit(source).alias("source_id"), F.to_timestamp(F.concat(F.element_at(F.array(*[F.lit(str(y)) for y in years]), (F.col("id") % len(years) + 1).cast("int")), F.lit("-06-01"))).alias("at"), F.element_at(F.array(*map(F.lit, taxa)), (F.floor(F.col("id") / len(years)) % len(taxa) + 1).cast("int")).cast("long").alias("taxon_key"), F.concat(F.lit("Taxon  "), F.col("id") % 7).alias("label"), F.col("id").cast("double").alias("value"))
    return df


@pytest.fixture
def table(spark, tmp_path):
    root = str(tmp_path)
    lake.write(rows(spark, "a", [2001, 2002, 2003]), SPEC, root, "a")
    lake.write(rows(spark, "b", [2001], taxa=(9,)), SPEC, root, "b", run_id="own")
    lake.write(rows(spark, "c", [2001, 2002], taxa=(1, 9)), SPEC, root, "c")
    return root


def stamps(root):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/seen/**/*.parquet", recursive=True)}


def test_sources_years_and_manifests(spark, table):
    assert sorted(r[0] for r in lake.sources(spark, SPEC, table).collect()) == ["a", "b", "c"]
    assert lake.scan(spark, SPEC, table, ["a"]).groupBy("year").count().orderBy("year").collect() == [("2001", 40), ("2002", 40), ("2003", 40)]
    assert dict(lake.scan(spark, SPEC, table, None).dtypes)["year"] == "string"
    log = {r.source_id: r for r in spark.read.parquet(f"{table}/_manifests").collect()}
    assert log["b"].run_id == "own" and len(log["a"].run_id) == 32 and log["c"].partitions == ["2001", "2002"] and log["a"].rows == 120


def test_a_table_may_be_written_from_itself(spark, table):
    own = lake.scan(spark, SPEC, table, ["a"]).where("year = '2002' and value < 60").drop("year")
    lake.write(own, SPEC, table, "a")
    left = lake.scan(spark, SPEC, table, ["a"]).groupBy("year").count().orderBy("year").collect()
    assert left == [("2001", 40), ("2002", 20), ("2003", 40)]
    assert max(spark.read.parquet(f"{table}/_manifests").collect(), key=lambda r: r["at"]).rows == 20


def test_drift_of_one_file_among_many_is_named_and_refuses_others_writes(spark, table):
    assert lake.schema_drift(spark, SPEC, f"{table}/seen").count() == 0
    base = f"{table}/seen/source_id=d/year=2001"
    os.makedirs(base)
    good = pa.table({"at": pa.array([None], pa.timestamp("us", "UTC")), "taxon_key": pa.array([1]), "label": ["x"], "value": [1.0]})
    for k in range(300):
        pq.write_table(good if k != 137 else good.drop_columns(["label"]).append_column("extra", pa.array([1])), f"{base}/part-{k:04}.parquet")
    drift = lake.schema_drift(spark, SPEC, f"{table}/seen").collect()
    assert [(r.path.rsplit("/", 1)[1], r.missing, r.unexpected) for r in drift] == [("part-0137.parquet", ["label"], ["extra"])]
    before = stamps(table)
    with pytest.raises(lake.LakeError, match="part-0137"):
        lake.write(rows(spark, "a", [2001]), SPEC, table, "a")
    assert stamps(table) == before
    fixed = rows(spark, "d", [2001])
    lake.write(fixed, SPEC, table, "d")  # its own drift is what a source may mend
    assert lake.schema_drift(spark, SPEC, f"{table}/seen").count() == 0
    lake.write(rows(spark, "a", [2001]), SPEC, table, "a")


def purge(spark, root):
    return {(r.source_id, r.year): (r.removed, r.kept) for r in lake.purge_floor(spark, SPEC, root, "taxon_key", "label", [9], [" TAXON 6"]).collect()}


def test_purge_rewrites_affected_partitions_only(spark, table):
    lake.write(rows(spark, "e", [2005], taxa=(4,)).withColumn("label", F.lit(None).cast("string")), SPEC, table, "e")
    before = stamps(table)
    wanted = {tuple(r) for r in lake.scan(spark, SPEC, table, None).where("not (coalesce(taxon_key, 0) = 9 or coalesce(label, '') = 'Taxon  6')").select("source_id", "year", "value").collect()}
    got = purge(spark, table)
    assert got["b", "2001"] == (40, 0) and ("e", "2005") not in got and all(removed for removed, _ in got.values())
    assert {tuple(r) for r in lake.scan(spark, SPEC, table, None).select("source_id", "year", "value").collect()} == wanted
    after = stamps(table)
    assert {f: t for f, t in before.items() if "source_id=e" in f} == {f: t for f, t in after.items() if "source_id=e" in f}
    assert not os.path.exists(f"{table}/seen/source_id=b/year=2001") and not os.path.exists(f"{table}/_purge/seen")
    assert purge(spark, table) == {} and stamps(table) == after


@pytest.mark.parametrize("crash", ["while staging", "before the swap", "before removal"])
def test_purge_is_carried_on_after_a_crash(spark, table, monkeypatch, crash):
    with monkeypatch.context() as m:
        if crash == "while staging":
            m.setattr(lake, "_store", lambda spark, path, f=lake._store: (_ for _ in ()).throw(OSError("gone")) if path.endswith("_ready") and os.path.exists(f"{table}/_purge/seen/rows") else f(spark, path))
        else:
            calls = {"before the swap": lambda spark, spec: (_ for _ in ()).throw(OSError("gone")) if os.path.exists(f"{table}/_purge/seen/_ready") else None}
            if crash == "before the swap":
                m.setattr(lake, "_stored", lambda spec, f=lake._stored: calls[crash](spark, spec) or f(spec))
            else:
                m.setattr(lake, "_remove", lambda spark, path, f=lake._remove: (_ for _ in ()).throw(OSError("gone")) if "year=" in path else f(spark, path))
        with pytest.raises(OSError, match="gone"):
            purge(spark, table)
    assert os.path.exists(f"{table}/_purge/seen")
    got = purge(spark, table)
    assert got["b", "2001"] == (40, 0) and got["c", "2001"][1] > 0
    left = lake.scan(spark, SPEC, table, None)
    assert left.where("taxon_key = 9 or label = 'Taxon  6'").count() == 0 and not os.path.exists(f"{table}/_purge/seen")
    shutil.rmtree(table)


def test_floor_match_of_keys_and_names(spark):
    df = spark.createDataFrame([(9, None), (1, "TAXON\t 6 "), (None, None), (1, "taxon 66")], "k long, n string")
    assert [r[0] for r in df.select(lake.floor_match(F.col("k"), F.col("n"), [9], ["Taxon  6"])).collect()] == [True, True, False, False]
