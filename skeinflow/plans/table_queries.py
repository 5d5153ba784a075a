"""Queries on files, delimited text and names, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from ..operators import names
from ..sources import delimited, lake
from ..sources.lineage import shared_folder
from .registry import _t, query

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_KNOWN = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(f"""WITH have AS (SELECT table_name AS t, column_name AS c FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in _TABLES)})), want AS (SELECT unnest({_KNOWN}) AS c), every AS (SELECT DISTINCT t FROM have),
m AS (SELECT t, string_agg(c, ',' ORDER BY c) AS missing FROM every, want WHERE NOT EXISTS (SELECT 1 FROM have WHERE have.t = every.t AND have.c = want.c) GROUP BY 1), u AS (SELECT t, string_agg(c, ',' ORDER BY c) AS unexpected FROM have WHERE c NOT IN ({', '.join(repr(c) for c in [*_KNOWN, 'source_id', 'year'])}) GROUP BY 1)
SELECT t AS name, coalesce(missing, '') AS missing, coalesce(unexpected, '') AS unexpected FROM every LEFT JOIN m USING (t) LEFT JOIN u USING (t) WHERE missing IS NOT NULL OR unexpected IS NOT NULL""")
def schema_drift(spark, sf_dir):
    spec = lake.TableSpec("customer", T.StructType([T.StructField(c, T.StringType()) for c in _KNOWN]))
    drift = lake.schema_drift(spark, spec, sf_dir)
    name = F.regexp_extract("path", r"/([a-z]+)\.parquet(/|$)", 1)
    return drift.select(name.alias("name"), F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected")).distinct()


@query("SELECT 'n' || (c_nationkey % 3) AS source_id, (1990 + c_custkey % 4)::VARCHAR AS year, count_if(c_custkey % 11 = 9 OR (c_nationkey = 3 AND c_custkey % 4 = 2)) AS removed, count_if(NOT (c_custkey % 11 = 9 OR (c_nationkey = 3 AND c_custkey % 4 = 2))) AS kept FROM customer GROUP BY ALL HAVING count_if(c_custkey % 11 = 9 OR (c_nationkey = 3 AND c_custkey % 4 = 2)) > 0")
def purged_partitions(spark, sf_dir):
    """Customers written as a table of sources and years, and purged of taxa by key and by name."""
    schema = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("taxon_key", T.LongType()), T.StructField("label", T.StringType())])
    spec, root = lake.TableSpec("seen", schema, time="at"), f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    source = F.concat(F.lit("n"), nation % 3)
    label = F.when((nation == 3) & (k % 4 == 2), F.concat(F.lit("Homo "), F.when(k % 8 == 2, " ").otherwise(""), F.lit(" SAPIENS"))).otherwise(F.concat(F.lit("t"), k % 5))
    d = _t(spark, sf_dir, "customer").select(source.alias("source_id"), F.make_timestamp(1990 + k % 4, F.lit(6), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("at"), (k % 11).alias("taxon_key"), label.alias("label"))
    out = lake.with_year(d, "at")
    out.write.partitionBy("source_id", "year").parquet(f"{root}/seen")
    return lake.purge_floor(spark, spec, root, "taxon_key", "label", [9], ["homo sapiens"])


@query("""WITH c AS (SELECT c_custkey AS k, c_mktsegment AS s, c_acctbal::DOUBLE AS v FROM customer)
SELECT s AS segment, count(*) AS n, count(*) FILTER (k % 13 <> 0) AS n_balance, round(sum(v) FILTER (k % 13 <> 0), 2) AS balance FROM c WHERE k % 17 <> 0 AND k % 19 <> 0 GROUP BY 1""")
def delimited_rows(spark, sf_dir):
    """Customers as tab-separated lines, some with a field too many, one too few, or a balance that is no number; parsed again."""
    k, tab = F.col("c_custkey"), "\t"
    balance = F.when(k % 13 == 0, F.when(k % 2 == 0, "n/a").otherwise("")).otherwise(F.col("c_acctbal").cast("string"))
    line = F.concat_ws(tab, k.cast("string"), F.col("c_name"), balance, F.when(k % 19 != 0, F.col("c_mktsegment")), F.when(k % 17 == 0, "more"), F.when((k % 17 == 0) & (k % 19 == 0), "still more"))
    lines = _t(spark, sf_dir, "customer").select(line.alias("value"))
    d = delimited.parsed(lines, ["key", "name", "balance", "segment"], {"segment": "string", "balance": "double"})
    return d.groupBy("segment").agg(F.count("*").alias("n"), F.count("balance").alias("n_balance"), F.round(F.sum("balance"), 2).alias("balance"))


#: Parts as a backbone: chains of up to six synonyms, circles of two, chains that lead out, and two entries of one name.
_BACKBONE = """b AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 10 BETWEEN 1 AND 6 THEN p_partkey - 1 WHEN p_partkey % 10 = 7 THEN p_partkey + 1 WHEN p_partkey % 10 = 8 THEN p_partkey - 1 WHEN p_partkey % 30 = 29 THEN 1000000007 END AS accepted, 'part no ' || CASE WHEN p_partkey % 50 = 19 THEN p_partkey - 9 ELSE p_partkey END AS name, p_partkey % 90 AS sure FROM part)"""


@query(f"""WITH RECURSIVE {_BACKBONE}, walk AS (SELECT key AS start, key AS here, coalesce(accepted, key) AS onward, 0 AS i FROM b UNION ALL SELECT start, onward, CASE WHEN b.key IS NULL THEN NULL ELSE coalesce(accepted, b.key) END, i + 1 FROM walk LEFT JOIN b ON b.key = onward WHERE onward IS NOT NULL AND onward <> here AND i < 40),
r AS (SELECT start AS key, max(CASE WHEN here = onward THEN here END) AS root, CASE WHEN bool_or(here = onward) THEN NULL WHEN max(i) >= 40 THEN 'circle' ELSE 'broken' END AS bad FROM walk GROUP BY 1),
f AS (SELECT name, min(root) AS a, max(root) AS z, max(bad) AS bad FROM b JOIN r USING (key) WHERE sure >= 5 GROUP BY 1),
n AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'part no ' || p_partkey WHEN 1 THEN 'part no ' || p_partkey WHEN 2 THEN 'part no ' || (p_partkey + 3) ELSE CASE WHEN p_partkey % 8 = 3 THEN NULL ELSE 'nothing ' || p_partkey END END AS name FROM part)
SELECT id, CASE WHEN a = z THEN a END AS accepted_key, CASE WHEN n.name IS NULL THEN 'no name' WHEN f.name IS NULL THEN 'unknown' WHEN a IS NULL THEN bad WHEN a <> z THEN 'ambiguous' END AS refusal FROM n LEFT JOIN f USING (name)""")
def resolved_names(spark, sf_dir):
    k = F.col("p_partkey")
    to = F.when((k % 10).between(1, 6), k - 1).when(k % 10 == 7, k + 1).when(k % 10 == 8, k - 1).when(k % 30 == 29, F.lit(1_000_000_007))
    part = _t(spark, sf_dir, "part")
    backbone = part.select(k.alias("key"), to.alias("accepted_key"), F.concat(F.lit("Part-N\u00f3  "), F.when(k % 50 == 19, k - 9).otherwise(k)).alias("name"), (k % 90).alias("confidence"))
    asked = F.when(k % 4 == 0, F.concat(F.lit("part no "), k)).when(k % 4 == 1, F.concat(F.lit(" P\u00e1rt n'O "), k)).when(k % 4 == 2, F.concat(F.lit("PART no. "), k + 3)).when(k % 8 == 3, " - ").otherwise(F.concat(F.lit("nothing "), k))
    out = names.resolved(part.select(k.alias("id"), asked.alias("name")), backbone, "name", least_confidence=5)
    return out.select("id", "accepted_key", "refusal")
