"""Queries on layers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layers
from .registry import _FIX, _SNAP, _fixes, _t, query

_WEEK = "least((dayofyear({0}) - 1) // 7, 51)::INTEGER"


def _tenths(of):
    """Keys and tenths of a map's values as text, in order of keys; exact in both engines."""
    entries = F.transform(F.array_sort(F.map_entries(of)), lambda x: F.concat_ws("=", x["key"], F.round(x["value"] * 10).cast("int").cast("string")))
    return F.array_join(entries, ",")


@query(f"""WITH x AS (SELECT l_suppkey AS s, l_shipdate AS t, {_WEEK.format('l_shipdate')} AS week, l_quantity::DOUBLE AS q, radians((l_partkey * 29) % 360) AS a, l_quantity::DOUBLE / 10 AS v FROM lineitem WHERE l_shipdate IS NOT NULL AND l_shipdate <= TIMESTAMP '2000-12-31'),
m AS (SELECT s, week, round(median(m), 1) AS m, count(*) AS years FROM (SELECT s, week, year(t) AS y, median(q) AS m FROM x GROUP BY ALL) GROUP BY ALL),
f AS (SELECT s, week, median(u) AS u, median(w) AS w FROM (SELECT s, week, year(t) AS y, sum(q * v * sin(a)) / sum(q) AS u, sum(q * v * cos(a)) / sum(q) AS w FROM x GROUP BY ALL) GROUP BY ALL),
g AS (SELECT s, string_agg(k || '=' || n, ',' ORDER BY k) AS vectors FROM (SELECT s, 'sw' || week AS k, round(round(sqrt(u * u + w * w), 1) * 10)::INT AS n FROM f) GROUP BY 1),
w AS (SELECT s, string_agg(k || '=' || n, ',' ORDER BY k) AS values, count(*)::INT AS weeks_present, max(m) AS peak, max(years) AS years FROM (SELECT s, 'w' || week AS k, round(m * 10)::INT AS n, m, years FROM m) GROUP BY 1)
SELECT s AS station, {_SNAP.format('(((s * 37) % 360) - 180 + 0.5)', '5.0')}::DOUBLE AS lon, {_SNAP.format('(((s * 17) % 120) - 60 + 0.5)', '5.0')}::DOUBLE AS lat, weeks_present, peak, years, s % 3 AS flag, values, vectors FROM w JOIN g USING (s)""")
def station_series(spark, sf_dir):
    s = F.col("l_suppkey")
    d = _t(spark, sf_dir, "lineitem").select(s.alias("station"), (F.pmod(s * 37, F.lit(360)) - 180 + 0.5).cast("double").alias("lon"), (F.pmod(s * 17, F.lit(120)) - 60 + 0.5).cast("double").alias("lat"), "l_shipdate", F.col("l_quantity").cast("double").alias("q"), F.pmod(F.col("l_partkey") * 29, F.lit(360)).alias("dir"), (F.col("l_quantity").cast("double") / 10).alias("v"))
    flags = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), (F.col("s_suppkey") % 3).alias("flag"))
    out = layers.station_series(d.where("l_shipdate is not null"), "station", "lon", "lat", "l_shipdate", "q", direction="dir", speed="v", grid=5.0, cutoff=F.lit("2000-12-31").cast("timestamp_ntz"), annotations=flags)
    speeds = F.map_filter("vectors", lambda k, _: k.startswith("sw"))
    return out.select("station", "lon", "lat", "weeks_present", "peak", "years", "flag", _tenths("values").alias("values"), _tenths(speeds).alias("vectors"))


#: Animals that go north by a third of a degree a day.
_MOVED = f"{_FIX}, y AS (SELECT user_id, ts, lat + 0.3 * day(ts) AS lat, lon FROM x), k AS (SELECT DISTINCT user_id, {_WEEK.format('ts')} AS week, {_SNAP.format('lat', '1.0')} AS la, {_SNAP.format('lon', '1.0')} AS lo FROM y)"


@query(f"""WITH {_MOVED}, n AS (SELECT week, la, lo, count(*) AS animals FROM k GROUP BY ALL HAVING count(*) >= 3),
l AS (SELECT round(abs(la), 2)::DECIMAL(9, 1) || '°' || CASE WHEN la >= 0 THEN 'N' ELSE 'S' END || ' ' || round(abs(lo), 2)::DECIMAL(9, 1) || '°' || CASE WHEN lo >= 0 THEN 'E' ELSE 'W' END AS site, * FROM n)
SELECT site, any_value(lon) AS lon, any_value(lat) AS lat, count(*)::INT AS weeks_present, max(animals)::DOUBLE AS peak, string_agg('w' || week || '=' || animals * 10, ',' ORDER BY 'w' || week) AS values FROM (SELECT *, lo::DOUBLE AS lon, la::DOUBLE AS lat FROM l) GROUP BY 1""")
def weekly_presence(spark, sf_dir):
    moved = _fixes(spark, sf_dir).withColumn("lat", F.col("lat") + 0.3 * F.dayofmonth("ts"))
    out = layers.presence(moved, "user_id", "ts", "lat", "lon", cell_deg=1.0, floor_deg=1.0)
    return out.select("site", "lon", "lat", "weeks_present", "peak", _tenths("values").alias("values"))
