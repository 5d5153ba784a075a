"""Further queries on the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import atlas, gate, grids, hygiene, panels, passage, ranges
from ..sources import lake
from .registry import _FIX, _KM, _OWN_CELLS, _PLACE, _QUANTILES, _SNAP, _STATION, _SURVEY, _fixes, _quantiles, _r, _stations, _surface, _survey, _t, card_cells, query

_PANEL = "SELECT l_suppkey, year, q50_doy FROM pq WHERE q50_doy IS NOT NULL"


def _panel(spark, sf_dir):
    return _quantiles(spark, sf_dir).dropna(subset=["q50_doy"])


@query(f"WITH {_QUANTILES}, own AS ({_PANEL}), spans AS (SELECT l_suppkey FROM own GROUP BY 1 HAVING count(DISTINCT year) FILTER (year < 1998) >= 2 AND count(DISTINCT year) FILTER (year >= 1998) >= 2) SELECT l_suppkey, count(*) AS years FROM own JOIN spans USING (l_suppkey) GROUP BY 1")
def balanced_panel(spark, sf_dir):
    return panels.balanced_panel(_panel(spark, sf_dir), "l_suppkey", "year", 1998, 2).groupBy("l_suppkey").agg(F.count("*").alias("years"))


@query(f"WITH {_QUANTILES}, own AS ({_PANEL}), m AS (SELECT l_suppkey, avg(q50_doy) FILTER (year < 1998) AS a, avg(q50_doy) FILTER (year >= 1998) AS b FROM own GROUP BY 1 HAVING count(DISTINCT year) FILTER (year < 1998) >= 2 AND count(DISTINCT year) FILTER (year >= 1998) >= 2) SELECT count(*) AS stations, round(avg(a), 4) AS before, round(avg(b), 4) AS after, round(avg(b - a), 4) AS change FROM m")
def era_comparison(spark, sf_dir):
    return _r(panels.era_comparison(_panel(spark, sf_dir), "l_suppkey", "year", "q50_doy", 1998, 2), "before", "after", "change", places=4)


@query(f"""WITH {_QUANTILES}, g AS (SELECT l_suppkey, year(l_shipdate) AS year, avg(l_discount::DOUBLE) AS x1, avg(l_tax::DOUBLE) AS x2 FROM lineitem GROUP BY ALL),
s AS (SELECT l_suppkey, count(*) AS n, covar_pop(x1, x1) AS aa, covar_pop(x2, x2) AS bb, covar_pop(x1, x2) AS ab, covar_pop(x1, q50_doy) AS ay, covar_pop(x2, q50_doy) AS b_y, covar_pop(year, year) AS tt, covar_pop(year, q50_doy) AS ty, covar_pop(year, x1) AS ta FROM pq JOIN g USING (l_suppkey, year) WHERE q50_doy IS NOT NULL GROUP BY 1)
SELECT l_suppkey, n, round((bb * ay - ab * b_y) / (aa * bb - ab * ab), 3) AS on_x1, round((aa * b_y - ab * ay) / (aa * bb - ab * ab), 3) AS on_x2, round(ty / tt, 4) AS y_trend, round(ta / tt, 6) AS x1_trend, round(ab / sqrt(aa * bb), 5) AS driver_r FROM s WHERE n >= 4 AND tt > 0 AND aa * bb - ab * ab > 1e-9 * aa * bb""")
def driver_fit(spark, sf_dir):
    g = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.avg(F.col("l_discount").cast("double")).alias("x1"), F.avg(F.col("l_tax").cast("double")).alias("x2"))
    fit = panels.driver_fit(_panel(spark, sf_dir).join(g, ["l_suppkey", "year"]), ["l_suppkey"], "q50_doy", "x1", "x2", "year")
    return _r(_r(_r(_r(fit, "on_x1", "on_x2", places=3), "y_trend", places=4), "x1_trend", places=6), "driver_r")


@query(f"WITH {_QUANTILES}, t AS (SELECT l_suppkey, regr_slope(q10_doy, year) * 10 AS a, regr_slope(q50_doy, year) * 10 AS b FROM pq WHERE q10_doy IS NOT NULL AND q50_doy IS NOT NULL GROUP BY 1 HAVING count(*) >= 4) SELECT count(*) AS n, round(avg(a - b), 4) AS difference, round(1.96 * stddev_samp(a - b) / sqrt(count(*)), 4) AS ci, round(corr(a, b), 5) AS r, abs(avg(a - b)) > 1.96 * stddev_samp(a - b) / sqrt(count(*)) AS differs FROM t")
def paired_slopes(spark, sf_dir):
    t = passage.decade_trends(_quantiles(spark, sf_dir), ["l_suppkey"], "year", ["q10_doy", "q50_doy"], min_years=4)
    one, two = (t.select("l_suppkey", F.col(f"{c}_per_decade").alias("b")) for c in ("q10_doy", "q50_doy"))
    return _r(_r(panels.paired_slopes(one, two, ["l_suppkey"], "b"), "difference", "ci", places=4), "r")


@query("WITH d AS (SELECT l_suppkey, l_shipdate, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL) SELECT l_suppkey, count(*) AS nights, round(sum(v), 3) AS total FROM d WHERE NOT EXISTS (SELECT 1 FROM d AS s WHERE s.v < 20 AND s.l_suppkey = d.l_suppkey AND s.l_shipdate = d.l_shipdate) GROUP BY 1")
def without_slow_nights(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_shipdate").agg(F.sum("l_quantity").cast("double").alias("v"))
    kept = panels.without(d, d.where("v < 20"), ["l_suppkey", "l_shipdate"])
    return _r(kept.groupBy("l_suppkey").agg(F.count("*").alias("nights"), F.sum("v").alias("total")), "total", places=3)


_WEEKS = "w AS (SELECT l_returnflag AS flag, least((dayofyear(l_shipdate) - 1) // 7, 51)::INTEGER AS week, avg(l_quantity::DOUBLE) AS v FROM lineitem GROUP BY ALL)"


def _weeks(spark, sf_dir):
    week = F.least(F.floor((F.dayofyear("l_shipdate") - 1) / 7), F.lit(51)).cast("int")
    return _t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), week.alias("week")).agg(F.avg(F.col("l_quantity").cast("double")).alias("v"))


@query(f"WITH {_WEEKS}, s AS (SELECT *, v - lag(v) OVER (PARTITION BY flag ORDER BY week) AS d FROM w) SELECT flag, week, round(CASE WHEN d IS NULL THEN 0 ELSE greatest(CASE WHEN week < 26 THEN d ELSE -d END, 0) END, 5) AS flux FROM s")
def rate_of_change(spark, sf_dir):
    return _r(panels.rate_of_change(_weeks(spark, sf_dir), ["flag"], "week", "v", F.col("week") < 26).select("flag", "week", "flux"), "flux")


@query(f"WITH {_WEEKS} SELECT flag, arg_max(week, (v, -week)) AS peak_day, round(sum(v) FILTER (week BETWEEN 22 AND 34) / sum(v), 5) AS share FROM w GROUP BY 1")
def peak_and_share(spark, sf_dir):
    return _r(panels.peak_and_share(_weeks(spark, sf_dir), ["flag"], "week", "v", (22, 34)), "share")


@query("WITH m AS (SELECT l_returnflag AS flag, month(l_shipdate) AS month, avg(l_quantity::DOUBLE) AS mean FROM lineitem GROUP BY ALL) SELECT flag, month, round(mean, 5) AS mean, round(mean / sum(mean) OVER (PARTITION BY flag), 6) AS share FROM m")
def group_shares(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.month("l_shipdate").alias("month"), F.col("l_quantity").cast("double").alias("v"))
    return _r(_r(panels.group_shares(d, ["flag"], ["month"], "v"), "mean"), "share", places=6)


@query("SELECT user_id, (ts::DATE - 1)::DATE AS night, count(*) AS n, round(avg(value), 5) AS value FROM events WHERE hour(ts) IN (0, 3, 6, 9) GROUP BY ALL")
def nightly_means(spark, sf_dir):
    return _r(panels.nightly_means(_t(spark, sf_dir, "events"), ["user_id"], "ts", "value"), "value")


@query("SELECT c_custkey, c_nationkey, round(c_acctbal::DOUBLE - avg(c_acctbal::DOUBLE) OVER (PARTITION BY c_nationkey), 4) AS c_acctbal_centred FROM customer")
def centred(spark, sf_dir):
    d = _t(spark, sf_dir, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("double"))
    return _r(hygiene.centred(d, ["c_nationkey"], ["c_acctbal"]).select("c_custkey", "c_nationkey", "c_acctbal_centred"), "c_acctbal_centred", places=4)


@query(f"""WITH {_FIX}, e AS (SELECT user_id, median(lat) FILTER (dayofyear(ts) <= 8) AS winter, median(lat) FILTER (dayofyear(ts) BETWEEN 20 AND 40) AS summer, max(ts) FILTER (dayofyear(ts) <= 8) AS a, min(ts) FILTER (dayofyear(ts) BETWEEN 20 AND 40) AS b FROM x GROUP BY 1)
SELECT user_id, round(winter, 4) AS winter, round(summer, 4) AS summer, round(summer - winter, 4) AS displacement, (SELECT count(*) FROM x WHERE x.user_id = e.user_id AND ts BETWEEN a AND b) AS fixes FROM e WHERE winter IS NOT NULL AND summer IS NOT NULL""")
def seasonal_displacement(spark, sf_dir):
    return _r(panels.seasonal_displacement(_fixes(spark, sf_dir), ["user_id"], "ts", "lat", (1, 8), (20, 40)), "winter", "summer", "displacement", places=4)


@query(f"""WITH {_FIX}, e AS (SELECT user_id, median(lat) FILTER (dayofyear(ts) <= 8) AS la1, median(lon) FILTER (dayofyear(ts) <= 8) AS lo1, median(lat) FILTER (dayofyear(ts) BETWEEN 20 AND 40) AS la2, median(lon) FILTER (dayofyear(ts) BETWEEN 20 AND 40) AS lo2, max(ts) FILTER (dayofyear(ts) <= 8) AS a, min(ts) FILTER (dayofyear(ts) BETWEEN 20 AND 40) AS b FROM x GROUP BY 1),
w AS (SELECT user_id, {_KM.format('lag(lat) OVER w', 'lat', 'lag(lon) OVER w', 'lon')} AS km, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86400000000 AS days FROM x JOIN e USING (user_id) WHERE ts BETWEEN a AND b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT user_id, count(*) AS fixes, sum(km) AS km, median(days) AS days FROM w GROUP BY 1)
SELECT user_id, round({_KM.format('la1', 'la2', 'lo1', 'lo2')}, 3) AS displacement_km, coalesce(fixes, 0) AS fixes, round(km, 3) AS path_km, round(days, 5) AS gap_days FROM e LEFT JOIN p USING (user_id) WHERE la1 IS NOT NULL AND la2 IS NOT NULL""")
def seasonal_path(spark, sf_dir):
    return _r(_r(panels.seasonal_path(_fixes(spark, sf_dir), ["user_id"], "ts", "lat", "lon", (1, 8), (20, 40), "event_id"), "displacement_km", "path_km", places=3), "gap_days")


@query(f"WITH {_FIX} SELECT user_id, year(ts) AS year, count(*) AS fixes, count(DISTINCT month(ts)) AS months, round(avg(lat), 5) AS mean_lat, round(max(lat) - min(lat), 5) AS lat_range, count(DISTINCT event_type) AS sensors FROM x GROUP BY ALL HAVING count(*) >= 5 AND count(DISTINCT month(ts)) >= 1")
def individual_years(spark, sf_dir):
    return _r(panels.individual_years(_fixes(spark, sf_dir), "user_id", "ts", "lat", "event_type", min_fixes=5, min_months=1), "mean_lat", "lat_range")


@query(f"WITH {_FIX} SELECT floor(lat) AS cy, floor(lon) AS cx, count(DISTINCT year(ts)) AS years, count(*) AS rows, count(DISTINCT event_type) AS sensors, max(year(ts)) - min(year(ts)) + 1 AS span FROM x GROUP BY ALL")
def cell_coverage(spark, sf_dir):
    d = _fixes(spark, sf_dir).withColumns({"cy": F.floor("lat").cast("double"), "cx": F.floor("lon").cast("double")})
    return grids.cell_coverage(d, ["cy", "cx"], "ts", "event_type")


_NEAR = f"""st AS (SELECT station, lon + 0.13::DOUBLE * (station % 7) AS lon, lat + 0.29::DOUBLE * (station % 5) AS lat FROM (SELECT {_STATION} FROM supplier)), g AS (SELECT c_custkey AS cell, lon, lat FROM (SELECT c_custkey, ((c_custkey * 37) % 360) - 180 + 0.5 AS lon, ((c_custkey * 17) % 120) - 60 + 0.5 AS lat FROM customer)),
n AS (SELECT station, min((sqrt(pow((g.lon - st.lon) * cos(radians(st.lat)), 2) + pow(g.lat - st.lat, 2)), cell)) AS b FROM st JOIN g ON abs(g.lon - st.lon) <= 10 AND abs(g.lat - st.lat) <= 10 GROUP BY 1)"""


def _near(spark, sf_dir):
    cells = _surface(spark, sf_dir).select(F.col("k").alias("cell"), "lon", "lat")
    k = F.col("station")
    off_centre = _stations(spark, sf_dir).withColumns({"lon": F.col("lon") + 0.13 * (k % 7), "lat": F.col("lat") + 0.29 * (k % 5)})
    return grids.nearest_cells(off_centre, cells, "station", "cell", reach=10.0)


@query(f"WITH {_NEAR} SELECT s_suppkey AS station, b[2] AS cell, round(b[1] * 111, 4) AS error_km FROM supplier LEFT JOIN n ON station = s_suppkey")
def nearest_cells(spark, sf_dir):
    return _r(_near(spark, sf_dir), "error_km", places=4)


@query(f"WITH {_NEAR} SELECT count(*) AS points, count(DISTINCT b[2]) AS cells, round(median(b[1] * 111), 4) AS median_error_km, round(max(b[1] * 111), 4) AS max_error_km FROM supplier LEFT JOIN n ON station = s_suppkey")
def match_report(spark, sf_dir):
    return _r(grids.match_report(_near(spark, sf_dir), "cell"), "median_error_km", "max_error_km", places=4)


@query(f"WITH {_NEAR} SELECT station, month(o_orderdate) AS month, count(*) AS n, round(avg(o_totalprice::DOUBLE), 3) AS value FROM n JOIN orders ON o_custkey = b[2] GROUP BY ALL")
def sampled_at_cells(spark, sf_dir):
    grid = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cell"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("k"), F.sum(F.col("o_totalprice").cast("double")).alias("s"))
    out = grids.sampled(grid, _near(spark, sf_dir), "station", "cell")
    return _r(out.groupBy("station", "month").agg(F.sum("k").alias("n"), (F.sum("s") / F.sum("k")).alias("value")), "value", places=3)


@query("""WITH y AS (SELECT o_orderstatus AS source, o_orderpriority AS unit, o_custkey % 100 AS cell, count(DISTINCT year(o_orderdate)) AS y FROM orders GROUP BY ALL), b AS (SELECT source, cell, max(y) AS y FROM y GROUP BY ALL)
SELECT cell, max(least(CASE WHEN y >= 6 THEN 3 WHEN y >= 4 THEN 2 WHEN y >= 2 THEN 1 ELSE 0 END, CASE source WHEN 'F' THEN 3 WHEN 'O' THEN 2 WHEN 'P' THEN 1 ELSE 0 END)) AS status FROM b GROUP BY 1""")
def detectability(spark, sf_dir):
    d = _t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("unit"), (F.col("o_custkey") % 100).alias("cell"), F.year("o_orderdate").alias("year"))
    return grids.detectability(d, "source", "unit", ["cell"], "year", {"F": 3, "O": 2, "P": 1}, [(2, 1), (4, 2), (6, 3)])


@query("SELECT count(*) AS n, round(sum(l_quantity::DOUBLE), 3) AS total FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 AND l_discount BETWEEN 0.01 AND 0.08")
def plausible_rows(spark, sf_dir):
    d = hygiene.plausible(_t(spark, sf_dir, "lineitem"), {"l_quantity": (5, 45), "l_discount": (0.01, 0.08)})
    return _r(d.agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("double")).alias("total")), "total", places=3)


@query("SELECT count(*) AS rows, count_if(coalesce(value, -1) >= 0 AND event_type <> 'error' AND user_id IS NOT NULL) AS kept, count_if(user_id IS NULL) AS dropped_nameless, count_if(user_id IS NOT NULL AND (value IS NULL OR value < 0)) AS dropped_negative, count_if(user_id IS NOT NULL AND value >= 0 AND (event_type IS NULL OR event_type = 'error')) AS dropped_error FROM events")
def drop_counts(spark, sf_dir):
    return hygiene.drop_counts(_t(spark, sf_dir, "events"), {"nameless": F.col("user_id").isNull(), "negative": F.col("value") < 0, "error": F.col("event_type") == "error"})


@query("WITH k AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(year(o_orderdate)) - min(year(o_orderdate)) + 1 >= 6) SELECT o_custkey, count(*) AS n FROM orders JOIN k USING (o_custkey) GROUP BY 1")
def spanning_keys(spark, sf_dir):
    return hygiene.spanning(_t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", 6).groupBy("o_custkey").agg(F.count("*").alias("n"))


_NAMED = "n AS (SELECT p_size, p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey END AS k, CASE p_partkey % 7 WHEN 0 THEN '   ' WHEN 1 THEN upper(p_brand) || '  X ' WHEN 2 THEN p_brand || ' x' WHEN 3 THEN NULL ELSE p_brand END AS name FROM part), a AS (SELECT *, nullif(trim(regexp_replace(lower(name), '\\s+', ' ', 'g')), '') AS plain FROM n), f AS (SELECT *, CASE WHEN k IS NULL AND plain IS NULL THEN 'no key and no name' WHEN coalesce(k IN (7, 11, 13), false) OR coalesce(plain IN ('brand#12', 'brand#33 x'), false) THEN 'never stored' END AS refusal FROM a)"


def _admitted(spark, sf_dir):
    """Parts under names with blanks, double spaces and capitals, some without key or name."""
    k, brand = F.col("p_partkey"), F.col("p_brand")
    name = F.when(k % 7 == 0, "   ").when(k % 7 == 1, F.concat(F.upper(brand), F.lit("  X "))).when(k % 7 == 2, F.concat(brand, F.lit(" x"))).when(k % 7 != 3, brand)
    named = _t(spark, sf_dir, "part").select("p_size", "p_partkey", F.when(k % 5 != 0, k).alias("k"), name.alias("name"))
    return hygiene.admit_rows(named, "k", "name", [7, 11, 13], [" brand#12", "BRAND#33   X"])


@query(f"WITH {_NAMED} SELECT refusal, count(*) AS n FROM f GROUP BY 1")
def admitted_rows(spark, sf_dir):
    return _admitted(spark, sf_dir).groupBy("refusal").agg(F.count("*").alias("n"))


@query(f"WITH {_NAMED} SELECT p_size, count(*) AS rows, coalesce(string_agg(DISTINCT plain, ',' ORDER BY plain), '') AS labels, string_agg(DISTINCT p_partkey % 3 + 1990, ',' ORDER BY p_partkey % 3 + 1990) AS years FROM f WHERE refusal = 'never stored' GROUP BY 1")
def floor_report(spark, sf_dir):
    return hygiene.floor_report(_admitted(spark, sf_dir).withColumn("plain", lake.plain_name(F.col("name"))), "p_size", "plain", F.col("p_partkey") % 3 + 1990)


@query("SELECT DISTINCT c_nationkey, CASE WHEN n_nationkey IS NULL THEN 'unregistered' WHEN n_regionkey = 0 THEN 'unclassified' WHEN n_regionkey = 1 THEN 'unlicensed' END AS refusal FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey <> 4")
def admitted_sources(spark, sf_dir):
    registry = _t(spark, sf_dir, "nation").where("n_nationkey <> 4").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") != 0).alias("classified"), (F.col("n_regionkey") != 1).alias("licensed"))
    return hygiene.admit_sources(_t(spark, sf_dir, "customer"), registry, "c_nationkey")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def shortfall(spark, sf_dir):
    return hygiene.shortfall(_t(spark, sf_dir, "customer").select("c_custkey"), _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3")
def having_all_kinds(spark, sf_dir):
    return hygiene.having_all(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min(o_orderdate)::DATE::VARCHAR AS o_orderdate FROM orders GROUP BY 1")
def first_rows(spark, sf_dir):
    d = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return hygiene.first_rows(d, ["o_custkey"], ["o_orderdate", "o_orderkey"]).withColumn("o_orderdate", F.to_date("o_orderdate").cast("string"))


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS sites, count(*) AS rows, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year FROM orders GROUP BY 1")
def coverage_facts(spark, sf_dir):
    return hygiene.coverage_facts(_t(spark, sf_dir, "orders"), ["o_orderstatus"], "o_custkey", "o_orderdate")


@query("SELECT o_custkey, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) ELSE 'mixed' END AS value_kind FROM orders GROUP BY 1")
def value_kind(spark, sf_dir):
    return hygiene.value_kind(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@query("SELECT p_brand, count(DISTINCT p_size) AS cells FROM part GROUP BY 1 ORDER BY cells DESC, p_brand LIMIT 12")
def widest_ranging(spark, sf_dir):
    d = _t(spark, sf_dir, "part").groupBy("p_brand").agg(F.countDistinct("p_size").alias("cells"))
    return hygiene.top_rows(d, [F.desc("cells"), F.col("p_brand")], 12)


_EPOCH = "(year(o_orderdate) >= 1998)"
_EPOCHS = f"""{_OWN_CELLS.replace('month(o_orderdate)', f"{_EPOCH}::INT")}, e AS (SELECT cell, month AS epoch, count(DISTINCT card) AS n FROM c GROUP BY ALL), r AS (SELECT cell, month AS epoch, species, count(DISTINCT card) AS k FROM c GROUP BY ALL),
d AS (SELECT s.species, e.epoch, e.cell, coalesce(r.k, 0) AS k, e.n FROM e CROSS JOIN (SELECT DISTINCT species FROM c) AS s LEFT JOIN r ON r.cell = e.cell AND r.epoch = e.epoch AND r.species = s.species),
own AS (SELECT species, epoch, count(*) AS cells, count_if(k > 0) AS seen, sum(k)::DOUBLE AS ks, (sum(n) FILTER (k > 0))::DOUBLE AS ns FROM d GROUP BY ALL), silent AS (SELECT species, epoch, n AS m, count(*) AS c FROM d WHERE k = 0 GROUP BY ALL),
em AS (SELECT species, epoch, 0 AS i, seen::DOUBLE / cells AS psi, least(ks / ns, 0.999) AS p FROM own WHERE seen > 0
  UNION ALL
  SELECT species, epoch, i + 1, (any_value(seen) + coalesce(sum(z), 0)) / any_value(cells), any_value(ks) / (any_value(ns) + coalesce(sum(z * m), 0))
  FROM (SELECT em.species, em.epoch, em.i, seen, cells, ks, ns, m, c * psi * pow(1 - p, m) / (psi * pow(1 - p, m) + 1 - psi) AS z FROM em JOIN own USING (species, epoch) LEFT JOIN silent USING (species, epoch) WHERE em.i < 100) GROUP BY species, epoch, i),
f AS (SELECT own.species, own.epoch, own.cells, own.seen, ks, ns, coalesce(psi, 0) AS psi, p FROM own LEFT JOIN (SELECT * FROM em WHERE i = 100) AS fit USING (species, epoch))"""


def _cells_by_epoch(spark, sf_dir):
    return card_cells(spark, sf_dir, f"int({_EPOCH})")


def _sums(spark, sf_dir):
    detections, effort = _cells_by_epoch(spark, sf_dir)
    return atlas.card_sums(detections, effort, "species", ["epoch"], "k", "n")


@query(f"WITH RECURSIVE {_EPOCHS} SELECT species, epoch, round(sum(CASE WHEN k > 0 THEN ln(psi) + k * ln(p) + CASE WHEN n > k THEN (n - k) * ln(1 - p) ELSE 0 END ELSE ln(psi * pow(1 - p, n) + 1 - psi) END), 3) AS loglik FROM d JOIN f USING (species, epoch) WHERE seen > 0 GROUP BY ALL")
def occupancy_likelihood(spark, sf_dir):
    sums = _sums(spark, sf_dir)
    fits = atlas.fit_occupancy(sums, ["species", "epoch"]).where("seen > 0").select("species", "epoch", "psi", "p")
    return _r(sums.join(fits, ["species", "epoch"]).select("species", "epoch", atlas.sums_likelihood(F.col("psi"), F.col("p")).alias("loglik")), "loglik", places=3)


@query(f"""WITH RECURSIVE {_EPOCHS}, l AS (SELECT species, epoch, seen, psi, seen * ln(psi) + ks * ln(p) + CASE WHEN ns > ks THEN (ns - ks) * ln(1 - p) ELSE 0 END + coalesce((SELECT sum(c * ln(psi * pow(1 - p, m) + 1 - psi)) FROM silent WHERE silent.species = f.species AND silent.epoch = f.epoch), 0) - 1.920729410347062 AS mark FROM f WHERE seen > 0),
grid AS (SELECT species, epoch, unnest(range(1, 100)) / 100.0::DOUBLE AS x FROM l),
pm AS (SELECT species, epoch, x, 0 AS i, least(ks / ns, 0.999) AS p FROM grid JOIN own USING (species, epoch)
  UNION ALL
  SELECT species, epoch, x, i + 1, any_value(ks) / (any_value(ns) + coalesce(sum(c * m * x * pow(1 - p, m) / (x * pow(1 - p, m) + 1 - x)), 0)) FROM pm JOIN own USING (species, epoch) LEFT JOIN silent USING (species, epoch) WHERE i < 100 GROUP BY species, epoch, x, i),
curve AS (SELECT species, epoch, x, any_value(seen) * ln(x) + any_value(ks) * ln(p) + CASE WHEN any_value(ns) > any_value(ks) THEN (any_value(ns) - any_value(ks)) * ln(1 - p) ELSE 0 END + coalesce(sum(c * ln(x * pow(1 - p, m) + 1 - x)), 0) AS y FROM pm JOIN own USING (species, epoch) LEFT JOIN silent USING (species, epoch) WHERE i = 100 GROUP BY species, epoch, x, p),
o AS (SELECT species, epoch, psi, x, y - mark AS over FROM curve JOIN l USING (species, epoch) UNION ALL SELECT species, epoch, psi, psi, 1.920729410347062 FROM l),
b AS (SELECT species, epoch, any_value(psi) AS psi, max(x) FILTER (x < psi AND over < 0) AS a1, arg_max(over, x) FILTER (x < psi AND over < 0) AS o1, min(x) FILTER (over >= 0) AS a2, arg_min(over, x) FILTER (over >= 0) AS o2, max(x) FILTER (over >= 0) AS a3, arg_max(over, x) FILTER (over >= 0) AS o3, min(x) FILTER (x > psi AND over < 0) AS a4, arg_min(over, x) FILTER (x > psi AND over < 0) AS o4 FROM o GROUP BY ALL)
SELECT species, epoch, round(psi, 4) AS psi, round(coalesce(a1 + (a2 - a1) * o1 / (o1 - o2), 0), 4) AS low, round(CASE WHEN a4 IS NULL THEN 1 ELSE a3 + (a4 - a3) * o3 / (o3 - o4) END, 4) AS high FROM b""")
def occupancy_interval(spark, sf_dir):
    sums = _sums(spark, sf_dir).where("seen > 0")
    return _r(atlas.profile_interval(sums, ["species", "epoch"]), "psi", "low", "high", places=4)


@query(f"WITH RECURSIVE {_EPOCHS} SELECT cell, max(n) FILTER (epoch = 0) AS cards_first, max(n) FILTER (epoch = 1) AS cards_second FROM e WHERE n >= 5 GROUP BY 1 HAVING count(*) = 2")
def paired_footprint(spark, sf_dir):
    return atlas.paired_footprint(_cells_by_epoch(spark, sf_dir)[1], "cell", "epoch", "n", least=5)


_CHANGES = f"{_EPOCHS}, g AS (SELECT a.species, a.seen AS seen_first, b.seen AS seen_second, b.psi - a.psi AS d_psi, b.seen::DOUBLE / b.cells - a.seen::DOUBLE / a.cells AS d_naive, b.p - a.p AS d_p, a.psi > 0.999 OR b.psi > 0.999 AS boundary FROM f AS a JOIN f AS b ON a.species = b.species AND a.epoch = 0 AND b.epoch = 1 WHERE a.seen >= 30)"


def _changes(spark, sf_dir):
    return atlas.epoch_changes(atlas.fit_occupancy(_sums(spark, sf_dir), ["species", "epoch"]), "species", "epoch")


@query(f"WITH RECURSIVE {_CHANGES} SELECT species, seen_first, seen_second, round(d_psi, 5) AS d_psi, round(d_naive, 5) AS d_naive, round(d_p, 5) AS d_p, boundary FROM g")
def epoch_changes(spark, sf_dir):
    return _r(_changes(spark, sf_dir), "d_psi", "d_naive", "d_p")


@query(f"WITH RECURSIVE {_CHANGES} SELECT count(*) AS taxa, round(median(d_psi), 5) AS median_d_psi, round(median(d_p), 5) AS median_d_p, round(avg((d_p > 0)::INT), 5) AS p_rose, count_if(abs(d_psi) > 0.02 AND abs(d_naive) > 0.02 AND sign(d_psi) <> sign(d_naive)) AS sign_flips, round(corr(d_psi, d_naive), 4) AS r FROM g")
def epoch_change_summary(spark, sf_dir):
    return _r(_r(atlas.change_summary(_changes(spark, sf_dir)), "median_d_psi", "median_d_p", "p_rose"), "r", places=4)


@query(f"WITH RECURSIVE {_CHANGES} SELECT species, seen_second FROM g WHERE seen_second < 800")
def dropped_by_stricter_rule(spark, sf_dir):
    return atlas.dropped_by_stricter_rule(_changes(spark, sf_dir), least_seen=800).select("species", "seen_second")


@query(f"WITH RECURSIVE {_EPOCHS} SELECT cell, count_if(k > 0) AS recorded, round(sum(CASE WHEN k > 0 THEN 1 WHEN psi * pow(1 - coalesce(p, 0), n) + 1 - psi = 0 THEN 0 ELSE psi * pow(1 - coalesce(p, 0), n) / (psi * pow(1 - coalesce(p, 0), n) + 1 - psi) END), 4) AS expected FROM d JOIN f USING (species, epoch) WHERE epoch = 0 GROUP BY 1")
def expected_taxa(spark, sf_dir):
    detections, effort = (x.where("epoch = 0") for x in _cells_by_epoch(spark, sf_dir))
    fits = atlas.fit_occupancy(_sums(spark, sf_dir), ["species", "epoch"]).where("epoch = 0")
    return _r(atlas.expected_taxa(detections, effort, fits, "species", "cell", "k", "n"), "expected", places=4)


@query(f"WITH {_SURVEY}, o AS (SELECT year, site, avg(CASE WHEN site % 10 < 2 * (year - 1995) THEN cpue END) AS v, avg(doy) AS d FROM s GROUP BY ALL) SELECT year, count(*) AS sites, round(avg(v), 5) AS ambient, round(avg((v IS NOT NULL)::INT), 5) AS share, round(avg(d), 4) AS mean_doy FROM o GROUP BY 1 HAVING avg((v IS NOT NULL)::INT) >= 0.5")
def available_environment(spark, sf_dir):
    measured = _survey(spark, sf_dir).withColumn("v", F.when(F.col("site") % 10 < 2 * (F.col("year") - 1995), F.col("cpue")))  # more sites measure each year
    return _r(_r(ranges.available(measured, "year", "site", "v", "doy"), "ambient", "share"), "mean_doy", places=4)


_SLOPES = "SELECT taxon, regr_sxy({0}, year) / regr_sxx({0}, year) AS slope, sqrt(greatest(regr_syy({0}, year) - regr_sxy({0}, year) / regr_sxx({0}, year) * regr_sxy({0}, year), 0) / (count(*) - 2) / regr_sxx({0}, year)) AS se FROM y GROUP BY 1 HAVING count(*) >= 4"


_WARMTH = "10 + 0.1 * (site % 3) * (year - 1995) - 0.02 * lat"


@query(f"WITH {_SURVEY}, y AS (SELECT taxon, year, sum(({_WARMTH}) * cpue) / sum(cpue) AS o, avg({_WARMTH}) AS a FROM s GROUP BY ALL), o AS ({_SLOPES.format('o')}), a AS ({_SLOPES.format('a')}) SELECT taxon, round(o.slope, 4) AS occupied, round(a.slope, 4) AS ambient, round(CASE WHEN abs(a.slope) > 1.96 * a.se THEN 1 - o.slope / a.slope END, 3) AS tracking FROM o JOIN a USING (taxon)")
def tracking_index(spark, sf_dir):
    d = _survey(spark, sf_dir).withColumn("w", F.expr(_WARMTH).cast("double"))  # sites warm at three rates
    y = d.groupBy("taxon", "year").agg((F.sum(F.col("w") * F.col("cpue")) / F.sum("cpue")).alias("o"), F.avg("w").alias("a"))
    one, two = (passage.trend_with_error(y, ["taxon"], "year", c, min_n=4) for c in ("o", "a"))
    return _r(_r(ranges.tracking_index(one, two, ["taxon"]), "occupied", "ambient", places=4), "tracking", places=3)


@query(f"WITH {_SURVEY}, y AS (SELECT taxon, year, avg(doy) AS d FROM s GROUP BY ALL) SELECT taxon, round(slope, 4) AS slope, round(se, 4) AS se FROM ({_SLOPES.format('d')})")
def date_drift(spark, sf_dir):
    y = _survey(spark, sf_dir).groupBy("taxon", "year").agg(F.avg("doy").alias("d"))
    return _r(passage.trend_with_error(y, ["taxon"], "year", "d", min_n=4).select("taxon", "slope", "se"), "slope", "se", places=4)


_DECIDED = "q AS (SELECT c_mktsegment AS taxon, CASE WHEN count(*) % 2 = 0 THEN 'publish' ELSE 'withhold' END AS decision, CASE WHEN length(c_mktsegment) <> 9 THEN 5.0 * (1 + length(c_mktsegment) % 3) END AS grid FROM customer GROUP BY 1)"


def _decided(spark, sf_dir):
    return _t(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("taxon")).agg(F.when(F.count("*") % 2 == 0, "publish").otherwise("withhold").alias("decision"), F.when(F.max(F.length("c_mktsegment")) != 9, 5.0 * (1 + F.max(F.length("c_mktsegment")) % 3)).alias("grid"))


@query(f"WITH c AS (SELECT {_PLACE} FROM customer), {_DECIDED} SELECT * FROM (SELECT taxon, coalesce({_SNAP.format('lon', 'grid')}, lon)::DOUBLE AS lon, coalesce({_SNAP.format('lat', 'grid')}, lat)::DOUBLE AS lat, round(sum(value), 3) AS value FROM c JOIN q USING (taxon) WHERE decision = 'publish' GROUP BY ALL) QUALIFY count(*) OVER (PARTITION BY taxon) >= 3")
def exported_taxa(spark, sf_dir):
    out, _ = gate.export_taxa(_surface(spark, sf_dir).drop("k"), _decided(spark, sf_dir), "taxon", "lon", "lat", "value")
    return _r(out, "value", places=3)


@query(f"WITH {_DECIDED} SELECT taxon, 'withheld' AS why FROM q WHERE decision <> 'publish'")
def withheld_taxa(spark, sf_dir):
    return gate.export_taxa(_surface(spark, sf_dir).drop("k"), _decided(spark, sf_dir), "taxon", "lon", "lat", "value")[1]


@query("""SELECT o_orderkey, (CASE WHEN given THEN greatest(5.0, own_grid) ELSE 5.0 END)::DOUBLE AS grid, (CASE WHEN given THEN own_delay ELSE 30 END)::INTEGER AS delay_days, CASE WHEN reason IS NULL OR given AND sensitivity = 'high' THEN 'publish' ELSE 'withhold' END AS decision
FROM (SELECT *, permitted AND sensitivity <> 'embargoed' AS given FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'embargoed' ELSE 'low' END AS sensitivity, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'policy' END AS reason, o_custkey % 3 = 0 AS permitted, CASE WHEN o_custkey % 2 = 0 THEN 10.0 END AS own_grid, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 7 ELSE 0 END AS own_delay FROM orders))""")
def owner_permissions(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    reason = F.when(status.isin("F", "O"), "policy")
    decisions = o.select("o_orderkey", "o_custkey", F.when(status == "F", "high").when(status == "O", "embargoed").otherwise("low").alias("sensitivity"), reason.alias("reason"), F.when(reason.isNull(), "publish").otherwise("withhold").alias("decision"), F.lit(5.0).alias("grid"), F.lit(30).alias("delay_days"), F.lit(True).alias("drop_ids"))
    permissions = o.where("o_custkey % 3 = 0").select("o_custkey", F.when(F.col("o_custkey") % 2 == 0, F.lit(10.0)).alias("own_grid"), F.when(F.col("o_custkey") % 5 != 0, (F.col("o_custkey") % 7).cast("int")).alias("own_delay_days"), F.lit(False).alias("own_drop_ids")).distinct()
    return gate.with_permission(decisions, permissions, ["o_custkey"]).select("o_orderkey", "grid", "delay_days", "decision")


@query("""SELECT c_mktsegment AS taxon, CASE WHEN c_nationkey % 6 = 5 OR c_nationkey % 6 = 4 THEN 'withheld: not published' ELSE coalesce(nullif(concat_ws('; ', CASE c_nationkey % 3 WHEN 0 THEN 'positions to 1.0 degrees' WHEN 1 THEN 'positions to 2.5 degrees' END, CASE WHEN c_nationkey % 4 > 0 THEN 'delayed by ' || (c_nationkey % 4 * 10) || ' days' END, CASE WHEN c_nationkey % 2 = 0 THEN 'identifiers removed' END), ''), 'none') END AS said, count(*) AS n FROM customer GROUP BY ALL""")
def generalisation_statements(spark, sf_dir):
    k = F.col("c_nationkey")
    grid = F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 2.5)
    said = gate.statement(grid, (k % 4 * 10).cast("int"), k % 2 == 0, F.when(k % 6 != 5, k % 6 == 4))
    return _t(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("taxon"), said.alias("said")).agg(F.count("*").alias("n"))
