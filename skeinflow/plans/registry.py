"""All queries of the library outside the text subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo
from ..operators import atlas, gate, inference, passage, ranges, tracks
from ..sources import lake

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(df: DataFrame, *columns: str, places: int = 5) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flux by supplier and day."""
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_shipdate").agg(F.sum("l_quantity").cast("double").alias("v"))


_SEASON = {"spring": (60, 181)}
_QUANTILES = """
d AS (SELECT l_suppkey, l_shipdate, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL),
k AS (SELECT l_suppkey, year(l_shipdate) AS year, dayofyear(l_shipdate) AS doy, v FROM d WHERE dayofyear(l_shipdate) BETWEEN 60 AND 181),
c AS (SELECT *, sum(v) OVER w AS cum, lag(doy) OVER w AS d0, sum(v) OVER (PARTITION BY l_suppkey, year) AS total, count(*) OVER (PARTITION BY l_suppkey, year) AS n
  FROM k WINDOW w AS (PARTITION BY l_suppkey, year ORDER BY doy ROWS UNBOUNDED PRECEDING)),
p AS (SELECT l_suppkey, year, n AS observations, total, q, min_by(CASE WHEN d0 IS NULL THEN doy ELSE d0 + (q * total - (cum - v)) / v * (doy - d0) END, doy) FILTER (cum >= q * total) AS place
  FROM c, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) AS x(q) GROUP BY ALL),
pq AS (SELECT l_suppkey, year, observations, total, max(place) FILTER (q = 0.1) AS q10_doy, max(place) FILTER (q = 0.5) AS q50_doy, max(place) FILTER (q = 0.9) AS q90_doy
  FROM (SELECT l_suppkey, year, observations, total, q, CASE WHEN observations >= 10 AND total > 0 THEN place END AS place FROM p) GROUP BY ALL)
"""


def _quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage.passage_quantiles(_daily(spark, sf_dir), ["l_suppkey"], "l_shipdate", "v", seasons=_SEASON, min_observations=10)


@query(f"WITH {_QUANTILES} SELECT l_suppkey, year, 'spring' AS season, observations, round(total, 5) AS total, round(q10_doy, 5) AS q10_doy, round(q50_doy, 5) AS q50_doy, round(q90_doy, 5) AS q90_doy FROM pq")
def passage_quantiles(spark, sf_dir):
    return _r(_quantiles(spark, sf_dir), "total", "q10_doy", "q50_doy", "q90_doy")


@query(f"WITH {_QUANTILES} SELECT l_suppkey, count(*) AS years, round(regr_slope(q10_doy, year) * 10, 5) AS q10_doy_per_decade, round(regr_slope(q50_doy, year) * 10, 5) AS q50_doy_per_decade FROM pq WHERE q10_doy IS NOT NULL AND q50_doy IS NOT NULL GROUP BY 1 HAVING count(*) >= 4 AND var_pop(year) > 0")
def passage_trends(spark, sf_dir):
    return _r(passage.decade_trends(_quantiles(spark, sf_dir), ["l_suppkey"], "year", ["q10_doy", "q50_doy"], min_years=4), "q10_doy_per_decade", "q50_doy_per_decade")


_TREND = f"WITH {_QUANTILES}, s AS (SELECT l_suppkey, count(*) AS n, regr_sxx(q50_doy, year) AS sxx, regr_sxy(q50_doy, year) AS sxy, regr_syy(q50_doy, year) AS syy FROM pq WHERE q50_doy IS NOT NULL GROUP BY 1)"


@query(f"{_TREND} SELECT l_suppkey, n, round(sxy / sxx, 5) AS slope, round(sqrt(greatest(syy - sxy / sxx * sxy, 0) / (n - 2) / sxx), 5) AS se FROM s WHERE n >= 4 AND sxx > 0")
def trend_with_error(spark, sf_dir):
    return _r(passage.trend_with_error(_quantiles(spark, sf_dir), ["l_suppkey"], "year", "q50_doy", min_n=4).drop("distinguishable"), "slope", "se")


@query(f"""WITH {_QUANTILES}, m AS (SELECT l_suppkey, year::DOUBLE AS x, q50_doy AS y, (year >= 1998)::INT::DOUBLE AS s FROM pq WHERE q50_doy IS NOT NULL),
cc AS (SELECT l_suppkey, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(s, s) AS ss, covar_pop(x, s) AS xs, covar_pop(x, y) AS xy, covar_pop(s, y) AS sy FROM m GROUP BY 1)
SELECT l_suppkey, n, round(CASE WHEN ss > 0 AND xx * ss - xs * xs > 1e-9 * xx * ss THEN (ss * xy - xs * sy) / (xx * ss - xs * xs) ELSE xy / xx END * 10, 4) AS per_decade,
 round(CASE WHEN ss > 0 AND xx * ss - xs * xs > 1e-9 * xx * ss THEN (xx * sy - xs * xy) / (xx * ss - xs * xs) END, 4) AS step FROM cc WHERE n >= 4 AND xx > 0""")
def trend_with_break(spark, sf_dir):
    return _r(passage.trend_with_break(_quantiles(spark, sf_dir), ["l_suppkey"], "year", "q50_doy", 1998, min_n=4), "per_decade", "step", places=4)


_STATION = "s_suppkey AS station, ((s_suppkey * 37) % 360) - 180 + 0.5 AS lon, ((s_suppkey * 17) % 120) - 60 + 0.5 AS lat"


def _stations(spark, sf_dir):
    k = F.col("s_suppkey")
    return _t(spark, sf_dir, "supplier").select(k.alias("station"), (F.pmod(k * 37, F.lit(360)) - 180 + 0.5).cast("double").alias("lon"), (F.pmod(k * 17, F.lit(120)) - 60 + 0.5).cast("double").alias("lat"))


@query(f"""WITH {_QUANTILES}, st AS (SELECT {_STATION} FROM supplier), t AS (SELECT l_suppkey, regr_slope(q50_doy, year) * 10 AS b FROM pq WHERE q50_doy IS NOT NULL GROUP BY 1 HAVING count(*) >= 4)
SELECT CASE WHEN lon < -60 THEN 'west' WHEN lon < 60 THEN 'central' ELSE 'east' END AS flyway, count(*) AS n, round(avg(b), 4) AS mean, round(coalesce(1.96 * stddev_samp(b) / sqrt(count(*)), 0), 4) AS ci FROM t JOIN st ON station = l_suppkey WHERE b IS NOT NULL GROUP BY 1""")
def flyway_intervals(spark, sf_dir):
    t = passage.decade_trends(_quantiles(spark, sf_dir), ["l_suppkey"], "year", ["q50_doy"], min_years=4)
    f = F.when(F.col("lon") < -60, "west").when(F.col("lon") < 60, "central").otherwise("east")
    d = t.join(_stations(spark, sf_dir), F.col("l_suppkey") == F.col("station")).withColumn("flyway", f)
    return _r(passage.mean_interval(d, ["flyway"], "q50_doy_per_decade"), "mean", "ci", places=4)


@query("""WITH d AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE ts::DATE BETWEEN '2024-01-01' AND '2024-01-30'),
e AS (SELECT * FROM d UNION ALL SELECT DISTINCT user_id, x FROM d, (VALUES (DATE '2023-12-31'), (DATE '2024-01-31')) v(x)),
g AS (SELECT user_id, d + 1 AS start, lead(d) OVER (PARTITION BY user_id ORDER BY d) - d - 1 AS gap FROM e)
SELECT user_id, arg_min(start, (-gap, start))::VARCHAR AS start, max(gap)::INTEGER AS days FROM g WHERE gap BETWEEN 1 AND 40 GROUP BY 1""")
def longest_outage(spark, sf_dir):
    return passage.longest_outage(_t(spark, sf_dir, "events"), "user_id", F.col("ts"), "2024-01-01", "2024-01-30", min_days=1).withColumn("start", F.col("start").cast("string"))


@query(f"""WITH {_QUANTILES}, b AS (SELECT l_suppkey, year AS x, q50_doy AS y, row_number() OVER (PARTITION BY l_suppkey ORDER BY year, q50_doy) AS k FROM pq WHERE q50_doy IS NOT NULL QUALIFY count(*) OVER (PARTITION BY l_suppkey) >= 5),
m AS (SELECT *, unnest(range(1, 201)) AS draw FROM b), t AS (SELECT l_suppkey, draw, y, row_number() OVER (PARTITION BY l_suppkey, draw ORDER BY md5(concat_ws('-', 0, draw, l_suppkey, k)), k) AS k FROM m),
s AS (SELECT l_suppkey, draw, regr_slope(t.y, x) * 10 AS b FROM m JOIN t USING (l_suppkey, draw, k) GROUP BY ALL), a AS (SELECT draw, avg(b) AS b, count(b) AS groups FROM s GROUP BY 1)
SELECT max(groups) AS groups, round(avg(b), 3) AS mean, round(quantile_cont(b, 0.025), 3) AS low, round(quantile_cont(b, 0.975), 3) AS high FROM a""")
def permutation_null(spark, sf_dir):
    return _r(passage.permutation_null(_quantiles(spark, sf_dir), ["l_suppkey"], "year", "q50_doy", min_years=5), "mean", "low", "high", places=3)


@query("""WITH y AS (SELECT l_suppkey, year(l_shipdate) AS year, least((dayofyear(l_shipdate) - 1) // 7, 51)::INTEGER AS week, median(l_quantity::DOUBLE) AS m FROM lineitem GROUP BY ALL)
SELECT l_suppkey, week, round(median(m), 5) AS value, count(*) AS years FROM y GROUP BY ALL""")
def weekly_climatology(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("double"))
    return _r(passage.weekly_climatology(d, ["l_suppkey"], "l_shipdate", "q"), "value")


@query("""WITH f AS (SELECT l_returnflag, year(l_shipdate) AS year, least((dayofyear(l_shipdate) - 1) // 7, 51)::INTEGER AS week, radians((l_partkey * 29) % 360) AS a, l_quantity::DOUBLE / 10 AS s, l_extendedprice::DOUBLE AS w FROM lineitem),
y AS (SELECT l_returnflag, year, week, sum(w * s * sin(a)) / sum(w) AS u, sum(w * s * cos(a)) / sum(w) AS v FROM f GROUP BY ALL), m AS (SELECT l_returnflag, week, median(u) AS u, median(v) AS v FROM y GROUP BY ALL)
SELECT l_returnflag, week, round(CASE WHEN degrees(atan2(u, v)) + 360 >= 360 THEN degrees(atan2(u, v)) ELSE degrees(atan2(u, v)) + 360 END, 4) AS bearing, round(sqrt(u * u + v * v), 5) AS speed FROM m""")
def weekly_flow(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", F.pmod(F.col("l_partkey") * 29, F.lit(360)).alias("dir"), (F.col("l_quantity").cast("double") / 10).alias("spd"), F.col("l_extendedprice").cast("double").alias("w"))
    return _r(_r(passage.weekly_flow(d, ["l_returnflag"], "l_shipdate", "dir", "spd", "w"), "bearing", places=4), "speed")


_SURVEY = """s AS (SELECT p_brand AS taxon, l_suppkey AS site, year(l_shipdate) AS year, l_quantity::DOUBLE / (1 + l_linenumber) AS cpue, ((l_suppkey * 17) % 120) - 60 + 0.5 AS lat, l_returnflag AS gear, dayofyear(l_shipdate) AS doy FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _survey(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    d = d.withColumn("effort", F.col("l_linenumber") + 1).withColumn("cpue", ranges.catch_per_effort("l_quantity", "effort"))
    return d.select(F.col("p_brand").alias("taxon"), F.col("l_suppkey").alias("site"), F.year("l_shipdate").alias("year"), "cpue", (F.pmod(F.col("l_suppkey") * 17, F.lit(120)) - 60 + 0.5).cast("double").alias("lat"), F.col("l_returnflag").alias("gear"), F.dayofyear("l_shipdate").alias("doy"))


@query(f"WITH {_SURVEY}, a AS (SELECT taxon, count(DISTINCT year) AS y FROM s GROUP BY 1), f AS (SELECT taxon, site, count(DISTINCT year) AS k FROM s GROUP BY ALL) SELECT taxon, count(*) AS rows FROM s JOIN f USING (taxon, site) JOIN a USING (taxon) WHERE k >= greatest(1, round_even(0.8 * y, 0)) GROUP BY 1")
def consistent_footprint(spark, sf_dir):
    return ranges.consistent_footprint(_survey(spark, sf_dir), ["taxon"], ["site"], "year", 0.8).groupBy("taxon").agg(F.count("*").alias("rows"))


@query(f"WITH {_SURVEY} SELECT taxon, year, count(*) AS n, round(sum(lat * cpue) / sum(cpue), 5) AS lat FROM s WHERE cpue > 0 GROUP BY ALL")
def weighted_centroids(spark, sf_dir):
    return _r(ranges.weighted_centroids(_survey(spark, sf_dir), ["taxon", "year"], "cpue", ["lat"]), "lat")


@query(f"WITH {_SURVEY}, g AS (SELECT taxon, year, min(gear) AS g FROM s GROUP BY ALL), z AS (SELECT taxon, arg_min(g, year) AS g0 FROM g GROUP BY 1) SELECT taxon, min(year) FILTER (g <> g0) AS change_year FROM g JOIN z USING (taxon) GROUP BY 1")
def gear_change_year(spark, sf_dir):
    return ranges.gear_change_year(_survey(spark, sf_dir), ["taxon"], "year", "gear")


_FIX = "x AS (SELECT user_id, event_id, ts, 40 + ((event_id * 7) % 1000) / 100.0::DOUBLE AS lat, -100 + ((event_id * 13) % 1000) / 100.0::DOUBLE AS lon, event_type FROM events)"
_KM = "2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians({1} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin(radians({3} - {2}) / 2), 2)))) + 0 * ({0} + {1} + {2} + {3})"


def _fixes(spark, sf_dir):
    e = F.col("event_id")
    return _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", (40 + F.pmod(e * 7, F.lit(1000)) / 100.0).alias("lat"), (-100 + F.pmod(e * 13, F.lit(1000)) / 100.0).alias("lon"), "event_type")


_STEP = f"{_FIX}, s AS (SELECT *, {_KM.format('lag(lat) OVER w', 'lat', 'lag(lon) OVER w', 'lon')} AS km, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86400000000 AS days FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(f"WITH {_STEP} SELECT user_id, event_id, round(km, 4) AS step_km, round(days, 6) AS step_days FROM s")
def track_steps(spark, sf_dir):
    d = tracks.steps(_fixes(spark, sf_dir), ["user_id"], "ts", "lat", "lon", "event_id").select("user_id", "event_id", "step_km", "step_days")
    return _r(_r(d, "step_km", places=4), "step_days", places=6)


@query(f"WITH {_STEP}, g AS (SELECT user_id, event_id, sum(CASE WHEN km > 50 AND (days <= 0 OR km / (days * 24) > 40) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM s) SELECT user_id, segment::INTEGER AS segment, count(*) AS fixes FROM g GROUP BY ALL")
def track_segments(spark, sf_dir):
    d = tracks.segments(_fixes(spark, sf_dir), ["user_id"], "ts", "lat", "lon", max_kmh=40.0, tie="event_id")
    return d.groupBy("user_id", "segment").agg(F.count("*").alias("fixes"))


def _reachable(rounds: int) -> str:
    """The SQL of so many rounds of segmenting and removing strays."""
    parts = [_FIX.replace("x AS", "x0 AS", 1)]
    for r in range(1, rounds + 1):
        parts += [
            f"s{r} AS (SELECT *, {_KM.format('lag(lat) OVER w', 'lat', 'lag(lon) OVER w', 'lon')} AS km, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86400000000 AS days FROM x{r - 1} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))",
            f"g{r} AS (SELECT user_id, event_id, ts, lat, lon, sum(CASE WHEN km > 50 AND (days <= 0 OR km / (days * 24) > 40) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM s{r})",
            f"p{r} AS (SELECT user_id, segment, avg(lat) AS la, avg(lon) AS lo, count(*) AS n FROM g{r} GROUP BY ALL)",
            f"h{r} AS (SELECT user_id, arg_max(la, (n, -segment)) AS hla, arg_max(lo, (n, -segment)) AS hlo, count(*) AS k FROM p{r} GROUP BY 1)",
            f"x{r} AS (SELECT g{r}.user_id, event_id, ts, lat, lon FROM g{r} JOIN p{r} USING (user_id, segment) JOIN h{r} USING (user_id) WHERE {_KM.format('hla', 'la', 'hlo', 'lo')} <= 300 AND (n > 1 OR k = 1))",
        ]
    return "WITH " + ", ".join(parts)


@query(f"{_reachable(3)} SELECT user_id, count(*) AS fixes FROM x3 GROUP BY 1")
def unreachable_removed(spark, sf_dir):
    return tracks.unreachable_removed(_fixes(spark, sf_dir), ["user_id"], "ts", "lat", "lon", max_kmh=40.0, stray_km=300.0, tie="event_id").groupBy("user_id").agg(F.count("*").alias("fixes"))


@query(f"""WITH {_FIX}, d AS (SELECT user_id, dayofyear(ts) AS doy, median(lat) AS lat FROM x GROUP BY ALL), m AS (SELECT user_id, (min(lat) + max(lat)) / 2 AS mid FROM d GROUP BY 1),
p AS (SELECT d.*, mid, max((lat < mid)::INT) OVER (PARTITION BY user_id ORDER BY doy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM d JOIN m USING (user_id))
SELECT user_id, min(doy) FILTER (was = 1 AND lat >= mid)::INTEGER AS crossing_doy FROM p GROUP BY 1""")
def midpoint_crossing(spark, sf_dir):
    d = _fixes(spark, sf_dir).groupBy("user_id", F.dayofyear("ts").alias("doy")).agg(F.median("lat").alias("lat"))
    return tracks.midpoint_crossing(d, ["user_id"], "doy", "lat")


_SNAP = "floor(round({0} / {1}, 9)) * {1} + {1} / 2"
_PATH = f"{_FIX}, d AS (SELECT user_id, ts::DATE AS day, median(lat) AS la, median(lon) AS lo FROM x GROUP BY ALL), p AS (SELECT user_id, day, {_SNAP.format('la', '1.0')} AS lat, {_SNAP.format('lo', '1.0')} AS lon FROM d)"


@query(f"WITH {_PATH} SELECT user_id, day::VARCHAR AS day, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM p")
def daily_path(spark, sf_dir):
    return tracks.daily_path(_fixes(spark, sf_dir), ["user_id"], "ts", "lat", "lon", 1.0).withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {_PATH}, r AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING)::INTEGER AS run FROM (SELECT *, coalesce(day - lag(day) OVER (PARTITION BY user_id ORDER BY day) > 2, false)::INT AS g FROM p)),
k AS (SELECT * FROM (SELECT *, coalesce(lag(lat) OVER w = lat AND lag(lon) OVER w = lon, false) AS same FROM r WINDOW w AS (PARTITION BY user_id, run ORDER BY day)) WHERE NOT same)
SELECT user_id, run, day::VARCHAR AS day, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM k QUALIFY count(*) OVER (PARTITION BY user_id, run) >= 2""")
def track_lines(spark, sf_dir):
    return tracks.lines(tracks.daily_path(_fixes(spark, sf_dir), ["user_id"], "ts", "lat", "lon", 1.0), ["user_id"], max_gap_days=2).select("user_id", "run", F.col("day").cast("string").alias("day"), "lat", "lon")


@query(f"WITH {_FIX}, c AS (SELECT *, floor(lat) AS cy, floor(lon) AS cx FROM x), k AS (SELECT cy, cx FROM c GROUP BY ALL HAVING count(DISTINCT user_id) >= 3) SELECT cy, cx, count(*) AS fixes FROM c JOIN k USING (cy, cx) GROUP BY ALL")
def anonymous_cells(spark, sf_dir):
    d = _fixes(spark, sf_dir).withColumns({"cy": F.floor("lat").cast("double"), "cx": F.floor("lon").cast("double")})
    return tracks.anonymous_cells(d, ["cy", "cx"], "user_id").groupBy("cy", "cx").agg(F.count("*").alias("fixes"))


_CARDS = "c AS (SELECT o_orderkey AS card, o_custkey % 100 AS cell, month(o_orderdate) AS month, p_brand AS species FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"


#: Line items that a task takes in joins of cards.
ITEMS_A_TASK = 400_000


def _parts(items: DataFrame) -> int:
    """Partitions for so many line items (their number stands in the footers), so that a task's share does not grow with them."""
    return max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // ITEMS_A_TASK))


def _species_of_cards(spark, sf_dir, parts: int) -> DataFrame:
    """(l_orderkey, species) of all line items, dealt by order."""
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition(parts, "l_partkey")
    d = items.join(_t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return d.select("l_orderkey", F.col("p_brand").alias("species")).repartition(parts, "l_orderkey")


def _cards(spark, sf_dir):
    d = _t(spark, sf_dir, "orders").join(_species_of_cards(spark, sf_dir, _parts(_t(spark, sf_dir, "lineitem"))), F.col("l_orderkey") == F.col("o_orderkey"))
    return d.select(F.col("o_orderkey").alias("card"), (F.col("o_custkey") % 100).alias("cell"), F.month("o_orderdate").alias("month"), "species")


_RATES = f"{_CARDS}, r AS (SELECT cell, month, species, count(DISTINCT card) AS cards_with FROM c GROUP BY ALL), e AS (SELECT cell, month, count(DISTINCT card) AS cards FROM c GROUP BY ALL)"


@query(f"WITH {_RATES} SELECT cell, month, species, cards_with, cards FROM r JOIN e USING (cell, month)")
def reporting_rates(spark, sf_dir):
    return atlas.reporting_rates(_cards(spark, sf_dir), ["cell", "month"], "card", "species")


@query(f"WITH {_RATES} SELECT cell, sum(cards)::BIGINT AS effort FROM e GROUP BY 1")
def pooled_effort(spark, sf_dir):
    return atlas.pooled_effort(reporting_rates(spark, sf_dir), ["cell", "month"], ["cell"], "cards")


#: Cells are so small that many are silent for a species that lives there.
_OWN_CELLS = _CARDS.replace("o_custkey % 100", "o_custkey")


def card_cells(spark, sf_dir, epoch=None):
    """Cards with each species by cell (a customer), and cards in all; with epoch (an expression of the orders), for each of its values."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("card"), F.col("o_custkey").alias("cell"), F.expr(epoch or "0").alias("epoch"))
    parts = _parts(_t(spark, sf_dir, "lineitem"))
    c = orders.join(_species_of_cards(spark, sf_dir, parts), F.col("l_orderkey") == F.col("card"))
    rates = atlas.reporting_rates(c, ["cell", "epoch"], "card", "species", parts=parts).select("species", "epoch", "cell", F.col("cards_with").alias("k"), F.col("cards").alias("n"))
    return rates, rates.groupBy("cell", "epoch").agg(F.max("n").alias("n"))


@query(f"""WITH RECURSIVE {_OWN_CELLS}, e AS (SELECT cell, count(DISTINCT card) AS n FROM c GROUP BY 1), r AS (SELECT cell, species, count(DISTINCT card) AS k FROM c GROUP BY ALL),
d AS (SELECT s.species, e.cell, coalesce(r.k, 0) AS k, e.n FROM e CROSS JOIN (SELECT DISTINCT species FROM c) AS s LEFT JOIN r ON r.cell = e.cell AND r.species = s.species),
own AS (SELECT species, count(*) AS cells, count_if(k > 0) AS seen, sum(k)::DOUBLE AS ks, (sum(n) FILTER (k > 0))::DOUBLE AS ns FROM d GROUP BY 1), silent AS (SELECT species, n AS m, count(*) AS c FROM d WHERE k = 0 GROUP BY ALL),
em AS (SELECT species, 0 AS i, seen::DOUBLE / cells AS psi, least(ks / ns, 0.999) AS p FROM own WHERE seen > 0
  UNION ALL
  SELECT species, i + 1, (any_value(seen) + coalesce(sum(z), 0)) / any_value(cells), any_value(ks) / (any_value(ns) + coalesce(sum(z * m), 0))
  FROM (SELECT em.species, em.i, seen, cells, ks, ns, m, c * psi * pow(1 - p, m) / (psi * pow(1 - p, m) + 1 - psi) AS z FROM em JOIN own USING (species) LEFT JOIN silent USING (species) WHERE em.i < 100) GROUP BY species, i)
SELECT species, cells, seen, round(coalesce(fit.psi, 0), 5) AS psi, round(fit.p, 5) AS p, coalesce(abs(fit.psi - before.psi) < 1e-6, false) AS converged, coalesce(abs(fit.psi - before.psi) < 1e-6, false) AND coalesce(fit.psi, 0) < 0.999 AS valid
FROM own LEFT JOIN (SELECT * FROM em WHERE i = 100) AS fit USING (species) LEFT JOIN (SELECT * FROM em WHERE i = 99) AS before USING (species)""")
def occupancy(spark, sf_dir):
    detections, effort = card_cells(spark, sf_dir)
    sums = atlas.card_sums(detections.drop("epoch"), effort.drop("epoch"), "species", [], "k", "n")
    return _r(atlas.fit_occupancy(sums, ["species"]), "psi", "p")


def two_sided(z: str) -> str:
    """SQL of the chance that a standard normal value lies at least as far out as z."""
    t, poly = f"(1 / (1 + abs({z}) / sqrt(2.0) / 2))", str(inference.ERFC[-1])
    for c in reversed(inference.ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    return f"{t} * exp(-({z}) * ({z}) / 2.0 + {poly})"


@query(f"WITH r AS (SELECT c_mktsegment AS g, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS a, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0 AS b FROM customer), s AS (SELECT g, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY 1), t AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS z FROM s) SELECT g AS c_mktsegment, n, round(rho, 5) AS rho, round({two_sided('z')}, 5) AS p FROM t")
def spearman(spark, sf_dir):
    return _r(inference.spearman(_t(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", "c_nationkey"), "rho", "p")


_CELLS = "c AS (SELECT ((c_custkey * 17) % 12)::INT AS r, ((c_custkey * 37) % 36)::INT AS c, avg(c_acctbal::DOUBLE) AS v FROM customer GROUP BY ALL)"


def _cells(spark, sf_dir):
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").groupBy(F.pmod(k * 17, F.lit(12)).cast("int").alias("r"), F.pmod(k * 37, F.lit(36)).cast("int").alias("c")).agg(F.avg(F.col("c_acctbal").cast("double")).alias("v"))


@query(f"""WITH {_CELLS}, z AS (SELECT r, c, v - (SELECT avg(v) FROM c) AS z FROM c), e AS (SELECT a.r, a.c, a.z, b.z AS z2, 1.0::DOUBLE / count(*) OVER (PARTITION BY a.r, a.c) AS w FROM z AS a JOIN z AS b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND NOT (a.r = b.r AND a.c = b.c))
SELECT (SELECT count(*) FROM z) AS n, round((SELECT count(*) FROM z) / sum(w) * sum(z * w * z2) / (SELECT sum(z * z) FROM z), 6) AS morans_i FROM e""")
def morans_i(spark, sf_dir):
    return _r(inference.morans_i(_cells(spark, sf_dir), "r", "c", "v"), "morans_i", places=6)


@query("""WITH d AS (SELECT c_mktsegment AS g, c_acctbal AS v, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS r FROM customer),
p AS (SELECT g, sum(r)::DOUBLE AS s, count(*) AS k FROM d GROUP BY 1), t AS (SELECT sum(k * k * k - k)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS k FROM d GROUP BY v))
SELECT sum(k)::BIGINT AS n, count(*) AS groups, round((12 / (sum(k)::DOUBLE * (sum(k) + 1)) * sum(s * s / k) - 3 * (sum(k) + 1)) / (1 - (SELECT ties FROM t) / (sum(k)::DOUBLE * sum(k) * sum(k) - sum(k))), 5) AS h FROM p""")
def kruskal_wallis(spark, sf_dir):
    return _r(inference.kruskal_wallis(_t(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal"), "h")


@query("""WITH s AS (SELECT l_returnflag, count(*) AS n, covar_pop(q, q) AS xx, covar_pop(d, d) AS gg, covar_pop(q, d) AS xg, covar_pop(q, y) AS xy, covar_pop(d, y) AS gy, corr(q, y) AS rxy, corr(q, d) AS rxg, corr(y, d) AS ryg
FROM (SELECT l_returnflag, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS d, l_extendedprice::DOUBLE AS y FROM lineitem) GROUP BY 1)
SELECT l_returnflag, n, round((gg * xy - xg * gy) / (xx * gg - xg * xg), 3) AS slope, round((rxy - rxg * ryg) / sqrt((1 - rxg * rxg) * (1 - ryg * ryg)), 5) AS partial_r FROM s""")
def partial_slope(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").select("l_returnflag", *[F.col(c).cast("double").alias(c) for c in ("l_extendedprice", "l_quantity", "l_discount")])
    return _r(_r(inference.partial_slope(d, ["l_returnflag"], "l_extendedprice", "l_quantity", "l_discount"), "slope", places=3), "partial_r")


_ENSEMBLE = """s AS (SELECT o_custkey % 20 AS st, o_orderstatus AS e, o_orderpriority AS m, o_custkey % 3 AS k, covar_samp(year(o_orderdate), o_totalprice::DOUBLE) / var_samp(year(o_orderdate)) AS b FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL),
m AS (SELECT e, m, avg(b) AS b FROM (SELECT e, m, k, avg(b) AS b FROM s WHERE b IS NOT NULL AND isfinite(b) GROUP BY ALL) GROUP BY ALL),
w AS (SELECT m, max(b) FILTER (e = 'F') AS f, max(b) FILTER (e = 'O') AS o FROM m GROUP BY 1)"""


@query(f"WITH {_ENSEMBLE} SELECT count(*) AS models, round(avg(f), 3) AS treated, round(avg(o), 3) AS control, round((avg(f) - avg(o)) / avg(f), 4) AS fraction FROM w WHERE f IS NOT NULL AND o IS NOT NULL")
def staged_fraction(spark, sf_dir):
    d = _t(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O")).select((F.col("o_custkey") % 20).alias("st"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("double").alias("v"), F.col("o_orderstatus").alias("e"), F.col("o_orderpriority").alias("m"), (F.col("o_custkey") % 3).alias("k"))
    out = inference.staged_fraction(d, "st", "year", "v", "e", "m", "k", "F", "O")
    return _r(_r(out, "treated", "control", places=3), "fraction", places=4)


_PLACE = "c_custkey AS k, c_mktsegment AS taxon, c_acctbal::DOUBLE AS value, ((c_custkey * 37) % 360) - 180 + 0.5 AS lon, ((c_custkey * 17) % 120) - 60 + 0.5 AS lat"


def _surface(spark, sf_dir):
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select(k.alias("k"), F.col("c_mktsegment").alias("taxon"), F.col("c_acctbal").cast("double").alias("value"), (F.pmod(k * 37, F.lit(360)) - 180 + 0.5).cast("double").alias("lon"), (F.pmod(k * 17, F.lit(120)) - 60 + 0.5).cast("double").alias("lat"))


@query(f"WITH c AS (SELECT {_PLACE} FROM customer) SELECT taxon, {_SNAP.format('lon', '5.0')}::DOUBLE AS lon, {_SNAP.format('lat', '5.0')}::DOUBLE AS lat, round(sum(value), 3) AS value FROM c GROUP BY ALL")
def generalised_surface(spark, sf_dir):
    d = gate.generalise(_surface(spark, sf_dir), "k", "lon", "lat", ["k"], grid=5.0, cutoff=None)
    return _r(gate.merged_cells(d, ["taxon"], "lon", "lat", "value"), "value", places=3)


@query(f"WITH c AS (SELECT {_PLACE} FROM customer) SELECT {_SNAP.format('lon', '5.0')}::DOUBLE AS lon, {_SNAP.format('lat', '5.0')}::DOUBLE AS lat, count(DISTINCT taxon) AS taxa FROM c GROUP BY ALL")
def taxa_per_cell(spark, sf_dir):
    d = _surface(spark, sf_dir).select("taxon", geo.snap(F.col("lon"), 5.0).alias("lon"), geo.snap(F.col("lat"), 5.0).alias("lat")).distinct()
    return d.groupBy("lon", "lat").agg(F.count("*").alias("taxa"))


@query("WITH d AS (SELECT DISTINCT l_suppkey, l_shipdate::DATE AS d FROM lineitem WHERE l_shipdate IS NOT NULL), b AS (SELECT date_trunc('month', min(d))::DATE AS a, last_day(max(d)) AS z FROM d), m AS (SELECT l_suppkey AS k, m FROM (SELECT DISTINCT l_suppkey FROM d), (SELECT unnest(generate_series(a, z, INTERVAL 1 MONTH))::DATE AS m FROM b)), h AS (SELECT l_suppkey, year(d) AS year, month(d) AS month, count(*) AS days FROM d GROUP BY ALL) SELECT k AS l_suppkey, year(m)::INTEGER AS year, month(m)::INTEGER AS month, coalesce(days, 0) AS days, day(last_day(m)) - coalesce(days, 0) AS missing FROM m LEFT JOIN h ON h.l_suppkey = k AND h.year = year(m) AND h.month = month(m) WHERE coalesce(days, 0) < day(last_day(m)) - 1")
def day_gaps(spark, sf_dir):
    return lake.day_gaps(_t(spark, sf_dir, "lineitem"), F.col("l_shipdate"), ["l_suppkey"])


@query("WITH d AS (SELECT DISTINCT c_nationkey, o_orderdate::DATE AS d FROM orders JOIN customer ON c_custkey = o_custkey), b AS (SELECT date_trunc('month', min(d))::DATE AS a, last_day(max(d)) AS z FROM d), m AS (SELECT c_nationkey AS k, m FROM (SELECT DISTINCT c_nationkey FROM d), (SELECT unnest(generate_series(a, z, INTERVAL 1 MONTH))::DATE AS m FROM b)), h AS (SELECT c_nationkey, year(d) AS year, month(d) AS month, count(*) AS days FROM d GROUP BY ALL) SELECT k AS c_nationkey, year(m)::INTEGER AS year, month(m)::INTEGER AS month, coalesce(days, 0) AS days, day(last_day(m)) - coalesce(days, 0) AS missing FROM m LEFT JOIN h ON h.c_nationkey = k AND h.year = year(m) AND h.month = month(m) WHERE coalesce(days, 0) < day(last_day(m)) - 1")
def day_gaps_by_nation(spark, sf_dir):
    d = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return lake.day_gaps(d, F.col("o_orderdate"), ["c_nationkey"])


@query("SELECT l_returnflag, l_linestatus, variable, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT l_returnflag, l_linestatus, unnest(['quantity', 'discount', 'tax']) AS variable, unnest([l_quantity::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE]) AS value FROM lineitem) WHERE value IS NOT NULL GROUP BY ALL")
def wide_to_long(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", *[F.col(f"l_{c}").cast("double").alias(c) for c in ("quantity", "discount", "tax")])
    long = d.unpivot(["l_returnflag", "l_linestatus"], ["quantity", "discount", "tax"], "variable", "value").where("value is not null")
    return _r(long.groupBy("l_returnflag", "l_linestatus", "variable").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", places=3)


@query("SELECT l_suppkey, round(sum(l_quantity::DOUBLE) FILTER (l_returnflag = 'A'), 3) AS a, round(sum(l_quantity::DOUBLE) FILTER (l_returnflag = 'N'), 3) AS n, round(sum(l_quantity::DOUBLE) FILTER (l_returnflag = 'R'), 3) AS r FROM lineitem GROUP BY 1")
def long_to_wide(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum(F.col("l_quantity").cast("double")))
    return _r(d.withColumnsRenamed({"A": "a", "N": "n", "R": "r"}), "a", "n", "r", places=3)


#: Small registries; the SQL has the same rows.
_RULES = [(1, None, None, "low"), (1, "surface", None, "moderate"), (1, None, "aerial", "high"), (2, None, None, "embargoed"), (3, "track", None, "high"), (3, None, "marine", "moderate"), (4, "surface", "aerial", "not_sensitive")]
_GATE_SOURCES = [("s", "low", True), ("t", None, True), ("u", "low", False)]
_POLICY = [("not_sensitive", "aggregate", False), ("low", "aggregate", False), ("low", "individual", False), ("moderate", "aggregate", False), ("moderate", "individual", True), ("high", "aggregate", False), ("high", "individual", True), ("embargoed", "aggregate", True)]


def _values(rows):
    word = lambda x: "NULL" if x is None else repr(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(word, r)) + ")" for r in rows) + ")"


@query(f"""WITH i AS (SELECT c_mktsegment AS taxon, CASE c_nationkey % 4 WHEN 0 THEN 's' WHEN 1 THEN 't' WHEN 2 THEN 'u' ELSE 'x' END AS source_id, CASE WHEN c_nationkey % 3 = 0 THEN 'surface' ELSE 'track' END AS evidence, CASE WHEN c_nationkey % 5 < 2 THEN 'aerial' ELSE 'marine' END AS realm,
  CASE WHEN c_nationkey % 7 <> 6 THEN CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END END AS k, count(*) AS n FROM customer GROUP BY ALL),
r AS (SELECT taxon, source_id, evidence, realm, k, arg_max(s, (re IS NOT NULL)::INT * 10 + (rr IS NOT NULL)::INT * 10 + list_position(['not_sensitive', 'low', 'moderate', 'high', 'embargoed'], s)) AS rule FROM i JOIN {_values(_RULES)} AS rules(rk, re, rr, s) ON rk = k AND coalesce(re = evidence, true) AND coalesce(rr = realm, true) GROUP BY ALL),
j AS (SELECT i.*, coalesce(rule, d) AS sensitivity, ok, CASE WHEN i.evidence = 'track' THEN 'individual' ELSE 'aggregate' END AS granularity FROM i LEFT JOIN r ON r.taxon = i.taxon AND r.source_id = i.source_id AND r.evidence = i.evidence AND r.realm = i.realm AND r.k = i.k LEFT JOIN {_values(_GATE_SOURCES)} AS sources(sid, d, ok) ON sid = i.source_id),
q AS (SELECT j.*, CASE WHEN coalesce(k = 5, false) THEN 'floor taxon' WHEN NOT coalesce(ok, false) THEN 'licence' WHEN sensitivity IS NULL THEN 'unresolved sensitivity' WHEN k IS NULL THEN 'exact scope without key' WHEN coalesce(w, true) THEN 'policy' END AS reason FROM j LEFT JOIN {_values(_POLICY)} AS policy(ps, pg, w) ON ps = sensitivity AND pg = granularity)
SELECT taxon, source_id, evidence, realm, k AS taxon_key, sensitivity, CASE WHEN reason IS NULL THEN 'publish' ELSE 'withhold' END AS decision, reason, n FROM q""")
def disclosure_decisions(spark, sf_dir):
    n = F.col("c_nationkey")
    names = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4, "MACHINERY": 5}
    key = F.when(n % 7 != 6, F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("c_mktsegment")])
    source = F.element_at(F.array(*map(F.lit, "stux")), (n % 4 + 1).cast("int"))
    parts = {"taxon": F.col("c_mktsegment"), "source_id": source, "evidence": F.when(n % 3 == 0, "surface").otherwise("track"), "realm": F.when(n % 5 < 2, "aerial").otherwise("marine"), "taxon_key": key}
    items = _t(spark, sf_dir, "customer").groupBy(*[c.alias(x) for x, c in parts.items()]).agg(F.count("*").alias("n"))
    items = items.withColumns({"taxon_scope": F.lit("exact"), "granularity": F.when(F.col("evidence") == "track", "individual").otherwise("aggregate")})
    rules = spark.createDataFrame(_RULES, "taxon_key int, evidence string, realm string, sensitivity string")
    sources = spark.createDataFrame(_GATE_SOURCES, "source_id string, default_sensitivity string, redistributable boolean")
    policy = spark.createDataFrame(_POLICY, "sensitivity string, granularity string, withhold boolean")
    out = gate.decide(gate.sensitivity(items, rules, sources), policy, sources, [5])
    return out.select("taxon", "source_id", "evidence", "realm", "taxon_key", "sensitivity", "decision", "reason", "n")


from . import layer_queries, more_queries, surface_queries, table_queries, trend_queries  # noqa: E402, F401  their queries register themselves here
