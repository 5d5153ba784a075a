"""Queries on lines, packed surfaces and spatial nulls, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import gate, inference, outlines
from .registry import _FIX, _PLACE, _SNAP, _fixes, _r, _surface, _t, query, two_sided

#: A chord of a line is (id, a, b): places of its ends; all chords that ever were give the points kept.
_SPLIT = """p AS (SELECT user_id AS id, event_id AS k, lat, lon FROM x),
chord AS (SELECT id, min(k) AS a, max(k) AS b FROM p GROUP BY 1
  UNION ALL
  (WITH d AS (SELECT c.id, c.a, c.b, t.k, CASE WHEN sqrt((q.lat - o.lat) * (q.lat - o.lat) + (q.lon - o.lon) * (q.lon - o.lon)) = 0 THEN sqrt((t.lat - o.lat) * (t.lat - o.lat) + (t.lon - o.lon) * (t.lon - o.lon))
      ELSE abs((q.lon - o.lon) * (t.lat - o.lat) - (t.lon - o.lon) * (q.lat - o.lat)) / sqrt((q.lat - o.lat) * (q.lat - o.lat) + (q.lon - o.lon) * (q.lon - o.lon)) END AS off
    FROM chord AS c JOIN p AS o ON o.id = c.id AND o.k = c.a JOIN p AS q ON q.id = c.id AND q.k = c.b JOIN p AS t ON t.id = c.id AND t.k > c.a AND t.k < c.b),
  far AS (SELECT id, a, b, arg_max(k, (off, -k)) AS m FROM d GROUP BY ALL HAVING max(off) > 2.0)
  SELECT id, unnest([a, m]), unnest([m, b]) FROM far))"""


@query(f"WITH RECURSIVE {_FIX}, {_SPLIT} SELECT user_id, event_id, lat, lon FROM x JOIN (SELECT id, a AS k FROM chord UNION SELECT id, b FROM chord) ON user_id = id AND event_id = k")
def simplified_lines(spark, sf_dir):
    return outlines.simplify(_fixes(spark, sf_dir), ["user_id"], "event_id", "lat", "lon", 2.0).select("user_id", "event_id", "lat", "lon")


@query(f"WITH c AS (SELECT {_PLACE} FROM customer), o AS (SELECT taxon, greatest(abs((lon + (k % 4) * 0.001::DOUBLE + 180) % 1.0 - 0.5), abs((lat + 90) % 1.0 - 0.5)) AS off FROM c) SELECT taxon, round(max(off), 6)::DOUBLE AS worst, count_if(off > 1e-6) AS off_grid, count(*) AS n FROM o GROUP BY 1")
def off_grid_report(spark, sf_dir):
    moved = _surface(spark, sf_dir).withColumn("lon", F.col("lon") + (F.col("k") % 4) * 0.001)
    return _r(outlines.off_grid_report(moved, ["taxon"], "lon", "lat", 1.0), "worst", places=6)


@query(f"""WITH c AS (SELECT {_PLACE} FROM customer), m AS (SELECT taxon, {_SNAP.format('lon', '5.0')} AS lon, {_SNAP.format('lat', '5.0')} AS lat, count(*) AS v FROM c GROUP BY ALL),
i AS (SELECT taxon, floor((lon + 180) / 5)::INT AS x, floor((lat + 90) / 5)::INT AS y, v FROM m)
SELECT taxon, x // 16 AS tile_x, y // 16 AS tile_y, string_agg(x % 16, ',' ORDER BY y, x) AS x, string_agg(y % 16, ',' ORDER BY y, x) AS y, string_agg(v, ',' ORDER BY y, x) AS v FROM i GROUP BY taxon, i.x // 16, i.y // 16""")
def packed_surface(spark, sf_dir):
    d = gate.merged_cells(_surface(spark, sf_dir).select("taxon", geo.snap(F.col("lon"), 5.0).alias("lon"), geo.snap(F.col("lat"), 5.0).alias("lat"), F.lit(1).alias("n")), ["taxon"], "lon", "lat", "n")
    packed = outlines.pack_grid(d, ["taxon"], "lon", "lat", "n", 5.0, tile=16)
    return packed.select("taxon", "tile_x", "tile_y", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("x", "y", "v")])


_PAIRS = """v AS (SELECT c_mktsegment AS g, c_acctbal AS v FROM customer), p AS (SELECT a.g AS l, b.g AS r FROM (SELECT DISTINCT g FROM v) AS a JOIN (SELECT DISTINCT g FROM v) AS b ON a.g < b.g),
k AS (SELECT l, r, g, v, rank() OVER (PARTITION BY l, r ORDER BY v) + (count(*) OVER (PARTITION BY l, r, v) - 1) / 2.0 AS k FROM p JOIN v ON g IN (l, r)),
t AS (SELECT l, r, sum(n * n * n - n)::DOUBLE AS ties FROM (SELECT l, r, count(*)::DOUBLE AS n FROM k GROUP BY l, r, v) GROUP BY ALL),
u AS (SELECT l, r, count_if(g = l)::DOUBLE AS a, count_if(g = r)::DOUBLE AS b, (sum(k) FILTER (g = l))::DOUBLE - count_if(g = l) * (count_if(g = l) + 1) / 2 AS u FROM k GROUP BY ALL),
z AS (SELECT l, r, a, b, u, greatest(abs(u - a * b / 2) - 0.5, 0) / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))) AS z FROM u JOIN t USING (l, r))"""


@query(f"WITH {_PAIRS}, q AS (SELECT *, least({two_sided('z')}, 1) AS p FROM z) SELECT l AS group_a, r AS group_b, a::BIGINT AS n_a, b::BIGINT AS n_b, u, round(p, 5) AS p, round(least(p * (count(*) OVER () - row_number() OVER (ORDER BY p, l, r) + 1), 1), 5) AS p_adjusted FROM q")
def pairwise_rank_tests(spark, sf_dir):
    return _r(inference.pairwise_rank_tests(_t(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal"), "p", "p_adjusted")


_UNIT = "('0x' || substr(md5(concat_ws('-', {0})), 1, 8))::BIGINT / 4294967296.0"


@query(f"""WITH v AS (SELECT c_mktsegment AS g, c_custkey AS k, c_acctbal::DOUBLE AS v FROM customer), own AS (SELECT g, count(*) AS n, quantile_cont(v, 0.25) AS a1, quantile_cont(v, 0.5) AS actual, quantile_cont(v, 0.75) AS a3 FROM v GROUP BY 1),
o AS (SELECT h.g, quantile_cont(v, 0.25) AS low, quantile_cont(v, 0.5) AS predicted, quantile_cont(v, 0.75) AS high FROM (SELECT DISTINCT g FROM v) AS h JOIN v ON h.g <> v.g GROUP BY 1),
i AS (SELECT g, avg((v BETWEEN low AND high)::INT) AS coverage FROM v JOIN o USING (g) GROUP BY 1),
w AS (SELECT g, draw, v, {' + '.join(f'(u >= {p})::INT' for p in inference.POISSON)} AS times FROM (SELECT g, v, draw, {_UNIT.format('0, draw, k')} AS u FROM v, range(1, 201) AS r(draw))),
b AS (SELECT g, stddev_samp(m) AS median_se FROM (SELECT g, draw, median(v) AS m FROM (SELECT g, draw, v, unnest(range(times)) FROM w) GROUP BY ALL) GROUP BY 1)
SELECT g AS c_mktsegment, n, round(actual, 4) AS actual, round(predicted, 4) AS predicted, round(abs(predicted - actual), 4) AS error, round((high - low) / (a3 - a1), 4) AS iqr_ratio, round(coverage, 5) AS coverage, round(median_se, 4) AS median_se FROM own JOIN o USING (g) JOIN i USING (g) JOIN b USING (g)""")
def held_out_groups(spark, sf_dir):
    d = _t(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.col("c_acctbal").cast("double").alias("v"))
    return _r(_r(inference.held_out_groups(d, "c_mktsegment", "v", "c_custkey"), "actual", "predicted", "error", "iqr_ratio", "median_se", places=4), "coverage")


#: Changes that lie on a slope from row to row, with noise from the balances.
_CHANGED = "s AS (SELECT (c_custkey % 20)::BIGINT AS r, ((c_custkey // 20) % 25)::BIGINT AS c, any_value(c_custkey % 20) * 0.02 + avg(c_acctbal::DOUBLE) / 20000 AS delta, any_value(c_custkey % 20) * 0.02 + avg(c_nationkey) / 100 AS delta_detected, avg(c_nationkey::DOUBLE) AS effort, max(c_acctbal::DOUBLE) AS most FROM customer GROUP BY ALL)"


def _changed(spark, sf_dir):
    k = F.col("c_custkey")
    row = (k % 20).cast("bigint")
    d = _t(spark, sf_dir, "customer").groupBy(row.alias("r"), (F.floor(k / 20) % 25).cast("bigint").alias("c"))
    slope = F.any_value(row) * 0.02
    return d.agg((slope + F.avg(F.col("c_acctbal").cast("double")) / 20000).alias("delta"), (slope + F.avg("c_nationkey") / 100).alias("delta_detected"), F.avg(F.col("c_nationkey").cast("double")).alias("effort"), F.max(F.col("c_acctbal").cast("double")).alias("most"))


_DEALT = f"""{_CHANGED}, z AS (SELECT r, c, delta - (SELECT avg(delta) FROM s) AS z FROM s), m AS (SELECT draw, r, c, z, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('-', 0, draw, r, c)), r, c) AS k FROM z, range(0, 1000) AS d(draw)),
own AS (SELECT r, c, k FROM m WHERE draw = 0), y AS (SELECT own.r, own.c, draw, z FROM own JOIN m USING (k)),
e AS (SELECT a.r, a.c, b.r AS r2, b.c AS c2, 1.0::DOUBLE / count(*) OVER (PARTITION BY a.r, a.c) AS w FROM z AS a JOIN z AS b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND NOT (a.r = b.r AND a.c = b.c)),
i AS (SELECT p.draw, (SELECT count(*) FROM z) / sum(w) * sum(w * p.z * q.z) / (SELECT sum(z * z) FROM z) AS i FROM e JOIN y AS p ON p.r = e.r AND p.c = e.c JOIN y AS q ON q.r = e.r2 AND q.c = e.c2 AND q.draw = p.draw GROUP BY 1),
g AS (SELECT (SELECT i FROM i WHERE draw = 0) AS morans_i, (count_if(i >= (SELECT i FROM i WHERE draw = 0)) FILTER (draw > 0) + 1) / 1000.0::DOUBLE AS p, avg(i) FILTER (draw > 0) AS null_mean, quantile_cont(i, 0.95) FILTER (draw > 0) AS null_high FROM i)"""


@query(f"WITH {_DEALT} SELECT (SELECT count(*) FROM s) AS n, round(morans_i, 6) AS morans_i, p, round(null_mean, 6) AS null_mean, round(null_high, 6) AS null_high FROM g")
def moran_permutations(spark, sf_dir):
    return _r(inference.moran_permutations(_changed(spark, sf_dir), "r", "c", "delta"), "morans_i", "null_mean", "null_high", places=6)


@query(f"""WITH {_DEALT}, a AS (SELECT rank() OVER (ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY abs(delta)) - 1) / 2.0 AS x, rank() OVER (ORDER BY effort) + (count(*) OVER (PARTITION BY effort) - 1) / 2.0 AS y FROM s),
h AS (SELECT count(*) AS n, corr(x, y) AS rho FROM a), o AS (SELECT count(*) AS cells, median(delta) AS md, median(abs(delta - delta_detected)) AS mg, count_if(most < 1000) AS dropped FROM s)
SELECT cells, round(md, 6) AS median_delta, round(mg, 6) AS median_gap, dropped, round(morans_i, 6) AS morans_i, g.p AS morans_p, round(rho, 6) AS effort_rho, round({two_sided('rho * sqrt((n - 2) / (1 - rho * rho))')}, 5) AS effort_p,
abs(md) <= 1.5 AS drift_ok, mg <= 1.0 AS model_ok, morans_i > 0 AND g.p < 0.05 AS structure_ok, abs(rho) < 0.3 AS effort_ok, dropped <= 0.1 * cells AS drop_ok, abs(md) <= 1.5 AND mg <= 1.0 AND morans_i > 0 AND g.p < 0.05 AND abs(rho) < 0.3 AND dropped <= 0.1 * cells AS publishable FROM o, g, h""")
def graded_surface(spark, sf_dir):
    d = _changed(spark, sf_dir).withColumn("steady", F.col("most") >= 1000)
    return _r(_r(inference.grade_surface(d, "r", "c"), "median_delta", "median_gap", "morans_i", "effort_rho", places=6), "effort_p")


_FIT = "(vg * cxy - cxg * cgy) / (vx * vg - cxg * cxg)"


_HOLES = _CHANGED.replace("GROUP BY ALL)", "GROUP BY ALL HAVING avg(c_nationkey) >= 8)")


@query(f"""WITH {_HOLES}, f AS (SELECT min(r) AS top, min(c) AS lft, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w FROM s),
d AS (SELECT draw, 1 + floor(({_UNIT.format("0, draw, 'y'")}) * greatest(h - 1, 1))::BIGINT AS dy, 1 + floor(({_UNIT.format("0, draw, 'x'")}) * greatest(w - 1, 1))::BIGINT AS dx, top, lft, h, w FROM f, range(1, 1000) AS t(draw)),
m AS (SELECT 0 AS draw, delta AS y, effort AS g, most AS x FROM s UNION ALL SELECT d.draw, a.delta, a.effort, b.most FROM s AS a, d JOIN s AS b ON b.r = top + (((a.r - top - dy) % h) + h) % h AND b.c = lft + (((a.c - lft - dx) % w) + w) % w),
q AS (SELECT draw, count(*) AS n, covar_pop(x, x) AS vx, covar_pop(g, g) AS vg, covar_pop(x, g) AS cxg, covar_pop(x, y) AS cxy, covar_pop(g, y) AS cgy, corr(x, y) AS rxy, corr(x, g) AS rxg, corr(y, g) AS ryg FROM m GROUP BY 1)
SELECT (SELECT n FROM q WHERE draw = 0) AS cells, round((SELECT {_FIT} FROM q WHERE draw = 0) * 1e6, 4) AS slope, round((SELECT (rxy - rxg * ryg) / sqrt((1 - rxg * rxg) * (1 - ryg * ryg)) FROM q WHERE draw = 0), 6) AS partial_r,
((SELECT count(*) FROM q WHERE draw > 0 AND vx * vg - cxg * cxg > 0 AND n >= 3 AND abs({_FIT}) >= (SELECT abs({_FIT}) FROM q WHERE draw = 0)) + 1) / 1000.0::DOUBLE AS p, round((SELECT sum(n) FROM q WHERE draw > 0) / 999.0, 4)::DOUBLE AS mean_cells""")
def toroidal_null(spark, sf_dir):
    out = inference.toroidal_null(_changed(spark, sf_dir).where("effort >= 8"), "r", "c", "delta", "most", "effort")
    return _r(_r(out.withColumn("slope", F.col("slope") * 1e6), "slope", "mean_cells", places=4), "partial_r", places=6)
