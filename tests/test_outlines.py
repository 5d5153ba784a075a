"""Lines against a recursive brute force; surfaces packed, refused and unpacked."""

import math
import random

import pytest
from pyspark.errors import PySparkException

from skeinflow.operators import outlines


def split(line, tolerance):
    """Places kept, one chord after the other."""
    if len(line) <= 2:
        return {p[0] for p in line}
    (_, y1, x1), (_, y2, x2) = line[0], line[-1]
    length = math.sqrt((y2 - y1) ** 2 + (x2 - x1) ** 2)
    off = [math.sqrt((y - y1) ** 2 + (x - x1) ** 2) if length == 0 else abs((x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)) / length for _, y, x in line[1:-1]]
    if max(off) <= tolerance:
        return {line[0][0], line[-1][0]}
    at = off.index(max(off)) + 1
    return split(line[: at + 1], tolerance) | split(line[at:], tolerance)


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(5)
    out = {}
    for line in range(4):
        y, x, points = 0.0, 0.0, []
        for k in range(1000):
            y, x = y + rng.gauss(0, 0.1), x + rng.gauss(0, 0.1)
            points.append((k * 3, round(y, 6), round(x, 6)))
        out[f"walk{line}"] = points
    out["stairs"] = [(k, k // 2 * 0.01, (k + 1) // 2 * 0.01) for k in range(400)]
    out["loop"] = [(k, math.sin(k * math.pi / 20), math.cos(k * math.pi / 20)) for k in range(41)]
    out["back"] = [(0, 1.0, 1.0), (1, 2.0, 2.0), (2, 1.0, 1.0)]
    out["two"], out["one"] = [(0, 1.0, 1.0), (1, 2.0, 2.0)], [(7, 1.0, 1.0)]
    return out


@pytest.mark.parametrize("tolerance", [0.011, 0.5, 100.0])
def test_simplified_lines_equal_brute_force(spark, lines, tolerance):
    rows = [(line, *p, "x") for line, points in lines.items() for p in points]
    df = spark.createDataFrame(rows, "line string, k int, la double, lo double, off string").repartition(3)
    got = outlines.simplify(df, ["line"], "k", "la", "lo", tolerance)
    assert got.columns == df.columns
    kept = {}
    for r in got.collect():
        kept.setdefault(r.line, set()).add(r.k)
    assert kept == {line: split(points, tolerance) for line, points in lines.items()}


def test_rounds_are_few(spark, lines, monkeypatch):
    calls = []
    monkeypatch.setattr(outlines, "cut", lambda df, cut=outlines.cut: calls.append(1) or cut(df))
    df = spark.createDataFrame([("a", *p) for p in lines["walk0"]], "line string, k int, la double, lo double")
    assert outlines.simplify(df, ["line"], "k", "la", "lo", 0.05).count() > 100
    assert len(calls) / 2 <= 4 * math.log2(1000)


def test_empty_lines(spark):
    assert outlines.simplify(spark.createDataFrame([], "line string, k int, la double, lo double"), ["line"], "k", "la", "lo", 1.0).count() == 0


def test_packed_surface_comes_back(spark):
    rng = random.Random(2)
    cells = {(rng.randrange(720), rng.randrange(360)) for _ in range(500)}
    rows = [("t", (x + 0.5) * 0.5 - 180, (y + 0.5) * 0.5 - 90, None if x == 7 else x * y) for x, y in cells] + [("u", -179.75, 89.75, 1)]
    df = spark.createDataFrame(rows, "taxon string, lon double, lat double, v int")
    packed = outlines.pack_grid(df, ["taxon"], "lon", "lat", "v", 0.5, tile=100)
    assert all(len(r.x) == len(r.y) == len(r.v) <= 10_000 and max(r.x) < 100 for r in packed.collect())
    assert all(list(zip(r.y, r.x, strict=True)) == sorted(zip(r.y, r.x, strict=True)) for r in packed.collect())
    assert sorted(map(tuple, outlines.unpack_grid(packed, ["taxon"], 0.5, tile=100).collect()), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("lon", [0.25 + 0.5e-5, None, 0.0])
def test_a_position_off_its_centre_is_refused(spark, lon):
    df = spark.createDataFrame([("t", 10.25, 0.25, 1), ("t", lon, 0.25, 1)], "taxon string, lon double, lat double, v int")
    with pytest.raises(PySparkException, match="off the grid|no position"):
        outlines.pack_grid(df, ["taxon"], "lon", "lat", "v", 0.5).collect()
    report = outlines.off_grid_report(df, ["taxon"], "lon", "lat", 0.5).first()
    assert (report.off_grid, report.n) == (1, 2)


def test_rounding_below_the_tolerance_is_no_refusal(spark):
    df = spark.createDataFrame([("t", 0.1 * k - 180 + 0.05, -89.95, 1) for k in range(1, 3600)], "taxon string, lon double, lat double, v int")
    packed = outlines.pack_grid(df, ["taxon"], "lon", "lat", "v", 0.1, tile=5000).first()
    assert packed.x == list(range(1, 3600)) and set(packed.y) == {0}
