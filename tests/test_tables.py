"""Delimited text with planted faults, and names through chains, circles and doubles."""

import pytest
from pyspark.sql import Observation, functions as F

from skeinflow.operators import names
from skeinflow.plans import registry
from skeinflow.sources import delimited

HEADER = ["key", "name", "value", "day"]
KINDS = {"value": "double", "key": "int", "day": "date"}


def lines(k):
    if k % 10 == 3:
        return f"{k}\ttoo\tfew"
    if k % 25 == 4:
        return f"{k}\tone\t1.0\t2001-01-01\tmore"
    value = "x" if k % 7 == 0 else "" if k % 7 == 1 else f"{k}.5"
    return f'{k}\t"quoted, {k}\t{value}\t2001-01-{k % 40 + 1:02}'


@pytest.fixture
def files(tmp_path):
    for part in range(3):
        body = "\n".join(["\t".join(HEADER), *[lines(k) for k in range(part * 400, part * 400 + 400)]])
        (tmp_path / f"part{part}.txt").write_bytes(body.encode() + b"\n" + f"{part}\tcaf".encode() + b"\xe9\t1.0\t2001-01-01\n")
    return str(tmp_path / "*.txt")


def test_faults_are_counted_in_the_scan_that_writes(spark, files, tmp_path):
    counts = delimited.project(spark, files, KINDS, f"{tmp_path}/out")
    short, long = (sum(f(k) for k in range(1200)) for f in (lambda k: k % 10 == 3, lambda k: k % 10 != 3 and k % 25 == 4))
    kept = [k for k in range(1200) if len(lines(k).split("\t")) == 4]
    assert (counts["lines"], counts["short"], counts["long"]) == (1203, short, long)
    assert counts["unread_value"] == sum(k % 7 == 0 for k in kept) and counts["unread_day"] == sum(k % 40 > 30 for k in kept) and counts["unread_key"] == 0
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.columns == list(KINDS) and out.count() == len(kept) + 3
    assert out.where("value is null").count() == sum(k % 7 < 2 for k in kept)
    scan = delimited.read_delimited(spark, files, KINDS)._jdf.queryExecution().executedPlan().toString()
    assert scan.count("FileScan") == 1


def test_ragged_lines_are_filled_and_cut(spark, files):
    seen = Observation()
    d = delimited.read_delimited(spark, files, {"key": "int", "value": "string", "day": "string"}, ragged=True, seen=seen)
    got = {r.key: r for r in d.collect() if r.key >= 3}
    assert len(got) == 1197 and seen.get["short"] == 120
    assert (got[13].value, got[13].day) == ("few", None) and got[4].day == "2001-01-01" and got[8].value is None


def test_latin_bytes_and_quotes_are_text(spark, files):
    d = delimited.read_delimited(spark, files, {"name": "string"})
    assert d.where("name = 'café'").count() == 3 and d.where(F.col("name").startswith('"quoted, ')).count() > 900


def test_missing_columns_and_empty_files(spark, tmp_path, files):
    with pytest.raises(ValueError, match="nowhere"):
        delimited.read_delimited(spark, files, {"nowhere": "int"})
    (tmp_path / "none.csv").write_text("")
    assert delimited.read_delimited(spark, f"{tmp_path}/none.csv", KINDS).count() == 0
    (tmp_path / "pipes.csv").write_text("a|b\n1|2\n|\n")
    assert [tuple(r) for r in delimited.read_delimited(spark, f"{tmp_path}/pipes.csv", {"b": "int", "a": "int"}, separator="|").collect()] == [(2, 1), (None, None)]


def test_members_are_concatenated_in_the_widest_types(spark):
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([(2.5, 7)], "n double, other long")
    out = delimited.concatenated([a, b])
    assert dict(out.dtypes) == {"n": "double", "s": "string", "other": "bigint"}
    assert sorted(map(tuple, out.collect())) == [(1.0, "x", None), (2.5, None, 7)]


def test_names_are_folded(spark):
    words = [("Père  Noël's", "pere noels"), ("ČESKÝ-les", "cesky les"), ("  ", None), ("’", None), (None, None), ("a.b", "a b"), ("Straße", "straße")]
    df = spark.createDataFrame(words, "n string, want string")
    assert [r[0] for r in df.select(names.folded(F.col("n"))).collect()] == [w for _, w in words]


def test_chains_circles_and_breaks(spark):
    chain = [(k, k - 1 if k else None) for k in range(200)]
    circle = [(1000 + k, 1000 + (k + 1) % 6) for k in range(6)] + [(1010, 1003), (1020, 1021), (1021, 1020)]
    other = [(2000, 2999), (2001, 2000), (3000, 3000), (4000, 0), (4000, 3000), (4001, 4000), (None, 1)]
    got = {r.key: (r.root, r.status) for r in names.accepted_keys(spark.createDataFrame(chain + circle + other, "key int, accepted_key int")).collect()}
    assert got[0] == (0, "accepted") and all(got[k] == (0, "synonym") for k in range(1, 200))
    assert all(got[k] == (None, "circle") for k, _ in circle)
    assert got[2000] == got[2001] == (None, "broken") and got[3000] == (3000, "accepted") and got[4000] == got[4001] == (None, "broken")


def test_names_without_one_key_are_refused(spark):
    backbone = [(1, "Felis catus", None, 90), (2, "Felis domesticus", 1, 90), (3, "FELIS  Catus.", 1, 80), (4, "Puma", None, 90), (5, "puma", None, 70), (6, "Lynx", 7, 90), (7, "lynx b", 6, 90), (8, "Ocelot", None, 10)]
    asked = [("felis catus", 1, None), ("Félis domesticus", 1, None), ("Puma", None, "ambiguous"), ("lynx", None, "circle"), ("ocelot", None, "unknown"), ("nobody", None, "unknown"), (" ", None, "no name"), (None, None, "no name")]
    out = names.resolved(spark.createDataFrame(asked, "n string, want int, why string"), spark.createDataFrame(backbone, "key int, name string, accepted_key int, confidence int"), "n", least_confidence=50)
    assert len(asked) == out.count() and all((r.accepted_key, r.refusal) == (r.want, r.why) for r in out.collect())


VARIES = {"occupancy": "psi", "occupancy_interval": "low", "epoch_changes": "d_psi", "expected_taxa": "expected", "nearest_cells": "error_km", "available_environment": "share", "balanced_panel": "years", "tracking_index": "tracking", "date_drift": "slope", "day_gaps": "missing", "disclosure_decisions": "reason", "off_grid_report": "off_grid", "held_out_groups": "median_se", "resolved_names": "refusal", "schema_drift": "unexpected", "purged_partitions": "removed", "delimited_rows": "balance", "admitted_rows": "refusal"}


@pytest.mark.parametrize("name", sorted(VARIES))
def test_results_vary(spark, name):
    rows = registry.QUERIES[name](spark, "/root/testdata/sf0.01").select(VARIES[name]).distinct().collect()
    assert len(rows) > 1


def test_balanced_panel_drops_no_year_for_its_observations(spark):
    """Stations with two years on both sides of 1998 stay, with all their years."""
    from skeinflow.plans import more_queries

    d = more_queries._panel(spark, "/root/testdata/sf0.01")
    want = {}
    for r in d.collect():
        want.setdefault(r.l_suppkey, set()).add(r.year)
    want = {k: len(ys) for k, ys in want.items() if sum(y < 1998 for y in ys) >= 2 and sum(y >= 1998 for y in ys) >= 2}
    assert {r.l_suppkey: r.years for r in registry.QUERIES["balanced_panel"](spark, "/root/testdata/sf0.01").collect()} == want
