"""Periodic runs against brute force: all periods of small sequences, and the query on whole tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.llm import periodic_runs as pr

SF = "/root/testdata/sf0.001"


def brute(w, min_length=6, min_power=4):
    """Every period in turn: stretches of words equal to those q later, without those of a smaller period."""
    code = {x: i for i, x in enumerate(dict.fromkeys(w))}
    w, out = np.array([code[x] for x in w], np.int64), []
    for q in range(1, len(w) // min_power + 1):
        edge = np.diff(np.concatenate([[0], w[:-q] == w[q:], [0]]).astype(int))
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q, strict=True):
            if e - s >= max(min_length, min_power * q) and not any((w[s : e - d] == w[s + d : e]).all() for d in range(1, q)):
                out.append((int(s), int(e - s), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def answer(doc_id, text):
    """The contract's row, word by word."""
    w = words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = brute(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(500):
        docs = []
        for _ in range(rng.randrange(1, 4)):
            w = []
            while rng.random() < 0.8:
                unit = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 7))]
                w += (unit * rng.randrange(1, 8))[: rng.randrange(1, 40)]
            docs.append(w)
        offsets = np.cumsum([0] + [len(x) for x in docs])
        got = pr.find_runs(np.array(sum(docs, []), np.int64), offsets).tolist()
        assert got == [[s + o, n, q] for o, x in zip(offsets.tolist(), docs, strict=False) for s, n, q in brute(x)]


def test_query_equals_brute_force_on_all_documents(spark):
    got = {r.doc_id: tuple(r) for r in pr.op12_periodic_runs(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: answer(*r) for r in rows}
    assert got == want
    assert sum(r[1] > 0 for r in want.values()) > 5


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n\t\x0b ", 0), (4, "a " * 6, 0), (5, "a " * 5, 0), (6, "x a b a b a b a b a b y", 0), (7, "ü ü ü ü ü ü ü", 0), (7, "ü ü ü ü ü ü ü", 0), (None, "k k k k k k a a a a a a", 0), (9, ("w%d " * 50 % tuple(range(50))) * 400, 0), (10, "z" * 100_000, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, runs int")


def test_odd_rows_and_ties(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in pr.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = sorted((answer(r.doc_id, r.text) if r.doc_id is not None else (None, *answer(-1, r.text)[1:]) for r in odd.collect()), key=str)
    assert zlib.crc32(b"-1") % 10 and got == want
    out = {r.doc_id: r for r in pr.periodic_runs(odd).collect()}
    assert [tuple(r) for r in out[6].runs] == [(1, 10, 2)] and out[6].collapsed == "x a b y"
    assert [tuple(r) for r in out[9].runs] == [(0, 20000, 50)] and out[7].collapsed == "ü" and out[3].collapsed == ""
    none = odd.where(F.lit(False))
    assert pr.periodic_runs(none).count() == 0


def test_a_smaller_power_finds_more_and_two_is_refused(odd):
    text = odd.sparkSession.createDataFrame([(1, "a b a b a b")], "doc_id long, text string")
    assert [tuple(r) for r in pr.periodic_runs(text, min_power=3).first().runs] == [(0, 6, 2)]
    assert pr.periodic_runs(text).first().runs == []
    with pytest.raises(ValueError, match="three periods"):
        pr.periodic_runs(odd, min_power=2)
