"""Periodic runs of words by a dictionary of basic factors.

The factors of a document are its stretches of 1, 2, 4, ... words. A factor of
length 2k is named by the names of its halves, so equal factors have equal names;
one that occurs once is dropped, as no longer factor that repeats can start there.
Each occurrence looks at its successor. If both lie within twice the factor's
length, their distance is a period there: in a run of period q, factors of q to
2q words start q apart, nowhere closer, and their starts are consecutive. So
consecutive starts with one distance p are extended to the stretch from the first
start to the end of the last successor. Such a stretch has smallest period p and
no neighbouring word extends it: a smaller period would make a nearer successor,
a neighbour with the same period another start. A run is found at one to several
lengths and kept once.

Documents are independent rows of a scan; nothing is shuffled. A task takes texts
of about 2 MB together, or one longer text, and needs about 100 bytes for each
byte of it while it looks.

Cases: a null text has no words, no runs and an empty collapsed text, as has an
empty or blank one; a text of any length is searched whole; null and repeated ids
and repeated rows are rows like others; runs that overlap are all reported, ordered
by start, then period; an empty table gives an empty result; columns other than id
and text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .textbytes import column_slices, words

MIN_LENGTH = 6
MIN_POWER = 4
_RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for identical words."""
    if not len(starts):
        return np.zeros(0, np.int64)
    marks = np.zeros(len(data) + 1, np.int8)
    marks[starts] += 1
    np.subtract.at(marks, ends, 1)
    inside = np.cumsum(marks[:-1], dtype=np.int8).view(bool)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def _stretches(at: np.ndarray, distance: np.ndarray, width: int) -> np.ndarray:
    """(start, length, period) of the stretches that consecutive starts ``at`` with one distance to their successors make."""
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (distance[1:] != distance[:-1])
    a = np.flatnonzero(first)
    last = np.append(a[1:], len(at))[: len(a)] - 1
    return np.column_stack([at[a], at[last] - at[a] + distance[a] + width, distance[a]])


def find_runs(codes: np.ndarray, row_words: np.ndarray, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> np.ndarray:
    """(start, length, period) of all runs, ordered by start, then period.

    Items are numbers; row_words are the rows' offsets, and no run crosses them. A run
    has at least min_length items and min_power (2 or more) periods.
    """
    n, found = len(codes), []
    row = np.repeat(np.arange(len(row_words) - 1), np.diff(row_words))
    at, key = np.arange(n), row * (int(codes.max(initial=0)) + 1) + codes
    name, width = np.empty(n, np.int64), 1
    while len(at):
        order = np.argsort(key, kind="stable")
        key, place = key[order], at[order]
        same = key[1:] == key[:-1]
        near = np.flatnonzero(same & (place[1:] - place[:-1] <= width))
        near = near[np.argsort(place[near], kind="stable")]
        got = _stretches(place[near], place[near + 1] - place[near], width)
        found.append(got[got[:, 1] >= np.maximum(min_length, min_power * got[:, 2])])
        name.fill(-1)
        again = np.append(same, False) | np.insert(same, 0, False)[: len(place)]
        name[place[again]] = np.cumsum(np.insert(~same, 0, True)[: len(place)])[again]
        at = np.flatnonzero(name >= 0)
        at = at[at + 2 * width <= row_words[row[at] + 1]]
        at = at[name[at + width] >= 0]
        key = name[at] * (len(place) + 1) + name[at + width]
        width *= 2
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 2], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:] != runs[:-1]).any(axis=1)
    return runs[fresh]


def _collapsed(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, row_words: np.ndarray, kept: np.ndarray) -> pa.Array:
    """Each row's kept words joined by one space."""
    row = np.repeat(np.arange(len(row_words) - 1), np.diff(row_words))[kept]
    starts, ends = starts[kept], ends[kept]
    marks = np.zeros(len(data) + 1, np.int8)
    marks[starts] += 1
    np.subtract.at(marks, ends, 1)
    inside = np.cumsum(marks[:-1], dtype=np.int8).view(bool)
    gaps = ends[:-1][row[1:] == row[:-1]]  # a word that another follows has a space after it
    data = data.copy()
    data[gaps] = 0x20
    inside[gaps] = True
    sizes = np.concatenate([[0], np.cumsum(inside)])[offsets]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(data[inside])]).cast(pa.string())


def _search(min_length: int, min_power: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in column_slices(batch["text"]):
                starts, ends, row_words = words(data, offsets)
                runs = find_runs(_codes(data, starts, ends), row_words, min_length, min_power)
                steps = np.zeros(len(starts) + 1, np.int64)
                np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
                np.subtract.at(steps, runs[:, 0] + runs[:, 1], 1)
                kept = np.cumsum(steps[:-1]) == 0
                row = np.searchsorted(row_words, runs[:, 0], "right") - 1
                runs[:, 0] -= row_words[row]
                lists = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(len(row_words))).astype(np.int32), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x), pa.int64()) for x in runs.T], ["start", "length", "period"]))
                ids = batch["doc_id"].slice(at, len(lists))
                yield pa.record_batch([ids, pa.array(np.diff(row_words), pa.int64()), lists, _collapsed(data, offsets, starts, ends, row_words, kept)], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: all runs of words, and the words that are not repetition.

    A run is a stretch with smallest period q and at least max(min_length, min_power * q)
    words that no neighbouring word extends; ``collapsed`` has the words left when each
    run gives up all after its first q.
    """
    if min_power < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_search(min_length, min_power), f"doc_id bigint, n_words bigint, runs array<{_RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, of equal ones the first; null without runs."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(_RUN), lambda best, r: F.when(better(best, r), r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the texts made periodic from some word on where crc32 of the id ends in 0."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    split = F.when(F.pmod(crc, F.lit(10)) == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    ws, n, g = F.col("ws"), F.size("ws"), F.floor(crc / 10)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(ws, a + 1, p), times)), F.lit(1), n - a)
    made = F.array_join(F.concat(F.slice(ws, F.lit(1), a), tail), " ")
    return docs.select("doc_id", "text", split.alias("ws")).select("doc_id", F.when(n > 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = periodic_runs(planted(docs)).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    runs = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        exponent.alias("exponent_milli"),
        F.sha2(F.encode(runs, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


SQL = None
