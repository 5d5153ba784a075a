"""Substring dedup on bytes by interval expansion on Burrows-Wheeler transforms.

A byte goes if it lies in a string of ``length`` bytes of one document that also
starts anywhere else, in the same document too.

1. Every such string has an anchor: its least hashed ``gram``-byte substring. Equal
   strings have equal anchors, so strings are compared within an anchor only. The
   region of an anchor is all that strings with this anchor can cover.
2. Shards of anchors count equal regions. A region found twice is repeated as a
   whole. A string has half of what surrounds its anchor, or more, on one side; a
   region whose anchor with that half is not in another region, on either side, has
   no repeated string otherwise. Of those left, one bucket supplies each region's
   bytes.
3. A task joins the regions of its anchors into texts of about ``_TEXT_BYTES``, makes
   the transform and extends intervals backwards, breadth first, so that common
   prefixes come by increasing value; it stops at ``length``. What is then without a
   value shares ``length`` bytes with its neighbour.
4. An anchor with more than ``hot_regions`` different regions is not gathered: the
   buckets send digests of its strings, which are counted exactly by hash.

Cases: null text counts as empty; documents shorter than ``length`` stay whole;
a document of any length is one run of bytes, of which the work arrays take about
60 times as much; rows with equal ids, or none, are documents of their own; of
equally small hashes all are anchors; an empty table gives an empty result; other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .buckets import bucketed, by_shard, pack_sorted, partitions, unpack_sorted
from .textbytes import RangeHash, column_slices, mix

LENGTH, GRAM, HOT_REGIONS = 400, 300, 500
_TEXT_BYTES = 300_000
_A, _B = RangeHash(31), RangeHash(32)
_DUP, _SUPPLY, _HOT = 1, 2, 4
_PLACES = 4  # the kind of rows that carry the places of a bucket's anchors, found once
_ROW = "kind int, shard int, bucket int, body binary"


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        x = op(x[:-span], x[span:])
        span *= 2
    return op(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class _Bucket:
    """The anchors of a bucket's documents and its distinct (anchor, region) entries."""

    def __init__(self, table: pa.Table, length: int, gram: int, places: bytes | None = None) -> None:
        """places: the anchors' places, packed, if they were found before."""
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.length, self.gram = length, gram
        self.parts, base = [], 0
        found: list[list] = [[] for _ in range(6)]
        known = None if places is None else unpack_sorted(places).astype(np.int64)
        self.places = []
        for row, data, offsets in column_slices(self.table["text"], 1_000_000):
            self.parts.append((row, data, offsets, base))
            if len(data) >= length:
                p = None if known is None else known[slice(*np.searchsorted(known, [base, base + len(data)]))] - base
                for k, (out, x) in enumerate(zip(found, self._anchors(data, offsets, base, p), strict=True)):
                    out.append(x + base if k > 3 else x)
            base += len(data)
        kinds = (np.uint64,) * 4 + (np.int64,) * 2
        anchor, region, left, right, self.start, self.end = (np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(found, kinds, strict=True))
        order = np.lexsort((region, anchor))
        a, b = anchor[order], region[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.order, self.head = order, np.flatnonzero(new)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.anchor, self.region = a[self.head], b[self.head]
        self.left, self.right = left[order][self.head], right[order][self.head]
        self.several = np.diff(np.append(self.head, len(order))) > 1

    def _least(self, pre: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places of the least hashed gram of every string."""
        n, k, length = len(pre) - 1, self.gram, self.length
        at = np.arange(n - k + 1)
        grams = np.maximum(_A.of(pre, at, at + k), np.uint64(1))
        width = length - k + 1
        least = _sliding(grams, width, np.minimum)
        doc_end = np.repeat(offsets[1:], np.diff(offsets))
        whole = np.arange(len(least)) + length <= doc_end[: len(least)]
        least = np.where(whole, least, np.uint64(0))
        pad = np.zeros(width - 1, np.uint64)
        most = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
        return np.flatnonzero(most[: len(grams)] == grams)

    def _anchors(self, data: np.ndarray, offsets: np.ndarray, base: int, p: np.ndarray | None):
        n, k, length = len(data), self.gram, self.length
        pre, pre2 = _A.prefix(data), _B.prefix(data)
        if p is None:
            p = self._least(pre, offsets)
            self.places.append(p + base)
        gram = np.maximum(_A.of(pre, p, p + k), np.uint64(1))
        row = np.searchsorted(offsets, p, "right") - 1
        start, end = np.maximum(p + k - length, offsets[row]), np.minimum(p + length, offsets[row + 1])
        half = (length - k) // 2
        left = np.where(p - half >= offsets[row], _A.of(pre, np.maximum(p - half, 0), p + k), np.uint64(0))
        right = np.where(p + k + half <= offsets[row + 1], _A.of(pre, p, np.minimum(p + k + half, n)), np.uint64(0))
        shift = (p - start).astype(np.uint64)
        # least hashes are small numbers: mixed again, they spread over the shards
        return mix(gram), _B.of(pre2, start, end) ^ shift, left, right, start, end

    def status(self, rows: pa.Table, shards: int) -> np.ndarray:
        out = np.zeros(len(self.anchor), np.uint8)
        told = {s: x for kind, s, x in zip(*(rows[c].to_pylist() for c in ("kind", "shard", "body")), strict=True) if kind == 0}
        for s, a, b in by_shard(self.anchor, shards):
            out[a:b] = np.frombuffer(told[s], np.uint8)
        return out

    def bytes_of(self, start: int, end: int) -> np.ndarray:
        k = np.searchsorted([base for *_, base in self.parts], start, "right") - 1
        _, data, _, base = self.parts[k]
        return data[start - base : end - base]

    def strings(self, starts: np.ndarray, ends: np.ndarray):
        """Places and digests of all strings of the given regions, each place once."""
        place, one, two = [], [], []
        for _, data, _, base in self.parts:
            own = (starts >= base) & (starts < base + len(data))
            if own.any():
                steps = np.zeros(len(data) + 1, np.int64)
                np.add.at(steps, starts[own] - base, 1)
                np.add.at(steps, ends[own] - base - self.length + 1, -1)
                at = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
                place.append(at + base)
                one.append(_A.of(_A.prefix(data), at, at + self.length))
                two.append(_B.of(_B.prefix(data), at, at + self.length))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return join(place, np.int64), join(one, np.uint64), join(two, np.uint64)


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    kind, shard, bucket, body = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.table({"kind": pa.array(kind, pa.int32()), "shard": pa.array(shard, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "body": pa.array(body, pa.binary())})


def _places(answers: pa.Table) -> bytes:
    return next(x for kind, x in zip(answers["kind"].to_pylist(), answers["body"].to_pylist(), strict=True) if kind == _PLACES)


def _regions(length: int, gram: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        own = _Bucket(table, length, gram)
        places = pack_sorted(np.concatenate(own.places).astype(np.uint32)) if own.places else b""
        return _rows([(_PLACES, bucket % shards, bucket, places)] + [(0, s, bucket, b"".join(x[a:b].tobytes() for x in (own.anchor, own.region, own.left, own.right, own.several.astype(np.uint64)))) for s, a, b in by_shard(own.anchor, shards)])

    return run


def _count(hot_regions: int):
    def run(whole: pa.Table) -> pa.Table:
        table, places = (whole.filter(pc.equal(whole["kind"], k)) for k in (0, _PLACES))
        passed = [(_PLACES, 0, b, x) for b, x in zip(places["bucket"].to_pylist(), places["body"].to_pylist(), strict=True)]
        if not len(table):
            return _rows(passed)
        sent = [np.frombuffer(x.as_py(), np.uint64).reshape(5, -1) for x in table["body"]]
        anchor, region, left, right, several = np.concatenate(sent, axis=1)
        order = np.lexsort((region, anchor))
        a, b = anchor[order], region[order]
        new_a = np.ones(len(order), bool)
        new_a[1:] = a[1:] != a[:-1]
        new = new_a.copy()
        new[1:] |= b[1:] != b[:-1]
        head, group = np.flatnonzero(new), np.cumsum(new) - 1
        dup = (np.diff(np.append(head, len(order))) > 1) | (np.maximum.reduceat(several[order], head) > 0)
        near = np.zeros(len(head), bool)
        for side in (left, right):
            value, inverse, counts = np.unique(side[order][head], return_inverse=True, return_counts=True)
            near |= (counts[inverse] > 1) & (value[inverse] > 0)
        of_anchor = (np.cumsum(new_a) - 1)[head]
        regions = np.bincount(of_anchor, near)[of_anchor]
        state = dup * _DUP + (near & (regions > hot_regions)) * _HOT
        status = state[group].astype(np.uint8)
        status[head] |= np.where(near & (regions > 1), _SUPPLY, 0).astype(np.uint8)
        back = np.empty(len(order), np.uint8)
        back[order] = status
        cuts = np.cumsum([0, *(x.shape[1] for x in sent)])
        return _rows(passed + [(0, s, k, back[cuts[i] : cuts[i + 1]].tobytes()) for i, (s, k) in enumerate(zip(table["shard"].to_pylist(), table["bucket"].to_pylist(), strict=True))])

    return run


def _supply(length: int, gram: int, shards: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _rows([])
        bucket = table["bucket"][0].as_py()
        places = _places(answers)
        own = _Bucket(table, length, gram, places)
        status = own.status(answers, shards)
        out = [(3, bucket % shards, bucket, status.tobytes()), (_PLACES, bucket % shards, bucket, places)]
        where = own.order[own.head]
        give = (status & _SUPPLY > 0) & (status & _HOT == 0)
        for s, a, b in by_shard(own.anchor, shards):
            ref = np.flatnonzero(give[a:b]) + a
            if len(ref):
                start, end = own.start[where[ref]], own.end[where[ref]]
                body = np.concatenate([own.bytes_of(x, y) for x, y in zip(start, end, strict=True)])
                out.append((1, s, bucket, np.array([len(ref)], np.int64).tobytes() + own.anchor[ref].tobytes() + ref.tobytes() + start.tobytes() + (end - start).tobytes() + body.tobytes()))
        hot = np.flatnonzero(status[own.entry] & _HOT > 0) if len(own.entry) else own.entry
        if len(hot):
            _, one, two = own.strings(own.start[hot], own.end[hot])
            order = np.lexsort((two, one))
            one, two = one[order], two[order]
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            head = np.flatnonzero(new)
            several = (np.diff(np.append(head, len(one))) > 1).astype(np.uint64)
            one, two = one[head], two[head]
            out += [(2, s, bucket, one[a:b].tobytes() + two[a:b].tobytes() + several[a:b].tobytes()) for s, a, b in by_shard(one, shards)]
        return _rows(out)

    return run


def _order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The order by two numbers below 2**20; sorting packed values is much faster than argsort."""
    n = len(high)
    if n > 1 << 20 or int(max(high.max(initial=0), low.max(initial=0))) >= 1 << 20:
        return np.lexsort((low, high))
    return np.sort((high << 40) | (low << 20) | np.arange(n)) & ((1 << 20) - 1)


def repeated_starts(text: np.ndarray, length: int) -> np.ndarray:
    """Groups (an id for each place, -1 for none) of places where the next ``length`` symbols are the same.

    text: separators, each a value of its own from 0 on, and bytes beyond them; it
    ends with a separator.
    """
    n = len(text)
    m = seps = int(text[-1]) + 1
    rank, span = text.astype(np.int64), 1
    order = None
    while span < length:
        after = np.zeros(n, np.int64)
        after[: n - span] = rank[span:]
        order = _order(rank, after)
        new, one, two = np.ones(n, np.int64), rank[order], after[order]
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        rank[order] = np.cumsum(new) - 1
        span *= 2
        if new.all() and span <= length:
            return np.full(n, -1)
    sa = order
    last = text[sa - 1]  # the transform; place 0 follows the last separator
    by = np.argsort(last.astype(np.uint16) if last.max() < 1 << 16 else last, kind="stable")
    step = np.empty(n, np.int64)
    step[by] = np.arange(n)
    value = np.full(n + 1, -1, np.int16)
    value[: seps + 1] = 0
    value[n] = 0
    counts = np.unique(text, return_counts=True)[1]
    low, high = np.cumsum(counts) - counts, np.cumsum(counts) - 1
    value[high + 1] = 0
    for common in range(1, length):
        if not len(low):
            break
        size = high - low + 1
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        own = np.repeat(np.arange(len(low)), size)
        keep = last[at] >= m
        at, own = at[keep], own[keep]
        to = step[at]
        sort = _order(own, to)
        own, to, sym = own[sort], to[sort], last[at[sort]]
        edge = np.ones(len(to), bool)
        edge[1:] = (own[1:] != own[:-1]) | (sym[1:] != sym[:-1])
        begin = np.flatnonzero(edge)
        if not len(begin):
            break
        low, high = to[begin], to[np.append(begin[1:], len(to)) - 1]
        fresh = value[high + 1] < 0
        low, high = low[fresh], high[fresh]
        value[high + 1] = common
    group = np.cumsum(value[:n] >= 0) - 1
    out = np.full(n, -1)
    several = np.bincount(group)[group] > 1
    out[sa[several]] = group[several]
    return out


def _expand(length: int):
    def bwt(rows: list[tuple[int, bytes]]) -> list[tuple[int, int, int, bytes]]:
        anchor, ref, start, size, bucket, body = [], [], [], [], [], []
        for b, x in rows:
            n = int(np.frombuffer(x, np.int64, 1)[0])
            for k, (out, kind) in enumerate(((anchor, np.uint64), (ref, np.int64), (start, np.int64), (size, np.int64))):
                out.append(np.frombuffer(x, kind, n, 8 + 8 * n * k))
            bucket.append(np.full(n, b))
            body.append(np.frombuffer(x, np.uint8, offset=8 + 32 * n))
        anchor, ref, start, size, bucket, body = map(np.concatenate, (anchor, ref, start, size, bucket, body))
        begin = np.cumsum(size) - size
        order = np.argsort(anchor, kind="stable")
        found: dict[int, list] = {}
        low = 0
        total = np.cumsum(size[order] + 1)
        while low < len(order):
            high = int(np.searchsorted(total, (total[low - 1] if low else 0) + _TEXT_BYTES, "right"))
            high = max(high, low + 1)
            while high < len(order) and anchor[order[high]] == anchor[order[high - 1]]:
                high += 1
            for b, item in expand(order[low:high], ref, start, size, bucket, begin, body):
                found.setdefault(b, []).append(item)
            low = high
        return [(1, 0, b, np.concatenate(x, axis=1).astype(np.int64).tobytes()) for b, x in found.items()]

    def expand(pick, ref, start, size, bucket, begin, body):
        own = size[pick]
        n = int(own.sum()) + len(pick)
        ends = np.cumsum(own + 1) - 1
        heads = ends - own
        region = np.repeat(np.arange(len(pick)), own)
        at = np.arange(len(region)) - np.repeat(np.cumsum(own) - own, own)
        text = np.empty(n, np.int64)
        text[ends] = np.arange(len(pick))
        text[heads[region] + at] = body[begin[pick][region] + at].astype(np.int64) + len(pick)
        group = repeated_starts(text, length)
        hit = np.flatnonzero(group >= 0)
        if not len(hit):
            return
        r = np.searchsorted(ends, hit)
        place = bucket[pick][r].astype(np.int64) * (1 << 40) + start[pick][r] + hit - heads[r]
        # a place that lies in two regions is one occurrence
        g = group[hit]
        order = np.lexsort((place, g))
        g, place = g[order], place[order]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        lone = np.minimum.reduceat(place, first) == np.maximum.reduceat(place, first)
        hit = hit[order][~np.repeat(lone, np.diff(np.append(first, len(g))))]
        if not len(hit):
            return
        steps = np.zeros(n + 1, np.int64)
        np.add.at(steps, hit, 1)
        np.add.at(steps, hit + length, -1)
        marks = np.concatenate([[False], np.cumsum(steps[:-1]) > 0, [False]])
        edges = np.flatnonzero(marks[1:] != marks[:-1])
        s, e = edges[::2], edges[1::2]
        r = np.searchsorted(ends, s)
        for b in np.unique(bucket[pick][r]):
            mine = bucket[pick][r] == b
            yield int(b), np.stack([ref[pick][r][mine], s[mine] - heads[r][mine], e[mine] - heads[r][mine]])

    def hot(rows: list[tuple[int, bytes]]) -> list[tuple[int, int, int, bytes]]:
        sent = [np.frombuffer(x, np.uint64).reshape(3, -1) for _, x in rows]
        one, two, several = np.concatenate(sent, axis=1)
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        head = np.flatnonzero(new)
        many = (np.diff(np.append(head, len(order))) > 1) | (np.maximum.reduceat(several[order], head) > 0)
        yes = np.empty(len(order), bool)
        yes[order] = many[np.cumsum(new) - 1]
        out, at = [], 0
        for (k, _), x in zip(rows, sent, strict=True):
            own = yes[at : at + x.shape[1]]
            at += x.shape[1]
            out.append((2, 0, k, x[:2, own].tobytes()))
        return out

    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"][0].as_py()
        rows = list(zip(table["bucket"].to_pylist(), table["body"].to_pylist(), strict=True))
        if kind in (3, _PLACES):
            return _rows([(kind, 0, b, x) for b, x in rows])
        return _rows(bwt(rows) if kind == 1 else hot(rows))

    return run


def _apply(length: int, gram: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept_bytes": pa.array([], pa.binary())})
        own = _Bucket(table, length, gram, _places(answers))
        told: dict[int, list[bytes]] = {1: [], 2: [], 3: [], _PLACES: []}
        for kind, body in zip(answers["kind"].to_pylist(), answers["body"].to_pylist(), strict=True):
            told[kind].append(body)
        status = np.frombuffer(told[3][0], np.uint8) if told[3] else np.zeros(len(own.anchor), np.uint8)
        state = status[own.entry] if len(own.entry) else np.zeros(0, np.uint8)
        dup = state & _DUP > 0
        starts, ends = [own.start[dup]], [own.end[dup]]
        where = own.order[own.head]
        for x in told[1]:
            ref, s, e = np.frombuffer(x, np.int64).reshape(3, -1)
            starts.append(own.start[where[ref]] + s)
            ends.append(own.start[where[ref]] + e)
        hot = (state & _HOT > 0) & ~dup
        if hot.any() and told[2]:
            yes = np.concatenate([np.frombuffer(x, np.uint64).reshape(2, -1) for x in told[2]], axis=1)
            yes = yes[:, np.argsort(yes[0])]
            place, one, two = own.strings(own.start[hot], own.end[hot])
            if yes.shape[1]:
                near = np.minimum(np.searchsorted(yes[0], one), yes.shape[1] - 1)
                place = place[(yes[0][near] == one) & (yes[1][near] == two)]
                starts.append(place)
                ends.append(place + length)
        start, end = np.concatenate(starts), np.concatenate(ends)
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for _, data, offsets, base in own.parts:
            mine = (start >= base) & (start < base + len(data))
            steps = np.zeros(len(data) + 1, np.int64)
            np.add.at(steps, start[mine] - base, 1)
            np.add.at(steps, end[mine] - base, -1)
            gone = np.cumsum(steps[:-1]) > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            begins = offsets[:-1][(np.diff(offsets) > 0)]
            opens[begins] = gone[begins]
            sums = [np.concatenate([[0], np.cumsum(x)])[offsets] for x in (gone, opens)]
            n_bytes.append(np.diff(offsets))
            n_removed.append(np.diff(sums[0]))
            n_spans.append(np.diff(sums[1]))
            rest = data[~gone].tobytes()
            cuts = offsets - sums[0]
            kept += [rest[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"doc_id": own.table["doc_id"], "n_bytes": join(n_bytes), "n_removed": join(n_removed), "n_spans": join(n_spans), "kept_bytes": pa.array(kept, pa.binary())})

    return run


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, gram: int = GRAM, hot_regions: int = HOT_REGIONS, buckets: int | None = None, shards: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_bytes); see the module's text."""
    gram = min(gram, max(1, 3 * length // 4))
    shards = shards or partitions(docs)
    own = bucketed(docs, id_col, text_col, buckets).groupBy("bucket")
    counted = own.applyInArrow(_regions(length, gram, shards), _ROW).groupBy("shard").applyInArrow(_count(hot_regions), _ROW)
    found = own.cogroup(counted.groupBy("bucket")).applyInArrow(_supply(length, gram, shards), _ROW).repartition(2 * shards, "kind", "shard").groupBy("kind", "shard").applyInArrow(_expand(length), _ROW)
    return own.cogroup(found.groupBy("bucket")).applyInArrow(_apply(length, gram), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary")


def op10_bwt_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


SQL = None
