"""Byte-level BPE with DuckDB recursive queries in each task.

A task cuts its texts by the pattern and encodes its distinct pieces, some
thousands at a time: rows (piece, position, token) join the table of merges, and
each round contracts every piece's leftmost pair of least rank, until no pair is
left; ordered aggregation gives the tokens and, back through the vocabulary, the
bytes. Only the rows of a piece's last state leave the recursion.

A round contracts one pair of each piece, so a long piece goes through the query in
slices of ``SLICE`` bytes. Tokens next to each other that encode to themselves
together are tokens of the whole, whatever lies around; where two slices meet in
tokens that do not, the tokens around that place are encoded again as one string,
and more of them each time, until all neighbours fit.

A task keeps its encoded pieces; beyond ``CACHE_PIECES`` of them, those of the last
texts only. What falls out is encoded again, so the bound costs time only.

Cases: null text counts as empty and has no tokens; special tokens have no meaning
in texts; a text of any length is cut once, its pieces are looked up one by one; an
empty table gives an empty result; repeated rows and null ids are rows like others;
ties of rank go to the leftmost pair; columns other than id and text are not looked
at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

SLICE = 64
CACHE_PIECES = 250_000
_AT_ONCE = 25_000
_SLICE_BYTES = 5_000_000

#: ``id`` is piece * 65536 + position. The order of pairs, rank then position, is one number.
#: A row carries its piece's best pair and the row that goes with it; a piece without is done.
_ROUNDS = """
WITH RECURSIVE step AS (
  SELECT id, token, NULL::BIGINT AS pair, NULL::BIGINT AS best, -1::BIGINT AS gone FROM start
  UNION ALL
  (WITH now AS (SELECT id, CASE WHEN pair = best THEN (pair >> 16)::INTEGER ELSE token END AS token FROM step WHERE gone IS NOT NULL AND id <> gone),
  near AS (SELECT id, token, lead((id << 20) | token) OVER (ORDER BY id) AS next FROM now),
  found AS MATERIALIZED (
    SELECT id, token, (rank::BIGINT << 16) | (id & 65535) AS pair, next >> 20 AS next_id
    FROM near LEFT JOIN merges ON ab = CASE WHEN next >> 36 = id >> 16 THEN (token::BIGINT << 20) | (next & 1048575) END),
  least_pair AS (SELECT id >> 16 AS piece, min(pair) AS best, arg_min(next_id, pair) AS gone FROM found WHERE pair IS NOT NULL GROUP BY piece)
  SELECT id, token, pair, best, gone FROM found LEFT JOIN least_pair ON piece = id >> 16)
)
SELECT id >> 16 AS piece, string_agg(token::VARCHAR, ' ' ORDER BY id) AS ids, unhex(string_agg(hex, '' ORDER BY id)) AS body
FROM step JOIN vocabulary USING (token) WHERE gone IS NULL GROUP BY piece
"""

_DECODE = """
SELECT place, unhex(string_agg(hex, '' ORDER BY spot)) AS body
FROM (SELECT place, unnest(ids) AS token, generate_subscripts(ids, 1) AS spot FROM encoded) JOIN vocabulary USING (token) GROUP BY place
"""

_WHITE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_DOUBLE = f"{_WHITE} {_WHITE}|^ | $"


@lru_cache(maxsize=2)
def _tables(path: str) -> tuple[dict[bytes, int], pa.Table, pa.Table]:
    """Ranks, pairs of tokens that are a token together, and the vocabulary: read once by each worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    a, b, rank = zip(*pairs, strict=True)
    merges = pa.table({"ab": (np.array(a, np.int64) << 20) | np.array(b, np.int64), "rank": pa.array(rank, pa.int32())})
    return ranks, merges, pa.table({"token": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]})


def _offsets(lists: list[list]) -> np.ndarray:
    return np.cumsum([0, *map(len, lists)])


def _join(offsets, values: pa.Array, gap: bytes) -> pa.Array:
    """Runs of values as one binary value each."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), gap)


class Codec:
    """Ranks and pattern with the pieces encoded last."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks, merges, vocabulary = _tables(path)  # noqa: F841
        self.name = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.whole, self.rank = pa.array(self.ranks, pa.binary()), np.fromiter(self.ranks.values(), np.int32, len(self.ranks))
        self.forget()
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")

    def forget(self) -> None:
        """The pieces encoded last, their ids and their bytes, are none."""
        self.seen = (pa.array([], pa.string()), pa.array([], pa.binary()), pa.array([], pa.binary()))

    def pieces(self, wanted: set[str]) -> dict[str, tuple[str, bytes]]:
        """Ids, as decimal strings joined by a space, and decoded bytes of each piece."""
        keys = pa.array(wanted, pa.string())
        ids, bodies = (x.to_pylist() for x in self._coded(keys))
        return {p: (i.decode(), body) for p, i, body in zip(keys.to_pylist(), ids, bodies, strict=True)}

    def _coded(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids and bytes of distinct pieces; those that were seen last are not encoded again."""
        at = pc.index_in(pieces, value_set=self.seen[0])
        new = pieces.filter(at.is_null())
        if len(new):
            short = pc.less_equal(pc.binary_length(new), SLICE)
            parts, bodies = [self.seen], new.filter(short)
            for k in range(0, len(bodies), _AT_ONCE):
                part = bodies.slice(k, _AT_ONCE)
                parts.append((part, *self._rounds(part.cast(pa.binary()))))
            if len(bodies) < len(new):
                long = new.filter(pc.invert(short))
                got = self._long(long.cast(pa.binary()).to_pylist())
                parts.append((long, *(pa.array(x, pa.binary()) for x in zip(*got, strict=True))))
            self.seen = tuple(pa.concat_arrays(x) for x in zip(*parts, strict=True))
            at = pc.index_in(pieces, value_set=self.seen[0])
        ids, out = (x.take(at) for x in self.seen[1:])
        if len(self.seen[0]) > CACHE_PIECES:
            self.seen = (pieces, ids, out)
        return ids, out

    def _joined(self, pieces: pa.Array, offsets: np.ndarray) -> list[pa.Array]:
        """Ids and bytes of runs of pieces."""
        coded = pieces.dictionary_encode()
        return [_join(offsets, x.take(coded.indices), gap) for x, gap in zip(self._coded(coded.dictionary), (b" ", b""), strict=True)]

    def _chunks(self, chunks: pa.Array, opening: pa.Array) -> list[pa.Array]:
        """Ids and bytes of chunks after their space, then of those that open a text.

        Chunks after a space are cut as one string, in which each of their spaces begins
        a piece and no other piece begins with one. White space beside it would go with
        the end of the chunk before, so chunks that begin with white space are cut alone.
        """
        alone = pc.match_substring_regex(chunks, f"^{_WHITE}").to_numpy(zero_copy_only=False)
        usual = chunks.filter(pa.array(~alone)).to_pylist()
        found = pa.array(self.find("".join([f" {x}" for x in usual])), pa.string())
        starts = np.flatnonzero(pc.starts_with(found, " ").to_numpy(zero_copy_only=False))
        if len(starts) != len(usual):
            raise ValueError("the pattern must begin a piece at a single space")
        rest = [self.find(x) for x in [f" {x}" for x in chunks.filter(pa.array(alone)).to_pylist()] + opening.to_pylist()]
        pieces = pa.concat_arrays([found, pa.array(chain.from_iterable(rest), pa.string())])
        coded = self._joined(pieces, np.append(starts, len(found) + _offsets(rest)))
        at = np.arange(len(chunks) + len(opening))
        at[np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])] = np.arange(len(chunks))
        return [x.take(pa.array(at)) for x in coded]

    def _rounds(self, bodies: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Encodes byte strings; one that is a token is that token, as in the reference encoders."""
        token = pc.index_in(bodies, value_set=self.whole)
        other = np.flatnonzero(token.is_null().to_numpy(zero_copy_only=False))
        whole = np.flatnonzero(token.is_valid().to_numpy(zero_copy_only=False))
        size = pc.binary_length(rest := bodies.take(pa.array(other))).to_numpy()
        piece = np.repeat(other, size)
        pos = np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size)
        self.db.register("start", pa.table({
            "id": np.concatenate([(piece << 16) | pos, whole << 16]),
            "token": np.concatenate([self.byte[np.frombuffer(b"".join(rest.to_pylist()), np.uint8)], self.rank[token.drop_null().to_numpy()]]),
        }))
        found = self.db.sql(_ROUNDS).to_arrow_table().combine_chunks()
        self.db.unregister("start")
        at = np.full(len(bodies), -1)
        at[found["piece"].to_numpy()] = np.arange(len(found))
        at = pa.array(at, mask=at < 0)  # an empty string has no rows
        return tuple(found[c].cast(pa.binary()).combine_chunks().take(at).fill_null(b"") for c in ("ids", "body"))

    def _tokens(self, bodies: list[bytes]) -> list[list[int]]:
        return [[int(i) for i in ids.split()] for ids in self._rounds(pa.array(bodies, pa.binary()))[0].to_pylist()]

    def _long(self, bodies: list[bytes]) -> list[tuple[str, bytes]]:
        """Pieces of any length by slices; see the module's text."""
        text = lambda tokens: b"".join([self.name[t] for t in tokens])
        slices = [[x] if x in self.ranks else [x[i : i + SLICE] for i in range(0, len(x), SLICE)] for x in bodies]
        coded = iter(self._tokens(list(chain.from_iterable(slices))))
        out = [[next(coded) for _ in x] for x in slices]
        open_, reach = list(range(len(out))), 1
        while open_:
            ends = list({(a[-1], b[0]) for k in open_ for a, b in zip(out[k], out[k][1:], strict=False)})
            fits = {e: got == list(e) for e, got in zip(ends, self._tokens([text(e) for e in ends]), strict=True)}
            seams = []
            for k in open_:
                joined = out[k][:1]
                for tokens in out[k][1:]:
                    if fits[joined[-1][-1], tokens[0]]:
                        joined[-1] = joined[-1] + tokens
                    else:
                        joined.append(tokens)
                # at every second seam, reach tokens of either side are encoded as one string
                parts = []
                for i in range(0, len(joined) - 1, 2):
                    left, right = joined[i : i + 2]
                    seams.append((k, len(parts) + 1))
                    parts += [left[:-reach], left[-reach:] + right[:reach], right[reach:]]
                out[k] = parts + joined[len(parts) // 3 * 2 :]
            for (k, i), tokens in zip(seams, self._tokens([text(out[k][i]) for k, i in seams]), strict=True):
                out[k][i] = tokens
            open_ = sorted({k for k, _ in seams})
            for k in open_:
                out[k] = [x for x in out[k] if x]
            reach = min(2 * reach, 4 * SLICE)
        tokens = [x[0] for x in out]
        return [(" ".join(map(str, x)), body) for x, body in zip(tokens, self.decode(tokens), strict=True)]

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """Bytes of each list of ids, by ordered aggregation."""
        self.db.register("encoded", pa.table({"place": pa.array(range(len(ids)), pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))}))
        found = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("encoded")
        out = [b""] * len(ids)
        for place, body in zip(found["place"].to_pylist(), found["body"].to_pylist(), strict=True):
            out[place] = body
        return out

    def encode(self, texts: pa.Array) -> list[tuple[bytes, bytes]]:
        """Ids, as decimal strings joined by a space, and decoded bytes of each text.

        A single space between two characters of which one is no white space begins
        a piece whatever comes before it, so most texts are cut there first, and what
        lies between is cut by the pattern once for all texts.
        """
        out: list = [(b"", b"")] * len(texts)
        double, full = pc.match_substring_regex(texts, _DOUBLE).to_numpy(zero_copy_only=False), pc.binary_length(texts).to_numpy() > 0
        odd, even = np.flatnonzero(double & full), np.flatnonzero(~double & full)
        done = []
        if len(odd):
            cut = [self.find(x) for x in texts.take(pa.array(odd)).to_pylist()]
            done.append((odd, self._joined(pa.array(chain.from_iterable(cut), pa.string()), _offsets(cut))))
        if len(even):
            lists = pc.split_pattern(texts.take(pa.array(even)), " ")
            coded = lists.flatten().dictionary_encode()
            place = coded.indices.to_numpy().copy()
            starts = lists.offsets.to_numpy()[:-1]
            opening = np.unique(place[starts])
            at = np.full(len(coded.dictionary), -1, np.int32)
            at[opening] = len(at) + np.arange(len(opening))
            place[starts] = at[place[starts]]
            found = self._chunks(coded.dictionary, coded.dictionary.take(pa.array(opening)))
            done.append((even, [_join(lists.offsets, x.take(pa.array(place)), gap) for x, gap in zip(found, (b" ", b""), strict=True)]))
        for where, (ids, bodies) in done:
            for i, a, b in zip(where.tolist(), ids.to_pylist(), bodies.to_pylist(), strict=True):
                out[i] = (a, b)
        return out


@contextmanager
def _codec(path: str, pattern: str):
    """A task's codec. It goes with the task: a worker that waits for other work holds the vocabulary only."""
    codec = Codec(path, pattern)
    try:
        yield codec
    finally:
        codec.db.close()
        codec.forget()


def _slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of rows with about ``_SLICE_BYTES`` bytes."""
    column = pc.fill_null(column, "")
    run = (np.cumsum(size := pc.binary_length(column).to_numpy()) - size) // _SLICE_BYTES
    cuts = [*np.flatnonzero(np.diff(run, prepend=-1)), len(run)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(a), column.slice(a, b - a)


def _encode(path: str, pattern: str, digests: bool):
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(path, pattern) as codec:
            for batch in batches:
                for row, texts in _slices(batch["text"]):
                    got = codec.encode(texts)
                    n = pa.array([a.count(b" ") + 1 if a else 0 for a, _ in got], pa.int64())
                    ids = pa.array([sha(a) if digests else a.decode() for a, _ in got], pa.string())
                    yield pa.record_batch([batch["doc_id"].slice(row, len(got)), n, ids, pa.array([sha(b) for _, b in got], pa.string())], ["doc_id", "n_tokens", "ids_sha256" if digests else "ids", "decoded_sha256"])

    return run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids: decimal ids joined by a space, or ids_sha256: their digest, decoded_sha256: digest of the bytes decoded from the ids)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_encode(ranks_path, pattern, digests), f"doc_id long, n_tokens long, {'ids_sha256' if digests else 'ids'} string, decoded_sha256 string")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of encoded documents; bytes that are no UTF-8 fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(ranks_path, pattern) as codec:
            for whole in batches:
                for at in range(0, len(whole), 500):
                    batch = whole.slice(at, 500)
                    texts = codec.decode([[int(i) for i in (x or "").split()] for x in batch["ids"].to_pylist()])
                    yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def vocabulary(name: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> tuple[str, str]:
    """Place and pattern of a public vocabulary."""
    import importlib.util
    import os

    spec = importlib.util.spec_from_file_location("public_tokenizers", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.path(name), module.PATTERN


def op6_duckdb_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabulary(), digests=True)


SQL = None
