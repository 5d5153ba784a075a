"""BPE with word ends by tree concatenation.

A text is normalised and matched by the vocabulary's pattern; the matches in a row
are one unsplit string of symbols, whose word ends are symbols of their own, which
no merge has on its left. This string is encoded in halves, down to leaves of about
``LEAF`` characters, wherever the cuts fall, also inside words. To join two halves,
the tokens next to the cut are encoded again, one of each side, then two, four and
so on, until the window's first token is the left side's and its last the right
side's. Tokens that stand next to each other in some encoding stand so in every
encoding that has both, so the joined row is that of the whole string.

No match and no normal form reaches across white space, so leaves look up the chunks
between it among those encoded before; a chunk of more than ``WORD`` symbols is
encoded in halves as well. Texts of more than ``spread`` characters are dealt out:
other tasks encode their parts, whose tokens come together again by document and are
joined as the same tree.

Cases: null text counts as empty and has no tokens; strings of special tokens in a
text are those tokens, as the library has it; a text of any length is encoded whole,
1 MB of letters without a space in some seconds; ties of rank go to the leftmost pair; null
and repeated ids and repeated rows are rows like others; an empty table gives an
empty result; columns other than id and text are not looked at, whatever their
names. A vocabulary file with other parts than these is refused.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAF = 2048
WORD = 48
SPREAD = 1_000_000
KNOWN_CHUNKS = 300_000
_ROWS = 200

#: Fixed values. White space; letters and digits of Unicode 16 that this Python may not know; small forms of capitals likewise.
_WHITE = r"\x09-\x0D\x20\x85\xA0  -     　"
_SINCE = {
    "L": "1C89-1C8A A7CB-A7CD A7D2-A7D2 A7D4-A7D4 A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0",
    "N": "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA",
}
_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {0x10D50 + k: 0x10D70 + k for k in range(22)} | {0x16EA0 + k: 0x16EBB + k for k in range(25)}
_CAPITALS = re.compile("[" + "".join(map(chr, _SMALL)) + "Σ]")


@lru_cache(maxsize=1)
def _classes() -> dict[str, str]:
    r"""What \p{L}, \p{N} and \s stand for inside brackets."""
    out = {}
    for kind, since in _SINCE.items():
        spans = [tuple(int(c, 16) for c in x.split("-")) for x in since.split()]
        own = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == kind]
        runs = [[c for _, c in g] for _, g in groupby(enumerate(own), lambda x: x[1] - x[0])]
        out[rf"\p{{{kind}}}"] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans + [(r[0], r[-1]) for r in runs])
    return out | {r"\s": _WHITE}


def _bytes_as_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself, or the next free one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Known(dict):
    """Tokens of whole chunks, encoded when first asked for."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) >= KNOWN_CHUNKS:
            self.clear()
        found = self[chunk] = tuple(self.encode(chunk))
        return found


class TreeBpe:
    """The tokens of texts under a vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = [(x["type"], x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in spec["pre_tokenizer"].get("pretokenizers", [])]
        model = spec["model"]
        fits = steps == ["NFC", "Replace", "Lowercase"] and cuts == [("Split", "Removed", True, None, None), ("ByteLevel", None, None, False, False)]
        if not fits or spec["decoder"] is not None or model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"]:
            raise ValueError(f"{path} is no vocabulary of lower-case words with word ends")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        letters = _bytes_as_letters()
        self.open = [ids[letters[b]] for b in range(256)]
        self.closed = [ids[letters[b] + end] for b in range(256)]
        self.rank, self.made, self.symbols = {}, [], {i: (i,) for i in (*self.open, *self.closed)}
        for a, b in (x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
            new = ids[a + b]
            self.rank[ids[a], ids[b]] = len(self.made)
            self.made.append(new)
            self.symbols[new] = self.symbols[ids[a]] + self.symbols[ids[b]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.symbols |= {i: (i,) for i in self.special.values()}
        self.name = {i: t for t, i in (ids | self.special).items()}
        pattern = split["pattern"]["Regex"]
        for sign, chars in _classes().items():
            pattern = pattern.replace(sign, chars)
        self.find = re.compile(pattern).findall
        self.white, self.control = re.compile(f"[{_WHITE}]+").split, re.compile(r"[\x1C-\x1F]").search
        self.specials = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else lambda text: [text]
        self.spelled = lru_cache(maxsize=4)(self._spelled)
        self.known = _Known(lambda chunk: self.merge(self._spelled(chunk)))

    def chunks(self, text: str) -> list[str]:
        """What stands between white space."""
        return [x for x in self.white(text) if x] if self.control(text) else text.split()

    def _spelled(self, chunk: str) -> list[int]:
        """Symbols of the pattern's matches in the normalised chunk, and special tokens."""
        out: list[int] = []
        for part in self.specials(chunk):
            if part in self.special:
                out.append(self.special[part])
                continue
            part = unicodedata.normalize("NFC", part)
            if not part.isascii():  # one small form for each capital, sigma too, wherever it stands
                part = _CAPITALS.sub(lambda m: chr(_SMALL.get(ord(m[0]), 0x3C3)), part)
            for word in self.find(part.lower()):
                body = word.encode()
                out += [self.open[b] for b in body]
                out[-1] = self.closed[body[-1]]
        return out

    def _short(self, symbols: list[int]) -> list[int]:
        """Merges the leftmost pair of the least rank until no pair has one."""
        rank, none, tokens = self.rank.get, len(self.made), symbols[:]
        ranks = [rank(pair, none) for pair in zip(tokens, tokens[1:])]  # noqa: B905
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            tokens[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((tokens[i - 1], tokens[i]), none)
            if i < len(ranks):
                ranks[i] = rank((tokens[i], tokens[i + 1]), none)
        return tokens

    def _plain(self, tokens: list[int]) -> list[int]:
        """The same for strings of any length, all pairs of the least rank at once: what a merge makes has a higher rank with its neighbours."""
        rank, none = self.rank.get, len(self.made)
        while len(tokens) > WORD:
            ranks = [rank(pair, none) for pair in zip(tokens, tokens[1:])]  # noqa: B905
            least = min(ranks)
            if least == none:
                return tokens
            out, i = [], 0
            while i < len(tokens):
                if i < len(ranks) and ranks[i] == least:
                    out.append(self.made[least])
                    i += 2
                else:
                    out.append(tokens[i])
                    i += 1
            tokens = out
        return self._short(tokens)

    def merge(self, symbols: list[int]) -> list[int]:
        """Tokens of a string of symbols, long ones in halves."""
        if len(symbols) <= WORD:
            return self._short(symbols)
        mid = len(symbols) // 2
        return self.join(self.merge(symbols[:mid]), self.merge(symbols[mid:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of two encoded strings one after the other."""
        if not left or not right:
            return left or right
        width = 1
        while True:
            a, b = left[-width:], right[:width]
            window = self._plain([s for t in a + b for s in self.symbols[t]])
            if (width >= len(left) or window[0] == a[0]) and (width >= len(right) or window[-1] == b[-1]):
                return left[:-width] + window + right[width:]
            width *= 2

    def encode(self, chunks: list[str]) -> list[int]:
        """Tokens of chunks in a row."""
        ends = list(accumulate(map(len, chunks)))

        def part(k: int, a: int, b: int) -> list[int]:
            """Tokens of characters a to b of the string, which lie in chunk k; its symbols are cut in proportion."""
            size = len(chunks[k])
            start = ends[k] - size
            if (a, b) == (start, ends[k]):
                return list(self.known[chunks[k]])
            symbols = self.spelled(chunks[k])
            return self.merge(symbols[(a - start) * len(symbols) // size : (b - start) * len(symbols) // size])

        def tree(a: int, b: int) -> list[int]:
            if b - a > LEAF:
                mid = (a + b) // 2
                return self.join(tree(a, mid), tree(mid, b))
            first, last = bisect_right(ends, a), bisect_left(ends, b)
            if first == last:
                return part(first, a, b)
            out = part(first, a, ends[first])
            out.extend(chain.from_iterable(map(self.known.__getitem__, chunks[first + 1 : last])))
            return out + part(last, ends[last - 1], b)

        return tree(0, ends[-1]) if ends else []

    def decode(self, ids: list[int]) -> str:
        """The tokens' names joined by a space, which is what a vocabulary without a decoder gives."""
        return " ".join(map(self.name.__getitem__, ids))


@lru_cache(maxsize=1)
def _codec(path: str) -> TreeBpe:
    return TreeBpe(path)


def _column(lists: list[list[int]]) -> pa.Array:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = [array("I", x) for x in lists]
    if sys.byteorder == "big":
        for x in packed:
            x.byteswap()
    return pa.array([x.tobytes() for x in packed], pa.binary())


def _lists(column) -> list[list[int]]:
    out = [array("I", x or b"") for x in column.to_pylist()]
    if sys.byteorder == "big":
        for x in out:
            x.byteswap()
    return [x.tolist() for x in out]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for whole in batches:
            for at in range(0, len(whole), _ROWS):
                batch = whole.slice(at, _ROWS)
                ids = [codec.encode(codec.chunks(t or "")) for t in batch["text"].to_pylist()]
                yield pa.record_batch([batch["doc_id"], pa.array(map(len, ids), pa.int64()), _column(ids)], ["doc_id", "n_tokens", "ids"])

    return run


_PART = "doc_id bigint, text_key string, part int, head array<int>, chunks array<string>, tail array<int>"


def _parts(path: str, size: int):
    """Parts of about ``size`` characters of each text, numbered: symbols of the chunk that is cut before it, whole chunks, symbols of the one cut behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for doc, key, text in zip(batch["doc_id"], batch["text_key"], batch["text"], strict=True):
                rows, head, chunks, room = [], [], [], size
                for chunk in codec.chunks(text.as_py()):
                    if len(chunk) <= room:
                        chunks.append(chunk)
                        room -= len(chunk)
                        continue
                    symbols = codec.spelled(chunk)
                    rows.append((head, chunks, symbols[:room]))
                    cuts = range(room, len(symbols), size)
                    rows += [(symbols[i : i + size], [], []) for i in cuts[:-1]]
                    head, chunks = symbols[cuts[-1] :] if cuts else [], []
                    room = size - len(head)
                rows.append((head, chunks, []))
                n = len(rows)
                ints, strings = pa.list_(pa.int32()), pa.list_(pa.string())
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (ints, strings, ints), strict=True)]
                yield pa.record_batch([pa.array([doc.as_py()] * n, pa.int64()), pa.array([key.as_py()] * n, pa.string()), pa.array(range(n), pa.int32()), *columns], ["doc_id", "text_key", "part", "head", "chunks", "tail"])

    return run


def _encode_parts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for whole in batches:
            for at in range(len(whole)):
                batch = whole.slice(at, 1)
                head, chunks, tail = (batch[x][0].as_py() for x in ("head", "chunks", "tail"))
                ids = codec.join(codec.join(codec.merge(head), codec.encode(chunks)), codec.merge(tail))
                yield pa.record_batch([batch["doc_id"], batch["text_key"], batch["part"], _column([ids])], ["doc_id", "text_key", "part", "ids"])

    return run


def _join_parts(path: str):
    def run(table: pa.Table) -> pa.Table:
        codec = _codec(path)
        number = table["part"].to_pylist()
        copies = number.count(0)  # rows with one id and one text
        found = dict(zip(number, table["ids"], strict=True))
        row = [_lists(pa.chunked_array([pa.array([found[k].as_py()], pa.binary())]))[0] for k in sorted(found)]
        while len(row) > 1:
            row = [codec.join(*row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        n = pa.array([len(row[0])] * copies, pa.int64())
        return pa.table({"doc_id": pa.array([table["doc_id"][0].as_py()] * copies, pa.int64()), "n_tokens": n, "ids": _column(row * copies)})

    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, spread: int = SPREAD) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; ids are little-endian unsigned 32-bit integers.

    Texts of more than ``spread`` characters are encoded by several tasks.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    result = "doc_id bigint, n_tokens bigint, ids binary"
    long = F.coalesce(F.length("text"), F.lit(0)) > spread
    short = own.where(~long).mapInArrow(_encode(path), result)
    parts = own.where(long).withColumn("text_key", F.sha2(F.encode("text", "UTF-8"), 256)).mapInArrow(_parts(path, spread), _PART)
    tokens = parts.repartition("doc_id", "text_key", "part").mapInArrow(_encode_parts(path), "doc_id bigint, text_key string, part int, ids binary")
    return short.unionByName(tokens.groupBy("doc_id", "text_key").applyInArrow(_join_parts(path), result))


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with the column ``decoded``: the text that its ids stand for."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for whole in batches:
            for at in range(0, len(whole), _ROWS):
                batch = whole.slice(at, _ROWS)
                texts = pa.array([codec.decode(x) for x in _lists(batch["ids"])], pa.string())
                yield pa.record_batch([*batch.columns, texts], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{columns}, decoded string")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_tree_bpe(spark, sf_dir: str) -> DataFrame:
    path = vocabulary()
    out = decode_ids(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


SQL = None
