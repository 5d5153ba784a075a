"""BPE by tree concatenation against the public library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skeinflow.llm import tree_bpe as tb

SF = "/root/testdata/sf0.001"
PATH = tb.vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "b", "the", "in", "'s", "'", "'re", "!", "?!", "1", "23", " ", "\n", "é", "é", "Σ", "ß", "İ", "日本", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "WORLD", "ing", "\x1c", "\x85", "​", "🙂"]


@pytest.fixture(scope="module")
def codec():
    return tb.TreeBpe(PATH)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def strange(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) * rng.choice([1, 1, 2, 5, 30]) for _ in range(rng.randrange(1, 15))) for _ in range(n)]


@pytest.mark.parametrize(("leaf", "word"), [(1, 2), (3, 3), (17, 8), (2048, 48)])
def test_any_cut_gives_the_library_s_ids(monkeypatch, leaf, word):
    monkeypatch.setattr(tb, "LEAF", leaf)
    monkeypatch.setattr(tb, "WORD", word)
    own = tb.TreeBpe(PATH)
    for text in strange(leaf, 1500):
        assert own.encode(own.chunks(text)) == library(text)


def test_all_characters_are_normalised_and_split_like_the_library_s(codec):
    signs = [chr(c) for c in range(0, 0x20000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(signs), 64):
        text = " ".join(f"a{c}1{c}{c}b" for c in signs[k : k + 64])
        assert codec.encode(codec.chunks(text)) == library(text)


def test_joining_reaches_as_far_as_needed(codec):
    rng = random.Random(2)
    for text in ("a" * 5001, "ab" * 4001 + "c", "!" * 7001, "aaab" * 2000, "".join(rng.choices("etaoin", k=20000))):
        want, symbols = library(text), codec._spelled(text)
        for at in (1, len(symbols) // 3, len(symbols) // 2, len(symbols) - 1):
            assert codec.join(codec.merge(symbols[:at]), codec.merge(symbols[at:])) == want


def test_every_token_encodes_to_itself(codec):
    special = set(codec.special.values())
    assert all(codec._short(list(s)) == [i] for i, s in codec.symbols.items() if i not in special)


def test_query_equals_the_library_on_all_documents(spark):
    got = {r.doc_id: tuple(r)[1:] for r in tb.op11_tree_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library(r.text or "")
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert got.pop(r.doc_id) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert not got


def test_long_texts_are_dealt_out_and_odd_rows_stay(spark):
    texts = [None, "", " \n", "word", *strange(9, 60), "x" * 700, "a.b" * 300, "<|endoftext|>" * 30, "one two " * 200]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(5, texts[-1], 0), (5, texts[-1], 1), (None, texts[-2], 2), (5, "other text " * 30, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3)
    for spread in (7, 64, 1_000_000):
        out = tb.decode_ids(tb.encode_documents(docs, PATH, spread=spread), PATH).collect()
        got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in out), key=str)
        ids = [(i, library(t or "")) for i, t, _ in rows]
        assert got == sorted(((i, len(x), np.array(x, "<u4").tobytes(), LIBRARY.decode(x, skip_special_tokens=False)) for i, x in ids), key=str)
    assert tb.encode_documents(docs.where(F.lit(False)), PATH).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="no vocabulary"):
        tb.TreeBpe(tb.vocabulary("byte_bpe_50k.json"))
