"""Operators of the text subpackage against brute force on small tables, with nulls, empty texts, repeats and odd columns."""

import base64
import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.llm import attention_quality, bpe, bwt_dedup, chat, divergence_rules, mixing, near_dedup, ppm, registry, sketch_dedup, trie_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, bucket int"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [rng.choice(["the", "of", "Tree", "ÉTÉ", "été", "a", "b", "c"]) + rng.choice(["", "x", "y", "."]) for _ in range(300)]
    out = [(1, None, "en", None, 0), (2, "", "en", "s", 0), (3, "x", None, "s", 0), (4, " \n\t ", "fr", "s", 0), (5, "long " * 3000, "en", "t", 1), (-7, "Word", "en", "t", 1), (8, "wORD", "en", "t", 1)]
    for i in range(10, 60):
        at = rng.randrange(150)
        w = base[at : at + rng.randrange(1, 140)]
        if rng.random() < 0.5 and w:
            w[rng.randrange(len(w))] = f"edit{i}"
        out.append((i, " ".join(w), rng.choice(["en", "fr", None]), rng.choice(["s", "t", "u", None]), 3))
    return out + [(99, out[20][1].upper(), "en", "u", 5)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    want = con.sql(registry.SQL[name]).select(", ".join(df.columns)).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_exact_duplicates(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[low(r[1])].append(r[0])
    got = {r.doc_id: r for r in trie_dedup.exact_duplicates(docs, keep="largest").collect()}
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), sha(text))


def test_trie_keeps_all_strings_when_it_spills():
    rng = random.Random(1)
    keys = [b"same prefix " * 5 + bytes(rng.choices(b"ab", k=rng.randrange(12))) for _ in range(400)] + [b""]
    trie = trie_dedup.PatriciaTrie(memory_bytes=3000)
    for i, k in enumerate(keys):
        trie.add(k, (i, i, 1))
    got = dict(trie.items())
    assert {k: v[2] for k, v in got.items()} == Counter(keys)
    assert all(got[k][0] == keys.index(k) for k in got)


def test_repeated_windows(docs, rows):
    first = {}
    for r in sorted(rows):
        ws = words(r[1])
        for i in range(len(ws) - 12):
            first.setdefault(tuple(ws[i : i + 13]), r[0])
    got = {r.doc_id: r for r in sketch_dedup.remove_repeated_windows(docs).collect()}
    for r in rows:
        ws, gone = words(r[1]), set()
        for i in range(len(ws) - 12):
            if first[tuple(ws[i : i + 13])] < r[0]:
                gone.update(range(i, i + 13))
        assert (got[r[0]].n_words, got[r[0]].n_removed, got[r[0]].kept_text) == (len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone))


@pytest.mark.parametrize("hot", [1, 500])
def test_repeated_bytes(docs, rows, hot):
    k, places = 40, defaultdict(set)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for i, t in texts.items():
        for at in range(len(t) - k + 1):
            places[t[at : at + k]].add((i, at))
    got = {r.doc_id: r for r in bwt_dedup.remove_repeated_bytes(docs, length=k, gram=15, hot_regions=hot).collect()}
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for at in range(len(t) - k + 1):
            if len(places[t[at : at + k]]) > 1:
                gone[at : at + k] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept_bytes)) == (len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone) if not g))


def test_op10_query_equals_brute_force_at_its_own_length(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n = Counter(hash(t[at : at + 400]) for t in texts.values() for at in range(len(t) - 399))
    got = {r.doc_id: r for r in registry.QUERIES["op10_bwt_substring_dedup"](spark, SF).collect()}
    assert got.keys() == texts.keys() and max(n.values()) > 1
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for at in range(len(t) - 399):
            if n[hash(t[at : at + 400])] > 1:
                gone[at : at + 400] = True
        rest = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), sha(rest))


def test_near_duplicates(docs, rows):
    sets = {}
    for r in rows:
        ws = words(low(r[1]))
        sets[r[0]] = {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if a and b and i < j and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    for options in ({}, {"star_rounds": 0}):
        got = {r.doc_id: r for r in near_dedup.near_duplicate_classes(docs, **options).collect()}
        assert {i: (len(sets[i]), find(i), find(i) == i) for i in sets} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}


def test_language_model_scores(docs, rows):
    order, train = 2, F.col("doc_id") % 3 != 0
    learn = [r for r in rows if r[0] % 3 != 0]
    tokens, n = Counter(), [defaultdict(Counter) for _ in range(order + 1)]
    for r in learn:
        tokens.update([*words(low(r[1])), "\0"])
        b = b"\xff" * order + low(r[1]).encode() + b"\xff"
        for i in range(order, len(b)):
            for k in range(order + 1):
                n[k][b[i - k : i]][b[i]] += 1
    total, kinds = sum(tokens.values()), len(tokens)

    def score(t):
        b, out = b"\xff" * order + low(t).encode() + b"\xff", 0.0
        for i in range(order, len(b)):
            seen = set()
            for k in range(order, -1, -1):
                c = n[k].get(b[i - k : i])
                if not c:
                    continue
                t_, q = sum(v for s, v in c.items() if s not in seen), len(set(c) - seen)
                if b[i] in c:
                    out += np.log10((2 * c[b[i]] - 1) / (2 * t_))
                    break
                out += np.log10(q / (2 * t_)) if q else 0
                seen = set(c)
            else:
                out -= np.log10(256 - len(n[0][b""]))
        return out

    got = {r.doc_id: r for r in ppm.score_documents(docs, train, order=order).collect()}
    for r in rows:
        own = [*words(low(r[1])), "\0"]
        g = got[r[0]]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(own), sum(tokens[w] > 0 for w in own), total)
        assert abs(g.base_score - sum(np.log10((tokens[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own)) < 1e-6
        assert abs(g.score - score(r[1])) < 1e-3 * max(1, abs(g.score))


def test_byte_bpe_equals_tiktoken_and_round_trips(spark, docs, rows):
    import tiktoken

    path, pattern = bpe.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    more = [(200, "=" * 700, "", "", 0), (201, "a  b \n \u00a0 c<|endoftext|>'ll 12² 𝒳", "", "", 0)]
    all_docs = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    encoded = bpe.encode_documents(all_docs, path, pattern)
    got = {r.doc_id: r for r in encoded.collect()}
    for r in rows + more:
        ids = enc.encode_ordinary(r[1] or "")
        assert (got[r[0]].n_tokens, got[r[0]].ids) == (len(ids), " ".join(map(str, ids)))
    assert {r.doc_id: r.text for r in bpe.decode_ids(encoded, path, pattern).collect()} == {r[0]: r[1] or "" for r in rows + more}


def test_new_words_of_many_texts_are_cut_together():
    import pyarrow as pa
    import tiktoken

    path, pattern = bpe.vocabulary()
    codec = bpe.Codec(path, pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(6)
    texts = [" ".join(f"{rng.choice(['w', 'é', '1', '的'])}{rng.randrange(10**6)}{rng.choice([',', '.', '', chr(39) + 'll'])}" for _ in range(50)) for _ in range(40)]
    texts += ["".join(rng.choice(["a", "b ", " ", "\n", "\t", "\u3000", "\x1c", "'s", "1\u00b2", "\U0001d4b3", "."]) for _ in range(rng.randrange(40))) for _ in range(400)] + ["", " ", "\n", "a \nb", "a\n b", "a \n b"]
    calls, find = [], codec.find
    codec.find = lambda x: calls.append(x) or find(x)
    plain = codec.encode(pa.array(texts[:40]))
    assert len(calls) <= 1 + 40  # the words after a space at once, and each text's first
    assert [(a.decode(), b.decode()) for a, b in plain + codec.encode(pa.array(texts[40:]))] == [(" ".join(map(str, enc.encode_ordinary(x))), x) for x in texts]


def test_long_pieces_equal_tiktoken_and_are_quick():
    import time

    import tiktoken

    path, pattern = bpe.vocabulary()
    codec = bpe.Codec(path, pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(8)
    chinese = "".join(rng.choice("的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经") for _ in range(4000))
    long = [chinese, "a" * 3001, "ab" * 999 + "a", "=" * 1234, *("".join(rng.choice(letters) for _ in range(rng.randrange(65, 1500))) for letters in ["ab", "aeinrst", "etaoinshrdluETAOIN", "é中の가aß", "=-_"] for _ in range(6))]
    long += ["".join(rng.choice(["ing", "tion", "the", "er", "a", "Th", "é"]) for _ in range(rng.randrange(30, 400))) for _ in range(20)]
    assert all(len(codec.find(text)) == 1 for text in long)
    began = time.thread_time()
    codec.pieces({chinese})
    assert time.thread_time() - began < 3  # 0.4 s on a usual machine
    for text, (ids, body) in codec.pieces(set(long)).items():
        assert (list(map(int, ids.split())), body) == (enc.encode_ordinary(text), text.encode())


def test_quality_measures(docs, rows):
    got = {r.doc_id: r for r in divergence_rules.quality_verdicts(docs).collect()}
    for r in rows:
        t, ws = r[1] or "", words(r[1])
        lines = [x for x in t.split("\n") if words(x)]
        at = defaultdict(list)
        for i in range(len(ws) - 7):
            at[tuple(ws[i : i + 8])].append(i)
        cover = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert g.base_failed == (len(ws) < 20 or 100 * len(cover) > 30 * len(ws)) and (g.kept is not None) and not (g.kept and g.base_failed)


def test_distances_and_verdicts_equal_brute_force(spark):
    import regex

    rng = random.Random(9)
    vocabulary = [*"the of and To été ÜBER 12 3.5 a, ( x=y".split(), *(f"w{k}" for k in range(60))]
    text = lambda: " ".join(rng.choice(vocabulary[: rng.choice([9, 30, 70])]) for _ in range(rng.randrange(10, 120)))
    rows = [(i, text(), rng.choice(["en", "fr"])) for i in range(150)] + [(200, "!? ## " * 60 + "a b c d", "en"), (201, "ÄÖ " * 50 + " ".join(f"É{k}" for k in range(60)), "fr"), (202, " ".join(str(k) for k in range(90)), "en"), (203, None, "fr"), (204, " ".join(f"w{k % 60}" for k in range(55)), "en")]
    got = {r.doc_id: r for r in divergence_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), min_reference_words=500).collect()}
    kinds = [r"[0-9]", r"\p{Lu}", r"[\p{P}\p{S}]"]

    def classes(t):
        n = [len(regex.findall(k, t)) for k in kinds] + [sum(ord(c) > 127 and not regex.match(r"[\p{Lu}\p{P}\p{S}]", c) for c in t)]
        return np.array([*n, sum(map(len, words(t))) - sum(n)], float)

    def distance(p, q):
        p, q = (x / x.sum() if x.sum() else x for x in (p, q))
        part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, (p + q) / 2, strict=True) if a > 0)
        return math.sqrt(max((part(p) + part(q)) / 2, 0))

    verdicts = Counter()
    for lang in ("en", "fr"):
        own = [(i, t or "") for i, t, k in rows if k == lang]
        total = Counter(w for _, t in own for w in words(t.lower()))
        picked = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0].encode()))[:16]]
        common = lambda n: np.array([*(n[w] for w in picked), n.total() - sum(n[w] for w in picked)], float)
        ref, shares = sum(classes(t) for _, t in own), common(total)
        lacking = distance(np.array([0.0] * 16 + [1]), shares)
        for i, t in own:
            n = len(words(t))
            a, b = distance(classes(t), ref), distance(common(Counter(words(t.lower()))), shares)
            limit = min(0.4, 0.95 * lacking) if (shares[-1] / shares.sum()) ** n < 1e-3 else 0.4
            g = got[i]
            assert max(abs(g.class_distance - a), abs(g.word_distance - b), abs(g.word_limit - limit)) < 1e-9
            assert g.kept == (not g.base_failed and not (n >= 50 and (a > 0.3 or b > limit)))
            verdicts[g.base_failed, g.kept] += 1
    assert len(verdicts) == 3 and min(verdicts.values()) >= 2


def test_words_of_small_and_null_languages_are_compared_to_all_documents(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["the", "of", "and", "to"] + [f"w{k}" for k in range(12)]) for _ in range(100))
    rows = [(i, text(), "en") for i in range(120)] + [(i, text(), lang) for i, lang in enumerate(["fr", "fr", None, "de"], 200)] + [(300, "zig zag " * 60, "fr"), (301, "zog zug " * 60, None)]
    got = {r.doc_id: r for r in divergence_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    total = Counter(w for r in rows for w in words(r[1]))
    picked = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:16]]

    def share(n):
        a = [n[w] for w in picked]
        return np.array([*a, n.total() - sum(a)]) / n.total()

    def part(x, m):
        return float(sum(a * np.log2(a / b) for a, b in zip(x, m) if a > 0))

    q = share(total)
    for i, t, lang in rows[120:]:
        p = share(Counter(words(t)))
        assert abs(got[i].word_distance - np.sqrt((part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2)) < 1e-9
    assert got[300].word_distance > 0.4 and got[301].word_distance > 0.4 and not got[300].kept and not got[301].kept


def test_document_without_common_words_fails_the_word_rule(spark):
    rng = random.Random(6)
    common = ["the", "of", "and", "to", *(f"c{k}" for k in range(12))]
    text = lambda share: " ".join(rng.choice(common) if rng.random() < share else f"w{rng.randrange(500)}" for _ in range(100))
    rows = [(i, text(0.21), "en") for i in range(120)] + [(i, text(0.002), "zh") for i in range(200, 320)] + [(400, text(0.0), "en"), (401, text(0.0), "zh"), (402, text(0.21), None)]
    got = {r.doc_id: r for r in divergence_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    total = Counter(w for r in rows if r[2] == "en" for w in words(r[1]))
    s = sum(n for _, n in total.most_common(16)) / total.total()
    lacking = math.sqrt((math.log2(2 / (2 - s)) + s + (1 - s) * math.log2(2 * (1 - s) / (2 - s))) / 2)
    r = got[400]
    assert abs(r.word_limit - 0.95 * lacking) < 1e-9 and lacking < 0.4 and abs(r.word_distance - lacking) < 1e-9
    assert not r.kept and not r.base_failed and r.class_distance <= 0.3
    assert all(x.kept for i, x in got.items() if i != 400) and got[401].word_limit == got[402].word_limit == 0.4


def test_mixing_targets_quotas_and_draws(docs, rows):
    goal = mixing.targets([100, 10, 0, 1000], [1, 2, 3, 1])
    assert abs(sum(goal) - 1110) < 1e-9 and goal[1] == 30 and goal[2] == 0 and goal[0] == 300
    cut = mixing.split_quotas(np.array([7, 0, 13]), 5, 1)
    assert cut.sum(axis=0).tolist() == [7, 0, 13] and set(cut.sum(axis=1)) == {4}
    plan = mixing.mixing_plan(docs, shards=3)
    got, again = ({r.doc_id: r for r in plan.collect()} for _ in range(2))
    assert {i: r.mix_draws for i, r in got.items()} == {i: r.mix_draws for i, r in again.items()}
    for s in {r[3] for r in rows}:
        own = [got[r[0]] for r in rows if r[3] == s]
        taken = sum(r.mix_size * len(r.mix_draws) for r in own)
        assert abs(taken - own[0].mix_target) <= max(r.mix_size for r in own) / 2 + 1
        assert all(len(r.mix_draws) <= 3 and all(0 <= d.shard < 3 for d in r.mix_draws) for r in own)
    assert mixing.mixed_documents(docs).columns == docs.columns
    few = {r.doc_id: r for r in mixing.mixing_plan(docs, shards=3, blocks=4).collect()}
    assert any(len(few[i].mix_draws) != len(got[i].mix_draws) for i in few)


def test_mix_takes_what_the_tree_gives(docs, monkeypatch):
    size = lambda plan: {r.doc_id: r.mix_size * len(r.mix_draws) for r in plan.collect()}
    whole, split = size(mixing.mixing_plan(docs, shards=4)), mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda *a: split(*a) * np.array([[1], [0], [1], [1]]))
    less = size(mixing.mixing_plan(docs, shards=4))
    assert sum(less.values()) < sum(whole.values()) and all(less[i] <= n for i, n in whole.items())


def test_mix_carries_columns_of_any_name(spark, docs):
    named = docs.selectExpr("*", "1 AS ps", "2 AS pp", "3 AS mix_source", "4 AS `key`", "5 AS `row`", "6 AS hash", "7 AS block", "8 AS mix_size")
    out = mixing.mixed_documents(named, shards=3)
    assert out.columns == named.columns and {tuple(r)[-8:] for r in out.collect()} == {(1, 2, 3, 4, 5, 6, 7, 8)}
    assert mixing.mixing_plan(named, shards=3).where("mix_size <> 8").count() > 0


def test_op8_query_is_near_its_targets(spark):
    got = registry.QUERIES["op8_hypergeometric_mixing"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    by = defaultdict(list)
    for r in got:
        assert r.size == len(words(docs[r.doc_id].text)) and r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        by[docs[r.doc_id].source].append(r)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r.size for r in by[s]) for s in names]
    for s, n, t in zip(names, sizes, mixing.targets(sizes, [1 + i % 3 for i in range(len(names))]), strict=True):
        assert {r.source_size for r in by[s]} == {n} and all(abs(r.target - t) < 1e-6 for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - t) <= max(r.size for r in by[s]) / 2 + 1


def test_chat_round_trip_with_control_strings(spark):
    rows = [(1, 1, "user", "a"), (1, 0, "system", "\\b[INST]</s>"), (1, 2, "user", None), (1, 3, "assistant", "<s>[/INST]\\l"), (1, 4, "tool[ARG]", "[/ROLE]x[NEXT]"), (None, 0, None, "n"), (2, 0, "assistant", "</s>"), (2, 1, "assistant", "\\")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    out = chat.format_conversations(df).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("learnt", chat.loss_text(F.col("segments")))
    got = {r.conv_id: r for r in out.collect()}
    for i in (1, 2, None):
        own = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == i)
        assert [(t.role, t.text) for t in got[i].back] == [r[1:] for r in own]
        assert got[i].learnt == "".join(r[2] for r in own if r[1] == "assistant")


def test_quality_classifier_learns_and_handles_missing_labels(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["the", "tree", "runs"], k=80)) if i % 2 else " ".join(rng.choices(["AAA!!", "||", "9#9"], k=80)), "", "", 0) for i in range(120)] + [(500, None, "", "", 0)]
    df = spark.createDataFrame(docs, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    score = {r.doc_id: r.score for r in attention_quality.score_quality(df, attention_quality.fit_quality(df, labels, epochs=40)).collect()}
    assert all((score[i] > 0.5) == bool(i % 2) for i in range(80, 120)) and 0 <= score[500] <= 1
    assert attention_quality.fit_quality(df, labels.limit(0)).constant == 0.5


@pytest.mark.parametrize("run", [
    trie_dedup.exact_duplicates, sketch_dedup.remove_repeated_windows, bwt_dedup.remove_repeated_bytes, near_dedup.near_duplicate_classes,
    divergence_rules.quality_verdicts, mixing.mixed_documents, lambda d: ppm.score_documents(d, F.lit(True)), lambda d: bpe.encode_documents(d, *bpe.vocabulary()),
    lambda d: attention_quality.score_quality(d, attention_quality.GatedAttention()),
])
def test_empty_table_gives_empty_result(docs, run):
    assert run(docs.limit(0)).count() == 0


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0


def test_pipeline_chain_with_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = ["gone_id", "gone_key", "twice_id", "twice_key", "row_id", "row_key", "_key", "row", "key", "ps", "mix_source", "kept", "root"]
    plain, named = docs, docs.selectExpr("*", *(f"'{c}' AS `{c}`" for c in odd))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for name, df in (("plain", plain), ("named", named)):
            stage(spark, df, SF).write.parquet(f"{tmp_path}/{name}{k}")
        plain, named = (spark.read.parquet(f"{tmp_path}/{name}{k}") for name in ("plain", "named"))
        if k < 4:
            assert named.columns == docs.columns + odd and named.drop(*odd).exceptAll(plain).isEmpty()
    got = sorted(map(tuple, plain.collect()))
    assert got == sorted(map(tuple, named.collect())) and 0 < len(got) < 3 * docs.count()
    assert {sha(t.text or "") for t in docs.collect()} >= {r[3] for r in got}


def test_dedup_stages_drop_rows_not_ids(spark):
    import corpus_pipeline

    text = lambda seed: " ".join(f"{seed}w{k}" for k in range(60))
    rows = [(3, text("a")), (5, text("a").upper()), (5, text("b")), (None, text("a")), (None, text("c")), (None, text("d")), (None, text("d")), (7, text("e")), (7, text("E")), (8, text("f")), (8, text("f")), (8, text("g")), (4, text("g")), (None, None), (9, ""), (9, "")]
    stay = lambda stage, rows: sorted(((r.doc_id, r.text and low(r.text)) for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF).collect()), key=str)
    want = [(3, "a"), (5, "b"), (None, "c"), (None, "d"), (7, "e"), (8, "f"), (4, "g")]
    want = [(i, text(t)) for i, t in want]
    assert stay(corpus_pipeline.exact_dedup, rows) == sorted([*want, (9, "")], key=str)
    assert stay(corpus_pipeline.near_dedup_stage, rows) == sorted([*want, (None, None), (9, ""), (9, "")], key=str)
    near = [(1, text("h")), (2, text("h") + " more"), (2, text("i")), (6, text("j")), (6, text("j") + " more"), (None, text("k")), (None, text("k") + " more"), (None, text("h") + " end"), (None, text("m"))]
    got = stay(corpus_pipeline.near_dedup_stage, near)
    assert len(got) == 5 and {(i, t[0]) for i, t in got} == {(1, "h"), (2, "i"), (6, "j"), (None, "k"), (None, "m")}
