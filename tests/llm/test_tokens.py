"""BPE, token counts, token files, language model, pairs and vector search."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loreworks.llm import block_search, bpe, pitman_yor, preferences, token_counts, token_files, units
from tests.llm.test_texts import SCHEMA, prose, table

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = list("abcde  \n\t'sdtrevmlyTHE1234.,!?éüñ中文字 ​\x85\x1c᠎<|>😀ةय\r\x0b") + ["<|endoftext|>", "  ", "aaaa", "the", "ing", "'ll"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(n)]


# -- BPE ------------------------------------------------------------------------------------------------


def test_trie_encoding_equals_the_library():
    texts = odd_texts(3000) + ["", "a" * 5000, "x" + " " * 3000 + "y", prose(3000, 1)]
    ids, counts = bpe.encoder(BYTE).encode(texts)
    ends = np.cumsum(counts)
    library = Tokenizer.from_file(BYTE)
    for text, end, n, expected in zip(texts, ends, counts, library.encode_batch(texts, add_special_tokens=False)):
        assert ids[end - n : end].tolist() == expected.ids, text
    assert [raw.decode() for raw in bpe.encoder(BYTE).decode(ids, counts)] == texts


def test_prefix_states_are_shared():
    encoder = bpe.TrieEncoder(BYTE)
    words = sorted({w.encode() for t in odd_texts(300, 4) for w in encoder.pattern.findall(t)})
    together = list(encoder.encode_words(words))
    assert together == [next(encoder.encode_words([w])) for w in words]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(units, "REMEMBERED", 10)
    table_ = units.UnitTable(token_counts.library(WORD))
    texts = odd_texts(200, 3)
    fresh = units.UnitTable(token_counts.library(WORD))
    expected = fresh.counts(texts).tolist()
    assert [int(table_.counts([t])[0]) for t in texts] == expected


def test_round_trip_and_edge_cases(spark):
    docs = table(spark, [None, "", "a\n\nb  c", "a\n\nb  c", "<|endoftext|> x"]).selectExpr("*", "1 AS n_tokens", "2 AS token_ids")
    found = {r.doc_id: r for r in bpe.round_trip(docs, BYTE).collect()}
    assert found[0].n_tokens == 0 and found[2].ids_sha256 == found[3].ids_sha256
    coded = bpe.encode_documents(docs, BYTE)
    assert {r.doc_id: r.text for r in bpe.decode_documents(coded, BYTE).collect()} == {0: "", 1: "", 2: "a\n\nb  c", 3: "a\n\nb  c", 4: "<|endoftext|> x"}
    assert bpe.round_trip(docs.limit(0), BYTE).count() == 0


# -- counts ---------------------------------------------------------------------------------------------


def test_counts_encode_only_new_texts(spark, tmp_path):
    folder = str(tmp_path / "cache")
    texts = odd_texts(60, 7) + [None, "", "same", "same"]
    docs = table(spark, texts).selectExpr("*", "1 AS digest", "2 AS version")
    library = Tokenizer.from_file(BYTE)
    first = {r.doc_id: r for r in token_counts.count_tokens(docs, BYTE, folder, limit=5).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (first[i].n_tokens, first[i].n_bytes, first[i].over_limit) == (n, len((text or "").encode()), n > 5)
    assert spark.read.parquet(folder).count() == len({t or "" for t in texts})
    more = docs.unionByName(table(spark, ["same", "another"], 500).selectExpr("*", "1 AS digest", "2 AS version"))
    assert token_counts.count_tokens(more, BYTE, folder).count() == len(texts) + 2
    assert spark.read.parquet(folder).count() == len({t or "" for t in texts}) + 1
    # another tokenizer has entries of its own
    piece = public_tokenizers.path("piece_bpe_32k.model")
    counts = token_counts.count_tokens(docs.limit(5), piece, folder)
    encode = token_counts.library(piece)
    assert {r.doc_id: r.n_tokens for r in counts.collect()} == {r.doc_id: len(encode([r.text or ""])[0]) for r in docs.limit(5).collect()}
    assert token_counts.count_tokens(docs.limit(0), BYTE, folder).count() == 0


# -- token files ----------------------------------------------------------------------------------------


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 6, n) for n in (1, 0, 1, 500, 2000, 3)] + [np.full(777, 5), np.tile([1, 2, 3], 200)]
    counts = np.array([len(d) for d in docs])
    grammar = token_files.compress(np.concatenate(docs), counts, 10)
    assert len(grammar.symbols) < 0.6 * counts.sum()
    raw = token_files.pack(grammar)
    back = token_files.unpack(raw)
    assert token_files.expand(back, back.symbols).tolist() == np.concatenate(docs).tolist()
    for k, doc in enumerate(docs):
        for start, stop in ((0, len(doc)), (len(doc) // 3, 2 * len(doc) // 3), (len(doc), len(doc))):
            assert token_files.read_span(raw, k, start, stop).tolist() == doc[start:stop].tolist()
    wide = token_files.compress(np.array([70_000, 70_001] * 50), np.array([100]), 80_000)
    assert token_files.expand(wide, token_files.unpack(token_files.pack(wide)).symbols).tolist() == [70_000, 70_001] * 50


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(8)
    passage = rng.integers(2, 1000, 300)
    docs = [passage] * 400 + [rng.integers(2, 1000, 300) for _ in range(50)] + [np.full(5000, 7)]
    counts = np.array([len(d) for d in docs])
    grammar = token_files.compress(np.concatenate(docs), counts, 1000)
    assert token_files.expand(grammar, grammar.symbols).tolist() == np.concatenate(docs).tolist()
    begin = np.concatenate([[0], grammar.ends[:-1]])
    left = Counter(p for b, e in zip(begin, grammar.ends) for p in itertools.pairwise(grammar.symbols[b:e].tolist()))
    assert max(left.values()) < token_files.FREQUENT and grammar.length.max() >= 300
    assert all(e - b == 1 for b, e in zip(begin[:400], grammar.ends))


@pytest.mark.parametrize("shard", [1 << 20, 40])
def test_token_files_keep_order(spark, tmp_path, shard):
    texts = odd_texts(80, 9) + [None, "", "The same", "The same", prose(500, 2)]
    docs = table(spark, texts).orderBy("text").selectExpr("*", "1 AS start", "2 AS part")
    folder = str(tmp_path / "ids")
    token_files.write_ids(docs, WORD, folder, shard=shard)
    library = Tokenizer.from_file(WORD)
    found = {r.doc_id: r for r in token_files.read_ids(spark, folder).collect()}
    at = 0
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (found[i].start, found[i].n_tokens) == (at, len(ids))
        assert zlib.crc32(bytes(found[i].ids)) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_token_files_edge_cases(spark, tmp_path):
    rows = [(None, "b", None, None, None), (1, "a", None, None, None), (1, "a", None, None, None)]
    token_files.write_ids(spark.createDataFrame(rows, SCHEMA), WORD, str(tmp_path / "x"))
    found = sorted((r.start, r.doc_id) for r in token_files.read_ids(spark, str(tmp_path / "x")).collect())
    assert found == [(0, None), (2, 1), (4, 1)]
    token_files.write_ids(table(spark, []), WORD, str(tmp_path / "none"))
    assert token_files.read_ids(spark, str(tmp_path / "none")).count() == 0


# -- language model -------------------------------------------------------------------------------------


def test_scores_and_base(spark):
    texts = [prose(80, i % 40) for i in range(150)] + [None, "", " ", "NEW words Only"]
    docs = table(spark, texts).selectExpr("*", "1 AS held", "2 AS score", "3 AS uid")
    tokens = [[*(t or "").lower().split(), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    count = Counter(itertools.chain.from_iterable(t for t, h in zip(tokens, held) if not h))
    n, v = sum(count.values()), len(count)
    found = {r.doc_id: r for r in pitman_yor.score_documents(docs).collect()}
    assert len(found) == len(texts)
    for i, own in enumerate(tokens):
        r = found[i]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(count[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    better = [r.score > r.base_score for i, r in found.items() if r.held_out and i < 150]
    assert np.mean(better) > 0.9


def test_seating_follows_its_conditional():
    rng = np.random.Generator(np.random.Philox(1))
    table_ = pitman_yor.stirling(0.5, 10)
    # S_d(3, t) for d = 1/2: 3/4, 3/2, 1
    assert np.exp(table_[3, 1:4]) == pytest.approx([0.75, 1.5, 1.0])
    draws = pitman_yor.seat(rng, np.full(4000, 3), 1.0, 0.5, np.zeros(4000), np.full(4000, 0.2), pitman_yor.stirling(0.5, pitman_yor.DIRECT))
    weight = np.array([0.75 * 1 * 0.2, 1.5 * 1 * 1.5 * 0.04, 1.0 * 1 * 1.5 * 2 * 0.008])
    assert np.bincount(draws, minlength=4)[1:] / 4000 == pytest.approx(weight / weight.sum(), abs=0.03)
    many = pitman_yor.seat(rng, np.array([100_000]), 10.0, 0.3, np.zeros(1), np.ones(1), pitman_yor.stirling(0.3, pitman_yor.DIRECT))
    assert 100 < many[0] < 5000


def test_model_mass_is_one(spark):
    """p(w | context) over the whole vocabulary and the unknown, read off single-token steps of the model."""
    from pyspark.sql import functions as F

    train = ["a b c a b a", "a c b", "c c a b d"]
    words = ["a", "b", "c", "d", "unseen"]
    rows = list(enumerate([*train, ""] + words + [f"{x} {y}" for x in words for y in words]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = {t: r for t, r in zip([t for _, t in rows], [None] * len(rows))}
    for r in pitman_yor.score_documents(docs, held=F.col("doc_id") >= 3).collect():
        score[rows[r.doc_id][1]] = r.score
    # s(x) = p(x|start) p(end|x); s(x y) = p(x|start) p(y|x) p(end|y)
    # summing p(y|x) / over y and the end: s(x y) / s(y) * p(y|start) = p(x|start) p(y|x)
    # so with unknown p(y|start) = f(y): sum_y s(x y) f(y) / s(y) + s(x) = f(x), and sum_y f(y) + s("") = 1
    p = {w: 10 ** score[w] for w in ["", *words]}
    matrix = np.array([[10 ** score[f"{x} {y}"] / p[y] for y in words] for x in words])
    f = np.linalg.solve(np.eye(len(words)) - matrix, np.array([p[w] for w in words]))
    assert f.sum() + p[""] == pytest.approx(1.0, abs=1e-6)


def test_model_edge_cases(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pitman_yor.score_documents(docs).collect()
    assert len(found) == 4 and len({r.score for r in found if r.doc_id == 1}) == 1
    assert pitman_yor.score_documents(docs.limit(0)).count() == 0
    from pyspark.sql import functions as F

    untaught = pitman_yor.score_documents(docs, held=F.lit(True)).collect()
    assert {round(r.score, 9) for r in untaught if r.n_tokens == 3} == {0.0} and all(r.train_tokens == 0 for r in untaught)


def test_rare_contexts_have_restaurants(spark):
    from pyspark.sql import functions as F

    # four rows each are the same words in the same order; every odd row is held out
    rng = np.random.default_rng(5)
    orders = [rng.permutation(30) for _ in range(30)]
    texts = [" ".join(f"w{i // 4}x{j}" for j in orders[i // 4]) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for contexts in (1, 7, 65_000):  # how many tokens' numbers all cells get is a matter of speed
        found[contexts] = {r.doc_id: r for r in pitman_yor.score_documents(docs, held=F.col("doc_id") % 2 == 1, contexts=contexts).collect()}
        assert len(found[contexts]) == len(texts)
    for i in range(1, len(texts), 2):
        scores = [found[c][i].score for c in found]
        assert min(scores) > found[1][i].base_score + 10  # what followed each word is known
        assert max(scores) - min(scores) < 0.1 * abs(scores[-1]) + 2
        assert len({(found[c][i].n_known, round(found[c][i].base_score, 6)) for c in found}) == 1


@pytest.mark.parametrize("contexts", [1, 3])
def test_model_mass_is_one_with_rare_contexts(spark, contexts):
    from pyspark.sql import functions as F

    taught = ["a b c a b", "b c d e a", "a b d", "e e e e f g", "a b c a b"]
    words = [*"abcdefg", "unknown"]
    rows = [(i, t) for i, t in enumerate([*taught, "", *words, *(f"{x} {y}" for x in words for y in words)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = {rows[r.doc_id][1]: r.score for r in pitman_yor.score_documents(docs, held=F.col("doc_id") >= 5, contexts=contexts).collect()}
    p = {w: 10 ** score[w] for w in ["", *words]}
    matrix = np.array([[10 ** score[f"{x} {y}"] / p[y] for y in words] for x in words])
    f = np.linalg.solve(np.eye(len(words)) - matrix, np.array([p[w] for w in words]))
    assert f.sum() + p[""] == pytest.approx(1.0, abs=1e-6)


# -- preference pairs -----------------------------------------------------------------------------------


def test_preference_pairs(spark):
    rows = "pair_id long, turn long, role string, text string"
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "ok"), (1, 3, "assistant", "A"),
              (2, 0, "user", "x"), (2, 1, "assistant", "y"), (3, 0, "user", None), (3, 1, None, "t"), (4, 0, "user", "only"),
              (None, 0, "user", "q"), (5, None, "user", "q"), (5, 0, "user", "b"), (5, 0, "user", "a"), (5, 1, "assistant", "z")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "ok"), (1, 3, "assistant", "Bé"), (1, 4, "user", "bye"),
                (2, 0, "user", "x"), (3, 0, "user", ""), (3, 1, "", "t"), (5, 0, "user", "a"), (5, 1, "assistant", "w")]
    frames = [spark.createDataFrame(x, rows).selectExpr("*", "1 AS prompt", "2 AS c", "3 AS apart") for x in (chosen, rejected)]
    found = {r.pair_id: r for r in preferences.format_pairs(*frames).collect()}
    assert set(found) == {1, 2, 3, 5}
    one = found[1]
    assert one.prompt_turns == 3 and one.prompt.count("<|im_start|>") == 3
    assert one.chosen == "<|im_start|>assistant\nA<|im_end|>\n"
    for text, loss, said in ((one.chosen, one.chosen_loss, "A"), (one.rejected, one.rejected_loss, "Bé")):
        (start, end), = [map(int, s.split("-")) for s in loss.split(",")]
        assert text[start:end] == said + "<|im_end|>\n"
    assert found[2].rejected == "" and not found[2].usable and one.usable
    assert found[3].prompt_turns == 2 and found[3].chosen == found[3].rejected == ""
    assert found[5].prompt_turns == 1 and "a<|im_end|>" in found[5].prompt
    assert preferences.format_pairs(frames[0].limit(0), frames[1]).count() == 0


def test_every_conversation_with_a_reply_is_paired(spark):
    rows = [(c, t, r, x) for c, reply in ((3, "a"), (7, "b"), (8, None), (20, "c")) for t, r, x in ((0, "user", f"q{c}"), (1, "assistant", reply))]
    rows += [(5, 0, "user", "no reply"), (None, 0, "assistant", "x"), (9, None, "assistant", "x")]
    table_ = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.pair_id: r for r in preferences.format_pairs(*preferences.replies_of_the_next(table_)).collect()}
    said = lambda text: text.removeprefix("<|im_start|>assistant\n").removesuffix("<|im_end|>\n")
    assert {k: (said(r.chosen), said(r.rejected)) for k, r in found.items()} == {3: ("a", "b"), 7: ("b", ""), 8: ("", "c"), 20: ("c", "a")}
    assert all(r.prompt_turns == 1 for r in found.values())
    alone = table_.where("conv_id = 3")
    assert preferences.format_pairs(*preferences.replies_of_the_next(alone)).count() == 0
    assert preferences.format_pairs(*preferences.replies_of_the_next(alone.limit(0))).count() == 0


# -- vector search --------------------------------------------------------------------------------------


def in_order(x, y):
    total = 0.0
    for a, b in zip(x, y):
        total += a * b
    return total


def brute_nearest(queries, vectors, k):
    out = {}
    for q, x in queries:
        scored = sorted((-in_order(x, y), v) for v, y in vectors if v != q and len(y) == len(x))
        out[q] = [(v, -s) for s, v in scored[:k]]
    return out


@pytest.mark.parametrize("group,block", [(8192, 2048), (64, 16)])
def test_search_equals_brute_force(spark, monkeypatch, group, block):
    monkeypatch.setattr(block_search, "GROUP", group)
    monkeypatch.setattr(block_search, "BLOCK", block)
    rng = np.random.default_rng(4)
    data = [(i, [float(v) for v in rng.normal(size=12).astype(np.float32) * 10 ** rng.uniform(-3, 3)]) for i in range(300)]
    data += [(300 + i, data[7][1]) for i in range(40)]  # ties
    data += [(400 + i, [float(v) for v in rng.normal(size=5)]) for i in range(6)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    stored = [(r.vec_id, list(r.embedding)) for r in frame.collect()]
    asked = [x for x in stored if x[0] % 20 == 0]
    expected = brute_nearest(asked, stored, 20)
    found = {}
    for r in sorted(block_search.nearest(frame.where("vec_id % 20 = 0"), frame, 20).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == expected


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, y = (block_search.Quantised(np.arange(50), rng.normal(size=(50, 1500)) * 10 ** rng.uniform(-4, 4, (50, 1))) for _ in range(2))
    value, off = block_search.bounds(x, y)
    assert (np.abs(x.data @ y.data.T - value) <= off).all() and (off < 0.06 * x.norm[:, None] * y.norm).all()


def test_search_among_many_equal_vectors(spark):
    """10,000 copies of one vector and rows that repeat an id: the least ids are found, the query itself apart."""
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(10_000)] + [(20, [1.0, 2.0, 0.5])] * 30 + [(20_001, [5.0, 1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = block_search.nearest(frame.where("vec_id in (20, 9000)"), frame, 3)
    got = {(r.query_id, r["rank"]): r.vec_id for r in found.collect()}
    assert {got[q, 1] for q in (20, 9000)} == {20_001}
    assert (got[20, 2], got[20, 3]) == (0, 1) and (got[9000, 2], got[9000, 3]) == (0, 1)


def test_search_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 1.0]), (7, []), (6, [1.0, 1.0]), (20, [2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS score", "3 AS block")
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in block_search.nearest(frame.where("vec_id % 20 = 0"), frame, 5).collect())
    assert found == [(0, 1, 6, 1.0), (0, 2, 6, 1.0)]
    assert block_search.nearest(frame.limit(0), frame, 5).count() == 0
    assert block_search.nearest(frame, frame.limit(0), 5).count() == 0


def test_sums_of_cells_travel_packed():
    rng = np.random.default_rng(3)
    parts = []
    for _ in range(40):  # cells of a task
        uid = np.unique(rng.integers(0, 500, 300))
        parts.append((uid, rng.integers(0, 9, len(uid)), rng.normal(size=len(uid)), rng.normal(size=len(uid))))
    parcels = pitman_yor._parcels(parts, 8)
    assert len(parcels) <= 8 and parcels.target.is_unique
    sent = [pitman_yor._parcels(parts[:15], 8), pitman_yor._parcels(parts[15:], 8)]
    whole = [r for target in range(8) for r in pitman_yor._totals(pd.concat([x[x.target == target] for x in sent])).itertuples(index=False)]
    want = {}
    for cell in parts:
        for uid, *values in zip(*cell):
            want[uid] = want.get(uid, 0) + np.array(values)
    assert sorted(r.uid for r in whole) == sorted(want)
    assert all(np.allclose(want[r.uid], [r.n_known, r.base_score, r.score]) for r in whole)
