"""Word helpers and the operators that keep documents apart: quality, near duplicates, repeats, benchmark."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from loreworks.llm import decontaminate, neardup, quality, suffix_dedup
from loreworks.llm.words import find_words, pairs, shingles, text_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(2, 8))) for _ in range(400)]


def prose(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(rng.choices(VOCABULARY[:vocabulary], k=n))


def table(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_words_pairs_and_shingles():
    data, offsets = text_bytes(pa.array(["Ab  cd\x0bef\n", "", None, "x", "a b c d e f"]))
    words = find_words(data, offsets)
    assert [bytes(data[s:e]) for s, e in zip(words.start, words.end)] == [b"Ab", b"cd", b"ef", b"x", b"a", b"b", b"c", b"d", b"e", b"f"]
    assert words.first.tolist() == [0, 3, 3, 3, 4, 10]
    lower = find_words(*text_bytes(pa.array(["aB CD EF"])))
    assert lower.hash.tolist() == words.hash[:3].tolist()
    assert len(pairs(words)[0]) == 2 + 5
    h, owner = shingles(words)
    assert owner.tolist() == [0, 3, 4, 4] and len(set(h.tolist())) == 4
    long = find_words(*text_bytes(pa.array(["abcdefghij" * 3, "abcdefghij" * 3 + "k"])))
    assert long.hash[0] != long.hash[1]


# -- quality --------------------------------------------------------------------------------------------


@pytest.fixture
def graded(spark):
    texts = [prose(60, i, 20) for i in range(120)] + [" ".join(w + "$$$" for w in prose(60, i, 20).split()) for i in range(40)]
    labels = [(i, int(i < 120), 0) for i in range(0, 160, 2)]
    return table(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_rejects_what_is_unlike_the_target(graded):
    docs, labels = graded
    found = {r.doc_id: r for r in quality.select(docs, labels).collect()}
    held_out = [i for i in found if i % 2]
    good = [found[i].kept for i in held_out if i < 120]
    bad = [found[i].kept for i in held_out if i >= 120]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.kept}


def test_gumbel_keeps_the_k_greatest_keys(graded):
    docs, labels = graded
    rows = quality.select(docs, labels, k=30).collect()
    best = sorted(rows, key=lambda r: -r.key)[:30]
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in best}
    assert not any(r.kept for r in quality.select(docs, labels, k=0).collect())
    assert all(r.kept for r in quality.select(docs, labels, k=1000).collect())


def test_last_key_narrows_down(spark, monkeypatch):
    monkeypatch.setattr(quality, "SORTED_KEYS", 3)
    values = [float(i % 50) for i in range(300)] + [1e9, -1e9]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 7, 100, 302):
        assert quality.last_key(keys, k) == sorted(values, reverse=True)[k - 1]


def test_quality_edge_cases(spark, graded):
    docs, labels = graded
    odd = table(spark, [None, "", "word", "x " * 30_000]).selectExpr("*", "1 AS _key", "2 AS _weight", "3 AS log_weight")
    assert quality.keep_good(odd, labels).columns == odd.columns
    none = labels.limit(0)
    assert quality.keep_good(odd, none).count() == 4
    nulls = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 1, None), (2, 0, None)], labels.schema)
    assert quality.select(docs, nulls).where("kept").count() == 160
    assert quality.select(docs.limit(0), labels).count() == 0
    twice = docs.unionByName(docs.where("doc_id = 3"))
    assert len({r.kept for r in quality.select(twice, labels).where("doc_id = 3").collect()}) == 1


def test_weighing_sends_texts_and_takes_weights_back(spark, graded):
    docs, _ = graded
    wide = docs.selectExpr("*", "repeat(text, 50) AS other")
    model = quality.ImportanceModel(np.linspace(-2, 2, 1 << 10, dtype=np.float32))
    found = quality.weigh(wide, model)
    assert found.columns == [*wide.columns, "log_weight"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    narrow = {r.doc_id: r.log_weight for r in quality.weigh(docs, model).collect()}
    assert {r.doc_id: r.log_weight for r in found.collect()} == narrow and len(set(narrow.values())) > 1


# -- near duplicates ------------------------------------------------------------------------------------


def edited(text, changes, seed):
    rng, words = random.Random(seed), text.split()
    for at in rng.sample(range(len(words)), changes):
        words[at] = "new%d" % rng.randrange(10**6)
    return " ".join(words)


def jaccard(a, b, n=5):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def brute_classes(texts, least=0.8):
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= least:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("tile", [4096, 8])
def test_classes_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    texts = [prose(200, i) for i in range(12)]
    for i in range(6):
        texts += [edited(texts[i], 1 + k, 100 * i + k) for k in range(4)] + [texts[i].upper()]
    chain = prose(300, 77)
    for k in range(8):
        texts.append(chain)
        chain = edited(chain, 4, 1000 + k)
    texts += [None, "", " \n", "one two", "one  two", "one two three"]
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(table(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == brute_classes(texts)


def test_probability_jaccard():
    def brute(a, b):
        keys = set(a) | set(b)
        both = [i for i in keys if a.get(i) and b.get(i)]
        return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in keys) for i in both)

    rng = random.Random(1)
    for _ in range(30):
        a = {k: rng.randint(1, 4) for k in rng.sample(range(20), 12)}
        b = {k: rng.randint(1, 4) for k in rng.sample(range(20), 12)}
        arrays = [(np.array(sorted(x), np.uint32), np.array([x[k] for k in sorted(x)], np.uint32)) for x in (a, b)]
        assert neardup.similarity(*arrays) == pytest.approx(brute(a, b))
    ones = {k: 1 for k in range(10)}, {k: 1 for k in range(5, 17)}
    assert brute(*ones) == pytest.approx(5 / 17)


def test_registers_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    element = np.concatenate([np.arange(60), np.arange(20, 80)]).astype(np.uint64)
    weight = np.concatenate([np.arange(1, 61), np.arange(21, 81)])
    owner = np.repeat([0, 1], 60)
    sig = neardup.prob_minhash(owner, element, weight, 2, 4000)
    exact = neardup.similarity((element[:60].astype(np.uint32), weight[:60]), (element[60:].astype(np.uint32), weight[60:]))
    assert (sig[0] == sig[1]).mean() == pytest.approx(exact, abs=0.04)
    assert len(set(neardup.prob_minhash(np.zeros(1, int), rng.integers(0, 9, 1).astype(np.uint64), np.ones(1), 1, 16)[0])) == 1


@pytest.mark.parametrize("seed", [48469, 70472])  # 63 and 61 equal registers of 100, at a similarity of exactly 0.8
def test_pairs_whose_registers_understate_them_are_verified(spark, seed):
    words = [f"w{seed}x{i}" for i in range(14)]
    texts = [" ".join(words), " ".join(words[:12])]
    assert brute_classes(texts) == [0, 0]
    assert [r.class_id for r in neardup.near_duplicates(table(spark, texts)).collect()] == [0, 0]


def test_near_duplicates_edge_cases(spark):
    text = prose(50, 1)
    rows = [(None, text, "en", "s", 1), (4, text, "en", "s", 1), (4, text, "en", "s", 1), (7, text, None, None, None), (9, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS class_id", "2 AS band", "3 AS vertex")
    found = sorted((r.doc_id or -1, r.class_id) for r in neardup.near_duplicates(docs).collect())
    assert found == [(-1, None), (4, 4), (4, 4), (7, 4), (9, 9)]
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 4, 9]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_keep_first_shuffles_texts_once_at_most(spark, monkeypatch):
    docs = table(spark, [prose(20, i) for i in range(12)])
    classes = docs.selectExpr("doc_id", "doc_id - doc_id % 3 AS class_id", "0L AS links")
    monkeypatch.setattr(neardup, "near_duplicates", lambda docs, **options: classes)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = neardup.keep_first(docs)
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Join") == 1  # one join, so the texts are dealt once
        assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 6, 9]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# -- repeated passages ----------------------------------------------------------------------------------


def brute_removal(rows, length=100):
    """{doc_id: (removed, spans, digest)} for unique doc_ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            gram = raw[i : i + length]
            if gram in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(gram)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
    return out


def test_repeats_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)  # long texts are dealt in pieces
    shared = [prose(n, 900 + n) for n in (15, 30, 90)]
    texts = [prose(40, i) + " " + shared[i % 3] + " " + prose(20, 50 + i) for i in range(20)]
    texts += [texts[3], "é" * 300, "ab" * 400, "ab" * 400, "a" * 99, "a" * 99, "a" * 100, "a" * 101, None, "", prose(400, 3) + shared[2] * 3, "\0" * 500, "\0" * 120]
    docs = table(spark, texts).repartition(3)
    expected = brute_removal(list(enumerate(texts)))
    found = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_report(docs).collect()}
    assert found == expected


def test_column_orders_are_suffix_orders():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 3, (20, 30)).astype(np.uint8)
    for column, order, common, inserted in suffix_dedup.suffix_columns(symbols):
        rows = [bytes(symbols[column:, i]) for i in order]
        assert rows == sorted(rows)
        for k in range(1, len(rows)):
            same = next((n for n, (x, y) in enumerate(zip(rows[k], rows[k - 1])) if x != y), len(rows[k]))
            assert common[k] == same
        assert sorted(inserted.tolist()) == sorted(symbols[column].tolist())


def test_repeats_edge_cases(spark):
    text = prose(60, 8)
    rows = [(None, text, "en", "s", 5), (2, text, "en", "s", 5), (2, text, "en", "s", 5), (3, "x " + text + " é" + text[:200], None, None, None), (1, None, None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS ranges", "2 AS print", "3 AS again")
    found = sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup.dedup_report(docs).collect())
    assert found[:4] == [(-1, 0), (1, 0), (2, 0), (2, 0)] and found[4][1] == len(text) + 200
    left = suffix_dedup.remove_repeats(docs)
    assert left.columns == docs.columns
    row = {r.doc_id: r for r in left.collect()}[3]
    assert row.text == "x  é" and row.n_chars == 4
    copy = spark.createDataFrame([(5, text, "en", "s", 1), (6, text, "en", "s", 1)], SCHEMA)
    assert [r.doc_id for r in suffix_dedup.remove_repeats(copy).collect()] == [5]
    assert suffix_dedup.dedup_report(docs.limit(0)).count() == 0


# -- benchmark ------------------------------------------------------------------------------------------


def items(spark, texts):
    return decontaminate.split_items(spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"))


def test_contaminated_documents_are_found(spark):
    tests = [prose(n, 7000 + n) for n in (15, 20, 33, 58, 64, 90, 200)]
    texts = [prose(500, i) for i in range(30)]
    planted = {}
    for k, test in enumerate(tests):
        for at in (0, 37, 63, 64, 200):
            words = prose(400, 31 * k + at).split()
            planted[len(texts)] = k
            texts.append(" ".join(words[:at] + test.upper().split() + words[at:]))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, texts), items(spark, tests)).collect()}
    assert found == set(planted.items())
    left = decontaminate.drop_contaminated(table(spark, texts), items(spark, tests))
    assert {r.doc_id for r in left.collect()} == set(range(30))


def test_bounds_lose_nothing(spark):
    """Every passage and unit whose full BM25 reaches the threshold is retrieved."""
    tests = [prose(n, 300 + n) for n in range(10, 60, 3)]
    (index,) = decontaminate.build_index(items(spark, tests))
    texts = [edited(t, len(t.split()) // 5, 9) for t in tests] + [prose(100, 4)]
    data, offsets = text_bytes(pa.array(texts))
    found = {(t, i) for t, i, *_ in decontaminate.matches(index, data, offsets, 0.4, 0.0)}
    words = find_words(data, offsets)
    brute = set()
    for t in range(len(texts)):
        own = words.hash[words.first[t] : words.first[t + 1]]
        for a in range(0, len(own), decontaminate.UNIT):
            asked = np.flatnonzero(np.isin(index.terms, own[a : a + 2 * decontaminate.UNIT]))
            for b, (terms, impact) in enumerate(index.blocks):
                score = impact[np.isin(terms, asked)].sum(axis=0)
                brute |= {(t, int(index.units[b * decontaminate.BLOCK + k])) for k in np.flatnonzero(score >= 0.4)}
    assert found == brute and len(found) >= len(tests)


def test_benchmark_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_UNITS", 2)
    rows = [(1, prose(30, 1)), (1, prose(30, 1)), (2, None), (3, ""), (None, prose(30, 2)), (4, prose(30, 1)), (5, "lonely")]
    tests = decontaminate.split_items(spark.createDataFrame(rows, "item_id long, text string"))
    docs = table(spark, [None, "", prose(30, 1), prose(30, 2), "a lonely word", "x " * 50_000]).selectExpr("*", "1 AS item_id", "2 AS score")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, tests).collect()}
    assert found == {(2, 1), (2, 4), (4, 5)}
    assert decontaminate.drop_contaminated(docs, tests).columns == docs.columns
    assert decontaminate.contaminated(docs, tests.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), tests).count() == 0
