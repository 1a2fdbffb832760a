"""Grouped prefix join, trie of conversation prefixes and cover trees against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loreworks.llm import cover_tree, grouped_join, prefix_trie
from tests.llm.test_texts import SCHEMA, table

# -- grouped prefix join ----------------------------------------------------------------------------------


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def linked(texts, percent=80):
    """Component of each text by all pairs."""
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def mixed_texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    bases = [rng.choices(vocabulary, k=rng.choice([3, 5, 6, 9, 40, 150])) for _ in range(12)]
    common = rng.choices(vocabulary, k=80)
    texts = []
    for _ in range(n):
        base = rng.choice(bases)
        kind = rng.random()
        if kind < 0.6:
            texts.append(edited(rng, base, rng.choice([0, 0, 1, 2, 3])))
        elif kind < 0.8:
            texts.append(" ".join(common + rng.choices(vocabulary, k=rng.choice([2, 10, 15, 20, 60]))))
        else:
            texts.append(" ".join(base[: rng.randint(1, len(base))]).upper())
    return texts


@pytest.mark.parametrize("seed, seen, tile, sent", [(1, 8, 2048, 1000), (2, 2, 3, 0)])
def test_grouped_join_equals_all_pairs(spark, monkeypatch, seed, seen, tile, sent):
    monkeypatch.setattr(grouped_join, "SEEN", seen)
    monkeypatch.setattr(grouped_join, "SENT", sent)
    texts = mixed_texts(seed) + [None, "", " \t", "one two", "ONE  two"]
    found = grouped_join.linked_components(table(spark, texts), tile=tile)
    assert sorted(map(tuple, found.collect())) == linked(texts)


def test_grouped_join_at_the_threshold(spark):
    words = [f"a{i}" for i in range(40)]  # 36 shingles
    texts = [" ".join(words), " ".join(words[4:] + ["x1", "x2", "x3", "x4"]), " ".join(words[5:] + ["y1", "y2", "y3", "y4", "y5"])]
    assert 100 * len(shingle_set(texts[0]) & shingle_set(texts[1])) == 80 * len(shingle_set(texts[0]) | shingle_set(texts[1]))
    assert sorted(map(tuple, grouped_join.linked_components(table(spark, texts)).collect())) == linked(texts)


def test_many_half_similar_and_many_near_texts(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    near = [edited(rng, base, 1) for _ in range(300)]
    half = [" ".join(base[:60] + [f"h{i}x{k}" for k in range(40)]) for i in range(200)]
    texts = near + half
    found = {r.doc_id: r.component_id for r in grouped_join.linked_components(table(spark, texts), tile=64).collect()}
    assert found == {i: c for i, _, c in linked(texts)}


def test_grouped_join_long_text_repeated_ids_and_empty_table(spark):
    long = " ".join(f"q{i}" for i in range(120_000))
    docs = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (4, None)], "doc_id long, text string")
    docs = docs.selectExpr("*", "1 AS n", "'x' AS digest", "2 AS token", "3 AS vertex")
    found = sorted(map(tuple, grouped_join.linked_components(docs).collect()), key=str)
    assert found == sorted([(1, 119_996, 1), (2, 119_997, 1), (3, 2, 3), (3, 2, 3), (None, 2, None), (4, 0, 4)], key=str)
    assert grouped_join.linked_components(spark.createDataFrame([], SCHEMA)).collect() == []


# -- trie of conversation prefixes --------------------------------------------------------------------------


def whole_trie(rows):
    """All nodes by walking every conversation; rows are (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:3])] for c, v in turns.items()}
    built = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = said.get(c - c % 5, [])[:h] + said[c][h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
            if d:
                kids[tuple(seq[: d - 1])].add(tuple(seq[:d]))
    name = {k: min(v) for k, v in members.items()}

    def under(k):
        return [k] + [x for kid in kids[k] for x in under(kid)]

    out = []
    for k, who in members.items():
        sub = under(k)
        ends = sorted(c for c in who if len(built[c]) == len(k))
        out.append((name[k], len(k), name[k[:-1]] if k else None, len(who), len(kids[k]), sum(not kids[x] for x in sub),
                    sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in sub if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out)


def trie_of(spark, rows, height):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS depth", "2 AS node", "3 AS pos", "4 AS band")
    found = prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(prefix_trie.numbered_turns(frame)), height=height)
    return sorted((tuple(r) for r in found.collect()))


@pytest.mark.parametrize("height", [2, 16])
def test_trie_equals_walking_every_conversation(spark, height):
    rng = random.Random(height)
    rows = []
    for c in rng.sample(range(200), 60):
        depth = rng.choice([0, 1, 3, 9, 12, 30])
        words = ["a", "bé", "", None, "long text " * 20]
        for turn in range(depth):
            rows.append((c, turn if turn else None, rng.choice(["user", "assistant", None]), words[0] if rng.random() < 0.7 else rng.choice(words)))
    rows += [(None, 1, "user", "x"), (7, 500, "user", "same"), (7, 500, "user", "same")]
    rng.shuffle(rows)
    assert trie_of(spark, rows, height) == whole_trie(rows)


def test_trie_of_deep_conversations_and_of_none(spark):
    rows = [(c, t, "user", "x" if t < 100 + c else f"{c}-{t}") for c in (0, 5, 10) for t in range(150)] + [(1, 0, None, "y" * 200_000)]
    assert trie_of(spark, rows, 4) == whole_trie(rows)
    assert trie_of(spark, [], 4) == []


# -- cover trees --------------------------------------------------------------------------------------------


def mined(rows, positives=5, negatives=10):
    """rows: {id: (label, integers)}; anchors are divisible by 100."""
    out = []
    for a, (label, q) in rows.items():
        if a % 100:
            continue
        score = {i: int(np.dot(q, v)) for i, (_, v) in rows.items() if i != a and len(v) == len(q)}
        best = sorted((-s, i) for i, s in score.items() if rows[i][0] == label)[:positives]
        for ps, p in best:
            fit = sorted((-s, i) for i, s in score.items() if rows[i][0] != label and 30 * -ps <= 100 * s <= 90 * -ps)[:negatives]
            out.extend((a, p, r, i, -ps, -s) for r, (s, i) in enumerate(fit, 1))
    return sorted(out)


def random_rows(rng, kind, n):
    if kind == "spread":
        points = rng.normal(0, 40, (n, 12))
    elif kind == "clusters":
        points = np.repeat(rng.normal(0, 60, (8, 12)), n // 8 + 1, axis=0)[:n] + rng.normal(0, 1.5, (n, 12))
    elif kind == "equal":
        points = np.repeat(rng.normal(0, 60, (3, 12)), n // 3 + 1, axis=0)[:n]
    else:
        points = rng.integers(-2, 3, (n, 3))
    return np.floor(points).astype(np.int64)


@pytest.mark.parametrize("kind", ["spread", "clusters", "equal", "ties"])
def test_hard_negatives_equal_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    points = random_rows(rng, kind, 500)
    rows = {i * 20: (int(rng.integers(0, 3)), p) for i, p in enumerate(points)}
    frame = spark.createDataFrame([(i, label, p.tolist()) for i, (label, p) in rows.items()], "vec_id long, label long, point array<int>")
    found = cover_tree.hard_negatives(frame, frame.where("vec_id % 100 = 0"), size=120)
    assert sorted(map(tuple, found.collect())) == mined(rows)


def test_tree_covers_its_points():
    rng = np.random.default_rng(3)
    points = random_rows(rng, "clusters", 1000).astype(np.int32)
    tree = cover_tree.CoverTree.unpack(cover_tree.CoverTree.build(np.arange(1000), np.zeros(1000, np.int64), points).pack())
    assert sorted(tree.order) == list(range(1000))
    wide = np.hstack([tree.floats, np.sqrt(tree.top - (tree.floats**2).sum(axis=1))[:, None]])
    for i in range(len(tree.centre)):
        inside = tree.order[tree.first[i] : tree.last[i]]
        assert np.linalg.norm(wide[inside] - wide[tree.centre[i]], axis=1).max() <= tree.radius[i] + 1e-6
        kids = slice(tree.child[i], tree.child[i] + tree.children[i])
        if tree.children[i]:
            assert (tree.radius[kids] <= tree.radius[i] / 2 + 1e-6).all() and tree.last[kids][-1] == tree.last[i]


def test_rows_that_take_no_part(spark):
    rows = [(100, 1, [1.0, 0.5]), (100, 1, [1.0, 0.5]), (101, 1, [1.0, 0.4]), (102, 2, [0.5, 0.25]), (103, None, [1.0, 1.0]), (104, 1, None), (105, 2, [float("nan"), 1.0]),
            (106, 2, [None, 1.0]), (107, 2, [float("inf"), 1.0]), (None, 2, [0.5, 0.5]), (108, 2, [0.5]), (109, 2, []), (110, 2, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS point", "2 AS shard", "3 AS tree")
    whole = cover_tree.whole_vectors(frame)
    assert sorted(r.vec_id for r in whole.collect()) == [100, 101, 102, 108, 109, 110]
    found = cover_tree.hard_negatives(whole, whole.where("vec_id % 100 = 0"))
    assert [tuple(r) for r in found.collect()] == [(100, 101, 1, 102, 256 * 256 + 128 * 102, 256 * 128 + 128 * 64)]
    assert cover_tree.hard_negatives(whole.limit(0), whole.limit(0)).collect() == []
    assert {r.vec_id: r.label for r in cover_tree.noisy_labels(whole).collect()}[105 - 5] == 1


def test_bitmaps_rule_out_pairs_before_they_are_made(spark, monkeypatch):
    rng = np.random.default_rng(7)
    sets = [np.sort(rng.integers(0, 1 << 63, 40).astype(np.uint64)) for _ in range(30)]
    sets.append(np.sort(np.append(sets[0][1:], np.uint64(5))))  # near the first
    owner = np.repeat(np.arange(31), 40)
    words = grouped_join.parities(owner, np.concatenate(sets), 31)
    bits = lambda i: int.from_bytes(words[:, i].tobytes(), "little")
    for i in range(31):
        for j in range(31):
            assert (bits(i) ^ bits(j)).bit_count() <= len(set(sets[i].tolist()) ^ set(sets[j].tolist()))
    # all are in the lists of six shingles
    rows = spark.createDataFrame(
        [(t, i, 40, t, i, 31, *(int(x) for x in words[:, i])) for i in range(31) for t in range(6)],
        "token long, vertex long, n long, pos int, label long, many long, " + ", ".join(f"{b} long" for b in grouped_join.PARITIES),
    )
    made, plain = [], grouped_join._candidates

    def candidates(percent, met, x, y):
        made.append(met.count())
        return plain(percent, met, x, y)

    monkeypatch.setattr(grouped_join, "_candidates", candidates)
    pairs = grouped_join._tiled_pairs(rows, 80, 8).select("a", "b").collect()
    assert made == [6]  # of 2,790
    assert [(r.a, r.b) for r in pairs] == [(0, 30)]


def test_shingles_of_a_pair_are_counted_before_it_is_sent(spark):
    """A pair that shares many shingles leaves its task once; the candidates are those of a join with a row for each."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.9], rng.integers(0, 1 << 63, 6).astype(np.uint64)])) for _ in range(40)]
    words = grouped_join.parities(np.repeat(np.arange(40), [len(s) for s in sets]), np.concatenate(sets), 40)
    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for pos, token in enumerate(s[:14].tolist()):
            lists[token].append((i, len(s), pos))
    fields = "token long, vertex long, n long, pos int, label long, pick long, many long, " + ", ".join(f"{b} long" for b in grouped_join.PARITIES)
    rows = [(t, i, n, pos, i % 33, min(i for i, *_ in own), len(own), *(int(x) for x in words[:, i])) for t, own in lists.items() if len(own) > 1 for i, n, pos in own]
    frame = spark.createDataFrame(rows, fields)
    plain = sorted(tuple(r) for r in grouped_join._tiled_pairs(frame, 80, 3).collect())
    assert len(plain) > 10
    for tile in (64, 3):
        assert sorted(tuple(r) for r in grouped_join._counted_pairs(frame, 80, tile).collect()) == plain
    # the same rows in one task, all at once and in small parts
    together = {}
    for most_rows, most_pairs in ((1 << 17, 1 << 19), (100, 50), (1, 1)):
        columns = list(zip(*((t, 0, i, n, pos, label, 2, *bits) for t, i, n, pos, label, _, _, *bits in rows)))
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["token", "tile", "vertex", "n", "pos", "label", "side", *grouped_join.PARITIES])
        made = [r for part in grouped_join._met(80, most_rows, most_pairs)(batch.slice(k, 90) for k in range(0, len(rows), 90)) for r in part.to_pylist()]
        total = defaultdict(lambda: [0, -1, -1, 99])
        for r in made:
            own = total[r["x"], r["y"], r["n"], r["m"]]
            own[:] = own[0] + r["shared"], max(own[1], r["pos"]), max(own[2], r["at"]), min(own[3], r["least"])
        together[most_rows] = dict(total)
        if most_rows == 1 << 17:
            assert len(made) == len(total)
            assert sum(r["shared"] for r in made) > 3 * len(made)  # a join makes as many rows
    assert together[1] == together[100] == together[1 << 17]
    # two bits that differ are two, also if one is the sign
    signed = [[5, 0, i, 40, 0, i, 2, (i and 8 - (1 << 63)), 0, 0, 0] for i in range(2)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*signed)], batch.schema.names)
    assert [r["shared"] for part in grouped_join._met(80)([batch]) for r in part.to_pylist()] == [1]
