import random
from collections import defaultdict


from loreworks.operators import graph as kg
from loreworks.operators import taskgraph as tg

EDGES = "root_id long, task long, dep long"


def test_cycles_small_and_large_paths_agree(spark, rows):
    data = [
        (1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 4, 1), (1, 5, 6),  # ring with a tail
        (2, 10, 11), (2, 11, 12),  # chain
        (3, 7, 7),  # self loop
        (4, 1, 2), (4, 2, 1), (4, 5, 6), (4, 6, 5),  # two rings
        (5, 1, 99),  # dangling
        *[(6, i, (i + 1) % 50) for i in range(50)],  # a long ring
    ]
    df = spark.createDataFrame(data, EDGES)
    want = [(1, [1, 2, 3, 1]), (3, [7, 7]), (4, [1, 2, 1]), (6, [*range(50), 0])]
    assert rows(tg.find_cycles(df)) == want
    assert rows(tg.find_cycles(df, small=0)) == want


def longest(tasks, edges):
    deps = {}
    for r, t, d in edges:
        deps.setdefault((r, t), set()).add((r, d))
    known = set(tasks)

    def depth(t):
        below = [depth(d) for d in deps.get(t, ()) if d in known]
        return 1 + max(below) if below else 0

    return sorted((r, t, depth((r, t))) for r, t in tasks)


def test_longest_path_small_and_large_paths_agree(spark, rows):
    r = random.Random(4)
    tasks = [(root, t) for root in range(3) for t in range(25)]
    edges = [(root, t, r.randrange(t)) for root in range(3) for t in range(1, 25) for _ in range(2)]
    edges += [(0, t, t - 1) for t in range(1, 25)] + [(1, 3, 777)]
    df = spark.createDataFrame([(a, b, "pending") for a, b in tasks], "root_id long, id long, status string")
    e = spark.createDataFrame(edges, EDGES)
    want = longest(tasks, edges)
    assert rows(tg.longest_path_rank(df, e)) == want
    assert rows(tg.longest_path_rank(df, e, small=0)) == want
    shape = {r["root_id"]: r["depth"] for r in tg.graph_shape(tg.longest_path_rank(df, e)).collect()}
    assert shape[0] == 25


def test_ready_blocked_and_cascade(spark, rows):
    tasks = spark.createDataFrame(
        [(1, 1, "failed"), (1, 2, "pending"), (1, 3, "pending"), (1, 4, "pending"), (1, 5, "succeeded"), (1, 6, "pending"), (1, 7, "timeout")],
        "root_id long, id long, status string",
    )
    edges = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 6, 5), (1, 3, 5)], EDGES)
    assert rows(tg.ready(tasks, edges)) == [(1, 6)]
    assert rows(tg.blocked(tasks, edges)) == [(1, 2)]
    assert rows(tg.skip_cascade(tasks, edges)) == [(1, 2, 1), (1, 3, 2), (1, 4, 3)]
    assert rows(tg.root_status(tasks)) == [(1, "failed")]


def test_components_match_union_find(spark, rows):
    r = random.Random(8)
    pairs = {tuple(sorted(r.sample(range(200), 2))) for _ in range(120)} | {(0, i) for i in range(150, 199)}
    pairs |= {(i, i + 1) for i in range(100, 140)}  # a long chain
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    nodes = spark.range(200)
    edges = spark.createDataFrame(sorted(pairs), "a long, b long")
    want = sorted((i, find(i)) for i in range(200))
    assert rows(kg.components(nodes, edges)) == want
    assert rows(kg.components(nodes, edges.limit(0))) == [(i, i) for i in range(200)]


def test_link_resolution(spark, rows):
    d = spark.createDataFrame(
        [(1, "n", "a/Index.md"), (2, "m", "b/index.md"), (3, "n", "c/Only.md"), (4, "n", "x/dup.md"), (5, "n", "y/dup.md"), (6, "z", "q.md")],
        "doc_id long, collection string, rel_path string",
    )
    links = spark.createDataFrame(
        [(3, "index"), (6, "index"), (1, "dir/only.md"), (3, "Only"), (1, "ghost"), (1, "dup"), (99, "only"), (2, None)], "src long, to_path string"
    )
    got = {(r["src"], r["to_path"]): (r["dst"], r["status"]) for r in kg.resolve_links(d, links).collect()}
    assert got == {
        (3, "index"): (1, "edge"), (6, "index"): (None, "ambiguous"), (1, "dir/only.md"): (3, "edge"), (3, "Only"): (3, "self"),
        (1, "ghost"): (None, "dangling"), (1, "dup"): (None, "ambiguous"), (2, None): (None, "dangling"),
    }
    assert kg.link_stats(kg.resolve_links(d, links)).first()["exact"] == 0


def test_placement_moves_nothing_and_falls_back_to_origin(spark, rows):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1])], "id long, vec array<double>")
    pos = spark.createDataFrame([(1, 4.0, 8.0), (2, 0.0, 0.0)], "id long, x double, y double")
    assert rows(kg.place_new(v, pos, 1)) == [(3, 4.0, 8.0)]
    assert rows(kg.place_new(v, pos.limit(0), 1)) == [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)]


def test_replan_rules_in_order(spark):
    rows_ = [
        (1, 1, "failed", "tool", None, '{"error":{"kind":"denied"}}'), (1, 2, "failed", "planning", None, None), (1, 3, "timeout", "tool", None, "bad"),
        (1, 4, "succeeded", "tool", 3, None), (2, 5, "failed", "tool", None, None), (3, 6, "failed", "tool", None, None),
        (3, 7, "pending", "tool", 70, None), (3, 8, "pending", "tool", 80, None), (3, 9, "pending", "tool", 80, None),
    ]
    t = spark.createDataFrame(rows_, "root_id long, id long, status string, kind string, supersedes long, result string")
    got = {r["id"]: r["reason"] for r in tg.replan_eligibility(t).collect()}
    assert got[1] == "a decision" and got[2] == "planning is not replanned" and got[3] == "already replanned"
    assert got[4] == "not a failure" and got[5] is None and got[6] == "budget spent"


def test_two_hop_variants(spark, rows):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3)], "a long, b long")
    picks = spark.createDataFrame([(1,), (9,)], "id long")
    assert rows(kg.two_hop(e, picks)) == [(1, 3), (9, 0)]
    assert rows(kg.two_hop(e, picks, hops_apart=True)) == [(1, 1), (9, 0)]


def test_reach_through_hubs_and_by_sketches(spark, rows):
    rng = random.Random(6)
    edges = {tuple(sorted(rng.sample(range(40_000), 2))) for _ in range(300)}
    edges |= {(0, i) for i in range(1, 6000, 7)} | {(1, i) for i in range(2, 90_000, 211)}  # two hubs, ids over several bitmaps
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    ids = [0, 1, 8, 15, 213, *rng.sample(sorted(near), 40), 999_999]
    e = spark.createDataFrame(sorted(edges), "a long, b long")
    picks = spark.createDataFrame([(i,) for i in sorted(set(ids))], "id long")
    both = {i: len((near[i] | {x for v in near[i] for x in near[v]}) - {i}) for i in set(ids)}
    apart = {i: len({x for v in near[i] for x in near[v]} - near[i] - {i}) for i in set(ids)}
    for hub in (1, 50, 10_000):
        assert dict(rows(kg.two_hop(e, picks, hub=hub))) == both
    assert dict(rows(kg.two_hop(e, picks, hops_apart=True, hub=50))) == apart
    assert all(abs(n - both[i]) <= max(1, 0.08 * both[i]) for i, n in rows(kg.reach_sketch(e, picks)))


def test_semantic_edges_threshold(spark, rows):
    import math

    def at(cos):
        return [cos, math.sqrt(1 - cos * cos)]

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, at(0.851)), (3, at(0.849)), (4, [0.0, -1.0]), (5, [0.0, 0.0])], "id long, vec array<double>")
    assert (1, 2) in rows(kg.semantic_edges(v)) and (1, 3) not in rows(kg.semantic_edges(v))
    assert all(5 not in pair for pair in rows(kg.semantic_edges(v)))


def test_cyclic_roots_are_placed_behind_and_others_are_ranked(spark, rows):
    tasks = spark.createDataFrame([(1, i) for i in range(1, 7)] + [(2, i) for i in (10, 11)] + [(3, 7)], "root_id long, id long")
    edges = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 4, 5), (1, 5, 4), (1, 6, 4), (2, 11, 10), (3, 7, 7)], EDGES)
    want = sorted([(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 3), (1, 6, 3), (2, 10, 0), (2, 11, 1), (3, 7, 1)])
    for small in (5000, 0):
        assert rows(tg.longest_path_rank(tasks, edges, small=small)) == want
