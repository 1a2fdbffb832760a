"""Registered queries: the knowledge graph."""

from pyspark.sql import functions as F

from loreworks.operators import graph as kg
from loreworks.plans.corpus_queries import tree_sql
from loreworks.plans.registry import query
from loreworks.session import save_point

THR, K = 0.36, 4
STEM = "lower(regexp_replace(string_split(trim({0}), '/')[-1], '\\.[^.]*$', ''))"
RESOLVED = f"""d AS (SELECT doc_id, collection, {STEM.format('rel_path')} AS stem FROM page_docs),
s AS (SELECT stem, count(*) AS n, min(doc_id) AS o FROM d GROUP BY 1), h AS (SELECT stem, collection, count(*) AS n, min(doc_id) AS o FROM d GROUP BY 1, 2),
l AS (SELECT src, to_path, {STEM.format('to_path')} AS stem, d.collection FROM links JOIN d ON d.doc_id = src),
r AS (SELECT l.src, l.to_path, CASE WHEN s.n = 1 THEN s.o WHEN h.n = 1 THEN h.o END AS dst, s.n FROM l LEFT JOIN s ON s.stem = l.stem LEFT JOIN h ON h.stem = l.stem AND h.collection = l.collection),
resolved AS (SELECT src, to_path, dst, CASE WHEN n IS NULL THEN 'dangling' WHEN dst IS NULL THEN 'ambiguous' WHEN dst = src THEN 'self' ELSE 'edge' END AS status FROM r)"""


def near_sql(k: int, thr: float) -> str:
    return f"""nn AS (SELECT * FROM (SELECT qid, id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM (
  SELECT a.id AS qid, b.id, round(list_dot_product(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])), 6) AS sim FROM vectors a, vectors b WHERE a.id <> b.id) x) y
  WHERE rank <= {k} AND sim >= {thr})"""


NEAR = near_sql(K, THR)
EDGES = f"""{RESOLVED}, {NEAR},
ex AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM resolved WHERE status = 'edge'),
se AS (SELECT DISTINCT least(qid, id) AS a, greatest(qid, id) AS b FROM nn),
known AS (SELECT doc_id AS id FROM page_docs),
se2 AS (SELECT * FROM se WHERE a IN (SELECT id FROM known) AND b IN (SELECT id FROM known)),
edges AS (SELECT a, b, 'explicit' AS kind FROM ex UNION ALL SELECT a, b, 'semantic' FROM (SELECT * FROM se2 EXCEPT SELECT * FROM ex) z)"""
DEG = "deg AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM edges UNION ALL SELECT b FROM edges) x GROUP BY 1)"
NODES = f"""{EDGES}, {DEG}, nodes AS (SELECT p.doc_id AS id, p.collection, p.rel_path, p.kind,
  CASE WHEN parse_error IS NOT NULL THEN 'failed' WHEN kind = 'config' OR v.id IS NULL THEN 'unembeddable' ELSE 'placed' END AS state, coalesce(degree, 0) AS degree
  FROM page_docs p LEFT JOIN vectors v ON v.id = p.doc_id LEFT JOIN deg ON deg.id = p.doc_id)"""
TABLES = "page_docs links vectors"


def _resolved(t):
    return kg.resolve_links(t("page_docs"), t("links"))


def _edges(t):
    nodes = t("page_docs").select(F.col("doc_id").alias("id"))
    return save_point(
        kg.merge_edges(kg.explicit_edges(_resolved(t)), kg.semantic_edges(t("vectors"), K, THR), nodes)
    )


def _nodes(t, edges):
    return kg.node_states(t("page_docs"), t("vectors"), edges)


def _positions(t):
    return t("layout_a").where("id % 3 <> 1").withColumn(
        "placed", F.when(F.col("id") % 5 == 0, "incremental").otherwise("layout")
    )


@query("g01_resolve_links", TABLES, f"WITH {RESOLVED} SELECT * FROM resolved")
def _(t):
    return _resolved(t)


@query(
    "g01_link_stats", TABLES,
    f"""WITH {RESOLVED} SELECT CAST(0 AS BIGINT) AS exact, count(*) FILTER (status = 'edge') AS basename, count(*) FILTER (status = 'ambiguous') AS ambiguous,
  count(*) FILTER (status = 'dangling') AS dangling, count(*) FILTER (status = 'self') AS self FROM resolved""",
)
def _(t):
    return kg.link_stats(_resolved(t))


@query(
    "g02_semantic_edges", TABLES,
    f"WITH {NEAR} SELECT DISTINCT least(qid, id) AS a, greatest(qid, id) AS b FROM nn",
)
def _(t):
    return kg.semantic_edges(t("vectors"), K, THR)


@query(
    "g02_semantic_edges_blocked", TABLES,
    f"WITH {NEAR} SELECT DISTINCT least(qid, id) AS a, greatest(qid, id) AS b FROM nn",
)
def _(t):
    return kg.semantic_edges(t("vectors"), K, THR, small=0, block=128)


@query("g03_merge_edges", TABLES, f"WITH {EDGES} SELECT * FROM edges")
def _(t):
    return _edges(t)


@query("g04_node_states", TABLES, f"WITH {NODES} SELECT * FROM nodes")
def _(t):
    return _nodes(t, _edges(t))


@query(
    "g05_graph_stats", TABLES + " layout_a",
    f"""WITH {NODES} SELECT count(*) AS documents, count(*) FILTER (degree = 0 AND state = 'placed') AS orphans,
  count(*) FILTER (state = 'placed' AND id NOT IN (SELECT id FROM layout_a WHERE id % 3 <> 1)) AS unplaced,
  (SELECT count(*) FROM edges WHERE kind = 'explicit') AS explicit_edges, (SELECT count(*) FROM edges WHERE kind = 'semantic') AS semantic_edges FROM nodes""",
)
def _(t):
    edges = _edges(t)
    return kg.graph_stats(_nodes(t, edges), edges, _positions(t))


COMP = f"""WITH RECURSIVE {EDGES}, sym AS (SELECT a AS u, b AS v FROM edges UNION SELECT b, a FROM edges),
reach(id, r) AS (SELECT id, id FROM known UNION SELECT reach.id, sym.v FROM reach JOIN sym ON sym.u = reach.r),
comp AS (SELECT id, min(r) AS component FROM reach GROUP BY 1)"""


@query("g06_components", TABLES, f"{COMP} SELECT * FROM comp")
def _(t):
    return kg.components(t("page_docs").select(F.col("doc_id").alias("id")), _edges(t))


@query(
    "g06_component_stats", TABLES,
    f"""{COMP}, z AS (SELECT component, count(*) AS n FROM comp GROUP BY 1)
SELECT count(*) AS components, max(n) AS largest, round(max(n) / sum(n), 4) AS largest_share FROM z""",
)
def _(t):
    return kg.component_stats(kg.components(t("page_docs").select(F.col("doc_id").alias("id")), _edges(t)))


PICKS = "picks AS (SELECT doc_id AS id FROM page_docs WHERE kind <> 'config')"
HOPS = f"""{EDGES}, {PICKS}, sym AS (SELECT a AS u, b AS v FROM edges UNION SELECT b, a FROM edges),
one AS (SELECT p.id, v AS n FROM picks p JOIN sym ON u = p.id), two AS (SELECT one.id, v AS n FROM one JOIN sym ON u = one.n)"""


def _picks(t):
    return kg.sample_nodes(t("page_docs").withColumnRenamed("doc_id", "id"))


def _reach(t, apart=False, **options):
    return kg.two_hop(_edges(t), _picks(t), apart, **options)


REACH = f"""WITH {HOPS} SELECT p.id, count(DISTINCT n) AS reach FROM picks p LEFT JOIN (SELECT * FROM one UNION SELECT * FROM two) x ON x.id = p.id AND x.n <> p.id GROUP BY 1"""


@query("g07_two_hop", TABLES, REACH)
def _(t):
    return _reach(t)


@query("g07_two_hop_hubs", TABLES, REACH)
def _(t):
    return _reach(t, hub=4)


@query("g07_reach_sketch", TABLES, f"SELECT id, TRUE AS close FROM ({REACH}) r")
def _(t):
    exact = _reach(t).withColumnRenamed("reach", "exact")
    off = F.abs(F.col("reach") - F.col("exact"))
    return kg.reach_sketch(_edges(t), _picks(t)).join(exact, "id").select("id", (off <= 0.08 * F.col("exact")).alias("close"))


@query(
    "g07_two_hop_apart", TABLES,
    f"""WITH {HOPS} SELECT p.id, count(DISTINCT n) AS reach FROM picks p LEFT JOIN (SELECT * FROM two EXCEPT SELECT * FROM one) x ON x.id = p.id AND x.n <> p.id GROUP BY 1""",
)
def _(t):
    return _reach(t, True)


@query(
    "g07_reach_stats", TABLES,
    f"""WITH {HOPS}, rr AS (SELECT p.id, count(DISTINCT n) AS reach FROM picks p LEFT JOIN (SELECT * FROM one UNION SELECT * FROM two) x ON x.id = p.id AND x.n <> p.id GROUP BY 1)
SELECT CAST(floor(median(reach)) AS BIGINT) AS two_hop_median, round(median(reach) / (SELECT count(*) FROM page_docs), 4) AS two_hop_median_share,
  CAST(floor(quantile_cont(reach, 0.9)) AS BIGINT) AS two_hop_p90 FROM rr""",
)
def _(t):
    return kg.reach_stats(_reach(t), t("page_docs").agg(F.count(F.lit(1)).alias("n")))


@query(
    "g08_edge_metrics", TABLES,
    f"""WITH {NODES}, x AS (SELECT count(*) AS edges, count(*) FILTER (p.collection <> q.collection) AS cross_collection_edges
  FROM edges e JOIN page_docs p ON p.doc_id = e.a JOIN page_docs q ON q.doc_id = e.b),
y AS (SELECT count(*) AS n, count(*) FILTER (kind <> 'config') AS able, count(*) FILTER (kind <> 'config' AND degree = 0) AS orphans FROM nodes)
SELECT edges, cross_collection_edges, orphans, round(orphans / able, 4) AS orphan_share, round(2 * edges / n, 2) AS avg_degree FROM x, y""",
)
def _(t):
    return kg.edge_metrics(t("page_docs").withColumnRenamed("doc_id", "id"), _edges(t))


KS, THRS = [2, 3, 4, 6, 8], [0.30, 0.34, 0.38, 0.42]


@query(
    "g09_edge_sweep", TABLES,
    f"""WITH {near_sql(8, 0.30)}, g AS (SELECT k, t FROM (SELECT unnest({KS}) AS k) a, (SELECT unnest({THRS}) AS t) b),
e AS (SELECT DISTINCT k, t, least(qid, id) AS a, greatest(qid, id) AS b FROM nn JOIN g ON rank <= k AND sim >= t),
n AS (SELECT k, t, count(DISTINCT x) AS nodes FROM (SELECT k, t, a AS x FROM e UNION ALL SELECT k, t, b FROM e) z GROUP BY 1, 2)
SELECT CAST(k AS BIGINT) AS k, CAST(t AS DOUBLE) AS threshold, count(*) AS edges, any_value(nodes) AS nodes FROM e JOIN n USING (k, t) GROUP BY 1, 2""",
)
def _(t):
    return kg.edge_sweep(t("vectors"), KS, THRS)


@query(
    "g10_corpus_census", "page_docs links",
    f"""
SELECT 'documents' AS facet, '' AS value, count(*) AS n FROM page_docs
UNION ALL SELECT 'kind', kind, count(*) FROM page_docs GROUP BY 2 UNION ALL SELECT 'collection', collection, count(*) FROM page_docs GROUP BY 2
UNION ALL SELECT 'unembeddable', '', count(*) FROM page_docs WHERE kind = 'config'
UNION ALL SELECT 'parse_error', '', count(*) FROM page_docs WHERE parse_error IS NOT NULL
UNION ALL SELECT 'links', '', count(*) FROM links
UNION ALL SELECT 'fingerprint', digest, 1 FROM (WITH {tree_sql(4096, 4, 'page_docs', 'doc_id', "doc_id || '|' || kind || '|' || collection", 'census')}) f""",
)
def _(t):
    return kg.corpus_census(t("page_docs"), t("links"))


@query(
    "g11_place_new", "vectors layout_a",
    """
WITH pos AS (SELECT * FROM layout_a WHERE id % 3 <> 1),
n AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM (
  SELECT a.id AS qid, b.id, round(list_dot_product(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])), 6) AS sim FROM vectors a, vectors b
  WHERE a.id NOT IN (SELECT id FROM pos) AND b.id IN (SELECT id FROM pos)) x)
SELECT qid AS id, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM n JOIN pos USING (id) WHERE rank <= 4 GROUP BY 1""",
)
def _(t):
    out = kg.place_new(t("vectors"), _positions(t).select("id", "x", "y"), 4)
    return out.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _nearest_layout(name: str) -> str:
    return f"""(SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM (
  SELECT a.id AS qid, b.id, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS d FROM {name} a, {name} b WHERE a.id <> b.id) x) y WHERE rank <= 10)"""


@query(
    "g12_layout_stability", "layout_a layout_b",
    f"""
WITH a AS {_nearest_layout('layout_a')}, b AS {_nearest_layout('layout_b')},
j AS (SELECT coalesce(a.qid, b.qid) AS id, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) / count(*) AS jaccard FROM a FULL OUTER JOIN b ON a.qid = b.qid AND a.id = b.id GROUP BY 1)
SELECT round(avg(jaccard), 6) AS jaccard, count(*) AS nodes FROM j""",
)
def _(t):
    return kg.layout_stability(t("layout_a"), t("layout_b"))


@query(
    "g14_filter_nodes", TABLES + " layout_a",
    f"""WITH {NODES} SELECT 'orphans' AS mode, id FROM nodes WHERE degree = 0 AND state = 'placed' AND contains(lower(rel_path), 'e')
UNION ALL SELECT 'failed', id FROM nodes WHERE state = 'failed' AND contains(lower(rel_path), 'e')
UNION ALL SELECT 'unplaced', id FROM nodes WHERE id % 5 = 0 AND id IN (SELECT id FROM layout_a WHERE id % 3 <> 1) AND contains(lower(rel_path), 'e')""",
)
def _(t):
    nodes = _nodes(t, _edges(t))
    parts = [
        kg.filter_nodes(nodes, _positions(t), mode, " E ").select(F.lit(mode).alias("mode"), "id")
        for mode in ("orphans", "failed", "unplaced")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
