"""Registered queries: search, fusion and citation."""

from pyspark.sql import functions as F

from loreworks.functions import text as tx
from loreworks.operators import corpus, knn, lexical
from loreworks.operators import retrieval as rt
from loreworks.operators.scale import contains_join
from loreworks.plans.corpus_queries import CAMEL_SQL, WORD_SQL, lex_sql
from loreworks.plans.registry import query

NOW = "2024-01-20T00:00:00Z"
K = 10

# ------------------------------------------------------- shared pieces of the SQL twins

BAGS = f"""bags AS (SELECT doc_id, {lex_sql('text')} AS bag FROM docs),
tf AS (SELECT term, doc_id, any_value(len) AS len, count(*) AS tf FROM (
  SELECT doc_id, len(bag) AS len, unnest(bag) AS term FROM bags) t GROUP BY term, doc_id),
st AS (SELECT count(*) AS n, avg(len(bag)) AS avg_len FROM bags),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
ALL_TERMS = f"qt AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest({lex_sql('text')}) AS term FROM questions) x)"
PLAIN_TERMS = (
    f"pt AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(list_transform(regexp_extract_all(text, '{WORD_SQL}'),"
    " lambda t: lower(t))) AS term FROM questions) x WHERE length(term) > 2)"
)


def scores(terms: str, out: str) -> str:
    return f"""{out} AS (SELECT qid, doc_id AS id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
FROM (SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM {terms} JOIN tf USING (term) JOIN dfs USING (term), st GROUP BY qid, doc_id HAVING sum(1) > 0) s WHERE score > 0)"""


def gate(terms: str = "pt") -> str:
    return f"""judged AS (SELECT qid, term, df, df < greatest(5.0, n * 0.10) AS kept FROM {terms} JOIN dfs USING (term), st),
opened AS (SELECT qid FROM judged GROUP BY qid HAVING count(*) FILTER (kept) > 0 AND count(*) FILTER (kept) / count(*) >= 0.40),
gt AS (SELECT qid, term FROM judged WHERE kept AND qid IN (SELECT qid FROM opened))"""


def nearest(queries: str, out: str, k: int = 30, where: str = "TRUE") -> str:
    return f"""{out} AS (SELECT * FROM (SELECT qid, id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM (
  SELECT q.qid, v.id, round(list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(v.vec AS DOUBLE[])), 6) AS sim
  FROM {queries} q, vectors v WHERE {where}) s) r WHERE rank <= {k})"""


def fused(parts: list[tuple[str, float]], out: str) -> str:
    union = " UNION ALL ".join(
        f"SELECT qid, id, {w:.1f} / (60 + rank) AS s, {i * 1_000_000} + rank AS p FROM {name}" for i, (name, w) in enumerate(parts)
    )
    return f"{out} AS (SELECT qid, id, round(sum(s), 12) AS score, min(p) AS first_seen FROM ({union}) u GROUP BY qid, id)"


LISTS = f"""{BAGS},
{PLAIN_TERMS},
{gate()},
{scores('gt', 'lexall')},
lex AS (SELECT * FROM lexall WHERE rank <= 30),
{nearest('question_vectors', 'dense')}"""
BOOSTED = f"""{LISTS},
{fused([('dense', 1.0), ('lex', 0.5)], 'fused')},
boosted AS (SELECT f.qid, f.id, f.first_seen, h.*, round(f.score
   * CASE WHEN h.project = q.project THEN 1.30 ELSE 1.0 END
   * CASE WHEN h.anchor <> '' AND contains(lower(q.text), lower(h.anchor)) THEN 1.20 ELSE 1.0 END
   * CASE WHEN floor(date_diff('second', try_cast(h.indexed_at AS TIMESTAMPTZ), TIMESTAMPTZ '{NOW}') / 86400) <= 7 THEN 1.15 ELSE 1.0 END, 12) AS score
  FROM fused f JOIN hit_docs h ON h.chunk_id = f.id JOIN questions q ON q.qid = f.qid)"""
HITS = f"""{BOOSTED},
per AS (SELECT *, row_number() OVER (PARTITION BY qid, rel_path ORDER BY score DESC, first_seen, id) AS pf FROM boosted),
hits AS (SELECT * EXCLUDE (rank0), rank0 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_seen, id) AS rank0
  FROM per WHERE pf <= 3) h WHERE rank0 <= 8)"""
HIT_TABLES = "docs hit_docs questions question_vectors vectors"

# ------------------------------------------------------------------------- Spark pieces


def _chunks(t):
    return t("docs").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", "collection", "project")


def _now():
    return F.to_timestamp(F.lit(NOW))


def _index(t):
    docs = _chunks(t)
    return rt.replace(
        _hit_tables(t),
        census=corpus.script_census(docs),
        hits=lexical.term_hits(docs, lexical.question_terms(t("questions"))),
    )


def _hit_tables(t):
    h = t("hit_docs")
    return rt.Index(
        chunks=h.select("chunk_id", "doc_id", "anchor", "text", "collection", "project"),
        vectors=t("vectors"),
        documents=h.select("doc_id", "rel_path", "abs_path", "provenance", "indexed_at"),
        census=None,
        hits=None,
    )


def _gated(t, index):
    return lexical.gate_terms(t("questions"), index.hits.df, index.census)


def _dense(t):
    return knn.knn_topk(t("question_vectors"), t("vectors"), rt.CANDIDATES)


def _lists(t):
    index = _index(t)
    return index, rt.lexical_list(_gated(t, index), index), _dense(t)


def _hits(t):
    index, words, dense = _lists(t)
    return rt.fuse_and_select(dense, words, t("questions"), index, _now())


@query(
    "q01_lex_tokens", "docs",
    f"SELECT doc_id, CAST(len(b) AS BIGINT) AS n, sha256(array_to_string(b, ' ')) AS digest FROM (SELECT doc_id, {lex_sql('text')} AS b FROM docs) x",
)
def _(t):
    return t("docs").select("doc_id", tx.lex_tokens(F.col("text")).alias("b")).select(
        "doc_id", F.size("b").cast("long").alias("n"), F.sha2(F.array_join("b", " "), 256).alias("digest")
    )


@query(
    "q02_inverted_index", "docs",
    f"WITH {BAGS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM tf GROUP BY term",
)
def _(t):
    postings, _, _ = lexical.build_postings(_chunks(t))
    return postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf")
    )


@query("q02_corpus_stats", "docs", f"WITH {BAGS} SELECT n, round(avg_len, 6) AS avg_len FROM st")
def _(t):
    return lexical.build_postings(_chunks(t))[2].select("n", F.round("avg_len", 6).alias("avg_len"))


@query(
    "q03_bm25_topk", "docs questions",
    f"WITH {BAGS}, {ALL_TERMS}, {scores('qt', 'lx')} SELECT qid, id AS chunk_id, score, rank FROM lx WHERE rank <= {K}",
)
def _(t):
    return lexical.bm25_topk(t("questions"), _chunks(t), K)


@query(
    "q03_bm25_from_index", "docs questions",
    f"WITH {BAGS}, {ALL_TERMS}, {scores('qt', 'lx')} SELECT qid, id AS chunk_id, score, rank FROM lx WHERE rank <= {K}",
)
def _(t):
    return lexical.bm25_from_index(t("questions"), *lexical.build_postings(_chunks(t)), K)


@query("q04_gate_terms", "docs questions", f"WITH {BAGS}, {PLAIN_TERMS}, {gate()} SELECT * FROM gt")
def _(t):
    return _gated(t, _index(t))


@query(
    "q05_lexical_gate", "docs questions",
    f"WITH {BAGS}, {PLAIN_TERMS}, {gate()} SELECT qid, qid IN (SELECT qid FROM gt) AS open FROM questions",
)
def _(t):
    return lexical.lexical_gate(t("questions"), _gated(t, _index(t)))


@query(
    "q05_answerable_twin", "docs questions",
    f"WITH {BAGS}, {ALL_TERMS}, {gate('qt')} SELECT qid, qid IN (SELECT qid FROM gt) AS open FROM questions",
)
def _(t):
    index = _index(t)
    gated = lexical.gate_terms(t("questions"), index.hits.df, index.census, min_len=1, tokenizer=tx.lex_tokens)
    return lexical.lexical_gate(t("questions"), gated)


@query(
    "q06_prefix_expansion", "foreign_words",
    """
WITH terms AS (SELECT DISTINCT qid, substring(word, 1, 3) AS term FROM foreign_words UNION SELECT qid, 'latin' FROM foreign_words)
SELECT qid, term, word FROM terms JOIN (SELECT DISTINCT word FROM foreign_words) v ON starts_with(word, term)
UNION ALL SELECT qid, term, term FROM terms WHERE term = 'latin'""",
)
def _(t):
    w = t("foreign_words")
    terms = w.select("qid", F.substring("word", 1, 3).alias("term")).unionByName(
        w.select("qid", F.lit("latin").alias("term"))
    ).distinct()
    return lexical.expand_prefixes(terms, w)


@query(
    "q07_identifier_search", "docs",
    f"""
SELECT doc_id AS chunk_id, CAST(len(list_distinct({lex_sql('s')})) AS BIGINT) AS terms FROM (
  SELECT doc_id, text || ' ' || collection || ' ' || array_to_string(list_distinct(flatten(list_transform(
    regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: CASE WHEN len({CAMEL_SQL}) > 1 THEN list_concat([w], {CAMEL_SQL}) ELSE [] END))), ' ') AS s FROM docs) x""",
)
def _(t):
    s = lexical.searchable_text(_chunks(t).withColumn("anchor", F.col("collection")))
    return s.select("chunk_id", F.size(F.array_distinct(tx.lex_tokens(F.col("searchable")))).cast("long").alias("terms"))


SEARCHABLE = f"""(SELECT doc_id, text || ' ' || collection || ' ' || array_to_string(list_distinct(flatten(list_transform(
    regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: CASE WHEN len({CAMEL_SQL}) > 1 THEN list_concat([w], {CAMEL_SQL}) ELSE [] END))), ' ') AS text FROM docs)"""


@query(
    "q07_identifier_ranked", "docs questions",
    f"WITH {BAGS.replace('FROM docs)', f'FROM {SEARCHABLE} d)', 1)}, {ALL_TERMS}, {scores('qt', 'lx')} SELECT qid, id AS chunk_id, score, rank FROM lx WHERE rank <= {K}",
)
def _(t):
    return lexical.identifier_search(t("questions"), _chunks(t).withColumn("anchor", F.col("collection")), K)


@query(
    "q08_knn_topk", "vectors",
    f"WITH {nearest('(SELECT id AS qid, vec FROM vectors)', 'nn', K, 'q.qid <> v.id')} SELECT * FROM nn",
)
def _(t):
    v = t("vectors")
    return knn.knn_topk(v.select(F.col("id").alias("qid"), "vec"), v, K, skip_self=True)


@query(
    "q08_knn_blocked", "vectors",
    f"WITH {nearest('(SELECT id AS qid, vec FROM vectors)', 'nn', K, 'q.qid <> v.id')} SELECT * FROM nn",
)
def _(t):
    v = t("vectors")
    return knn.knn_topk(v.select(F.col("id").alias("qid"), "vec"), v, K, skip_self=True, small=0, block=256)


# vectors of other lengths, and some zeros: products, not angles, decide
UNEVEN = "uneven AS (SELECT id, list_transform(vec, lambda x: x * (id % 5)) AS vec FROM vectors)"
UNEVEN_SQL = f"WITH {UNEVEN}, {nearest('(SELECT id AS qid, vec FROM uneven)', 'nn', K, 'q.qid <> v.id').replace('vectors', 'uneven')} SELECT * FROM nn"


def _uneven(t):
    times = F.transform("vec", lambda x: (x * (F.col("id") % 5)).cast("float"))
    return t("vectors").select("id", times.alias("vec"))


@query("q08_knn_uneven", "vectors", UNEVEN_SQL)
def _(t):
    v = _uneven(t)
    return knn.knn_topk(v.select(F.col("id").alias("qid"), "vec"), v, K, skip_self=True)


@query("q08_knn_uneven_blocked", "vectors", UNEVEN_SQL)
def _(t):
    v = _uneven(t)
    return knn.knn_topk(v.select(F.col("id").alias("qid"), "vec"), v, K, skip_self=True, small=0, block=256)


@query(
    "q09_hydrate", HIT_TABLES,
    f"WITH {LISTS} SELECT qid, id, rel_path, provenance, anchor FROM dense JOIN hit_docs h ON h.chunk_id = id",
)
def _(t):
    index, dense = _hit_tables(t), _dense(t)
    return rt.hydrate(dense, index.chunks, index.documents).select("qid", "id", "rel_path", "provenance", "anchor")


@query(
    "q10_weighted_rrf", HIT_TABLES,
    f"WITH {LISTS}, {fused([('dense', 1.0), ('lex', 0.5)], 'f')} SELECT qid, id, score FROM f",
)
def _(t):
    _, words, dense = _lists(t)
    return rt.rrf([(dense, 1.0), (words, 0.5), (words, 0.0)]).select("qid", "id", "score")


ALLLEX = f"{BAGS}, {PLAIN_TERMS}, {gate()}, {ALL_TERMS}, {scores('qt', 'lexall')}, lex AS (SELECT * FROM lexall WHERE rank <= 30), {nearest('question_vectors', 'dense')}"


@query(
    "q11_gated_fusion", HIT_TABLES,
    f"""WITH {ALLLEX}, adm AS (SELECT * FROM lex WHERE qid IN (SELECT qid FROM gt)), {fused([('dense', 1.0), ('adm', 0.5)], 'f')}
SELECT qid, id, score, CASE WHEN qid IN (SELECT qid FROM adm) THEN 'hybrid' ELSE 'dense' END AS strategy FROM f""",
)
def _(t):
    index, dense = _index(t), _dense(t)
    words = rt.lexical_list(lexical.question_terms(t("questions")), index)
    opened = lexical.lexical_gate(t("questions"), _gated(t, index))
    out = rt.gated_fusion(dense, words, opened).select("qid", "id", "score")
    return out.join(rt.strategies(t("questions"), rt.admit(words, opened)), "qid")


@query(
    "q12_second_probe", HIT_TABLES + " probe_vectors",
    f"""WITH {nearest('question_vectors', 'dense')},
usable AS (SELECT qid FROM questions WHERE trim(text) <> '' AND length(trim(text)) <= 400),
{nearest('(SELECT * FROM probe_vectors WHERE qid IN (SELECT qid FROM usable))', 'probe')},
{fused([('dense', 1.0), ('probe', 1.0)], 'f')}
SELECT qid, id, score, qid IN (SELECT qid FROM probe) AS translated FROM f""",
)
def _(t):
    usable = t("questions").where(rt.usable_translation(F.col("text"))).select("qid")
    probes = t("probe_vectors").join(usable, "qid", "left_semi")
    dense = _dense(t)
    extra = knn.knn_topk(probes, t("vectors"), rt.CANDIDATES)
    hit = extra.select("qid").distinct().withColumn("_t", F.lit(True))
    return rt.rrf([(dense, 1.0), (extra, 1.0)]).join(hit, "qid", "left").select(
        "qid", "id", "score", F.coalesce("_t", F.lit(False)).alias("translated")
    )


def _arm(name: str, parts: list[tuple[str, float]]) -> str:
    return (
        f"{fused(parts, 'f_' + name)}, r_{name} AS (SELECT '{name}' AS arm, qid, id, rank FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f_{name}) x WHERE rank <= 60)"
    )


ARMS = f"""{ALLLEX}, adm AS (SELECT * FROM lex WHERE qid IN (SELECT qid FROM gt)), {nearest('probe_vectors', 'probe')},
{_arm('rrf', [('dense', 1.0), ('lex', 1.0)])}, {_arm('rrf_w2', [('dense', 2.0), ('lex', 1.0)])},
{_arm('gated', [('dense', 1.0), ('adm', 1.0)])}, {_arm('gated_w2', [('dense', 1.0), ('adm', 0.5)])},
{_arm('dense_xl', [('dense', 1.0), ('probe', 1.0)])},
arms AS (SELECT 'dense' AS arm, qid, id, rank FROM dense UNION ALL SELECT 'lexical', qid, id, rank FROM lex
  UNION ALL SELECT * FROM r_rrf UNION ALL SELECT * FROM r_rrf_w2 UNION ALL SELECT * FROM r_gated
  UNION ALL SELECT * FROM r_gated_w2 UNION ALL SELECT * FROM r_dense_xl)"""
ARM_TABLES = HIT_TABLES + " probe_vectors"


def arms(t):
    index, dense = _index(t), _dense(t)
    words = rt.lexical_list(lexical.question_terms(t("questions")), index)
    opened = lexical.lexical_gate(t("questions"), _gated(t, index))
    probe = knn.knn_topk(t("probe_vectors"), t("vectors"), rt.CANDIDATES)
    return rt.fusion_arms(dense, words, opened, {"dense_xl": probe})


@query("q13_fusion_arms", ARM_TABLES, f"WITH {ARMS} SELECT * FROM arms")
def _(t):
    return arms(t)


@query("q14_boosts", HIT_TABLES, f"WITH {BOOSTED} SELECT qid, id, score FROM boosted")
def _(t):
    index, words, dense = _lists(t)
    hits = rt.hydrate(rt.rrf([(dense, 1.0), (words, 0.5)]), index.chunks, index.documents)
    return rt.boost(hits, t("questions"), _now()).select("qid", "id", "score")


@query(
    "q15_diversify", HIT_TABLES,
    f"""WITH {LISTS}, d AS (SELECT qid, id, sim AS score, rel_path, row_number() OVER (PARTITION BY qid, rel_path ORDER BY sim DESC, id) AS pf
  FROM dense JOIN hit_docs h ON h.chunk_id = id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM d WHERE pf <= 3)
SELECT qid, id, rel_path, rank FROM r WHERE rank <= 8""",
)
def _(t):
    index, dense = _hit_tables(t), _dense(t)
    hits = rt.hydrate(dense.select("qid", "id", F.col("sim").alias("score")), index.chunks, index.documents)
    return rt.diversify(hits).select("qid", "id", "rel_path", "rank")


@query("q16_hybrid_retrieval", HIT_TABLES, f"WITH {HITS} SELECT qid, id, rank, score, rel_path FROM hits")
def _(t):
    return _hits(t).select("qid", "id", "rank", "score", "rel_path")


@query("q16_retrieve_embedded")
def _(t):
    embed = corpus.hashing_embedder()
    docs = t("hit_docs").select(F.sha2("text", 256).alias("text_hash"), "text", "chunk_id", "collection", "project")
    vectors, _, _ = corpus.embed_with_cache(
        docs, t("cache_rows").limit(0).withColumn("vec", F.array().cast("array<float>")), embed
    )
    index = rt.replace(
        _index(t),
        vectors=vectors.withColumnRenamed("chunk_id", "id").join(
            docs.select(F.col("chunk_id").alias("id"), "collection", "project"), "id"
        ),
    )
    return rt.retrieve(t("questions"), index, _now(), embed).select("qid", "id", "rank", "score", "strategy")


@query(
    "q17_taint", HIT_TABLES,
    f"WITH {HITS} SELECT qid, bool_or(provenance <> 'local_owned') AS tainted FROM hits GROUP BY qid",
)
def _(t):
    return rt.taint(_hits(t))


@query(
    "q18_lexical_only", "docs questions",
    f"""WITH {BAGS}, {ALL_TERMS}, q2 AS (SELECT * FROM qt WHERE length(term) >= 2), {scores('q2', 'lx')}
SELECT qid, id AS chunk_id, score, rank, 'lexical' AS strategy, true AS degraded FROM lx WHERE rank <= 8""",
)
def _(t):
    return lexical.lexical_only(t("questions"), _chunks(t), 8)


@query(
    "q18_lexical_scoped", "docs questions",
    f"""WITH {BAGS}, {ALL_TERMS}, q2 AS (SELECT * FROM qt WHERE length(term) >= 2), {scores('q2', 'lx')},
s AS (SELECT lx.* EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM lx JOIN docs ON doc_id = id WHERE collection = 'en' AND project = 'src3')
SELECT qid, id AS chunk_id, score, rank, 'lexical' AS strategy, true AS degraded FROM s WHERE rank <= 8""",
)
def _(t):
    return lexical.lexical_only(t("questions"), _chunks(t), 8, collection="en", project="src3")


@query(
    "q19_citations", HIT_TABLES,
    f"""WITH {HITS} SELECT qid, rank, id AS chunk_id, collection, project, rel_path AS path, abs_path, anchor,
  round_even(score, 4) AS score, provenance, indexed_at,
  CASE WHEN length(text) <= 600 THEN text ELSE substring(text, 1, 600) || '…' END AS text FROM hits""",
)
def _(t):
    return rt.citations(_hits(t))


@query(
    "q20_context_block", HIT_TABLES,
    f"""WITH {HITS},
b AS (SELECT qid, rank, provenance, '[' || CAST(rank AS VARCHAR) || '] ' || project || ' / ' || rel_path ||
  CASE WHEN anchor <> '' THEN ' / ' || anchor ELSE '' END || chr(10) || text AS block FROM hits),
f AS (SELECT *, sum(length(block)) OVER (PARTITION BY qid ORDER BY rank) <= 6000 AS fits FROM b)
SELECT qid, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY rank) FILTER (fits), '') AS context, NOT bool_and(fits) AS truncated,
  coalesce(bool_or(fits AND provenance <> 'local_owned'), false) AS tainted, count(*) FILTER (fits) AS n FROM f GROUP BY qid""",
)
def _(t):
    return rt.context_block(_hits(t), 6000)


@query(
    "q21_scoped_search", HIT_TABLES,
    f"WITH {nearest('question_vectors', 'dense', 10, chr(118) + '.collection = ' + chr(39) + 'c3' + chr(39))} SELECT qid, id, sim, rank FROM dense",
)
def _(t):
    scope = rt.scoped(_hit_tables(t), collection="c3")
    return knn.knn_topk(t("question_vectors"), scope.vectors, 10)


@query(
    "q22_global_search", "search_queries projects tasks log",
    """
WITH q AS (SELECT qid, lower(q) AS q FROM search_queries WHERE length(q) >= 2),
src AS (
  SELECT 'projects' AS grp, project_id AS id, name AS label, project_id AS sort, lower(name || chr(10) || description) AS txt FROM projects
  UNION ALL SELECT 'tasks', id, status, id, lower(CAST(id AS VARCHAR) || chr(10) || status || chr(10) ||
     coalesce(regexp_extract(spec, '"objective":"([^"]*)"', 1), '')) FROM tasks
  UNION ALL SELECT 'events', seq, type, seq, lower(type || chr(10) || payload) FROM log),
m AS (SELECT qid, grp, id, label, row_number() OVER (PARTITION BY qid, grp ORDER BY sort DESC, id) AS rank FROM q, src WHERE contains(txt, q))
SELECT qid, grp AS "group", rank, CAST(id AS VARCHAR) AS id, label AS text FROM m WHERE rank <= 8""",
)
def _(t):
    nl = F.lit("\n")
    objective = F.get_json_object("spec", "$.objective")
    p, k, e = t("projects"), t("tasks"), t("log")
    return rt.global_search(
        t("search_queries"),
        {
            "projects": p.select(F.col("project_id").alias("id"), F.concat("name", nl, "description").alias("text"), F.col("name").alias("label"), F.col("project_id").alias("sort")),
            "tasks": k.select("id", F.concat(F.col("id").cast("string"), nl, "status", nl, F.coalesce(objective, F.lit(""))).alias("text"), F.col("status").alias("label"), F.col("id").alias("sort")),
            "events": e.select(F.col("seq").alias("id"), F.concat("type", nl, "payload").alias("text"), F.col("type").alias("label"), F.col("seq").alias("sort")),
        },
    )


@query(
    "q23_fit_excerpts", "excerpts",
    """
SELECT request, id, sum(tokens) OVER (PARTITION BY request ORDER BY priority DESC, position, id ROWS UNBOUNDED PRECEDING) + base_tokens <= 120 AS kept,
  base_tokens > 120 AS over_budget FROM excerpts""",
)
def _(t):
    return rt.fit_excerpts(t("excerpts"), 120)


@query(
    "q24_untrusted_sources", HIT_TABLES,
    f"""WITH {HITS} SELECT qid, string_agg(rel_path, ' ' ORDER BY r) AS sources FROM (
  SELECT qid, rel_path, min(rank) AS r FROM hits WHERE provenance <> 'local_owned' GROUP BY qid, rel_path) x GROUP BY qid""",
)
def _(t):
    return rt.untrusted_sources(_hits(t)).select("qid", F.array_join("sources", " ").alias("sources"))


# more needles than are shipped at once: words of the benchmark in whole documents
@query(
    "q22_contains_many", "",
    """
WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS word FROM benchmark) x WHERE word <> '')
SELECT word, count(*) AS documents FROM w JOIN documents d ON contains(d.text, word) GROUP BY 1""",
)
def _(t):
    words = t("benchmark").select(F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''").distinct()
    found = contains_join(t("documents").select("doc_id", "text"), words, "text", "word")
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("documents"))
