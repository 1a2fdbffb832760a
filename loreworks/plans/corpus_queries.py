"""Registered queries: corpus preparation and the index."""

import uuid

from pyspark.sql import functions as F

from loreworks.functions import text as tx
from loreworks.functions.vectors import truncate_normalise
from loreworks.operators import chunking, corpus
from loreworks.plans.registry import query
from loreworks.session import shared_dir

CAMEL_SQL = (
    r"regexp_extract_all(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'),"
    r" '[A-Z][a-z][a-z0-9]*|[A-Z]+|[a-z0-9]+')"
)
WORD_SQL = r"[A-Za-z0-9_]+|[\x{0400}-\x{04FF}]+"


def lex_sql(text: str) -> str:
    """Bag of words of ``text`` for the twins: words, camel parts, snake parts."""
    return (
        f"list_transform(flatten(list_transform(regexp_extract_all({text}, '{WORD_SQL}'), lambda w: "
        f"list_concat(list_concat([w], CASE WHEN len({CAMEL_SQL}) > 1 THEN {CAMEL_SQL} ELSE [] END), "
        "CASE WHEN contains(w, '_') THEN list_filter(string_split(w, '_'), lambda p: p <> '') ELSE [] END))), "
        "lambda t: lower(t))"
    )


@query("c01_content_hash", "docs", "SELECT doc_id, sha256(text) AS content_hash FROM docs")
def _(t):
    return t("docs").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


@query(
    "c02_chunk_id", "chunks",
    "SELECT chunk_id, sha256(rel_path || CAST(ordinal AS VARCHAR) || text) AS digest FROM chunks",
)
def _(t):
    return t("chunks").select(
        "chunk_id", tx.chunk_id(F.col("rel_path"), F.col("ordinal"), F.col("text")).alias("digest")
    )


@query("c03_document_id", "docs", "SELECT doc_id, collection || '/' || rel_path AS document FROM docs")
def _(t):
    return t("docs").select("doc_id", tx.document_id(F.col("collection"), F.col("rel_path")).alias("document"))


@query(
    "c04_provenance", "docs",
    """
SELECT doc_id, CASE WHEN kind = 'pdf' OR rel_path LIKE '%/AGENTS.md' AND project <> 'src3'
    OR rel_path LIKE '%/vendor/%' THEN 'local_foreign' ELSE 'local_owned' END AS provenance FROM docs""",
)
def _(t):
    return t("docs").select(
        "doc_id",
        tx.provenance(F.col("rel_path"), F.col("kind"), F.col("project"), "src3").alias("provenance"),
    )


@query(
    "c05_identifiers", "docs",
    f"""
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n, array_to_string(list_sort(ids), ' ') AS idents FROM (
  SELECT doc_id, list_distinct(flatten(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'),
    lambda w: CASE WHEN len({CAMEL_SQL}) > 1 THEN list_concat([w], {CAMEL_SQL}) ELSE [] END))) AS ids FROM docs) d""",
)
def _(t):
    ids = tx.identifiers(F.col("text"))
    return t("docs").select("doc_id", ids.alias("ids")).select(
        "doc_id", F.size("ids").cast("long").alias("n"), F.array_join(F.array_sort("ids"), " ").alias("idents")
    )


@query(
    "c06_approx_tokens", "chunks",
    "SELECT chunk_id, greatest(1, CAST(round_even(length(text) / 3.6, 0) AS BIGINT)) AS tokens FROM chunks",
)
def _(t):
    return t("chunks").select("chunk_id", tx.approx_tokens(F.col("text")).alias("tokens"))


EST_SQL = r"""CASE WHEN length(text) = 0 THEN 0 ELSE greatest(
  CAST(floor(cyr / 1.9 + cjk / 1.0 + lat / 3.3 + (length(text) - cyr - cjk - lat) / 2.4) AS BIGINT) + 1,
  CAST(len(regexp_extract_all(text, '[^\s\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+')) AS BIGINT)) END"""
EST_PARTS_SQL = r"""
  length(text) - length(regexp_replace(text, '[\x{0400}-\x{052F}]', '', 'g')) AS cyr,
  length(text) - length(regexp_replace(text, '[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]', '', 'g')) AS cjk,
  length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS lat"""


@query(
    "c07_estimate_tokens", "chunks",
    f"SELECT chunk_id, {EST_SQL} AS tokens FROM (SELECT chunk_id, text, {EST_PARTS_SQL} FROM chunks) c",
)
def _(t):
    return t("chunks").select("chunk_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "c08_markdown_sections", "notes",
    r"""
WITH body AS (
  SELECT doc_id, 'note' || CAST(doc_id AS VARCHAR) AS title,
    CASE WHEN starts_with(text, '---' || chr(10)) THEN substring(text, strpos(substring(text, 5), chr(10) || '---') + 8) ELSE text END AS text
  FROM notes),
lines AS (SELECT doc_id, title, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS no FROM body),
marked AS (SELECT *, length(regexp_extract(line, '^(#{1,6})\s+(.*)', 1)) AS level FROM lines),
heads AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS j FROM marked WHERE level > 0),
depths AS (SELECT *, j - 1 + least(min(level - (j - 1)) OVER (PARTITION BY doc_id ORDER BY no), 1) AS depth FROM heads),
paths AS (SELECT doc_id, no, concat_ws(' > ',
    last_value(CASE WHEN depth = 1 THEN t END IGNORE NULLS) OVER w,
    CASE WHEN depth >= 2 THEN last_value(CASE WHEN depth = 2 THEN t END IGNORE NULLS) OVER w END,
    CASE WHEN depth >= 3 THEN last_value(CASE WHEN depth = 3 THEN t END IGNORE NULLS) OVER w END,
    CASE WHEN depth >= 4 THEN last_value(CASE WHEN depth = 4 THEN t END IGNORE NULLS) OVER w END) AS path
  FROM (SELECT *, trim(regexp_extract(line, '^(#{1,6})\s+(.*)', 2)) AS t FROM depths) d
  WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
placed AS (SELECT m.*, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY m.doc_id ORDER BY m.no) AS run, p.path
  FROM marked m LEFT JOIN paths p ON p.doc_id = m.doc_id AND p.no = m.no),
secs AS (SELECT doc_id, run, coalesce(max(path), max(title)) AS heading_path,
    string_agg(CASE WHEN level = 0 THEN line END, chr(10) ORDER BY no) AS body,
    count(CASE WHEN level = 0 THEN 1 END) AS n FROM placed GROUP BY doc_id, run)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) AS section_no, heading_path, body FROM secs WHERE n > 0""",
)
def _(t):
    return chunking.markdown_sections(t("notes"))


@query(
    "c09_code_sections", "code_docs",
    r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS no FROM code_docs),
sym AS (SELECT doc_id, no, line,
    regexp_extract(line, '^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:(?:abstract\s+)?class|interface|type|enum|function|const|let|var|def|fn|impl|struct|trait|pub\s+fn|pub\s+struct)\s+([A-Za-z_$][\w$]*)', 1) AS d,
    regexp_extract(line, '^\s{2,6}(?:public|private|protected|static|async|readonly|\s)*([A-Za-z_$][\w$]*)\s*\(', 1) AS m,
    rtrim(string_split(string_split(line, '//')[1], '#')[1]) AS code FROM lines),
marked AS (SELECT *, CASE WHEN d <> '' THEN d WHEN m <> '' AND m NOT IN ('if','for','while','switch','catch','return','do','else','elif','with','match','case','try','except','finally','await','yield','throw','new','typeof','delete','in','of','and','or','not')
    AND regexp_matches(code, '(\{|:|\(|=>|->|,)$') THEN m END AS symbol FROM sym),
runs AS (SELECT *, sum(CASE WHEN symbol IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS run FROM marked),
blocks AS (SELECT doc_id, run, coalesce(max(symbol), '(file)') AS symbol, string_agg(line, chr(10) ORDER BY no) AS body FROM runs GROUP BY doc_id, run)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) AS block_no, symbol, body FROM blocks""",
)
def _(t):
    return chunking.code_sections(t("code_docs"))


@query(
    "c10_page_sections", "page_text",
    r"""
SELECT doc_id, page_no, body FROM (
  SELECT doc_id, unnest(string_split(text, chr(12))) AS body,
    CAST(generate_subscripts(string_split(text, chr(12)), 1) AS BIGINT) AS page_no FROM page_text) p
WHERE regexp_matches(body, '\S')""",
)
def _(t):
    return chunking.page_sections(t("page_text"))


def _digest(df, keys=("doc_id", "ordinal")):
    return df.select(
        *keys, "anchor", F.char_length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("digest")
    )


@query("c11_pack_blocks")
def _(t):
    docs = t("code_docs").select(
        "doc_id",
        chunking.code_blocks(F.col("text")).alias("blocks"),
        F.concat_ws("", "project", F.lit(" / "), "rel_path", F.lit("\n\n")).alias("header"),
    )
    return _digest(chunking.pack_sections(docs))


@query("c12_window_text")
def _(t):
    docs = t("docs").select("doc_id", F.concat_ws("", "rel_path", F.lit("\n\n")).alias("prefix"), "text")
    return _digest(chunking.window_text(docs))


@query("c13_chunk_documents")
def _(t):
    made = chunking.chunk_documents(t("docs").unionByName(t("notes"), allowMissingColumns=True))
    return made.groupBy("kind", "collection").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum(F.char_length("text")).alias("chars"),
        F.max(F.char_length("text")).alias("longest"),
        F.countDistinct("chunk_id").alias("distinct_ids"),
    )


@query(
    "c14_extract_links", "",
    """
SELECT page_id, CAST(len(l) AS BIGINT) AS n, array_to_string(list_sort(l), ' ') AS targets FROM (
  SELECT page_id, list_distinct(list_transform(regexp_extract_all(html, 'href="([^"#?]*)', 1), lambda x: trim(x))) AS l FROM pages) p""",
)
def _(t):
    found = tx.link_targets(F.col("html"), r'href="([^"#?]*)')
    return t("pages").select("page_id", found.alias("l")).select(
        "page_id", F.size("l").cast("long").alias("n"), F.array_join(F.array_sort("l"), " ").alias("targets")
    )


@query(
    "c15_extract_tags", "notes",
    r"""
SELECT doc_id, CAST(len(l) AS BIGINT) AS n, array_to_string(list_sort(l), ' ') AS tags FROM (
  SELECT doc_id, list_distinct(list_concat(
    CASE WHEN doc_id % 3 = 0 THEN [collection, 'all', 'type:' || project] ELSE [] END,
    regexp_extract_all(CASE WHEN doc_id % 3 = 0 THEN substring(text, strpos(substring(text, 5), chr(10) || '---') + 8) ELSE text END,
      '(?:^|\s)#([A-Za-z][\w/-]*)', 1))) AS l FROM notes) x""",
)
def _(t):
    tags = chunking.extract_tags(t("notes"))
    return tags.select(
        "doc_id", F.size("tags").cast("long").alias("n"), F.array_join(F.array_sort("tags"), " ").alias("tags")
    )


DIFF_SQL = """
SELECT coalesce(c.collection, k.collection) AS collection, coalesce(c.rel_path, k.rel_path) AS rel_path,
  CASE WHEN k.content_hash IS NULL THEN 'new' WHEN c.text IS NULL THEN 'removed'
       WHEN sha256(c.text) = k.content_hash THEN 'unchanged' ELSE 'changed' END AS action
FROM docs c FULL OUTER JOIN known_docs k ON c.collection = k.collection AND c.rel_path = k.rel_path"""


def _actions(t):
    current = t("docs").select("collection", "rel_path", tx.content_hash(F.col("text")).alias("content_hash"))
    return corpus.diff_corpus(current, t("known_docs"))


@query("c16_incremental_diff", "docs known_docs", DIFF_SQL)
def _(t):
    return _actions(t)


@query(
    "c17_cascade_delete", "chunks",
    """
SELECT 'chunks' AS derived, count(*) AS kept, CAST(sum(length(text)) AS BIGINT) AS chars FROM chunks
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'vectors', count(*), NULL FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def _(t):
    removed = t("labels").where("toxic = 1").select("doc_id")
    chunks, vectors = corpus.cascade_delete(
        removed, t("chunks"), t("embeddings").select(F.col("vec_id").alias("doc_id"))
    )
    return chunks.agg(
        F.lit("chunks").alias("derived"), F.count(F.lit(1)).alias("kept"), F.sum(F.char_length("text")).alias("chars")
    ).unionByName(
        vectors.agg(
            F.lit("vectors").alias("derived"), F.count(F.lit(1)).alias("kept"), F.lit(None).cast("long").alias("chars")
        )
    )


@query(
    "c17_prune", "chunks known_docs",
    "SELECT collection, count(*) AS kept FROM chunks WHERE doc_id IN (SELECT doc_id FROM known_docs) GROUP BY collection",
)
def _(t):
    return corpus.prune(t("chunks"), t("known_docs")).groupBy("collection").agg(F.count(F.lit(1)).alias("kept"))


def _hashed(t):
    return t("chunks").withColumn("text_hash", F.sha2("text", 256))


@query(
    "c18_cache_hits", "chunks cache_rows",
    """
SELECT count(*) AS chunks, count(r.text_hash) AS cached, count(*) - count(r.text_hash) AS embedded
FROM chunks c LEFT JOIN cache_rows r ON r.text_hash = sha256(c.text)""",
)
def _(t):
    return corpus.cache_stats(_hashed(t), t("cache_rows"))


@query("c18_embed_with_cache")
def _(t):
    cache = corpus.embed_with_cache(
        _hashed(t).where("kind = 'markdown'"), t("cache_rows").limit(0).withColumn("vec", F.array().cast("array<float>"))
    )[1]
    vectors, _, _ = corpus.embed_with_cache(_hashed(t), cache)
    return vectors.select("chunk_id", F.size("vec").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


def sizes(frames):
    """A stand-in for a model that SQL can compute: characters, and those before the first space."""
    for pdf in frames:
        pdf["vec"] = [[float(len(x)), float(len(x.split(" ")[0]))] for x in pdf["text"]]
        yield pdf[["text_hash", "vec"]]


@query(
    "c18_embed_missing", "chunks",
    """
WITH c AS (SELECT sha256(text) AS text_hash FROM chunks WHERE kind = 'markdown')
SELECT chunk_id, CASE WHEN sha256(text) IN (SELECT text_hash FROM c) THEN -1.0 ELSE length(text)::DOUBLE END AS size,
  CASE WHEN sha256(text) IN (SELECT text_hash FROM c) THEN -2.0 ELSE length(string_split(text, ' ')[1])::DOUBLE END AS head FROM chunks""",
)
def _(t):
    stored = F.array(F.lit(-1.0), F.lit(-2.0)).cast("array<float>")  # tells cached vectors from those that were made
    cache = _hashed(t).where("kind = 'markdown'").select("text_hash", stored.alias("vec")).distinct()
    vectors, _, _ = corpus.embed_with_cache(_hashed(t), cache, sizes)
    return vectors.select("chunk_id", F.col("vec")[0].cast("double").alias("size"), F.col("vec")[1].cast("double").alias("head"))


@query(
    "c19_warm_cache", "chunks cache_rows",
    """
SELECT sha256(text) AS text_hash, min(chunk_id) AS vec FROM chunks
WHERE sha256(text) NOT IN (SELECT text_hash FROM cache_rows) GROUP BY 1""",
)
def _(t):
    vectors = t("chunks").select("chunk_id", F.col("chunk_id").alias("vec"))
    return corpus.warm_cache(_hashed(t), vectors, t("cache_rows"))


@query(
    "c20_index_stats", "docs known_docs chunks cache_rows",
    f"""
SELECT a.*, h.*, (SELECT count(*) FROM chunks) AS chunks, h.cached / (h.cached + h.embedded) AS hit_rate FROM (
  SELECT count(*) FILTER (action IN ('new', 'changed')) AS documents, count(*) FILTER (action = 'unchanged') AS unchanged,
    count(*) FILTER (action = 'removed') AS pruned, count(*) FILTER (action = 'failed') AS failed FROM ({DIFF_SQL}) d) a,
 (SELECT count(r.text_hash) AS cached, count(*) - count(r.text_hash) AS embedded
  FROM chunks c LEFT JOIN cache_rows r ON r.text_hash = sha256(c.text)) h""",
)
def _(t):
    return corpus.index_stats(_actions(t), t("chunks"), corpus.cache_stats(_hashed(t), t("cache_rows")))


@query(
    "c21_compatibility", "",
    """
SELECT key, stored, expected FROM (
  SELECT 'documents:' || lang AS key, CAST(count(*) % 2 AS VARCHAR) AS stored, '0' AS expected FROM documents GROUP BY lang) m
WHERE stored <> expected""",
)
def _(t):
    meta = t("documents").groupBy("lang").agg((F.count(F.lit(1)) % 2).cast("string").alias("value")).select(
        F.concat(F.lit("documents:"), "lang").alias("key"), "value"
    )
    return corpus.check_compatible(meta, {f"documents:{x}": "0" for x in ("en", "de", "fr", "es")})


@query(
    "c22_script_census", "chunks",
    r"""
SELECT total, cyrillic, cyrillic * 2 > total AS majority_cyrillic FROM (
  SELECT count(*) AS total, count(*) FILTER (regexp_matches(text, '[\x{0400}-\x{04FF}]')) AS cyrillic FROM chunks) c""",
)
def _(t):
    return corpus.script_census(t("chunks"))


@query(
    "c23_truncate_normalise", "vectors",
    """
SELECT id, CAST(unnest(generate_series(1, 32)) AS BIGINT) AS d,
  round(unnest(list_transform(vec[1:32], lambda v: CAST(v AS DOUBLE) / sqrt(list_sum(list_transform(vec[1:32], lambda u: CAST(u AS DOUBLE) * CAST(u AS DOUBLE)))))), 6) AS v
FROM vectors""",
)
def _(t):
    cut = t("vectors").select("id", F.posexplode(truncate_normalise(F.col("vec"), 32)).alias("d", "v"))
    return cut.select("id", (F.col("d") + 1).cast("long").alias("d"), F.round("v", 6).alias("v"))


@query(
    "c24_pool_vectors", "",
    """
WITH x AS (SELECT vec_id % 100 AS doc_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
m AS (SELECT doc_id, d, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(m * m)) AS len FROM m GROUP BY 1)
SELECT doc_id, CAST(d AS BIGINT) AS d, round(m / len, 6) AS v FROM m JOIN n USING (doc_id)""",
)
def _(t):
    chunk_vectors = t("embeddings").select((F.col("vec_id") % 100).alias("doc_id"), F.col("embedding").alias("vec"))
    pooled = corpus.pool_vectors(chunk_vectors).select("doc_id", F.posexplode("vec").alias("d", "v"))
    return pooled.select("doc_id", (F.col("d") + 1).cast("long").alias("d"), F.round("v", 6).alias("v"))


def tree_sql(fan: int, height: int, table: str = "chunks", node: str = "chunk_id", text: str = "text", key: str = "model") -> str:
    levels = [f"l0 AS (SELECT {node} AS node, CAST(1 AS BIGINT) AS n, sha256({text}) AS h FROM {table})"]
    levels += [
        f"l{i + 1} AS (SELECT CAST(floor(node / {fan}) AS BIGINT) AS node, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, '' ORDER BY l{i}.node)) AS h FROM l{i} GROUP BY 1)"
        for i in range(height)
    ]
    return f"{', '.join(levels)} SELECT sha256('{key}|' || CAST(n AS VARCHAR) || '|' || h) AS digest FROM l{height}"


#: Small runs, so that small tables have several levels too; the ids may be as large as with the defaults (2^48).
TREE = {"fan": 64, "height": 8}


@query("c25_fingerprint", "chunks", f"WITH {tree_sql(**TREE)}")
def _(t):
    return corpus.fingerprint(t("chunks"), "model", order="chunk_id", **TREE)


CHANGED = "CASE WHEN chunk_id % 10 = 3 THEN text || ' changed' ELSE text END"


@query("c25_fingerprint_renewed", "chunks", f"WITH c AS (SELECT chunk_id, {CHANGED} AS text FROM chunks WHERE chunk_id % 100 <> 7), {tree_sql(**TREE, table='c')}")
def _(t):
    tree = corpus.FingerprintTree(t.spark, f"{shared_dir(t.spark)}/trees/{uuid.uuid4().hex}", **TREE)
    tree.build(t("chunks"), "chunk_id")
    changed = t("chunks").where("chunk_id % 10 = 3 and chunk_id % 100 <> 7").withColumn("text", F.concat("text", F.lit(" changed")))
    tree.renew(changed, t("chunks").where("chunk_id % 100 = 7"), "chunk_id")
    return tree.digest("model")


@query(
    "c26_index_health", "docs chunks",
    """
SELECT d.collection, count(*) AS documents, max(indexed_at) AS last_indexed, CAST(sum(size) AS BIGINT) AS bytes,
  count(parse_error) AS failures,
  CAST(coalesce(sum(c.n), 0) AS BIGINT) AS chunks, CAST(coalesce(sum(v.n), 0) AS BIGINT) AS vectors
FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) c USING (doc_id)
LEFT JOIN (SELECT vec_id AS doc_id, 1 AS n FROM embeddings) v USING (doc_id) GROUP BY 1""",
)
def _(t):
    return corpus.index_health(t("docs"), t("chunks"), t("embeddings").select(F.col("vec_id").alias("doc_id")))


REQ_SQL = "SELECT doc_id % 7 AS request, doc_id AS position, doc_id * 3 AS doc_id FROM labels"


def _requests(t):
    return t("labels").select(
        (F.col("doc_id") % 7).alias("request"), F.col("doc_id").alias("position"), (F.col("doc_id") * 3).alias("doc_id")
    )


@query(
    "c27_read_documents", "docs chunks",
    f"""
WITH r AS ({REQ_SQL}),
j AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS txt FROM chunks GROUP BY doc_id)
SELECT request, position, doc_id, substring(coalesce(txt, ''), 1, 2000) AS text, length(coalesce(txt, '')) > 2000 AS truncated
FROM r JOIN docs USING (doc_id) LEFT JOIN (SELECT doc_id, txt FROM j) j2 USING (doc_id)""".replace("SELECT request", "SELECT r.request")
    .replace("r.request, position, doc_id, substring", "r.request, r.position, doc_id, substring"),
)
def _(t):
    return corpus.read_documents(_requests(t), t("docs"), t("chunks"), 2000)[0]


@query("c27_missing_documents", "docs", f"SELECT * FROM ({REQ_SQL}) r WHERE doc_id NOT IN (SELECT doc_id FROM docs)")
def _(t):
    return corpus.read_documents(_requests(t), t("docs"), t("chunks"))[1]
