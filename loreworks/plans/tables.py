"""Tables in the shape the operators expect, derived from the given test tables.

A definition is SQL both engines read alike; where their dialects part, it is a pair
(Spark text, other text).  ``{name}`` marks a table a definition reads.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from loreworks.session import spread

RAW = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# tables whose text is tokenized or parsed: worth dealing over all cores
TEXT_HEAVY = ("documents", "pages")

DEFS: dict[str, str | tuple[str, str]] = {}

# ------------------------------------------------------------------ corpus and retrieval

DEFS["docs"] = """
SELECT doc_id, lang AS collection, source AS project,
  CASE WHEN doc_id % 23 = 0 THEN source || '/p' || CAST(doc_id AS STRING) || '/AGENTS.md'
       WHEN doc_id % 17 = 0 THEN source || '/vendor/d' || CAST(doc_id AS STRING) || '.md'
       ELSE source || '/d' || CAST(doc_id AS STRING) ||
            CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.txt'
                            WHEN 3 THEN '.json' ELSE '.pdf' END
  END AS rel_path,
  CASE WHEN doc_id % 23 = 0 OR doc_id % 17 = 0 THEN 'markdown'
       ELSE CASE doc_id % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'code' WHEN 2 THEN 'text'
                            WHEN 3 THEN 'config' ELSE 'pdf' END
  END AS kind,
  text, n_chars AS size,
  '2024-01-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || 'T00:00:00Z' AS indexed_at,
  CASE WHEN doc_id % 97 = 0 THEN 'unreadable' END AS parse_error
FROM {documents}
"""

DEFS["known_docs"] = """
SELECT doc_id, collection, rel_path,
  CASE WHEN doc_id % 3 = 0 THEN sha2_hex ELSE 'stale' END AS content_hash
FROM (SELECT doc_id + CASE WHEN doc_id % 11 = 0 THEN 1000000000 ELSE 0 END AS doc_id, collection,
        CASE WHEN doc_id % 11 = 0 THEN 'gone/' || rel_path ELSE rel_path END AS rel_path,
        SHA256(text) AS sha2_hex FROM {docs}) k
"""

# an empty text has no chunk; Spark's sequence would count down from 0 to -1
DEFS["chunks"] = (
    """
SELECT doc_id * 1000 + ordinal AS chunk_id, doc_id, collection, project, rel_path, kind, ordinal,
  'part ' || CAST(ordinal AS STRING) AS anchor, substring(text, CAST(ordinal * 800 + 1 AS INT), 800) AS text
FROM {docs} LATERAL VIEW explode(sequence(0L, CAST(floor((char_length(text) - 1) / 800) AS BIGINT))) s AS ordinal
WHERE text <> ''
""",
    """
SELECT doc_id * 1000 + ordinal AS chunk_id, doc_id, collection, project, rel_path, kind, ordinal,
  'part ' || CAST(ordinal AS STRING) AS anchor, substring(text, ordinal * 800 + 1, 800) AS text
FROM (SELECT *, unnest(range(0, CAST(floor((length(text) - 1) / 800) AS BIGINT) + 1)) AS ordinal FROM {docs}) c
""",
)

DEFS["cache_rows"] = """
SELECT DISTINCT SHA256(text) AS text_hash FROM {chunks} WHERE kind = 'markdown'
"""

DEFS["questions"] = """
SELECT item_id AS qid, text, 'src' || CAST(item_id % 20 AS STRING) AS project FROM {benchmark}
"""

DEFS["vectors"] = """
SELECT vec_id AS id, embedding AS vec, 'c' || CAST(label AS STRING) AS collection,
  'p' || CAST(vec_id % 4 AS STRING) AS project FROM {embeddings}
"""

DEFS["question_vectors"] = """
SELECT b.item_id AS qid, e.embedding AS vec FROM {benchmark} b JOIN {embeddings} e ON e.vec_id = b.item_id
"""

DEFS["probe_vectors"] = """
SELECT b.item_id AS qid, e.embedding AS vec FROM {benchmark} b JOIN {embeddings} e ON e.vec_id = b.item_id + 100
"""

DEFS["links"] = (
    """
SELECT page_id AS src, to_path FROM {pages}
LATERAL VIEW explode(array_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) l AS to_path
""",
    """
SELECT page_id AS src, to_path FROM (
  SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS to_path FROM {pages}) l
""",
)

# pages as linkable documents: the path is the visible address without its query and fragment
DEFS["page_docs"] = (
    """
SELECT page_id AS doc_id, CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS collection,
  coalesce(nullif(regexp_extract(html, 'href="/([^"]*)"', 1), ''), 'page') || '.md' AS rel_path,
  CASE WHEN page_id % 7 = 0 THEN 'config' ELSE 'markdown' END AS kind,
  CASE WHEN page_id % 29 = 0 THEN 'broken' END AS parse_error
FROM {pages}
""",
    """
SELECT page_id AS doc_id, CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS collection,
  coalesce(nullif(regexp_extract(html, 'href="/([^"]*)"', 1), ''), 'page') || '.md' AS rel_path,
  CASE WHEN page_id % 7 = 0 THEN 'config' ELSE 'markdown' END AS kind,
  CASE WHEN page_id % 29 = 0 THEN 'broken' END AS parse_error
FROM {pages}
""",
)

# notes: some lines become headings, some notes get a front-matter head
DEFS["notes"] = (
    """
SELECT doc_id, collection, project, 'n/note' || CAST(doc_id AS STRING) || '.md' AS rel_path, 'markdown' AS kind,
  CASE WHEN doc_id % 3 = 0 THEN '---\ntags: ' || collection || ', all\ntype: ' || project || '\n---\n' ELSE '' END ||
  array_join(transform(split(text, '\n', -1), x -> CASE WHEN char_length(x) % 7 = 3
    THEN repeat('#', 1 + char_length(x) % 4) || ' ' || x ELSE x END), '\n') AS text FROM {docs}
""",
    """
SELECT doc_id, collection, project, 'n/note' || CAST(doc_id AS STRING) || '.md' AS rel_path, 'markdown' AS kind,
  CASE WHEN doc_id % 3 = 0 THEN '---' || chr(10) || 'tags: ' || collection || ', all' || chr(10) || 'type: ' || project
    || chr(10) || '---' || chr(10) ELSE '' END ||
  array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(x) % 7 = 3
    THEN repeat('#', CAST(1 + length(x) % 4 AS INT)) || ' ' || x ELSE x END), chr(10)) AS text FROM {docs}
""",
)

# source files: some lines become declarations, methods or calls
DEFS["code_docs"] = (
    """
SELECT doc_id, collection, project, 'c/f' || CAST(doc_id AS STRING) || '.py' AS rel_path, 'code' AS kind,
  array_join(transform(split(text, '\n', -1), x -> CASE char_length(x) % 9
    WHEN 1 THEN 'export function f' || char_length(x) || '(a) {{' WHEN 3 THEN '    async m' || char_length(x) || '(b): # ' || x
    WHEN 5 THEN '    call' || char_length(x) || '(c);' WHEN 7 THEN '  if (' || x || ') {{' ELSE x END), '\n') AS text FROM {docs}
""",
    """
SELECT doc_id, collection, project, 'c/f' || CAST(doc_id AS STRING) || '.py' AS rel_path, 'code' AS kind,
  array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE length(x) % 9
    WHEN 1 THEN 'export function f' || length(x) || '(a) {{' WHEN 3 THEN '    async m' || length(x) || '(b): # ' || x
    WHEN 5 THEN '    call' || length(x) || '(c);' WHEN 7 THEN '  if (' || x || ') {{' ELSE x END), chr(10)) AS text FROM {docs}
""",
)

DEFS["page_text"] = (
    "SELECT doc_id, replace(text, '\n', '\f') AS text FROM {docs}",
    "SELECT doc_id, replace(text, chr(10), chr(12)) AS text FROM {docs}",
)

# documents as single-chunk search hits; a "file" is a whole source, so that files have many hits
DEFS["hit_docs"] = """
SELECT doc_id, doc_id AS chunk_id, collection, project, project || '.md' AS rel_path, '/abs/' || project AS abs_path,
  CASE WHEN doc_id % 9 = 0 THEN '' ELSE collection END AS anchor, text,
  CASE WHEN doc_id % 31 = 0 THEN 'n/a' ELSE indexed_at END AS indexed_at,
  CASE WHEN doc_id % 6 = 0 THEN 'local_foreign' ELSE 'local_owned' END AS provenance FROM {docs}
"""

# words and their beginnings in another script
DEFS["foreign_words"] = (
    """
SELECT DISTINCT item_id AS qid, translate(w, 'abcdefghijklmnopqrstuvwxyz', 'абцдефгхижклмнопярстуввхыз') AS word
FROM {benchmark} LATERAL VIEW explode(regexp_extract_all(lower(text), '[a-z]+', 0)) x AS w
""",
    """
SELECT DISTINCT item_id AS qid, translate(w, 'abcdefghijklmnopqrstuvwxyz', 'абцдефгхижклмнопярстуввхыз') AS word
FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM {benchmark}) x
""",
)

DEFS["excerpts"] = """
SELECT l_orderkey AS request, l_partkey * 10 + l_linenumber AS id, CAST(l_quantity AS BIGINT) % 5 AS priority,
  l_suppkey AS position, CAST(l_quantity AS BIGINT) AS tokens, CAST(l_orderkey % 100 AS BIGINT) AS base_tokens
FROM {lineitem}
"""

DEFS["search_queries"] = """
SELECT n_nationkey AS qid, CASE n_nationkey % 5 WHEN 0 THEN 'Ship order 1' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'cit%'
  WHEN 3 THEN 'customer#00000' || CAST(n_nationkey AS STRING) ELSE 'error_' END AS q FROM {nation}
UNION ALL SELECT 100 + r_regionkey, CASE r_regionkey % 3 WHEN 0 THEN 'machinery' WHEN 1 THEN 'click ' ELSE 'x' END FROM {region}
"""

# ------------------------------------------------------------------------- evaluation

DEFS["cases"] = """
SELECT item_id AS qid, CASE item_id % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'lexical' ELSE 'crosslang' END AS kind,
  'src' || CAST(item_id % 20 AS STRING) || '/d' AS expected FROM {benchmark}
UNION ALL SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'lexical' ELSE 'crosslang' END,
  CASE WHEN item_id % 5 = 0 THEN 'src1/vendor' ELSE 'src' || CAST(item_id AS STRING) || '0/x' END FROM {benchmark} WHERE item_id % 2 = 0
"""

DEFS["unreachable_cases"] = """
SELECT qid, kind, CASE WHEN qid % 3 = 0 THEN 'nowhere/' || CAST(qid AS STRING) ELSE expected END AS expected FROM {cases}
"""

DEFS["label_results"] = """
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 'q' || CAST(quality AS STRING) END AS expected_intent,
  'q' || CAST(toxic AS STRING) AS got_intent,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'p' || CAST(quality AS STRING) END AS expected_project,
  CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'p' || CAST(toxic AS STRING) END AS got_project,
  doc_id % 3 = 0 AS wants_clarify, doc_id % 2 = 0 AS clarified, doc_id % 7 = 0 AS prerouted FROM {labels}
"""

DEFS["structured_calls"] = """
SELECT o_orderpriority AS schema, 1 + o_orderkey % 2 AS attempts, o_orderkey % 2 AS repairs,
  CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS failures FROM {orders}
"""

DEFS["baseline_tests"] = """
SELECT CAST(p_size AS BIGINT) AS root, p_partkey AS test, p_partkey % 3 = 0 AS failed FROM {part} WHERE p_size % 5 <> 0
"""
DEFS["observed_tests"] = """
SELECT CAST(p_size AS BIGINT) AS root, p_partkey AS test, p_partkey % 4 = 0 OR p_partkey % 3 = 0 AND p_size < 25 AS failed
FROM {part} WHERE p_partkey % 9 <> 5
"""

# node positions, and a later layout of the same nodes in which some have moved
DEFS["layout_a"] = (
    "SELECT vec_id AS id, round(CAST(embedding[0] AS DOUBLE), 4) AS x, round(CAST(embedding[1] AS DOUBLE), 4) AS y FROM {embeddings}",
    "SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 4) AS x, round(CAST(embedding[2] AS DOUBLE), 4) AS y FROM {embeddings}",
)
DEFS["layout_b"] = """
SELECT id, CASE WHEN id % 4 = 0 THEN x + 0.0125 * (id % 7) ELSE x END AS x, CASE WHEN id % 4 = 0 THEN y - 0.0125 * (id % 5) ELSE y END AS y FROM {layout_a}
"""

# --------------------------------------------------------------------------- event log

DEFS["log"] = """
SELECT event_id + 1 AS seq, ts, 's' || CAST(user_id AS STRING) AS session_id,
  CASE CAST(event_id % 20 AS INT)
    WHEN 0 THEN 'turn.started' WHEN 1 THEN 'message.delta' WHEN 2 THEN 'message.delta'
    WHEN 3 THEN CASE WHEN event_id % 3 = 0 THEN 'message.delta' ELSE 'message.completed' END
    WHEN 4 THEN 'turn.finished'
    WHEN 5 THEN 'tool.started' WHEN 6 THEN 'tool.started' WHEN 7 THEN 'tool.finished'
    WHEN 8 THEN 'tool.finished' WHEN 9 THEN 'task.created' WHEN 10 THEN 'task.updated'
    WHEN 11 THEN 'task.finished' WHEN 12 THEN 'approval.requested' WHEN 13 THEN 'approval.resolved'
    WHEN 14 THEN 'system.degraded' WHEN 15 THEN 'error' WHEN 16 THEN 'knowledge.state'
    WHEN 17 THEN 'tool.finished'
    WHEN 18 THEN CASE WHEN event_id % 2000 = 18 THEN 'system.boot' ELSE 'log.entry' END
    ELSE 'agent.state' END AS type,
  CASE WHEN event_id % 20 < 9 OR event_id % 20 = 17
    THEN 't' || CAST(CAST(floor(event_id / 40) AS BIGINT) AS STRING) END AS turn_id,
  CASE WHEN event_id % 20 IN (9, 10, 11) THEN 'k' || CAST(CAST(floor(event_id / 20) AS BIGINT) AS STRING) END AS task_id,
  'tr' || CAST(event_id % 50 AS STRING) AS trace_id,
  CASE WHEN event_id % 500 = 499 THEN '{{bad' ELSE '{{"text":"' || event_type || ' ' || CAST(user_id AS STRING) || '"' ||
  CASE CAST(event_id % 20 AS INT)
    WHEN 4 THEN CASE WHEN event_id % 3 = 0 THEN ',"outcome":"halted"' ELSE '' END
    WHEN 5 THEN ',"tool":"know.search"' WHEN 6 THEN ',"tool":"fs.read"'
    WHEN 7 THEN ',"tool":"know.search","ok":true' WHEN 8 THEN ',"tool":"' ||
         CASE WHEN event_id % 3 = 0 THEN 'know.search' ELSE 'fs.read' END || '","ok":false'
    WHEN 9 THEN ',"root_id":"r' || CAST(CAST(floor(event_id / 100) AS BIGINT) AS STRING) || '","source":"' ||
         CASE WHEN event_id % 7 = 0 THEN 'delegate' ELSE 'graph' END || '","kind":"tool"'
    WHEN 10 THEN ',"root_id":"r' || CAST(CAST(floor(event_id / 100) AS BIGINT) AS STRING) ||
         '","source":"graph","status":"running"'
    WHEN 11 THEN ',"root_id":"r' || CAST(CAST(floor(event_id / 100) AS BIGINT) AS STRING) || '"' ||
         CASE WHEN event_id % 5 = 0 THEN ',"outcome":"done"' ELSE ',"source":"graph","status":"' ||
         CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'succeeded' END || '"' END
    WHEN 12 THEN ',"approval_id":"a' || CAST(CAST(floor(event_id / 20) AS BIGINT) AS STRING) || '","expires_in_s":' ||
         CAST(60 + event_id % 3 * 100000 AS STRING) || CASE WHEN event_id % 9 = 0 THEN ',"waits":true' ELSE '' END
    WHEN 13 THEN ',"approval_id":"a' || CAST(CAST(floor(event_id / 20) AS BIGINT) -
         CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS STRING) || '","resolution":"approved"'
    WHEN 14 THEN ',"reason":"' || event_type || ' down","component":"' || event_type || '"'
    WHEN 17 THEN ',"tool":"know.search","citations":[{{"collection":"c","path":"' || event_type ||
         '"}},{{"collection":"c","path":"' || event_type || '"}},{{"collection":"d","path":"p' || CAST(user_id AS STRING) || '"}}]'
    WHEN 18 THEN ',"unclean":' || CASE WHEN event_id % 4000 = 18 THEN 'true' ELSE 'false' END
    ELSE '' END || '}}' END AS payload
FROM {events}
"""

DEFS["chat"] = """
SELECT 'c' || CAST(conv_id AS STRING) AS session_id, conv_id * 1000 + turn AS seq,
  CASE role WHEN 'user' THEN 'turn.started' WHEN 'assistant' THEN 'message.completed' ELSE 'log.entry' END AS type,
  text FROM {conversations}
"""

DEFS["probes"] = """
SELECT event_type AS component, count(*) % 2 = 0 AS ok, count(*) % 3 = 0 AS unknown,
  'checked ' || CAST(count(*) AS STRING) AS detail FROM {events} GROUP BY event_type
UNION ALL SELECT r_name, r_regionkey % 2 = 0, false, 'region ' || CAST(r_regionkey AS STRING) FROM {region}
"""

# ---------------------------------------------------------------- projects and task graphs

DEFS["projects"] = """
SELECT c_custkey AS project_id, c_name AS name, c_custkey % 100 AS watermark,
  CASE c_custkey % 7 WHEN 0 THEN 'archived' WHEN 1 THEN 'missing' WHEN 2 THEN 'active' ELSE 'idle' END AS status,
  c_mktsegment AS description FROM {customer}
"""

DEFS["task_base"] = """
SELECT o.o_orderkey AS id, o.o_custkey AS root_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'tool' WHEN '2-HIGH' THEN 'delegation'
    WHEN '3-MEDIUM' THEN 'planning' WHEN '5-LOW' THEN 'report' ELSE 'verify' END AS kind,
  CASE WHEN o_orderstatus = 'F' THEN CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'failed' WHEN 1 THEN 'timeout' ELSE 'succeeded' END
    WHEN o_orderstatus = 'O' THEN CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'pending' WHEN 1 THEN 'ready' WHEN 2 THEN 'waiting' ELSE 'running' END
    ELSE CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'skipped' WHEN 1 THEN 'cancelled' ELSE 'succeeded' END END AS status,
  'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS project,
  CASE o_orderkey % 3 WHEN 0 THEN 'coder' WHEN 1 THEN 'reviewer' ELSE 'researcher' END AS role,
  CASE o_orderkey % 4 WHEN 0 THEN 'a1' WHEN 1 THEN 'a2' WHEN 2 THEN 'a3' END AS agent,
  1 + o_orderkey % 2 AS attempt,
  CASE WHEN o_orderkey % 11 = 0 THEN lag(o_orderkey, 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS supersedes,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS day,
  CAST(round(o_totalprice) AS BIGINT) AS price,
  o_orderkey % 60 AS sel60, o_orderkey % 13 AS sel13
FROM {orders} o
"""

DEFS["tasks"] = """
SELECT id, root_id, kind, status, project, role, agent, attempt, supersedes,
  day || 'T00:00:00Z' AS created_at,
  CASE WHEN status IN ('pending', 'ready') THEN NULL WHEN sel60 = 0 THEN 'n/a'
    ELSE day || 'T' || lpad(CAST(sel13 AS STRING), 2, '0') || ':00:00Z' END AS started_at,
  CASE WHEN status IN ('succeeded', 'failed', 'timeout', 'skipped', 'cancelled')
    THEN day || 'T' || lpad(CAST(sel60 % 24 AS STRING), 2, '0') || ':30:00Z' END AS finished_at,
  CASE WHEN id % 50 = 7 THEN '{{bad' ELSE '{{"objective":"ship order ' || CAST(id % 200 AS STRING) ||
     ' for segment ' || CAST(root_id % 5 AS STRING) || '","role":"' || role || '","project":"' || project || '"}}' END AS spec,
  CASE WHEN status NOT IN ('succeeded', 'failed', 'timeout', 'cancelled') THEN NULL
    WHEN id % 41 = 3 THEN 'not json'
    ELSE '{{"summary":"s' || CAST(id % 10 AS STRING) || '","cost":{{"tokens":' ||
      CASE WHEN sel13 = 0 THEN CAST(price AS STRING) || '.5' WHEN sel13 = 1 THEN '"' || CAST(price AS STRING) || '"'
           ELSE CAST(price AS STRING) END || ',"usd":' || CAST(id % 100 AS STRING) || '.25}},"evidence":{{"exit_code":' ||
      CAST(id % 2 AS STRING) || CASE WHEN id % 5 = 0 THEN ',"branch":"b' || CAST(id AS STRING) || '"' ELSE '' END ||
      ',"secret_path":"/x"}}' ||
      CASE WHEN status IN ('failed', 'timeout') THEN ',"error":{{"kind":"' ||
        CASE WHEN id % 4 = 0 THEN 'denied' ELSE 'execution_failed' END || '","message":"step ' || CAST(id % 30 AS STRING) || ' broke"}}'
        ELSE '' END || '}}' END AS result
FROM {task_base}
"""

# dependencies point at smaller keys of the same customer: acyclic
DEFS["task_edges"] = """
SELECT root_id, task, dep FROM (
  SELECT o_custkey AS root_id, o_orderkey AS task, lag(o_orderkey, 1) OVER w AS dep, o_orderkey % 3 <> 0 AS has FROM {orders}
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
  UNION ALL
  SELECT o_custkey, o_orderkey, lag(o_orderkey, 2) OVER w, o_orderkey % 4 = 1 FROM {orders}
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) e
WHERE has AND dep IS NOT NULL
"""

# the same with faults: unknown tasks, self-dependencies, and back edges that close cycles
DEFS["faulty_edges"] = """
SELECT root_id, task, dep FROM {task_edges}
UNION ALL SELECT o_custkey, o_orderkey, -o_orderkey FROM {orders} WHERE o_orderkey % 101 = 5
UNION ALL SELECT o_custkey, o_orderkey, o_orderkey FROM {orders} WHERE o_orderkey % 97 = 3
UNION ALL SELECT root_id, task, dep FROM (
  SELECT o_custkey AS root_id, o_orderkey AS task, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dep
  FROM {orders}) b WHERE task % 19 = 4 AND dep IS NOT NULL
"""

DEFS["agents"] = """
SELECT 'g' || CAST(s_suppkey AS STRING) AS agent,
  CASE s_nationkey % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'subscription' WHEN 2 THEN 'quota' ELSE 'metered' END AS cost,
  CASE s_suppkey % 3 WHEN 0 THEN 'coder' WHEN 1 THEN 'reviewer' ELSE 'researcher' END AS role,
  s_suppkey % 4 = 0 AS read_only, CASE WHEN s_suppkey % 5 = 0 THEN 'local' ELSE 'cloud' END AS locality
FROM {supplier}
"""

DEFS["spec_tasks"] = (
    "SELECT * EXCEPT (project), get_json_object(spec, '$.project') AS project FROM {tasks}",
    "SELECT * EXCLUDE (project), CASE WHEN json_valid(spec) THEN json_extract_string(spec, '$.project') END AS project FROM {tasks}",
)

DEFS["task_events"] = """
SELECT l_orderkey AS task_id, (l_orderkey * 7 + l_linenumber) % 200 AS seq FROM {lineitem}
"""

DEFS["project_names"] = """
SELECT 'Customer#' || lpad(CAST(o_custkey * 2 AS STRING), 9, '0') AS name FROM {orders}
UNION ALL SELECT s_name FROM {supplier}
"""

DEFS["acks"] = "SELECT o_custkey AS project_id, o_orderkey % 150 AS through FROM {orders} WHERE o_orderstatus = 'F'"

DEFS["project_notes"] = """
SELECT c_name AS project, 0 AS position, 'TODO.md' AS path, 'finish ' || c_mktsegment || repeat(' and more', CAST(c_custkey % 200 AS INT)) AS text
FROM {customer} WHERE c_nationkey < 12
UNION ALL SELECT c_name, 1, 'docs/ROADMAP.md', '  ' FROM {customer}
"""

DEFS["delegations"] = """
SELECT o_orderkey AS task_id, 'adapter' || CAST(o_custkey % 3 AS STRING) AS adapter, o_orderpriority AS task,
  'running' AS state, CASE WHEN o_orderkey % 2 = 0 THEN 'done' END AS outcome FROM {orders} WHERE o_orderpriority = '2-HIGH'
"""

DEFS["approvals"] = """
SELECT event_id AS approval_id, event_type AS tool, 'T' || CAST(user_id % 3 AS STRING) AS tier FROM {events} WHERE event_type = 'signup'
"""

DEFS["requests"] = """
SELECT conv_id * 1000 + turn AS id, CASE CAST((conv_id + turn) % 11 AS INT)
  WHEN 0 THEN '/status now' WHEN 1 THEN '  STOP!! ' WHEN 2 THEN 'Please ask our Claude to fix it' WHEN 3 THEN '/Halt'
  WHEN 4 THEN 'run the region_' || CAST(turn AS STRING) || ' pipeline on NATION_' || CAST(conv_id % 25 AS STRING)
  WHEN 5 THEN '/staus quo' WHEN 6 THEN 'compare nation_3 with Nation_4' WHEN 7 THEN 'Nightly Asia report' WHEN 8 THEN ''
  ELSE text END AS text FROM {conversations}
"""

DEFS["pipelines"] = """
SELECT r_name AS name FROM {region} UNION ALL SELECT 'nightly ' || r_name FROM {region} UNION ALL SELECT 'region_' || CAST(n_nationkey AS STRING) FROM {nation}
"""

DEFS["planned"] = """
SELECT o_custkey AS graph, o_orderkey - o_orderkey % 2 * CASE WHEN o_orderkey % 211 = 1 THEN 1 ELSE 0 END AS task,
  CASE WHEN o_orderkey % 307 = 0 THEN -1 ELSE o_custkey END AS root,
  CASE o_orderkey % 6 WHEN 0 THEN 'coder' WHEN 1 THEN 'reviewer' WHEN 2 THEN 'verifier' WHEN 3 THEN 'researcher' WHEN 4 THEN 'poet' ELSE 'cook' END AS role,
  CASE o_orderkey % 3 WHEN 0 THEN 'diff' WHEN 1 THEN 'verdict' ELSE 'report' END AS outcome,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Customer#' || lpad(CAST(o_custkey + o_orderkey % 2 AS STRING), 9, '0') END AS project,
  CASE WHEN o_orderkey % 5 < 2 THEN 'g' || CAST(o_orderkey % 120 AS STRING) END AS hint,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'g' || CAST(o_orderkey % 110 AS STRING) END AS chosen,
  o_orderpriority AS kind, o_orderkey % 2 AS acceptance FROM {orders}
"""

DEFS["role_table"] = """
SELECT DISTINCT CASE n_nationkey % 5 WHEN 0 THEN 'coder' WHEN 1 THEN 'reviewer' WHEN 2 THEN 'verifier' WHEN 3 THEN 'researcher' ELSE 'cook' END AS role,
  n_nationkey % 5 = 2 AS deterministic, CASE n_nationkey % 5 WHEN 0 THEN 'diff' ELSE 'text' END AS outcome FROM {nation}
"""

# ------------------------------------------------------------------- memory and policy

DEFS["fact_writes"] = """
SELECT event_id AS seq, 'f' || CAST(event_id AS STRING) AS fact_id, event_type AS key,
  CASE WHEN user_id % 2 = 0 THEN 'global' ELSE 'project' END AS scope,
  CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'p' || CAST(user_id % 5 AS STRING) END AS scope_ref,
  CASE WHEN event_id % 3 = 0 THEN 'preference' ELSE 'fact' END AS kind,
  props AS value,
  CASE event_id % 4 WHEN 0 THEN 'inferred' WHEN 1 THEN 'observed' WHEN 2 THEN 'user_stated' ELSE 'user_corrected' END AS source,
  event_id % 13 = 0 AS tainted, event_id % 17 = 0 AS plan_active,
  1 + event_id % 3 AS observations, event_id % 5 = 0 AS user_approved,
  CAST((event_id % 10 + 1) / 10.0 AS DOUBLE) AS confidence,
  '2024-' || lpad(CAST(1 + event_id % 12 AS STRING), 2, '0') || '-01T00:00:00Z' AS at
FROM {events}
"""

DEFS["attempts"] = """
SELECT p_partkey AS attempt_id, p_name || ' ' || p_brand || ' ' || p_type AS goal,
  'p' || CAST(p_size % 3 AS STRING) AS project, p_partkey AS at FROM {part}
"""

DEFS["goals"] = """
SELECT DISTINCT s_suppkey AS goal_id, p.p_name || ' the ' || p.p_type || ' ' || p.p_brand AS goal,
  'p' || CAST(s_suppkey % 3 AS STRING) AS project
FROM {supplier} s JOIN {part} p ON p.p_partkey = s.s_suppkey * 7
"""

DEFS["policy_rules"] = """
SELECT DISTINCT event_type AS tool, length(event_type) % 3 AS tier, event_type <> 'error' AS has_scopes FROM {events} WHERE event_type <> 'view'
"""

DEFS["policy_rule_scopes"] = """
SELECT tool, 'projects' AS scope FROM {policy_rules} WHERE has_scopes UNION ALL SELECT tool, 'notes' FROM {policy_rules} WHERE has_scopes
UNION ALL SELECT tool, 'scratch' FROM {policy_rules} WHERE tool = 'click'
"""

DEFS["policy_scope_tiers"] = """
SELECT tool, 'notes' AS scope, 2 AS tier FROM {policy_rules} UNION ALL SELECT tool, 'projects', 1 FROM {policy_rules} WHERE tier < 2
UNION ALL SELECT tool, 'scratch', 3 FROM {policy_rules}
"""

DEFS["lent_calls"] = """
SELECT event_id AS id, user_id % 10 AS grant_id, event_type AS tool, event_id % 4 AS tier,
  CASE event_id % 6 WHEN 0 THEN '/work/g' || CAST(user_id % 10 AS STRING) || '/src/a.py' WHEN 1 THEN '/work/g' || CAST(user_id % 10 AS STRING)
    WHEN 2 THEN '/work/g' || CAST(user_id % 10 AS STRING) || 'x/a.py' WHEN 3 THEN '/work/g' || CAST(user_id % 10 AS STRING) || '/../g9/b'
    WHEN 4 THEN NULL ELSE '/work/g' || CAST(user_id % 10 AS STRING) || '/./a//b' END AS path FROM {events}
"""

DEFS["grants"] = """
SELECT n_nationkey AS grant_id, '/work/g' || CAST(n_nationkey AS STRING) AS root,
  CASE n_nationkey % 2 WHEN 0 THEN 'click,view,error' ELSE 'purchase,view,signup' END AS tools FROM {nation}
"""

DEFS["entropy_texts"] = """
SELECT doc_id, 'id ' || SHA256(text) || ' then ' || SHA256(rel_path) || 'GHIJKLMNOPQRSTUV_wxyz-' || lang_tag || ' end' AS text
FROM (SELECT doc_id, text, rel_path, upper(collection) AS lang_tag FROM {docs}) d
"""

DEFS["context_items"] = """
SELECT conv_id AS request, CASE conv_id % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'reason' ELSE 'route' END AS call_type,
  turn AS item_no, CASE WHEN turn = 0 THEN 3 ELSE 4 + turn % 4 END AS band, text, turn % 5 <> 3 AS truncatable,
  CASE turn % 6 WHEN 1 THEN 'local_foreign' WHEN 2 THEN 'user' ELSE 'system' END AS provenance, role AS source FROM {conversations}
"""

DEFS["policy_requests"] = """
SELECT event_id AS id, event_type AS tool, user_id % 5 AS declared_tier,
  CASE WHEN event_id % 6 = 0 THEN user_id % 4 END AS floor_tier,
  event_id % 4 = 0 AS writes, event_id % 9 = 0 AS tainted
FROM {events}
"""

DEFS["policy_paths"] = """
SELECT event_id AS id, 0 AS pos, CASE user_id % 3 WHEN 0 THEN 'projects' WHEN 1 THEN 'notes' ELSE 'scratch' END AS scope,
  user_id % 8 <> 0 AS writable FROM {events}
UNION ALL
SELECT event_id, 1, CASE event_id % 4 WHEN 0 THEN 'outside' ELSE 'notes' END, event_id % 7 <> 0 FROM {events} WHERE event_id % 2 = 0
"""

# ----------------------------------------------------------------------------- sources

DEFS["files"] = """
SELECT doc_id, collection, project, rel_path, '/corpus/' || rel_path AS path, size, doc_id % 41 <> 0 AS readable, text FROM {docs}
UNION ALL SELECT doc_id + 1000000000, collection, project, project || '/node_modules/m' || CAST(doc_id AS STRING) || '/index.js', '/corpus/nm', size, true, text
  FROM {docs} WHERE doc_id % 10 = 0
UNION ALL SELECT doc_id + 2000000000, collection, project, project || '/bin/tool' || CAST(doc_id AS STRING), '/corpus/bin', size, true, text
  FROM {docs} WHERE doc_id % 15 = 0
"""

DEFS["listing"] = "SELECT project, rel_path FROM {docs} WHERE doc_id % 4 <> 1 AND length(project) = 4"

DEFS["transcript_lines"] = """
SELECT 'run' || CAST(conv_id AS STRING) AS run, turn AS line_no,
  CASE WHEN turn = 0 AND conv_id % 9 = 0 THEN '{{"type":"system","subtype":"init","session_id":"s' || CAST(conv_id AS STRING) || '","plugin_errors":["boom"]}}'
    WHEN turn = 0 THEN '{{"type":"system","subtype":"init","session_id":"s' || CAST(conv_id AS STRING) || '","model":"m1"}}'
    WHEN turn = 4 THEN '{{"type":"result","is_error":' || CASE WHEN conv_id % 5 = 0 THEN 'true' ELSE 'false' END ||
       ',"result":"done","total_cost_usd":0.25,"duration_ms":' || CAST(1000 + conv_id AS STRING) || ',"num_turns":' || CAST(turn AS STRING) || '}}'
    WHEN turn = 2 AND conv_id % 7 = 0 THEN '{{broken'
    WHEN role = 'assistant' THEN '{{"type":"assistant","message":{{"content":[{{"type":"text","text":"said ' || CAST(length(text) AS STRING) ||
       '"}},{{"type":"thinking","thinking":""}},{{"type":"tool_use","name":"fs.read"}}]}}' || CASE WHEN conv_id % 4 = 0 THEN ',"parent_tool_use_id":"p"' ELSE '' END || '}}'
    ELSE '{{"type":"user","message":{{"content":"x"}}}}' END AS raw
FROM {conversations}
"""

DEFS["run_exits"] = "SELECT DISTINCT 'run' || CAST(conv_id AS STRING) AS run, CASE WHEN conv_id % 8 = 0 THEN 1 ELSE 0 END AS exit_code FROM {conversations}"

DEFS["commit_lines"] = """
SELECT o_orderkey AS id, SHA256(day) || {SEP} || CAST(o_orderkey AS STRING) || {SEP} || 'author' || CAST(o_custkey AS STRING) || {SEP} || day ||
  CASE WHEN o_orderkey % 10 = 3 THEN '' ELSE {SEP} || o_orderpriority END || CASE WHEN o_orderkey % 17 = 4 THEN {SEP} ELSE '' END AS raw
FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day FROM {orders}) o
""".replace("{SEP}", "chr(31)")

DEFS["report_rows"] = """
SELECT s_suppkey AS run, count(*) AS tests, count(*) FILTER (WHERE l_linenumber = 7) AS failures, count(*) FILTER (WHERE l_linenumber = 6) AS errors,
  count(*) FILTER (WHERE l_linenumber = 5) AS skipped FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey GROUP BY s_suppkey
"""

DEFS["change_events"] = """
SELECT event_id, ts, CASE user_id % 3 WHEN 0 THEN 'notes' WHEN 1 THEN 'projects' ELSE 'books' END AS collection,
  CASE event_id % 5 WHEN 0 THEN 'src/a' || CAST(user_id AS STRING) || '.py' WHEN 1 THEN 'node_modules/x/b.js' WHEN 2 THEN 'notes/n' || CAST(user_id AS STRING) || '.md'
    WHEN 3 THEN 'private/key.pem' ELSE 'bin/blob' || CAST(user_id AS STRING) END AS rel_path FROM {events}
"""

_REF = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def _pick(name: str, spark: bool) -> str:
    found = DEFS[name]
    return found if isinstance(found, str) else found[0 if spark else 1]


class Tables:
    """Derived tables of one data directory; each is built once and lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in RAW:
                table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                self._made[name] = spread(table) if name in TEXT_HEAVY else table
            else:
                text = re.sub(r"SHA256\((\w+)\)", r"sha2(\1, 256)", _pick(name, True))
                refs = {r: self(r) for r in dict.fromkeys(_REF.findall(text))}
                self._made[name] = self.spark.sql(text, **refs)
        return self._made[name]

    @cached_property
    def log(self) -> DataFrame:
        return self("log")


def _order(names: list[str], seen: dict[str, None]) -> None:
    for name in names:
        if name in RAW or name in seen:
            continue
        _order(_REF.findall(_pick(name, False)), seen)
        seen[name] = None


def with_tables(names: list[str], body: str) -> str:
    """``body`` with the named derived tables, and what they read, as common table expressions."""
    seen: dict[str, None] = {}
    _order(names, seen)
    ctes = []
    for name in seen:
        text = _REF.sub(r"\1", _pick(name, False)).replace("{{", "{").replace("}}", "}")
        ctes.append(f"{name} AS ({text.strip()})")
    body = body.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        if rest[:10].upper() == "RECURSIVE ":
            return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + rest[10:]
        return "WITH " + ",\n".join(ctes) + ",\n" + rest
    return "WITH " + ",\n".join(ctes) + "\n" + body
