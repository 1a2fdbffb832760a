"""Registered queries: redaction, audit, policy and context packing."""

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F

from loreworks.functions import text as tx
from loreworks.operators import audit as au
from loreworks.operators import context as cx
from loreworks.operators import redaction as rd
from loreworks.plans.corpus_queries import EST_PARTS_SQL, EST_SQL
from loreworks.plans.registry import query


def _chain(column: str, upto: int) -> str:
    out = column
    for label, pattern in rd.PATTERNS[:upto]:
        put = rf"\1=[REDACTED:{label}]" if label == rd.KEEPS_NAME else f"[REDACTED:{label}]"
        quoted = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted}', '{put}', 'g')"
    return out


def _counts(column: str) -> str:
    parts = []
    for i, (label, pattern) in enumerate(rd.PATTERNS):
        quoted = pattern.replace("'", "''")
        parts.append(f"SELECT source, '{label}' AS label, len(regexp_extract_all({_chain(column, i)}, '{quoted}')) AS n FROM documents")
    return " UNION ALL ".join(parts)


@query("r01_redact_text", "", f"SELECT doc_id, {_chain('text', len(rd.PATTERNS))} AS redacted FROM documents")
def _(t):
    return t("documents").select("doc_id", rd.redact_column(F.col("text")).alias("redacted"))


@query("r02_redact_json")
def _(t):
    return t("log").select("seq", rd.redact_json("payload").alias("payload"))


@query(
    "r03_token_entropy", "entropy_texts",
    r"""
WITH k AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9_\-]{32,}\b')) AS token FROM entropy_texts),
c AS (SELECT doc_id, token, ch, count(*) / any_value(length(token)) AS p FROM (SELECT doc_id, token, unnest(string_split(token, '')) AS ch FROM k) x WHERE ch <> '' GROUP BY 1, 2, 3)
SELECT doc_id, token, round(-sum(p * log2(p)), 6) AS bits FROM c GROUP BY 1, 2""",
)
def _(t):
    return rd.entropy_tokens(t("entropy_texts"), "text", ["doc_id"]).withColumn("bits", F.round("bits", 6))


@query("r03_redact_entropy")
def _(t):
    return t("entropy_texts").select("doc_id", rd.redact_entropy(F.col("text")).alias("text"))


@query(
    "r04_redaction_census", "",
    f"SELECT source, label, CAST(sum(n) AS BIGINT) AS n FROM ({_counts('text')}) c GROUP BY 1, 2 HAVING sum(n) > 0",
)
def _(t):
    return rd.redaction_census(t("documents"), "text", ["source"])


AUDIT_BASE = """base AS (SELECT user_id AS log_id, event_id, event_type AS actor, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) + sum(CASE WHEN event_id % 89 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events)"""
BODY = """'{{"actor":"' || {actor} || '","event":' || CAST(b.event_id AS VARCHAR) || ',"prev":"' || {prev} || '","seq":' || CAST(b.seq AS VARCHAR) || '}}'"""
Z = "repeat('0', 64)"
PREV1 = Z
PREVN = f"CASE WHEN b.event_id % 83 = 0 THEN {Z} ELSE c.h END"
CHAIN = f"""WITH RECURSIVE {AUDIT_BASE},
chain(log_id, line_no, seq, prev, h, shown) AS (
  SELECT b.log_id, b.line_no, b.seq, {PREV1}, sha256({BODY.format(actor='b.actor', prev=PREV1)}),
    sha256({BODY.format(actor="CASE WHEN b.event_id % 97 = 0 THEN 'x' ELSE b.actor END", prev=PREV1)}) FROM base b WHERE b.line_no = 1
  UNION ALL
  SELECT b.log_id, b.line_no, b.seq, {PREVN}, sha256({BODY.format(actor='b.actor', prev=PREVN)}),
    sha256({BODY.format(actor="CASE WHEN b.event_id % 97 = 0 THEN 'x' ELSE b.actor END", prev=PREVN)})
  FROM chain c JOIN base b ON b.log_id = c.log_id AND b.line_no = c.line_no + 1),
lagged AS (SELECT *, lag(seq) OVER (PARTITION BY log_id ORDER BY line_no) AS ps, lag(h) OVER (PARTITION BY log_id ORDER BY line_no) AS ph FROM chain)"""


def _audit_lines(t):
    """Audit lines chained per user, with some records removed, forged or edited."""
    base = t.spark.sql(
        """SELECT user_id AS log_id, event_id, event_type AS actor, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) + sum(CASE WHEN event_id % 89 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS seq
        FROM {events}""",
        events=t("events"),
    )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, last = [], au.GENESIS
        for r in pdf.sort_values("line_no").itertuples():
            body = {"actor": r.actor, "event": r.event_id, "prev": au.GENESIS if r.event_id % 83 == 0 else last, "seq": r.seq}
            last = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
            shown = {**body, "hash": last, "actor": "x" if r.event_id % 97 == 0 else r.actor}
            rows.append((r.log_id, r.line_no, json.dumps(shown, sort_keys=True)))
        return pd.DataFrame(rows, columns=["log_id", "line_no", "raw"])

    return base.groupBy("log_id").applyInPandas(chain, "log_id long, line_no long, raw string")


@query(
    "a01_verify_chain", "",
    f"""{CHAIN}
SELECT log_id, line_no, CAST(seq AS BIGINT) AS seq, CAST(CAST(coalesce(ps + 1, 1) AS BIGINT) AS VARCHAR) AS expected, CAST(CAST(seq AS BIGINT) AS VARCHAR) AS found, 'sequence gap' AS detail FROM lagged WHERE seq <> coalesce(ps + 1, 1)
UNION ALL SELECT log_id, line_no, CAST(seq AS BIGINT), coalesce(ph, {Z}), prev, 'previous hash differs' FROM lagged WHERE prev <> coalesce(ph, {Z})
UNION ALL SELECT log_id, line_no, CAST(seq AS BIGINT), shown, h, 'record edited' FROM lagged WHERE shown <> h""",
)
def _(t):
    return au.verify_chain(_audit_lines(t), segment=16)


@query(
    "a02_args_digest", "",
    "SELECT event_id, replace(props, ' ', '') AS canonical, 'sha256:' || sha256(replace(props, ' ', '')) AS digest FROM events",
)
def _(t):
    return t("events").select(
        "event_id", au.canonical_json("props").alias("canonical"), au.args_digest(F.col("props")).alias("digest")
    )


@query(
    "a03_replay_policy", "policy_requests policy_paths policy_rules policy_rule_scopes policy_scope_tiers",
    """
WITH q AS (SELECT q.*, r.tier AS rt, r.has_scopes FROM policy_requests q LEFT JOIN policy_rules r ON r.tool = q.tool),
p AS (SELECT p.id, p.pos, p.scope, CASE WHEN q.has_scopes AND NOT EXISTS (SELECT 1 FROM policy_rule_scopes s WHERE s.tool = q.tool AND s.scope = p.scope) THEN 'tools.' || q.tool || '.scopes'
    WHEN q.writes AND NOT p.writable THEN 'scopes.' || p.scope || '.mode' END AS no, t.tier AS up
  FROM policy_paths p JOIN q ON q.id = p.id AND q.rt IS NOT NULL LEFT JOIN policy_scope_tiers t ON t.tool = q.tool AND t.scope = p.scope),
f AS (SELECT id, min(pos) AS at_, arg_min(no, pos) AS no FROM p WHERE no IS NOT NULL GROUP BY 1),
u AS (SELECT p.id, max(up) AS up, arg_max(scope, up * 10 - pos) AS us FROM p LEFT JOIN f ON f.id = p.id WHERE up IS NOT NULL AND (f.at_ IS NULL OR pos < f.at_) GROUP BY 1),
a AS (SELECT q.*, f.no, u.up, u.us, greatest(rt, declared_tier) AS b0 FROM q LEFT JOIN f USING (id) LEFT JOIN u USING (id)),
b AS (SELECT *, greatest(b0, coalesce(up, 0)) AS b1 FROM a), c AS (SELECT *, greatest(b1, coalesce(floor_tier, 0)) AS b2 FROM b),
d AS (SELECT *, rt IS NULL OR no IS NOT NULL AS denied, CASE WHEN b2 > b1 THEN 'floor' WHEN b1 > b0 THEN 'tools.' || tool || '.scope_tiers.' || us
  WHEN declared_tier > rt THEN 'tools.' || tool || '.contract_tier' ELSE 'tools.' || tool || '.tier' END AS name FROM c),
e AS (SELECT *, CASE WHEN denied THEN 4 WHEN tainted AND b2 > 0 THEN least(b2 + 1, 4) ELSE b2 END AS tier,
  CASE WHEN rt IS NULL THEN declared_tier WHEN no IS NOT NULL THEN b1 ELSE b2 END AS base_tier FROM d)
SELECT id, CASE tier WHEN 0 THEN 'allow' WHEN 1 THEN 'allow' WHEN 2 THEN 'confirm' WHEN 3 THEN 'confirm_strong' ELSE 'deny' END AS decision,
  CAST(tier AS BIGINT) AS tier, CAST(base_tier AS BIGINT) AS base_tier, CASE WHEN rt IS NULL THEN 'default-deny' WHEN no IS NOT NULL THEN no
    WHEN tainted AND b2 > 0 AND tier <> base_tier THEN 'taint.escalate(' || name || ')' ELSE name END AS rule,
  NOT denied AND tainted AS tainted, NOT denied AND tainted AND b2 > 0 AND tier <> base_tier AS escalated FROM e""",
)
def _(t):
    return au.replay_policy(
        t("policy_requests"), t("policy_paths"), t("policy_rules"), t("policy_rule_scopes"), t("policy_scope_tiers")
    )


@query(
    "a04_narrow_calls", "lent_calls grants",
    """
SELECT id, CASE WHEN root IS NULL THEN 'no such grant' WHEN NOT list_contains(string_split(tools, ','), tool) THEN 'not lent'
  WHEN id % 6 IN (2) OR (id % 6 = 3 AND c.grant_id <> 9) THEN 'outside the workspace' WHEN tier > 1 THEN 'tier too high' END AS reason
FROM lent_calls c LEFT JOIN grants g ON g.grant_id = c.grant_id""",
)
def _(t):
    return au.narrow_calls(t("lent_calls"), t("grants").withColumn("tools", F.split("tools", ",")))


@query(
    "a05_audit_tail", "",
    f"""WITH {AUDIT_BASE}, r AS (SELECT log_id, line_no, row_number() OVER (PARTITION BY log_id ORDER BY line_no DESC) AS rn FROM base)
SELECT log_id, line_no FROM r WHERE rn <= 5""",
)
def _(t):
    return au.audit_tail(_audit_lines(t), 5).select("log_id", "line_no")


@query("b01_pack_context")
def _(t):
    return cx.pack_context(t("context_items"))[1]


@query("b01_packed_items")
def _(t):
    kept = cx.pack_context(t("context_items"))[0]
    return kept.select("request", "item_no", "band", "cost", "how", F.sha2("text", 256).alias("digest"))


CAPS = "[" + ", ".join(f"('{n}', {list(c)})" for n, c in cx.ALLOWANCES.items()) + "]"


@query(
    "b01_whole_items", "context_items",
    f"""
WITH caps(call_type, cap) AS (VALUES {CAPS[1:-1]}),
c AS (SELECT *, ({EST_SQL}) + 4 AS cost FROM (SELECT *, {EST_PARTS_SQL} FROM context_items) x)
SELECT request, item_no, sum(cost) OVER (PARTITION BY request, band ORDER BY item_no) <= cap[band] AS fits FROM c JOIN caps USING (call_type)""",
)
def _(t):
    return cx.fit_whole_items(t("context_items"))


@query(
    "b02_item_cost", "context_items",
    f"SELECT request, item_no, ({EST_SQL}) + 4 AS cost FROM (SELECT *, {EST_PARTS_SQL} FROM context_items) x",
)
def _(t):
    return t("context_items").select("request", "item_no", tx.item_cost(F.col("text")).alias("cost"))
