"""Audit-chain verification and replay of access policy."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreworks.operators.scale import first_rows, running

GENESIS = "0" * 64
# The decision of each tier.
DECISIONS = ("allow", "allow", "confirm", "confirm_strong", "deny")
FORBIDDEN, LENDING_TIER = 4, 1


def _canonical(raw: str | None, without: str | None = None) -> str | None:
    if raw is None:
        return None
    try:
        value = json.loads(raw)
    except ValueError:
        return None
    if without is not None and isinstance(value, dict):
        value.pop(without, None)
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no spaces; NULL when it cannot be read."""
    return raw.map(_canonical)


@F.pandas_udf(T.StringType())
def _body_hash(raw: pd.Series) -> pd.Series:
    """Digest of an audit record without its own hash field."""
    bodies = raw.map(lambda r: _canonical(r, "hash"))
    return bodies.map(lambda b: None if b is None else hashlib.sha256(b.encode("utf-8")).hexdigest())


def args_digest(raw: Column) -> Column:
    """``sha256:`` digest of canonical arguments."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(raw), 256))


def verify_chain(lines: DataFrame, segment: int = 65_536) -> DataFrame:
    """{log_id, seq, expected, found, detail}: every break, in file order per log.

    ``lines`` is {log_id, line_no, raw}.  Each record is checked against the one before it in
    the same file, found with a segmented lag, so a huge log is checked by many tasks.
    """
    recs = lines.where(F.trim("raw") != "").select(
        "log_id", "line_no",
        F.coalesce(F.get_json_object("raw", "$.seq").cast("long"), F.lit(-1)).alias("seq"),
        F.coalesce(F.get_json_object("raw", "$.prev"), F.lit("None")).alias("prev"),
        F.coalesce(F.get_json_object("raw", "$.hash"), F.lit("None")).alias("hash"),
        _body_hash("raw").alias("body"),
    )
    seen = running(
        recs, ["log_id"], "line_no", {"_seq": (F.col("seq"), "prev"), "_hash": (F.col("hash"), "prev")}, segment
    )
    want_seq = F.coalesce(F.col("_seq") + 1, F.lit(1))
    want_prev = F.coalesce("_hash", F.lit(GENESIS))

    def fault(broken: Column, expected: Column, found: Column, detail: str) -> Column:
        return F.when(broken, F.struct(expected.alias("expected"), found.alias("found"), F.lit(detail).alias("detail")))

    faults = F.array_compact(
        F.array(
            fault(F.col("seq") != want_seq, want_seq.cast("string"), F.col("seq").cast("string"), "sequence gap"),
            fault(F.col("prev") != want_prev, want_prev, F.col("prev"), "previous hash differs"),
            fault(~F.col("body").eqNullSafe(F.col("hash")), F.col("body"), F.col("hash"), "record edited"),
        )
    )
    return seen.select("log_id", "line_no", "seq", F.explode(faults).alias("_f")).select(
        "log_id", "line_no", "seq", "_f.expected", "_f.found", "_f.detail"
    )


def audit_tail(lines: DataFrame, n: int) -> DataFrame:
    """The last ``n`` lines of each log."""
    return first_rows(lines, ["log_id"], [F.col("line_no").desc()], n)


def replay_policy(
    requests: DataFrame, paths: DataFrame, rules: DataFrame, rule_scopes: DataFrame, scope_tiers: DataFrame, read_only: bool = False
) -> DataFrame:
    """{id, decision, tier, base_tier, rule, tainted, escalated} for a table of requests.

    ``requests`` {id, tool, declared_tier, floor_tier, writes, tainted}; ``paths`` {id, pos, scope,
    writable}; ``rules`` {tool, tier, has_scopes}; ``rule_scopes`` {tool, scope} permitted;
    ``scope_tiers`` {tool, scope, tier}.  A request's paths are reduced to one row before they
    meet it: the first refusal in path order, and the highest tier asked for before it.
    """
    ruled = requests.join(rules.withColumnRenamed("tier", "_rule"), "tool", "left")
    allowed = rule_scopes.select("tool", "scope").distinct().withColumn("_ok", F.lit(True))
    raised = scope_tiers.select("tool", "scope", F.col("tier").alias("_up"))
    each = (
        paths.join(ruled.where("_rule IS NOT NULL").select("id", "tool", "writes", "has_scopes"), "id")
        .join(allowed, ["tool", "scope"], "left")
        .join(raised, ["tool", "scope"], "left")
    )
    off_scope = F.col("has_scopes") & F.col("_ok").isNull()
    locked = F.col("writes") & ~F.col("writable")
    refusal = F.when(off_scope, F.concat(F.lit("tools."), "tool", F.lit(".scopes"))).when(
        locked, F.concat(F.lit("scopes."), "scope", F.lit(".mode"))
    )
    judged = each.withColumn("_no", refusal)
    first_no = judged.where("_no IS NOT NULL").groupBy("id").agg(F.min("pos").alias("_no_at"), F.min_by("_no", "pos").alias("_no"))
    before = (
        judged.join(first_no.select("id", "_no_at"), "id", "left")
        .where((F.col("_up").isNotNull()) & (F.col("_no_at").isNull() | (F.col("pos") < F.col("_no_at"))))
        .groupBy("id")
        .agg(F.max("_up").alias("_up"), F.max_by("scope", F.struct(F.col("_up"), -F.col("pos"))).alias("_up_scope"))
    )
    tool = F.col("tool")
    declared = F.coalesce(F.col("declared_tier") > F.col("_rule"), F.lit(False))
    base0 = F.when(declared, F.col("declared_tier")).otherwise(F.col("_rule"))
    lifted = F.coalesce(F.col("_up") > F.col("_b0"), F.lit(False))
    base1 = F.when(lifted, F.col("_up")).otherwise(F.col("_b0"))
    floored = F.coalesce(F.col("floor_tier") > F.col("_b1"), F.lit(False))
    joined = (
        ruled.join(first_no, "id", "left").join(before, "id", "left")
        .withColumn("_b0", base0).withColumn("_b1", base1)
        .withColumn("_b2", F.when(floored, F.col("floor_tier")).otherwise(F.col("_b1")))
    )
    name = (
        F.when(floored, "floor")
        .when(lifted, F.concat(F.lit("tools."), tool, F.lit(".scope_tiers."), F.col("_up_scope")))
        .when(declared, F.concat(F.lit("tools."), tool, F.lit(".contract_tier")))
        .otherwise(F.concat(F.lit("tools."), tool, F.lit(".tier")))
    )
    unknown, shut = F.col("_rule").isNull(), F.lit(read_only) & F.col("writes")
    denied = unknown | shut | F.col("_no").isNotNull()
    bumped = ~denied & F.col("tainted") & (F.col("_b2") > 0)
    tier = F.when(denied, F.lit(FORBIDDEN)).when(bumped, F.least(F.col("_b2") + 1, F.lit(FORBIDDEN))).otherwise(F.col("_b2"))
    base = (
        F.when(unknown, F.coalesce("declared_tier", F.lit(FORBIDDEN))).when(shut, F.col("_b0"))
        .when(F.col("_no").isNotNull(), F.col("_b1")).otherwise(F.col("_b2"))
    )
    escalated = bumped & (F.col("tier") != F.col("base_tier"))
    out = joined.withColumn("tier", tier.cast("long")).withColumn("base_tier", base.cast("long")).withColumn("_name", name)
    rule = (
        F.when(unknown, "default-deny").when(shut, "lockdown.read_only").when(F.col("_no").isNotNull(), F.col("_no"))
        .when(escalated, F.concat(F.lit("taint.escalate("), "_name", F.lit(")"))).otherwise(F.col("_name"))
    )
    decision = F.get(F.array(*[F.lit(d) for d in DECISIONS]), F.col("tier").cast("int"))
    return out.select(
        "id", decision.alias("decision"), "tier", "base_tier", rule.alias("rule"),
        (~denied & F.col("tainted")).alias("tainted"), escalated.alias("escalated"),
    )


def resolve_path(path: Column) -> Column:
    """A path with forward slashes and without ``.``, ``..`` and doubled slashes."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "") | (p == "."), acc)
        .when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, p)),
    )
    return F.concat(F.when(path.rlike(r"^[/\\]"), "/").otherwise(""), F.array_join(folded, "/"))


def narrow_calls(calls: DataFrame, grants: DataFrame, max_tier: int = LENDING_TIER) -> DataFrame:
    """{id, reason}: why a lent capability refuses a call, NULL when it may run.

    ``calls`` {id, grant_id, tool, path, tier}; ``grants`` {grant_id, root, tools array}.
    """
    root, path = resolve_path(F.col("root")), resolve_path(F.col("path"))
    inside = (path == root) | path.startswith(F.concat(root, F.lit("/")))
    reason = (
        F.when(F.col("root").isNull(), "no such grant")
        .when(~F.array_contains("tools", F.col("tool")), "not lent")
        .when((F.coalesce("path", F.lit("")) != "") & ~inside, "outside the workspace")
        .when(F.col("tier") > max_tier, "tier too high")
    )
    return calls.join(grants, "grant_id", "left").select("id", reason.alias("reason"))
