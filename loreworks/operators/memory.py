"""Facts and attempts: what may be remembered, who wins a contradiction, what was tried before."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreworks.functions import text as tx
from loreworks.operators.projects import json_text
from loreworks.operators.scale import attach_row, first_rows, map_groups
from loreworks.session import save_point

# Authority of a source, staleness, matching.
AUTHORITY = {"user_corrected": 4, "user_stated": 3, "observed": 2, "inferred": 1}
OBSERVATIONS_REQUIRED = 2
STALE_AFTER_DAYS, STALE_MULTIPLIER = 90, 0.8
MATCH_THRESHOLD, MATCH_LIMIT = 0.6, 3
MAX_PREFERENCES, MAX_FACTS = 5, 8
MEASURED = ("diff_lines", "exit_code", "new_failures", "delta_passed", "branch")
SCOPE_KEY = ("key", "scope", "scope_ref")


def admit_writes(writes: DataFrame) -> DataFrame:
    """Adds ``allowed`` and ``reason``; the first rule that applies decides."""
    src = F.col("source")
    return writes.withColumn(
        "reason",
        F.when(F.col("tainted"), "tainted")
        .when(F.col("plan_active"), "plan active")
        .when(src.isin("user_stated", "user_corrected"), "owner said so")
        .when((src == "observed") & (F.col("observations") >= OBSERVATIONS_REQUIRED), "observed often enough")
        .when(src == "observed", "observed too rarely")
        .when(F.col("user_approved"), "owner approved")
        .otherwise("inferred"),
    ).withColumn("allowed", F.col("reason").isin("owner said so", "observed often enough", "owner approved"))


# ------------------------------------------------------------------------------ the fold
#
# A write against the held fact (value, authority): the same value confirms it; otherwise an
# authority at least as high replaces it; otherwise it is a contradiction and nothing changes.
# The walk over one key is sequential, so a key is cut into segments of bounded size.  From a
# held (v0, a0) a segment's first change is its first write with authority >= a0 and another
# value than v0 -- which, for each of the four authorities, is one of two known writes.  So a
# segment is summarised by where those lead, the summaries are walked per key, and then every
# segment is replayed from its known start.


def _chain(values: list, auths: list, start: int) -> int:
    at = start
    for j in range(start + 1, len(values)):
        if auths[j] >= auths[at] and values[j] != values[at]:
            at = j
    return at


def _summarise(rows: list[tuple]) -> list[tuple]:
    """Rows (value, authority, fact) of one segment -> per level (v1, end 1, end 2)."""
    values, auths, ids = zip(*rows, strict=True)
    out = []
    for level in (1, 2, 3, 4):
        first = next((i for i, a in enumerate(auths) if a >= level), None)
        if first is None:
            continue
        other = next((i for i, a in enumerate(auths) if a >= level and values[i] != values[first]), None)
        ends = []
        for start in (first, other):
            e = None if start is None else _chain(values, auths, start)
            ends += [None, None, None] if e is None else [values[e], auths[e], ids[e]]
        out.append((level, values[first], *ends))
    return out


def _starts(rows: list[tuple]) -> list[tuple]:
    """Rows (segment, level, v1, end 1, end 2) of one key -> the fact held as each segment starts."""
    out = []
    value, auth, fact = None, None, None
    for seg, part in groupby(rows, key=lambda r: r[0]):
        out.append((seg, value, auth, fact))
        hit = {r[1]: r for r in part}.get(auth if auth is not None else 1)
        if hit is None:
            continue
        _, _, v1, *ends = hit
        if auth is None or v1 != value:
            value, auth, fact = ends[:3]
        elif ends[5] is not None:
            value, auth, fact = ends[3:]
    return out


def _replay(rows: list[tuple]) -> list[tuple]:
    """Rows (seq, value, authority, fact, start) of one segment -> (seq, outcome, held)."""
    value, auth, fact = rows[0][4:]
    out = []
    for seq, v, a, f, *_ in rows:
        met = fact
        if fact is None:
            what = "new"
        elif v == value:
            what = "confirmed"
        elif a >= auth:
            what = "superseded"
        else:
            what = "contradicted"
        if what in ("new", "superseded"):
            value, auth, fact = v, a, f
        out.append((seq, what, met))
    return out


def judge_writes(writes: DataFrame, segment: int = 10_000) -> DataFrame:
    """Admitted writes with ``outcome`` (new, confirmed, superseded, contradicted) and ``held``,
    the fact the write met.  ``seq`` is unique and gives the order."""
    auth = F.try_element_at(F.create_map(*[F.lit(x) for kv in AUTHORITY.items() for x in kv]), F.col("source"))
    w = writes.withColumn("authority", auth.cast("long")).withColumn("_seg", F.floor(F.col("seq") / segment))
    small = w.select(*SCOPE_KEY, "_seg", "seq", "value", "authority", "fact_id")
    s, n = T.StringType(), T.LongType()

    def fields(*names: tuple) -> T.StructType:
        return T.StructType([small.schema[k] for k in SCOPE_KEY] + [T.StructField(a, b) for a, b in names])

    summary = map_groups(
        small, [*SCOPE_KEY, "_seg"], ["seq"], _summarise, ["value", "authority", "fact_id"],
        fields(("_seg", n), ("level", n), ("v1", s), ("e1", s), ("a1", n), ("f1", s), ("e2", s), ("a2", n), ("f2", s)),
    )
    starts = map_groups(
        summary, SCOPE_KEY, ["_seg", "level"], _starts, ["_seg", "level", "v1", "e1", "a1", "f1", "e2", "a2", "f2"],
        fields(("_seg", n), ("_v0", s), ("_a0", n), ("_f0", s)),
    )
    k = starts.select(*[F.col(c).alias(f"_{c}") for c in SCOPE_KEY], F.col("_seg").alias("_g"), "_v0", "_a0", "_f0")
    same = F.col("_seg") == F.col("_g")
    for c in SCOPE_KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    verdicts = map_groups(
        small.join(k, same), [*SCOPE_KEY, "_seg"], ["seq"], _replay,
        ["seq", "value", "authority", "fact_id", "_v0", "_a0", "_f0"],
        fields(("_seg", n), ("seq", n), ("outcome", s), ("held", s)),
    )
    return w.drop("_seg", "authority").join(verdicts.select("seq", "outcome", "held"), "seq")


def fold_facts(writes: DataFrame, segment: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(facts, contradictions) after all admitted writes.

    facts {fact_id, key, scope, scope_ref, kind, value, source, confidence, created_at,
    last_confirmed_at, superseded_by}: a confirmed fact keeps its own, possibly weaker, source
    and takes the highest confidence.  contradictions {seq, fact_id, proposed, proposed_source}.
    """
    judged = save_point(judge_writes(writes, segment))
    born = judged.where(F.col("outcome").isin("new", "superseded"))
    touch = judged.select(
        F.when(F.col("outcome") == "confirmed", F.col("held")).when(F.col("outcome") != "contradicted", F.col("fact_id")).alias("fact_id"),
        "confidence", "seq", "at",
    ).where("fact_id IS NOT NULL")
    kept = touch.groupBy("fact_id").agg(F.max("confidence").alias("confidence"), F.max_by("at", "seq").alias("last_confirmed_at"))
    after = judged.where("outcome = 'superseded'").select(F.col("held").alias("fact_id"), F.col("fact_id").alias("superseded_by"))
    facts = (
        born.select("fact_id", *SCOPE_KEY, "kind", "value", "source", F.col("at").alias("created_at"))
        .join(kept, "fact_id").join(after, "fact_id", "left")
    )
    contradictions = judged.where("outcome = 'contradicted'").select(
        "seq", F.col("held").alias("fact_id"), F.col("value").alias("proposed"), F.col("source").alias("proposed_source")
    )
    return facts, contradictions


def live_facts(facts: DataFrame) -> DataFrame:
    """The believed fact per key and scope (a NULL scope reference is a scope of its own)."""
    return first_rows(
        facts.where("superseded_by IS NULL"), list(SCOPE_KEY), [F.col("last_confirmed_at").desc(), F.col("fact_id")], 1
    )


def fact_history(facts: DataFrame, key: str) -> DataFrame:
    return facts.where(F.col("key") == key).orderBy(F.col("created_at").desc(), "fact_id")


def with_staleness(facts: DataFrame, now: Column) -> DataFrame:
    """Adds ``stale`` and ``effective_confidence``; an unreadable stamp is not stale."""
    age = F.unix_micros(now) - F.unix_micros(tx.iso_timestamp(F.col("last_confirmed_at")))
    stale = F.coalesce(age >= STALE_AFTER_DAYS * 86_400_000_000, F.lit(False))
    worth = F.when(stale, F.col("confidence") * STALE_MULTIPLIER).otherwise(F.col("confidence"))
    return facts.withColumn("stale", stale).withColumn("effective_confidence", F.round(worth, 3))


def count_hits(facts: DataFrame, uses: DataFrame) -> DataFrame:
    """{fact_id, hit_count} after adding {fact_id} uses."""
    n = uses.groupBy("fact_id").agg(F.count(F.lit(1)).alias("_n"))
    return facts.select("fact_id").join(n, "fact_id", "left").select("fact_id", F.coalesce("_n", F.lit(0)).alias("hit_count"))


# ---------------------------------------------------------------------------- attempts


def _word_sets(df: DataFrame, ident: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, ident, F.array_sort(tx.goal_words(F.col("goal"))).alias("words")).where(F.size("words") > 0)


def match_attempts(
    goals: DataFrame,
    attempts: DataFrame,
    threshold: float = MATCH_THRESHOLD,
    limit: int = MATCH_LIMIT,
    by: list[str] | None = None,
) -> DataFrame:
    """{goal_id, attempt_id, score, rank}: prior attempts at the same task by word overlap.

    Similarity depends on the word set alone, so equal sets are compared once, and of equal
    attempts only the newest ``limit`` can ever be shown.  Candidate pairs come from an
    equi-join on each set's rarest words: two sets that overlap enough must share one of their
    first n - ceil(t n) + 1 words in rarity order (prefix filtering, Chaudhuri et al., ICDE 2006).
    """
    by = by or []
    g, a = _word_sets(goals, "goal_id", by), _word_sets(attempts.select(*by, "attempt_id", "goal", "at"), "attempt_id", [*by, "at"])
    top = first_rows(a, [*by, "words"], [F.col("at").desc(), F.col("attempt_id").desc()], limit)
    gs, sets = g.select(*by, "words").distinct(), a.select(*by, "words").distinct()
    df = sets.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("_df"))

    def prefixes(s: DataFrame, name: str) -> DataFrame:
        words = s.select(*by, "words", F.explode("words").alias("w")).join(df, "w", "left")
        ordered = words.groupBy(*by, "words").agg(
            F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("f"), "w"))).alias("_o")
        )
        n = F.size("_o")
        take = n - F.ceil(n * F.lit(threshold) - 1e-9) + 1
        return ordered.select(*by, F.col("words").alias(name), F.explode(F.slice("_o", F.lit(1), take.cast("int"))).alias("_p")).select(*by, name, "_p.w")

    size = F.size("_g") / F.size("_a")
    pairs = (
        prefixes(gs, "_g").join(prefixes(sets, "_a"), [*by, "w"])
        .where((size >= threshold - 1e-9) & (size <= 1 / threshold + 1e-9))
        .select(*by, "_g", "_a").distinct()
        .withColumn("score", F.size(F.array_intersect("_g", "_a")) / F.size(F.array_union("_g", "_a")))
        .where(F.col("score") >= threshold)
    )
    best = pairs.join(top.withColumnRenamed("words", "_a"), [*by, "_a"]).select(*by, F.col("_g").alias("words"), "attempt_id", "at", "score")
    order = [F.col("score").desc(), F.col("at").desc(), F.col("attempt_id").desc()]
    shown = first_rows(best, [*by, "words"], order, limit, "rank")
    return g.join(shown, [*by, "words"]).select("goal_id", "attempt_id", F.round("score", 6).alias("score"), "rank")


def prior_attempts(goals: DataFrame, attempts: DataFrame, pool: int | None = None, limit: int = MATCH_LIMIT) -> DataFrame:
    """{goal_id, attempt_id, how, rank}: exact signature first; otherwise the closest of
    the project's attempts (of the newest ``pool``, if given)."""
    g = goals.withColumn("signature", tx.goal_signature(F.col("goal"), F.col("project")))
    a = attempts.withColumn("signature", tx.goal_signature(F.col("goal"), F.col("project")))
    newest = first_rows(a, ["project", "signature"], [F.col("at").desc(), F.col("attempt_id").desc()], limit, "rank")
    exact = g.select("goal_id", "project", "signature").join(
        newest.select("project", "signature", "attempt_id", "rank"), ["project", "signature"]
    ).select("goal_id", "attempt_id", F.lit("exact").alias("how"), "rank")
    recent = a if pool is None else first_rows(a, ["project"], [F.col("at").desc(), F.col("attempt_id").desc()], pool)
    rest = g.join(exact.select("goal_id").distinct(), "goal_id", "left_anti")
    fuzzy = match_attempts(rest, recent, limit=limit, by=["project"])
    return exact.unionByName(fuzzy.select("goal_id", "attempt_id", F.lit("fuzzy").alias("how"), "rank"))


def attempts_from_tasks(tasks: DataFrame) -> DataFrame:
    """{task_id, signature, goal, project, approach, agent, outcome, what_failed, files} of finished tasks."""
    s = F.col("status")
    outcome = F.when(s == "succeeded", "success").when(s.isin("cancelled", "skipped"), "abandoned").otherwise("failure")
    goal, project, role = json_text("spec", "objective"), json_text("spec", "project"), json_text("spec", "role")
    measured = F.array_join(
        F.array_compact(
            F.array(*[F.concat(F.lit(f"{k}="), json_text("result", f"evidence.{k}")) for k in MEASURED])
        ),
        ", ",
    )
    none = F.lit(None).cast("string")
    approach = F.concat_ws(
        "; ",
        F.when(F.coalesce(role, F.lit("")) != "", F.concat(F.lit("asked a "), role, F.lit(" to: "), F.coalesce(goal, F.lit("")))),
        F.when(F.coalesce(json_text("result", "summary"), F.lit("")) != "", json_text("result", "summary")),
        F.when(measured != "", F.concat(F.lit("measured "), measured)).otherwise(none),
    )
    branch = json_text("result", "evidence.branch")
    files = F.coalesce(
        F.from_json(json_text("result", "evidence.files_touched"), "array<string>"),
        F.from_json(json_text("result", "evidence.files"), "array<string>"),
        F.when(F.coalesce(branch, F.lit("")) != "", F.array(F.concat(F.lit("branch:"), branch))),
        F.array().cast("array<string>"),
    )
    return tasks.where(s.isin("succeeded", "failed", "timeout", "skipped", "cancelled")).select(
        F.col("id").alias("task_id"),
        tx.goal_signature(F.coalesce(goal, F.lit("")), project).alias("signature"),
        F.coalesce(goal, F.lit("")).alias("goal"), F.coalesce(project, F.lit("")).alias("project"),
        approach.alias("approach"), F.coalesce(F.col("agent"), F.lit("")).alias("agent"), outcome.alias("outcome"),
        F.when(outcome != "success", json_text("result", "error.message")).alias("what_failed"), files.alias("files"),
    )


def memory_band(requests: DataFrame, live: DataFrame, prior: DataFrame) -> DataFrame:
    """{request, part, position, id}: preferences, global facts, project facts and attempts.

    ``requests`` is {request, project}; ``live`` the believed facts; ``prior`` {goal_id,
    attempt_id, rank} with the request as goal.  The unscoped parts are the same few rows for
    every request, so they travel as one row.
    """
    live = save_point(live)
    order = [F.col("last_confirmed_at").desc(), F.col("fact_id")]

    def few(df: DataFrame, part: str, n: int) -> DataFrame:
        head = df.orderBy(*order).limit(n)
        ranked = F.transform(
            F.array_sort(F.collect_list(F.struct("last_confirmed_at", "fact_id")), lambda x, y: F.when(x["last_confirmed_at"] > y["last_confirmed_at"], -1)
                .when(x["last_confirmed_at"] < y["last_confirmed_at"], 1).when(x["fact_id"] < y["fact_id"], -1).when(x["fact_id"] > y["fact_id"], 1).otherwise(0)),
            lambda x, i: F.struct(F.lit(part).alias("part"), (i + 1).cast("long").alias("position"), x["fact_id"].alias("id")),
        )
        return head.agg(ranked.alias(part))

    prefs = few(live.where("kind = 'preference'"), "preferences", MAX_PREFERENCES)
    global_ = few(live.where("kind = 'fact' AND scope = 'global'"), "global", MAX_FACTS)
    shared = attach_row(attach_row(requests, prefs), global_).select(
        "request", F.explode(F.concat("preferences", "global")).alias("_i")
    ).select("request", "_i.part", "_i.position", "_i.id")
    scoped = first_rows(live.where("kind = 'fact' AND scope = 'project'"), ["scope_ref"], order, MAX_FACTS, "position")
    own = requests.join(scoped, F.col("project") == F.col("scope_ref")).select(
        "request", F.lit("project").alias("part"), "position", F.col("fact_id").alias("id")
    )
    tried = prior.where(F.col("rank") <= MATCH_LIMIT).select(
        F.col("goal_id").alias("request"), F.lit("attempts").alias("part"), F.col("rank").alias("position"),
        F.col("attempt_id").cast("string").alias("id"),
    )
    return shared.unionByName(own).unionByName(tried)
