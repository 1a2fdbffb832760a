"""Task-graph analytics over many graphs at once.

``tasks`` is {root_id, id, status, …}; ``edges`` is {root_id, task, dep} (a task and one thing it
waits for).  Graphs proven small are walked inside one task each; larger ones go through
distributed rounds whose intermediate tables are saved, so no graph is ever too big for a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreworks.functions.text import iso_seconds
from loreworks.operators.projects import FAILED, TERMINAL, json_text
from loreworks.operators.scale import first_rows, map_groups
from loreworks.session import save_point

# Graph size limit, replanning rules, default ceilings, ordering of states.
MAX_GRAPH_SIZE, REPLAN_BUDGET = 12, 2
HUMAN_DECISIONS = (
    "denied", "refused", "expired", "halted", "cancelled", "approval_required", "approval_invalid", "interrupted",
)
AGGREGATE_ORDER = (
    "cancelled", "failed", "timeout", "running", "waiting", "ready", "pending", "skipped", "succeeded",
)
TIMEOUT_S = {"tool": 120.0, "verify": 900.0, "report": 120.0, "planning": 600.0, "delegation": 3600.0}
COST_ORDER = {"free": 0, "subscription": 1, "quota": 2, "metered": 3}
REPORTED = (
    "outcome", "exit_code", "diff_lines", "untracked", "branch", "harvest_commit", "observed", "baseline",
    "new_failures", "fixed", "delta_passed", "verified", "ran",
)
SMALL_GRAPH = 5_000


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def by_size(edges: DataFrame, limit: int = SMALL_GRAPH) -> tuple[DataFrame, DataFrame, bool]:
    """(edges of small graphs, edges of large ones, whether any is large)."""
    sizes = edges.groupBy("root_id").agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    if most <= limit:
        return edges, edges.limit(0), False
    large = save_point(sizes.where(F.col("_n") > limit).select("root_id"))
    return edges.join(large, "root_id", "left_anti"), edges.join(large, "root_id", "left_semi"), True


# --------------------------------------------------------------------------- validation


def graph_problems(
    graphs: DataFrame, planned: DataFrame, edges: DataFrame, roles: DataFrame, holders: DataFrame, projects: DataFrame,
    agents: DataFrame, limit: int = MAX_GRAPH_SIZE,
) -> DataFrame:
    """{graph, task, problem}: everything that keeps a plan from being scheduled.

    ``graphs`` {graph}; ``planned`` {graph, task, root, role, outcome, project, hint, acceptance};
    ``edges`` {graph, task, dep}; ``roles`` {role, deterministic}; ``holders`` {role};
    ``projects`` {project}; ``agents`` {agent}.
    """
    none = F.lit(None).cast(planned.schema["task"].dataType)
    count = planned.groupBy("graph").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("_r0"), F.max("root").alias("_r1")
    )
    ids = planned.select("graph", F.col("task").alias("dep")).distinct()
    per_role = roles.select("role", "deterministic", F.lit(True).alias("_known")).join(
        holders.select("role").distinct().withColumn("_held", F.lit(True)), "role", "left"
    )
    each = (
        planned.join(per_role, "role", "left")
        .join(projects.select("project").distinct().withColumn("_p", F.lit(True)), "project", "left")
        .join(agents.select(F.col("agent").alias("hint")).distinct().withColumn("_h", F.lit(True)), "hint", "left")
    )
    known, fixed = F.coalesce("_known", F.lit(False)), F.coalesce("deterministic", F.lit(False))
    faults = F.array_compact(
        F.array(
            F.when(~known, "unknown role"),
            F.when(known & fixed & (F.col("outcome") != "verdict"), "deterministic role needs a verdict"),
            F.when(known & ~fixed & F.col("_held").isNull(), "role without holder"),
            F.when(F.col("project").isNotNull() & F.col("_p").isNull(), "unknown project"),
            F.when(F.col("hint").isNotNull() & F.col("_h").isNull(), "unknown agent hint"),
            F.when((F.col("outcome") == "diff") & (F.col("acceptance") == 0), "diff without acceptance"),
        )
    )
    one = lambda df, task, text: df.select("graph", task.alias("task"), F.lit(text).alias("problem"))
    parts = [
        one(graphs.join(count, "graph", "left_anti"), none, "empty"),
        one(planned.groupBy("graph", "task").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1"), F.col("task"), "duplicate id"),
        one(count.where(F.col("n") > limit), none, "too large"),
        one(edges.join(ids, ["graph", "dep"], "left_anti").select("graph", "task").distinct(), F.col("task"), "unknown dependency"),
        one(edges.where("task = dep").select("graph", "task").distinct(), F.col("task"), "depends on itself"),
        one(count.where("_r0 <> _r1"), none, "several roots"),
        each.select("graph", "task", F.explode(faults).alias("problem")).distinct(),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def find_cycles(edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """{root_id, path}: one cycle per graph that has any, as ids from its smallest, closed.

    Tasks that cannot reach a cycle are peeled off; every other task then follows its smallest
    remaining dependency, which must end in a cycle, and the one with the smallest id is given.
    """
    few, many, any_large = by_size(edges.distinct(), small)
    id_type = edges.schema["dep"].dataType
    schema = T.StructType([edges.schema["root_id"], T.StructField("path", T.ArrayType(id_type))])

    def walk(pairs: list[tuple]) -> list[tuple]:
        after: dict = {}
        for task, dep in pairs:
            after.setdefault(task, set()).add(dep)
        while dead := [t for t, deps in after.items() if not deps & after.keys()]:
            for t in dead:
                del after[t]
        step = {t: min(deps & after.keys()) for t, deps in after.items()}
        done: set = set()
        best = None
        for start in sorted(step):
            trail: list = []
            at = start
            while at not in done and at not in trail:
                trail.append(at)
                at = step[at]
            if at in trail:
                ring = trail[trail.index(at) :]
                first = ring.index(min(ring))
                ring = ring[first:] + ring[:first]
                if best is None or ring[0] < best[0]:
                    best = ring
            done.update(trail)
        return [([*best, best[0]],)] if best else []

    found = map_groups(few, ["root_id"], ["task", "dep"], walk, ["task", "dep"], schema)
    return found.unionByName(_large_cycles(many)) if any_large else found


def _large_cycles(edges: DataFrame) -> DataFrame:
    """The same for graphs too large for one task: peeling, then pointer doubling."""
    left = save_point(edges)
    n = left.count()
    while True:
        alive = left.select("root_id", F.col("task").alias("dep")).distinct()
        kept = save_point(left.join(alive, ["root_id", "dep"], "left_semi").select("root_id", "task", "dep"))
        m = kept.count()
        left = kept
        if m == n:
            break
        n = m
    step = left.groupBy("root_id", "task").agg(F.min("dep").alias("to"))
    nodes = step.count()
    # after 2^k >= nodes steps every walk stands on its cycle; ``low`` is the least id seen on
    # the way, which on a cycle is the least id of the cycle
    jump = save_point(step.withColumn("low", F.least("task", "to")))
    reach = 1
    while reach < max(nodes, 1):
        nxt = jump.select("root_id", F.col("task").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        jump = save_point(
            jump.join(nxt, ["root_id", "to"]).select("root_id", "task", F.col("_to").alias("to"), F.least("low", "_low").alias("low"))
        )
        reach *= 2
    on_cycle = jump.select("root_id", F.col("to").alias("task")).distinct()
    ring = step.join(on_cycle, ["root_id", "task"], "left_semi")
    ring = save_point(ring.join(jump.select("root_id", "task", "low"), ["root_id", "task"]))
    first = ring.groupBy("root_id").agg(F.min("low").alias("low"))
    ring = save_point(ring.join(first, ["root_id", "low"]).select("root_id", "low", "task", "to"))
    # distance to the closing id, doubled the same way
    dist = save_point(ring.select("root_id", "low", "task", "to", F.lit(1).cast("long").alias("d"), (F.col("to") == F.col("low")).alias("end")))
    reach = 1
    size = max(ring.count(), 1)
    while reach < size:
        nxt = dist.select("root_id", F.col("task").alias("to"), F.col("to").alias("_to"), F.col("d").alias("_d"), F.col("end").alias("_end"))
        dist = save_point(
            dist.join(nxt, ["root_id", "to"]).select(
                "root_id", "low", "task",
                F.when(F.col("end"), F.col("to")).otherwise(F.col("_to")).alias("to"),
                F.when(F.col("end"), F.col("d")).otherwise(F.col("d") + F.col("_d")).alias("d"),
                (F.col("end") | F.col("_end")).alias("end"),
            )
        )
        reach *= 2
    ordered = dist.groupBy("root_id", "low").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("o"), "task"))), lambda s: s["task"]).alias("_p")
    )
    return ordered.select("root_id", F.array_append("_p", F.col("low")).alias("path"))


# -------------------------------------------------------------------------- the algebra


def _with_status(edges: DataFrame, tasks: DataFrame) -> DataFrame:
    deps = tasks.select("root_id", F.col("id").alias("dep"), F.col("status").alias("dep_status"))
    return edges.join(deps, ["root_id", "dep"], "left")


def ready(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending tasks whose every dependency succeeded."""
    unmet = _with_status(edges, tasks).where(~F.col("dep_status").eqNullSafe("succeeded"))
    held = unmet.select("root_id", F.col("task").alias("id")).distinct()
    return tasks.where("status = 'pending'").join(held, ["root_id", "id"], "left_anti").select("root_id", "id")


def blocked(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending tasks with a dependency that ended in anything but success."""
    bad = [s for s in TERMINAL if s != "succeeded"]
    dead = _with_status(edges, tasks).where(F.col("dep_status").isin(*bad)).select("root_id", F.col("task").alias("id")).distinct()
    return tasks.where("status = 'pending'").select("root_id", "id").join(dead, ["root_id", "id"], "left_semi")


def skip_cascade(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """{root_id, id, round}: pending tasks that are skipped, and in which round.

    Only the edges between pending tasks are followed after the first round, so the work per
    round is the frontier and the number of rounds is the longest chain of pending tasks.
    """
    pending = tasks.where("status = 'pending'").select("root_id", F.col("id").alias("task"))
    inner = save_point(
        edges.join(pending, ["root_id", "task"], "left_semi")
        .join(pending.select("root_id", F.col("task").alias("dep")), ["root_id", "dep"], "left_semi")
        .select("root_id", "task", "dep")
    )
    done = save_point(blocked(tasks, edges).withColumn("round", F.lit(1).cast("long")))
    frontier, n = done, 1
    while frontier.limit(1).collect():
        n += 1
        nxt = (
            inner.join(frontier.select("root_id", F.col("id").alias("dep")), ["root_id", "dep"], "left_semi")
            .select("root_id", F.col("task").alias("id")).distinct()
            .join(done.select("root_id", "id"), ["root_id", "id"], "left_anti")
            .withColumn("round", F.lit(n).cast("long"))
        )
        frontier = save_point(nxt)
        done = save_point(done.unionByName(frontier))
    return done


def dependents(edges: DataFrame) -> DataFrame:
    """{root_id, id, dependents}."""
    return edges.groupBy("root_id", F.col("dep").alias("id")).agg(F.count_distinct("task").alias("dependents"))


def root_progress(tasks: DataFrame) -> DataFrame:
    """{root_id, tasks, active, done}."""
    live = F.count_if(~F.col("status").isin(*TERMINAL))
    return tasks.groupBy("root_id").agg(F.count(F.lit(1)).alias("tasks"), live.alias("active"), (live == 0).alias("done"))


def root_status(tasks: DataFrame) -> DataFrame:
    """{root_id, status}: the worst state by precedence."""
    rank = F.try_element_at(_map({s: i for i, s in enumerate(AGGREGATE_ORDER)}), F.col("status"))
    return tasks.groupBy("root_id").agg(F.min_by("status", rank).alias("status"))


def longest_path_rank(tasks: DataFrame, edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """{root_id, id, column}: length of the longest dependency chain below each task.

    Unknown dependencies are ignored.  Tasks on a cycle, and those that depend on one, have no such length: they stand
    together in the column behind all others of their root (see :func:`find_cycles`).
    """
    ids = tasks.select("root_id", F.col("id").alias("dep"))
    known = (
        edges.select("root_id", "task", "dep").distinct()
        .join(ids, ["root_id", "dep"], "left_semi")
        .join(ids.select("root_id", F.col("dep").alias("task")), ["root_id", "task"], "left_semi")
        .select("root_id", "task", "dep")
    )
    few, many, any_large = by_size(known, small)
    id_type = tasks.schema["id"].dataType
    schema = T.StructType([edges.schema["root_id"], T.StructField("id", id_type), T.StructField("column", T.LongType())])

    def rank(pairs: list[tuple]) -> list[tuple]:
        deps: dict = {}
        for task, dep in pairs:
            deps.setdefault(task, []).append(dep)
        level: dict = {}
        waiting = list(deps)
        while waiting:
            held = [t for t in waiting if any(d in deps and d not in level for d in deps[t])]
            if len(held) == len(waiting):
                last = 1 + max(level.values(), default=0)
                level.update({t: last for t in held})
                break
            free = set(waiting) - set(held)
            level.update({t: 1 + max(level.get(d, 0) for d in deps[t]) for t in free})
            waiting = held
        return list(level.items())

    ranks = map_groups(few, ["root_id"], ["task", "dep"], rank, ["task", "dep"], schema)
    if any_large:
        ranks = ranks.unionByName(_large_ranks(many))
    return tasks.select("root_id", "id").join(ranks, ["root_id", "id"], "left").select(
        "root_id", "id", F.coalesce("column", F.lit(0)).alias("column")
    )


def _large_ranks(edges: DataFrame) -> DataFrame:
    """Ranks by peeling: each round places the tasks whose dependencies are all placed; what never is, is cyclic."""
    left = save_point(edges)
    placed = None
    n = 0
    while left.limit(1).collect():
        n += 1
        waiting = left.select("root_id", F.col("task").alias("dep")).distinct()
        held = left.join(waiting, ["root_id", "dep"], "left_semi").select("root_id", "task").distinct()
        now = save_point(
            left.select("root_id", "task").distinct().join(held, ["root_id", "task"], "left_anti")
            .select("root_id", F.col("task").alias("id"), F.lit(n).cast("long").alias("column"))
        )
        if now.isEmpty():
            cyclic = left.select("root_id", F.col("task").alias("id")).distinct()
            if placed is None:
                return cyclic.withColumn("column", F.lit(1).cast("long"))
            last = placed.groupBy("root_id").agg(F.max("column").alias("_last"))
            behind = cyclic.join(last, "root_id", "left").select("root_id", "id", (F.coalesce("_last", F.lit(0)) + 1).cast("long").alias("column"))
            return placed.unionByName(behind)
        left = save_point(left.join(now.select("root_id", F.col("id").alias("task")), ["root_id", "task"], "left_anti"))
        placed = now if placed is None else placed.unionByName(now)
    return placed


def graph_shape(ranks: DataFrame) -> DataFrame:
    """{root_id, depth, width}."""
    per = ranks.groupBy("root_id", "column").agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy("root_id").agg((F.max("column") + 1).alias("depth"), F.max("_n").alias("width"))


# --------------------------------------------------------------------------- replanning


def replan_eligibility(tasks: DataFrame, budget: int = REPLAN_BUDGET) -> DataFrame:
    """{root_id, id, eligible, reason}: the first rule that refuses, or none."""
    used = tasks.where("supersedes IS NOT NULL").groupBy("root_id").agg(F.count_distinct("supersedes").alias("_used"))
    again = tasks.where("supersedes IS NOT NULL").select("root_id", F.col("supersedes").alias("id")).distinct().withColumn("_again", F.lit(True))
    reason = (
        F.when(~F.col("status").isin(*FAILED), "not a failure")
        .when(F.col("kind") == "planning", "planning is not replanned")
        .when(json_text("result", "error.kind").isin(*HUMAN_DECISIONS), "a decision")
        .when(F.col("_again"), "already replanned")
        .when(F.coalesce("_used", F.lit(0)) >= budget, "budget spent")
    )
    return (
        tasks.join(again, ["root_id", "id"], "left").join(used, "root_id", "left")
        .withColumn("reason", reason)
        .select("root_id", "id", F.col("reason").isNull().alias("eligible"), "reason")
    )


def attempts_report(tasks: DataFrame) -> DataFrame:
    """{root_id, replans_used, failures, skipped, partials} — counts per root."""
    return tasks.groupBy("root_id").agg(
        F.count_distinct("supersedes").alias("replans_used"),
        F.count_if(F.col("status").isin(*FAILED)).alias("failures"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.coalesce(json_text("result", "evidence.branch"), json_text("result", "evidence.workspace"), F.lit("")) != "").alias("partials"),
    )


def attempts_detail(tasks: DataFrame) -> DataFrame:
    """{root_id, id, part, text}: the failed attempts, skipped tasks and partial results themselves."""
    branch = json_text("result", "evidence.branch")
    message = F.coalesce(json_text("result", "error.message"), json_text("result", "summary"), F.lit(""))
    parts = F.array_compact(
        F.array(
            F.when(F.col("status").isin(*FAILED), F.struct(F.lit("attempt").alias("part"), message.alias("text"))),
            F.when(F.col("status") == "skipped", F.struct(F.lit("skipped").alias("part"), F.lit("").alias("text"))),
            F.when(F.coalesce(branch, F.lit("")) != "", F.struct(F.lit("partial").alias("part"), branch.alias("text"))),
        )
    )
    return tasks.select("root_id", "id", F.explode(parts).alias("_p")).select("root_id", "id", "_p.part", "_p.text")


def recovery_view(tasks: DataFrame) -> DataFrame:
    """Unfinished tasks after a crash: running ones become failed (interrupted), others stay."""
    ran = F.col("status") == "running"
    return tasks.where(~F.col("status").isin(*TERMINAL)).select(
        "root_id", "id", F.when(ran, "failed").otherwise(F.col("status")).alias("status"),
        F.when(ran, "interrupted").alias("error_kind"), F.when(ran, F.col("started_at")).alias("interrupted_at"),
    )


def overdue(tasks: DataFrame, now: Column, defaults: dict[str, float] | None = None) -> DataFrame:
    """{id, ceiling, overdue} of running tasks; a task's own ceiling beats its kind's."""
    own = F.col("timeout_s") if "timeout_s" in tasks.columns else F.lit(None).cast("double")
    ceiling = F.coalesce(own, F.try_element_at(_map(defaults or TIMEOUT_S), F.col("kind")))
    spent = F.unix_micros(now) / F.lit(1e6) - iso_seconds(F.col("started_at"))
    return tasks.where("status = 'running'").select(
        "id", ceiling.alias("ceiling"), F.coalesce(spent > ceiling, F.lit(False)).alias("overdue")
    )


def rank_executors(roles: DataFrame, agents: DataFrame, defaults: DataFrame, n: int | None = None) -> DataFrame:
    """{role, agent, rank}: the stated default first if it still holds the role, then by cost.

    All who hold the role are ranked; ``n`` keeps the first ``n``.

    ``roles`` {role, outcome}; ``agents`` {agent, role, cost, read_only}; ``defaults`` {role, agent}.
    """
    able = agents.join(roles, "role").where(~((F.col("outcome") == "diff") & F.col("read_only")))
    stated = defaults.select("role", F.col("agent").alias("_d"))
    cost = F.coalesce(F.try_element_at(_map(COST_ORDER), F.col("cost")), F.lit(9))
    order = [F.coalesce(F.col("agent") == F.col("_d"), F.lit(False)).desc(), cost, F.col("agent")]
    held = able.join(stated, "role", "left")
    if n is not None:
        return first_rows(held, ["role"], order, n, "rank").select("role", "agent", "rank")
    rank = F.row_number().over(Window.partitionBy("role").orderBy(*order)).cast("long")
    return held.select("role", "agent", rank.alias("rank"))


def overridden_hints(planned: DataFrame, agents: DataFrame) -> DataFrame:
    """{task, role, hinted, chosen, reason} for hints that were not honoured.

    ``agents`` has one row per (agent, role).
    """
    ignored = planned.where("hint IS NOT NULL AND NOT (hint <=> chosen)")
    about = agents.groupBy(F.col("agent").alias("hint")).agg(
        F.bool_or("read_only").alias("_ro"), F.max("locality").alias("_loc"), F.lit(True).alias("_known")
    )
    holds = agents.select(F.col("agent").alias("hint"), "role").distinct().withColumn("_holds", F.lit(True))
    reason = (
        F.when(F.col("_known").isNull(), "not a registered agent")
        .when(F.col("_holds").isNull(), "does not hold the role")
        .when(F.col("_ro"), "read-only")
        .when((F.col("_loc") == "local") & F.col("kind").isNotNull(), "a local model")
        .otherwise("not honoured")
    )
    return (
        ignored.join(about, "hint", "left").join(holds, ["hint", "role"], "left")
        .select("task", "role", F.col("hint").alias("hinted"), "chosen", reason.alias("reason"))
    )


def task_tree(tasks: DataFrame) -> DataFrame:
    """{root_id, id, status, created_at, root_status} for every root, in creation order."""
    return tasks.select("root_id", "id", "status", "created_at").join(
        root_status(tasks).withColumnRenamed("status", "root_status"), "root_id"
    )


def evidence_report(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """{task, dep, dep_status, summary, key, value}: allow-listed measurements of dependencies.

    Only the named keys are read, so a worker's own claim cannot slip in.  A dependency without
    any measurement gives one row with a NULL key.
    """
    report = tasks.where("kind = 'report'").select("root_id", F.col("id").alias("task"))
    facts = F.filter(
        F.array(
            *[
                F.struct(F.lit(k).alias("key"), json_text("result", f"evidence.{k}").alias("value"))
                for k in REPORTED
            ]
        ),
        lambda f: f["value"].isNotNull(),
    )
    deps = tasks.select(
        "root_id", F.col("id").alias("dep"), F.col("status").alias("dep_status"),
        F.coalesce(json_text("result", "summary"), F.lit("")).alias("summary"), facts.alias("_f"),
    )
    return (
        edges.join(report, ["root_id", "task"]).join(deps, ["root_id", "dep"])
        .select("task", "dep", "dep_status", "summary", F.explode_outer("_f").alias("_e"))
        .select("task", "dep", "dep_status", "summary", "_e.key", "_e.value")
    )

