"""Line-oriented sources: audit logs, agent transcripts, commit logs, evaluation cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreworks.operators.events import is_critical
from loreworks.operators.redaction import redact_payloads
from loreworks.operators.scale import dense_number

# ------------------------------------------------------------------------------- lines


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """{file, line_no, raw}: text lines with a number that grows with their place in the file.

    A large file is read in blocks by several tasks.  A line's number is its block's first byte
    plus its position in the block; a block never has more lines than bytes, so the numbers
    keep the order of the file without any task seeing all of it (they are not consecutive).
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"), F.col("value").alias("raw"),
    )
    first = lines.groupBy("file", "_b").agg(F.min("_m").alias("_m0"))
    return lines.join(first, ["file", "_b"]).select(
        "file", (F.col("_b") + F.col("_m") - F.col("_m0")).alias("line_no"), "raw"
    )


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """{log_id, line_no, raw}, one log per file; blank lines are dropped."""
    return read_lines(spark, path).where(F.trim("raw") != "").withColumnRenamed("file", "log_id")


# ------------------------------------------------------------------------- transcripts

_EVENT = (
    "type string, subtype string, session_id string, model string, error string, is_error boolean, result string, "
    "parent_tool_use_id string, is_api_error_message boolean, mcp_server_errors array<string>, plugin_errors array<string>, "
    "total_cost_usd double, duration_ms long, num_turns long, "
    "message struct<content: array<struct<type: string, text: string, thinking: string, name: string>>>"
)


def parse_transcripts(lines: DataFrame) -> DataFrame:
    """{run, line_no, bad, e}: parsed lines up to and with the first ``result`` of each run."""
    parsed = lines.where(F.trim("raw") != "").select(
        "run", "line_no", F.try_parse_json("raw").isNull().alias("bad"), F.from_json("raw", _EVENT).alias("e")
    )
    ends = parsed.where(F.col("e.type") == "result").groupBy("run").agg(F.min("line_no").alias("_end"))
    return parsed.join(ends, "run", "left").where(F.col("_end").isNull() | (F.col("line_no") <= F.col("_end"))).drop("_end")


def transcript_events(lines: DataFrame) -> DataFrame:
    """{run, line_no, part, kind, text, tool, from_subagent} of {run, line_no, raw}."""
    e = F.col("e")
    problems = F.concat(
        F.coalesce(e["mcp_server_errors"], F.array().cast("array<string>")),
        F.coalesce(e["plugin_errors"], F.array().cast("array<string>")),
    )
    none = F.lit(None).cast("string")

    def one(kind, text, tool=none, sub=F.lit(False)):
        return F.struct(
            F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"),
            text.alias("text"), tool.alias("tool"), sub.alias("from_subagent"),
        )

    content = F.coalesce(e["message"]["content"], F.array().cast("array<struct<type:string,text:string,thinking:string,name:string>>"))
    said = F.array_join(F.transform(F.filter(content, lambda c: c["type"] == "text"), lambda c: F.coalesce(c["text"], F.lit(""))), " ")
    sub = e["parent_tool_use_id"].isNotNull()
    pieces = F.transform(
        F.filter(
            content,
            lambda c: ((c["type"] == "text") & (F.coalesce(c["text"], F.lit("")) != ""))
            | ((c["type"] == "thinking") & (F.coalesce(c["thinking"], F.lit("")) != ""))
            | (c["type"] == "tool_use"),
        ),
        lambda c: one(
            c["type"],
            F.when(c["type"] == "text", c["text"]).when(c["type"] == "thinking", c["thinking"]).otherwise(""),
            F.when(c["type"] == "tool_use", F.coalesce(c["name"], F.lit("?"))),
            sub,
        ),
    )
    init = (e["type"] == "system") & (e["subtype"] == "init")
    events = (
        F.when(init & (F.size(problems) > 0), F.array(one("error", F.array_join(problems, "; "))))
        .when(init, F.array(one("started", F.coalesce(e["model"], F.lit("")))))
        .when((e["type"] == "system") & (e["subtype"] == "api_retry"), F.array(one("retrying", F.coalesce(e["error"], F.lit("")))))
        .when(
            (e["type"] == "assistant") & F.coalesce(e["is_api_error_message"], F.lit(False)),
            F.array(one("error", F.when(said != "", said).otherwise(F.coalesce(e["error"], F.lit("unknown error"))))),
        )
        .when(e["type"] == "assistant", pieces)
        .when(
            e["type"] == "result",
            F.array(one(F.when(F.coalesce(e["is_error"], F.lit(False)), "error").otherwise("finished"), F.coalesce(e["result"], F.lit("")))),
        )
    )
    return parse_transcripts(lines).where("NOT bad").select("run", "line_no", F.posexplode(events).alias("part", "_v")).select(
        "run", "line_no", F.col("part").cast("long").alias("part"), "_v.kind", "_v.text", "_v.tool", "_v.from_subagent"
    )


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return transcript_events(read_lines(spark, path).withColumnRenamed("file", "run"))


def transcript_summary(lines: DataFrame, exits: DataFrame) -> DataFrame:
    """{run, success, cost_usd, duration_ms, num_turns, session_id, bad_lines}.

    ``exits`` is {run, exit_code}.  Success needs exit 0, a result that is no error, and an
    initialisation without problems.
    """
    e = F.col("e")
    done = e["type"] == "result"
    init = (e["type"] == "system") & (e["subtype"] == "init")
    broken = init & (
        F.size(F.coalesce(e["mcp_server_errors"], F.array().cast("array<string>")))
        + F.size(F.coalesce(e["plugin_errors"], F.array().cast("array<string>"))) > 0
    )
    per = parse_transcripts(lines).groupBy("run").agg(
        F.coalesce(F.bool_or(done), F.lit(False)).alias("_has"),
        F.coalesce(F.bool_or(done & F.coalesce(e["is_error"], F.lit(False))), F.lit(False)).alias("_err"),
        F.coalesce(F.bool_or(broken), F.lit(False)).alias("_broken"),
        F.max(F.when(done, e["total_cost_usd"])).alias("cost_usd"),
        F.max(F.when(done, e["duration_ms"])).alias("duration_ms"),
        F.max(F.when(done, e["num_turns"])).alias("num_turns"),
        F.max(F.when(done, e["session_id"])).alias("_s1"),
        F.max_by(e["session_id"], F.when(init, F.col("line_no"))).alias("_s0"),
        F.count_if("bad").alias("bad_lines"),
    )
    ok = (F.col("exit_code") == 0) & F.coalesce("_has", F.lit(False)) & ~F.coalesce("_err", F.lit(False)) & ~F.coalesce("_broken", F.lit(False))
    return exits.join(per, "run", "left").select(
        "run", ok.alias("success"), "cost_usd", "duration_ms", "num_turns", F.coalesce("_s1", "_s0").alias("session_id"),
        F.coalesce("bad_lines", F.lit(0)).alias("bad_lines"),
    )


# ----------------------------------------------------------------------------- commits


def parse_commits(lines: DataFrame) -> DataFrame:
    """{sha, short, author, date, subject} of {raw}; lines without exactly five fields are dropped."""
    parts = F.split("raw", "\u001f", -1)
    return lines.select(parts.alias("_p")).where(F.size("_p") == 5).select(
        *[F.col("_p")[i].alias(n) for i, n in enumerate(("sha", "short", "author", "date", "subject"))]
    )


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    return parse_commits(spark.read.text(path).withColumnRenamed("value", "raw"))


# ------------------------------------------------------------------------------- cases

_CASE = "id string, q string, q_en string, lang string, kind string, collection string, expect_any array<string>"


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """{qid, text, text_en, lang, kind, collection, expected}: one row per accepted source.

    JSON lines are read by Spark.  A hand-written YAML file (``cases:`` with a list) is a small
    dimension by nature and is parsed once on the driver.
    """
    if path.endswith((".yaml", ".yml")):
        import yaml

        raw = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(1).collect())
        cases = [
            (str(c["id"]), c.get("q"), c.get("q_en"), c.get("lang"), c.get("kind"), c.get("collection"), [str(x) for x in c.get("expect_any", [])])
            for c in yaml.safe_load(raw)["cases"]
        ]
        table = spark.createDataFrame(cases, _CASE)
    else:
        table = spark.read.schema(_CASE).json(path)
    return table.select(
        F.col("id").alias("qid"), F.col("q").alias("text"), F.col("q_en").alias("text_en"), "lang", "kind", "collection",
        F.explode("expect_any").alias("expected"),
    )


# --------------------------------------------------------------------------- event log


def append_events(new: DataFrame, log_path: str) -> None:
    """Append events: payloads are cleaned and the critical flag is set before anything is written."""
    clean = redact_payloads(new).withColumn("critical", is_critical(F.col("type")))
    clean.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(log_path)


def compact_seq(pending: DataFrame, order: list[str], head: int = 0) -> DataFrame:
    """Gap-free sequence numbers after ``head``, in ``order``.

    Numbers are only handed out here: appends by many writers cannot agree on them.
    """
    return dense_number(pending, order, "seq", head)
