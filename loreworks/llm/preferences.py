"""Preference pairs: the longest common turn prefix as prompt, and two masked completions.

Both sides are tables of turns ``pair_id, turn, role, text``.  Turns at equal places with equal role and text
are common up to the first that differs or is missing on one side; they are rendered once, as the prompt.  The
turns from there on are rendered as that side's completion, with ``loss``: the character spans ``start-end`` of
what the assistant says, its end mark included; the rest (headers, other roles) is masked.

Only DataFrame functions are used; nothing but the turns of a pair meets in one place.

Defined cases: null role and text count as empty, and equal each other; turns without pair_id or place are left
out; of turns that repeat a place the least (by role and text) counts; a pair that one side lacks is left out;
if a side ends with the prompt its completion is empty, and ``usable`` is false (as where a completion has
nothing that the assistant says); further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreworks.operators.scale import dense_number

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def _turns(side: DataFrame, name: str) -> DataFrame:
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return side.where("pair_id is not null and turn is not null").groupBy("pair_id", "turn").agg(F.min(said).alias(name))


def _header(said: Column) -> Column:
    return F.concat(F.lit(OPEN), said["role"], F.lit("\n"))


def _body(said: Column) -> Column:
    return F.concat(said["text"], F.lit(CLOSE + "\n"))


def _completion(turns: Column) -> tuple[Column, Column]:
    """Text of sorted turns, and the spans of it that count."""
    text = F.array_join(F.transform(turns, lambda t: F.concat(_header(t["said"]), _body(t["said"]))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_header(t["said"]))
        end = begin + F.length(_body(t["said"]))
        span = F.concat_ws("-", begin, end)
        counts = t["said"]["role"] == ASSISTANT
        return F.struct(end.alias("at"), F.when(counts, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return text, F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``pair_id, prompt, prompt_turns, chosen, chosen_loss, rejected, rejected_loss, usable``."""
    both = _turns(chosen, "c").join(_turns(rejected, "r"), ["pair_id", "turn"], "full")
    apart = F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("turn")))
    split = both.groupBy("pair_id").agg(apart.alias("apart"), F.count("c").alias("nc"), F.count("r").alias("nr")).where("nc > 0 and nr > 0").select("pair_id", "apart")
    common = F.col("apart").isNull() | (F.col("turn") < F.col("apart"))
    kept = lambda side, when: F.sort_array(F.collect_list(F.when(when & F.col(side).isNotNull(), F.struct("turn", F.col(side).alias("said")))))
    grouped = both.join(split, "pair_id").groupBy("pair_id").agg(
        kept("c", common).alias("p"), kept("c", ~common).alias("c"), kept("r", ~common).alias("r")
    )
    prompt, _ = _completion(F.col("p"))
    (chosen_text, chosen_loss), (rejected_text, rejected_loss) = _completion(F.col("c")), _completion(F.col("r"))
    return grouped.select(
        "pair_id", prompt.alias("prompt"), F.size("p").cast("long").alias("prompt_turns"), chosen_text.alias("chosen"), chosen_loss.alias("chosen_loss"),
        rejected_text.alias("rejected"), rejected_loss.alias("rejected_loss"), ((chosen_loss != "") & (rejected_loss != "")).alias("usable"),
    )


def replies_of_the_next(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from a table of single conversations.

    Chosen is each conversation; in the rejected one, its last assistant turn is replaced by that of the next
    conversation that has one, and ends it.  Conversations with an assistant turn are numbered by conv_id without gaps;
    after the last comes the first.  Left out are those without such a turn (they have no completion), and one
    that is alone in having it.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text").where("pair_id is not null and turn is not null")
    last = turns.where(F.col("role") == ASSISTANT).groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("own"))
    numbered = dense_number(last, ["pair_id"], "nth", start=-1)
    n = numbered.count()
    other = numbered.select(F.pmod(F.col("nth") - 1, F.lit(n)).alias("nth"), F.col("own.text").alias("reply")).where(F.lit(n > 1))
    return _sides(turns, numbered.join(other, "nth").select("pair_id", F.col("own.turn").alias("end"), "reply"))


def _sides(turns: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns, given the place of the last assistant turn and the ``reply`` that replaces it."""
    chosen = turns.join(ends.select("pair_id"), "pair_id", "left_semi")
    before = turns.join(ends, "pair_id").where("turn < end").select("pair_id", "turn", "role", "text")
    rejected = before.unionByName(ends.select("pair_id", F.col("end").alias("turn"), F.lit(ASSISTANT).alias("role"), F.col("reply").alias("text")))
    return chosen, rejected


#: The same rows by SQL, for ``format_pairs(*replies_of_the_next(conversations))``.
TWIN = """
WITH turns AS (
  SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (
  SELECT pair_id, max(turn) AS "end", arg_max(coalesce(text, ''), row(turn, coalesce(text, ''))) AS reply,
         row_number() OVER (ORDER BY pair_id) - 1 AS nth, count(*) OVER () AS n
  FROM turns WHERE role = 'assistant' GROUP BY 1),
ends AS (
  SELECT a.pair_id, a."end", b.reply FROM last a JOIN last b ON b.nth = (a.nth + 1) % a.n WHERE a.n > 1),
sides AS (
  SELECT t.pair_id, t.turn, 'c' AS side, role, text FROM turns t JOIN ends USING (pair_id)
  UNION ALL SELECT t.pair_id, t.turn, 'r', role, text FROM turns t JOIN ends USING (pair_id) WHERE t.turn < "end"
  UNION ALL SELECT pair_id, "end", 'r', 'assistant', reply FROM ends),
said AS (
  SELECT pair_id, turn, side, coalesce(role, '') AS role, '<|im_start|>' || coalesce(role, '') || chr(10) AS head,
         coalesce(text, '') || '<|im_end|>' || chr(10) AS body FROM sides),
apart AS (
  SELECT pair_id, min(turn) FILTER (WHERE n < 2) AS turn
  FROM (SELECT pair_id, turn, head || body AS whole, count(*) AS n FROM said GROUP BY ALL) GROUP BY 1),
placed AS (
  SELECT s.*, s.turn < coalesce(a.turn, s.turn + 1) AS common,
         coalesce(sum(length(head) + length(body)) FILTER (WHERE s.turn >= coalesce(a.turn, s.turn + 1))
           OVER (PARTITION BY s.pair_id, side ORDER BY s.turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS pos
  FROM said s JOIN apart a USING (pair_id)),
parts AS (
  SELECT pair_id,
    coalesce(string_agg(head || body, '' ORDER BY turn) FILTER (WHERE common AND side = 'c'), '') AS prompt,
    count(*) FILTER (WHERE common AND side = 'c') AS prompt_turns,
    coalesce(string_agg(head || body, '' ORDER BY turn) FILTER (WHERE NOT common AND side = 'c'), '') AS chosen,
    coalesce(string_agg(pos::BIGINT || '-' || (pos + length(body))::BIGINT, ',' ORDER BY turn) FILTER (WHERE NOT common AND side = 'c' AND role = 'assistant'), '') AS chosen_loss,
    coalesce(string_agg(head || body, '' ORDER BY turn) FILTER (WHERE NOT common AND side = 'r'), '') AS rejected,
    coalesce(string_agg(pos::BIGINT || '-' || (pos + length(body))::BIGINT, ',' ORDER BY turn) FILTER (WHERE NOT common AND side = 'r' AND role = 'assistant'), '') AS rejected_loss
  FROM placed GROUP BY 1)
SELECT *, chosen_loss <> '' AND rejected_loss <> '' AS usable FROM parts
"""
