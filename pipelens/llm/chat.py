"""Chat formatting in budgeted windows of whole turns, with a loss mask. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelens.llm._shared import col

BEGIN, END = "### ", " </turn>\n"  # around each turn; a colon and a space end the role
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))  # what may stand in a text, and how it is written


@dataclass(frozen=True)
class Budget:
    window: int = 1024  # tokens of a window: system turn, history and new turns
    history: int = 256  # of which repeated turns may take
    turns: int = 4  # that are repeated at most
    overhead: int = 4  # tokens of a turn's marks


PRODUCTION = Budget(window=512, history=128, turns=4)


def escape(c: Column) -> Column:
    """A backslash starts an escape and nothing else, and no mark's first character is left."""
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def tokens(c: Column) -> Column:
    """Tokens of a text by default: its runs of non-blanks."""
    return F.regexp_count(c, F.lit("[^ \\t\\n\\r\\f\\x0B]+"))


def format_chats(turns: DataFrame, budget: Budget = Budget(), count_tokens=tokens) -> DataFrame:
    """turns: conv_id, turn, role, text. One row a conversation: conv_id and windows, an array of
    (text, repeated int, n_turns int, losses array of (start, length) in code points from 1).

    Turns stand in the order of turn, then role, then text; null roles and texts count as empty. A window holds the
    system turn if the conversation starts with one, then at most budget.turns and budget.history tokens of the turns
    before it, then new turns until budget.window tokens are reached, one at least: no turn is ever cut, so a turn
    longer than the budget has a window that is longer too. `repeated` turns stand at the window's start for context;
    only new assistant turns are targets, so each is learned once. Null conv_ids are one conversation.

    One shuffle by conversation, then prefix sums and spans are worked out within the row: a conversation's turns
    make up one result, so they have to meet; nothing else does.
    """
    t = turns.select(col("conv_id").alias("conv_id"), col("turn").alias("turn"), F.coalesce(col("role"), F.lit("")).alias("role"), F.coalesce(col("text"), F.lit("")).alias("text"))
    t = t.select("conv_id", F.struct("turn", "role", "text", (count_tokens(F.col("text")) + budget.overhead).cast("long").alias("n")).alias("t"))
    rows = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    rows = rows.select("conv_id", "ts", F.expr("if(ts[0].role = 'system', 1, 0)").alias("sys"), F.expr("transform(ts, x -> x.n)").alias("n"))
    rows = rows.select("*", F.expr("aggregate(n, array(0L), (acc, x) -> concat(acc, array(acc[size(acc) - 1] + x)))").alias("sums"))
    # where a window that begins at turn i starts to repeat: as early as turns and history allow, not before the system turn's end
    back = f"""transform(sequence(0, size(n) - 1), i -> i - coalesce(array_max(filter(sequence(0, {budget.turns}), k -> k <= greatest(i - sys, 0) and sums[i] - sums[greatest(i - k, 0)] <= {budget.history})), 0))"""
    rows = rows.select("*", F.expr(back).alias("back"))
    fixed = "if(sys = 1, n[0], 0L)"
    starts = f"""aggregate(sequence(0, size(n) - 1), struct(array(0) as starts, 0L as used), (s, i) ->
        if(i = 0 or s.used + n[i] <= {budget.window}, struct(s.starts as starts, s.used + n[i] as used),
           struct(concat(s.starts, array(i)) as starts, if(i >= sys, {fixed}, 0L) + (sums[i] - sums[back[i]]) + n[i] as used)), s -> s.starts)"""
    rows = rows.select("*", F.expr(starts).alias("starts"))

    def written(x: Column) -> Column:
        return F.concat(F.lit(BEGIN), escape(x["role"]), F.lit(": "), escape(x["text"]), F.lit(END))

    marked = F.transform("ts", lambda x: F.struct(written(x).alias("text"), (F.char_length(F.lit(BEGIN)) + F.char_length(escape(x["role"])) + 2).alias("skip"), F.char_length(escape(x["text"])).alias("len"), (x["role"] == "assistant").alias("loss")))
    rows = rows.select("conv_id", "sys", "back", "starts", marked.alias("m"))
    spans = """transform(starts, (a, w) -> struct(a as a, coalesce(get(starts, w + 1), size(m)) as b,
        if(w = 0, cast(array() as array<int>), concat(if(sys = 1, array(0), cast(array() as array<int>)), if(back[a] < a, sequence(back[a], a - 1), cast(array() as array<int>)))) as old))"""
    rows = rows.select("conv_id", "m", F.expr(spans).alias("spans"))
    windows = """transform(spans, s -> struct(
        concat(array_join(transform(s.old, i -> m[i].text), ''), array_join(transform(slice(m, s.a + 1, s.b - s.a), x -> x.text), '')) as text,
        size(s.old) as repeated, size(s.old) + s.b - s.a as n_turns,
        filter(aggregate(slice(m, s.a + 1, s.b - s.a),
            struct(cast(char_length(array_join(transform(s.old, i -> m[i].text), '')) as int) as at, cast(array() as array<struct<start: int, length: int>>) as spans),
            (acc, x) -> struct(acc.at + cast(char_length(x.text) as int) as at, concat(acc.spans, array(if(x.loss, named_struct('start', acc.at + x.skip + 1, 'length', x.len), named_struct('start', 0, 'length', 0)))) as spans),
            acc -> acc.spans), x -> x.start > 0) as losses))"""
    return rows.select("conv_id", F.expr(windows).alias("windows"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of (role, text): every turn once) and targets (array of the texts under the loss mask),
    all from the windows' text, repeated and losses alone."""
    new = F.flatten(F.transform("windows", lambda w: F.slice(F.split(w["text"], END), w["repeated"] + 1, w["n_turns"] - w["repeated"])))
    targets = F.flatten(F.transform("windows", lambda w: F.transform(w["losses"], lambda s: unescape(F.substring(w["text"], s["start"], s["length"])))))
    return formatted.select("conv_id", F.transform(new, lambda x: F.struct(unescape(F.regexp_extract(x, "(?s)^### ([^:]*): ", 1)).alias("role"), unescape(F.regexp_replace(x, "(?s)^### [^:]*: ", "")).alias("text"))).alias("turns"), targets.alias("targets"), "windows")


def formatted_digest(spark, conversations: DataFrame) -> DataFrame:
    """op4: formats all conversations and conversation -7, and digests what is read back from the output."""
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = read_back(format_chats(conversations.select("conv_id", "turn", "role", "text").unionByName(own), PRODUCTION))
    spoken = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learned = F.array_join("targets", "")
    chars = F.aggregate("windows", F.lit(0).cast("long"), lambda acc, w: acc + F.char_length(w["text"]))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        chars.alias("formatted_chars"),
        F.size("windows").cast("long").alias("n_windows"),
    )


ORACLE = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS size, len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) + 4 AS n,
    17 + 2 * len(role) - len(regexp_replace(role, '[\\#<:]', '', 'g')) + 2 * len(text) - len(regexp_replace(text, '[\\#<:]', '', 'g')) - 2 AS chars
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)
), s AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) - n AS before, first_value(role) OVER (PARTITION BY conv_id ORDER BY i) = 'system' AS sys, first_value(n) OVER (PARTITION BY conv_id ORDER BY i) AS n0 FROM t
), b AS (
  SELECT s.*, (SELECT coalesce(max(s.i - p.i), 0) FROM s p WHERE p.conv_id = s.conv_id AND p.i < s.i AND s.i - p.i <= 4 AND p.i >= s.sys::INT AND s.before - p.before <= 128) AS k FROM s
), r AS (
  SELECT conv_id, i, n AS used, true AS starts FROM b WHERE i = 0
  UNION ALL
  SELECT b.conv_id, b.i, CASE WHEN r.used + b.n <= 512 THEN r.used + b.n ELSE (CASE WHEN b.sys THEN b.n0 ELSE 0 END) + b.before - (SELECT p.before FROM b p WHERE p.conv_id = b.conv_id AND p.i = b.i - b.k) + b.n END, r.used + b.n > 512
  FROM r JOIN b ON b.conv_id = r.conv_id AND b.i = r.i + 1
), w AS (
  SELECT b.conv_id, count(*) AS n_windows, sum(CASE WHEN b.i = 0 THEN 0 ELSE (SELECT coalesce(sum(p.chars), 0) FROM b p WHERE p.conv_id = b.conv_id AND ((p.i >= b.i - b.k AND p.i < b.i) OR (b.sys AND p.i = 0))) END) AS again
  FROM r JOIN b ON b.conv_id = r.conv_id AND b.i = r.i WHERE r.starts GROUP BY b.conv_id
), d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS learned, sum(chars) AS chars
  FROM b GROUP BY conv_id
)
SELECT d.conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
  CAST(chars + again AS BIGINT) AS formatted_chars, CAST(n_windows AS BIGINT) AS n_windows
FROM d JOIN w ON d.conv_id = w.conv_id
"""
