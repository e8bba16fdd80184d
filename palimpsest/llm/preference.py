"""Preference formatting: a prompt rendered once, and paired completions with training masks.

The longest common prefix of turns of the chosen and the rejected conversation is the prompt; what
follows in either is its completion. A mask lists the character ranges of a completion that count
for training: replies of the assistant with their end mark. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the chat format. Marks inside a text are broken up, so that none is forged.
BEGIN, END = "<|im_start|>", "<|im_end|>"
FORGED, BROKEN = "<|im_", "<| im_"
ASSISTANT = "assistant"


def dialogues(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns array<struct<role, text>>) of a table of turns, in order of turn, then role and text.

    Null roles count as user, null texts as empty, null turns come first; rows with a null id belong to
    no conversation. Repeated rows are turns of their own. Rows are grouped by conversation, which is
    bounded by the conversation's own length, as its rendered text is.
    """
    t = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.struct(F.col(turn_col).alias("n"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    t = t.groupBy("_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return t.select(F.col("_id").alias(id_col), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def contrasted(talks: DataFrame, turns_col: str = "turns") -> DataFrame:
    """Adds chosen (the conversation) and rejected (it up to the last reply of the assistant, which
    gives way to the assistant's first reply, or to an empty one if there is no other). A conversation
    without a reply is both."""
    t = F.col(turns_col)
    replies = F.filter(F.transform(t, lambda x, i: F.when(x["role"] == ASSISTANT, i + 1)), lambda i: i.isNotNull())
    weak = F.when(F.size(replies) > 1, F.element_at(t, F.get(replies, F.lit(0)))["text"]).otherwise(F.lit(""))
    swapped = F.concat(F.slice(t, F.lit(1), F.element_at(replies, -1) - 1), F.array(F.struct(F.lit(ASSISTANT).alias("role"), weak.alias("text"))))
    return talks.withColumn("chosen", t).withColumn("rejected", F.when(F.size(replies) > 0, swapped).otherwise(t))


def content(turn: Column) -> Column:
    return F.replace(turn["text"], F.lit(FORGED), F.lit(BROKEN))


def head(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), F.replace(turn["role"], F.lit(FORGED), F.lit(BROKEN)), F.lit("\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(head(x), content(x), F.lit(END + "\n"))), "")


def mask(turns: Column) -> Column:
    """Ranges start:end of the rendered turns that train, comma-joined, ends exclusive."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("m"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(head(x))
        end = begin + F.length(content(x)) + len(END)
        said = F.concat(acc["m"], F.when(acc["m"] == "", F.lit("")).otherwise(F.lit(",")), begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(x["role"] == ASSISTANT, said).otherwise(acc["m"]).alias("m"))

    return F.aggregate(turns, start, step, lambda acc: acc["m"])


def formatted(pairs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per row of ``pairs`` (id, chosen, rejected as arrays of turns): (id, n_prompt_turns,
    prompt, chosen, rejected, chosen_mask, rejected_mask).

    Turns are equal if role and text are. Equal conversations have empty completions; conversations
    that differ from the first turn on have an empty prompt. A null array counts as no turns. Other
    columns are ignored. No shuffle, no Python.
    """
    a, b = F.coalesce("chosen", F.array().cast(pairs.schema["chosen"].dataType)), F.coalesce("rejected", F.array().cast(pairs.schema["rejected"].dataType))
    p = pairs.select(F.col(id_col).alias("_id"), a.alias("a"), b.alias("b"))
    same = F.transform(F.slice("a", F.lit(1), F.least(F.size("a"), F.size("b"))), lambda x, i: x.eqNullSafe(F.get("b", i)))
    p = p.withColumn("first", F.array_position(same, False)).withColumn("n", F.when(F.col("first") > 0, F.col("first") - 1).otherwise(F.least(F.size("a"), F.size("b")).cast("long")).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    p = p.select("_id", "n", F.slice("a", F.lit(1), F.col("n")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return p.select(F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_prompt_turns"), rendered(F.col("p")).alias("prompt"), rendered(F.col("a")).alias("chosen"), rendered(F.col("b")).alias("rejected"), mask(F.col("a")).alias("chosen_mask"), mask(F.col("b")).alias("rejected_mask"))


def oracle() -> str:
    """DuckDB SQL for formatted(contrasted(dialogues(conversations)))."""
    clean = lambda x: f"replace({x}, '{FORGED}', '{BROKEN}')"
    show = lambda t: f"array_to_string(list_transform({t}, lambda x: '{BEGIN}' || {clean('x.role')} || chr(10) || {clean('x.text')} || '{END}' || chr(10)), '')"
    wide = lambda t, i: f"coalesce(list_sum(list_transform({t}[1:{i} - 1], lambda y: {len(BEGIN) + len(END) + 2} + length({clean('y.role')}) + length({clean('y.text')}))), 0)::BIGINT"
    begin = lambda t, x, i: f"({wide(t, i)} + {len(BEGIN) + 1} + length({clean(x + '.role')}))"
    marks = lambda t: f"array_to_string(list_filter(list_transform({t}, lambda x, i: CASE WHEN x.role = '{ASSISTANT}' THEN {begin(t, 'x', 'i')}::VARCHAR || ':' || ({begin(t, 'x', 'i')} + length({clean('x.text')}) + {len(END)})::VARCHAR END), lambda m: m IS NOT NULL), ',')"
    return f"""
WITH talk AS (
  SELECT conv_id, list({{'role': coalesce(role, 'user'), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS a
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
reply AS (SELECT *, list_filter(range(1, len(a) + 1), lambda i: a[i].role = '{ASSISTANT}') AS r FROM talk),
pair AS (
  SELECT conv_id, a, CASE WHEN len(r) > 0 THEN list_concat(a[1 : r[len(r)] - 1], [{{'role': '{ASSISTANT}', 'text': CASE WHEN len(r) > 1 THEN a[r[1]].text ELSE '' END}}]) ELSE a END AS b FROM reply),
cut AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS n FROM pair),
part AS (SELECT conv_id, n, a[1:n] AS p, a[n + 1:] AS a, b[n + 1:] AS b FROM cut)
SELECT conv_id, n::BIGINT AS n_prompt_turns, {show("p")} AS prompt, {show("a")} AS chosen, {show("b")} AS rejected, {marks("a")} AS chosen_mask, {marks("b")} AS rejected_mask
FROM part"""
