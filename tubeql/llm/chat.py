"""Chat formatting: multi-party perspective rotation, in DataFrame expressions only.

For every participant of a conversation the dialogue is rendered once with that participant as the assistant and
all others as named users; the mask holds the spans that a model is to learn, which are the assistant's words and
the end mark after them. System turns keep their role, are in every rendering, and are nobody's perspective.

A dialogue is rendered in segments of SEGMENT turn numbers, and a segment in parts of SEGMENT turns (one part, unless
turn numbers repeat), so a conversation of any length fills rows of a bounded number of turns. Equal turns are counted
before the shuffle and told apart by running sums; participants meet the segments in a join whose sides Spark can split.
The texts of a participant's segments and parts, put together in order, are the whole dialogue.

Defined results
* null role: the speaker "unknown". Null text: empty. Null conv_id: each row is a conversation of its own. Null turn:
  before all others, in a segment of its own (null).
* turns of equal number follow each other by speaker, then by text; repeated rows are repeated turns.
* the marks inside a text are broken up with a blank, so that they can't end a turn.
* a conversation without participants (system turns only) has no rows; an empty table gives an empty result; other
  columns are not looked at and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import let

SEGMENT = 64
SYSTEM = "system"
#: The marks around a turn.
START, END = "<|im_start|>", "<|im_end|>"


def clean(text: Column) -> Column:
    """text without whole marks."""
    for mark in (START, END):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("_", " _")))
    return text


def header(speaker: Column, assistant: Column) -> Column:
    role = F.when(speaker == SYSTEM, F.lit("system")).when(speaker == assistant, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), speaker))
    return F.concat(F.lit(START), role, F.lit("\n"))


def rendered(turns: Column, assistant: Column) -> tuple[Column, Column]:
    """The text of a segment's turns, and the spans [start, end) in it, in code points, of the assistant's words."""
    body = lambda t: F.concat(t["text"], F.lit(END))
    text = F.array_join(F.transform(turns, lambda t: F.concat(header(t["speaker"], assistant), body(t), F.lit("\n"))), "")
    none = F.array().cast("array<struct<start:int,end:int>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(state: Column, t: Column) -> Column:
        def placed(x: Column) -> Column:
            span = F.struct(x["a"].alias("start"), x["z"].alias("end"))
            spans = F.when(t["speaker"] == assistant, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
            return F.struct((x["z"] + 1).alias("at"), spans.alias("spans"))

        a = state["at"] + F.length(header(t["speaker"], assistant))
        return let(F.struct(a.alias("a"), (a + F.length(body(t))).alias("z")), placed)

    return text, F.aggregate(turns, begin, step, lambda state: state["spans"])


def parts(turns: DataFrame, segment: int) -> DataFrame:
    """(conv_id, segment, part, turns): the turns of each part of each conversation, in order."""
    place = ["conv_id", "segment"]
    same = turns.groupBy(*place, "turn", "speaker", "text").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*place).orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = same.withColumn("a", F.coalesce(F.sum("n").over(before), F.lit(0)))
    number = lambda x: F.floor(x / segment).cast("long")
    cut = placed.withColumn("part", F.explode(F.sequence(number(F.col("a")), number(F.col("a") + F.col("n") - 1))))
    times = F.least(F.col("a") + F.col("n"), (F.col("part") + 1) * segment) - F.greatest(F.col("a"), F.col("part") * segment)
    listed = cut.groupBy(*place, "part").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text", times.cast("int").alias("times")))).alias("turns"))
    return listed.withColumn("turns", F.flatten(F.transform("turns", lambda t: F.array_repeat(t, t["times"]))))


def rotate(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, participant, segment, part, n_turns, text, mask): mask is an array of struct(start, end)."""
    speaker = F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker")
    text = clean(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")
    turns = conversations.select("conv_id", F.floor(F.col("turn") / segment).cast("long").alias("segment"), "turn", speaker, text)
    known = turns.where(F.col("conv_id").isNotNull())
    people = known.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("participant")).distinct()
    columns = ["conv_id", "participant", "segment", "part", "turns"]
    pairs = parts(known, segment).join(people, "conv_id").select(*columns)
    one = F.array(F.struct("turn", "speaker", "text", F.lit(1).alias("times")))
    lone = turns.where(F.col("conv_id").isNull() & (F.col("speaker") != SYSTEM))
    pairs = pairs.unionByName(lone.select("conv_id", F.col("speaker").alias("participant"), "segment", F.lit(0).cast("long").alias("part"), one.alias("turns")))
    whole, mask = rendered(F.col("turns"), F.col("participant"))
    return pairs.select(*columns[:4], F.size("turns").cast("long").alias("n_turns"), whole.alias("text"), mask.alias("mask"))


def report(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """rotate() with the mask as text: start-end,start-end,..."""
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rotate(conversations, segment).withColumn("mask", spans)


#: The same in SQL for segments of 64 turn numbers.
ORACLE = """
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN -row_number() OVER () END AS lone, turn, CAST(floor(turn / 64.0) AS BIGINT) AS segment, coalesce(role, 'unknown') AS speaker,
    replace(replace(coalesce(text, ''), '<|im_start|>', '<|im _start|>'), '<|im_end|>', '<|im _end|>') AS words FROM conversations),
k AS (
  SELECT *, words || '<|im_end|>' AS body, row_number() OVER w AS k, (row_number() OVER w - 1) // 64 AS part FROM t
  WINDOW w AS (PARTITION BY conv_id, lone, segment ORDER BY turn NULLS FIRST, speaker, words)),
p AS (SELECT DISTINCT conv_id, lone, speaker AS participant FROM t WHERE speaker <> 'system'),
m AS (
  SELECT k.*, participant,
    '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head
  FROM k JOIN p ON k.conv_id IS NOT DISTINCT FROM p.conv_id AND k.lone IS NOT DISTINCT FROM p.lone),
placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS a FROM m
  WINDOW w AS (PARTITION BY conv_id, lone, participant, segment, part ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT conv_id, participant, segment, part, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY k) AS text,
  coalesce(string_agg(CAST(a AS BIGINT) || '-' || CAST(a + length(body) AS BIGINT), ',' ORDER BY k) FILTER (speaker = participant), '') AS mask
FROM placed GROUP BY conv_id, lone, participant, segment, part
"""
