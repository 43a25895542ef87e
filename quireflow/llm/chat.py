"""Multi-party perspective rotation (operator 7, DataFrame functions only).

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and all others as named users.  The result has a row
for each turn of each rendering, so a conversation of any length is never
gathered in one task; rows sorted by (conv_id, perspective, turn, speaker)
and joined give the training text.  ``mask_start``/``mask_end`` bound the characters
of the row that are trained on: the content and end mark of the assistant's own
turns, nothing (0, 0) elsewhere.

Defined results: system turns are context, never a perspective; a null role is
the speaker ``unknown``; a null text is empty; turns with equal numbers are
ordered by speaker, then by rendered text; repeated rows are rendered each; a conversation of system turns alone has no perspective and no rows; null
conversation ids form one conversation.  Marks inside a text or a speaker's name are
broken up, and line breaks in a name become spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.common import table

BEGIN, END = "<|im_start|>", "<|im_end|>"
SYSTEM_ROLES = ("system",)
NOBODY = "unknown"


def _head(speaker: Column, perspective: Column, system: Column) -> Column:
    # a speaker's name opens no turn: marks are broken up, and it stays on its line
    name = F.translate(F.replace(speaker, F.lit("<|"), F.lit("< |")), "\r\n", "  ")
    named = F.concat(F.lit(f"{BEGIN}user name="), name, F.lit("\n"))
    return F.when(system, f"{BEGIN}system\n").when(speaker == perspective, f"{BEGIN}assistant\n").otherwise(named)


def rotate(turns: DataFrame, system_roles=SYSTEM_ROLES) -> DataFrame:
    """A row for each turn of each participant's rendering."""
    said = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit(NOBODY)).alias("speaker"),
        F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("content"),
    )
    # at most one row for each participant of a conversation, combined before the shuffle
    people = said.filter(~F.col("speaker").isin(*system_roles)).select(F.col("conv_id").alias("c__id"), F.col("speaker").alias("perspective")).distinct()
    both = said.join(people, F.col("conv_id").eqNullSafe(F.col("c__id"))).drop("c__id")
    system = F.col("speaker").isin(*system_roles)
    own = ~system & (F.col("speaker") == F.col("perspective"))
    both = both.withColumn("c__head", _head(F.col("speaker"), F.col("perspective"), system))
    rendered = F.concat("c__head", "content", F.lit(f"{END}\n"))
    return both.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        F.when(system, "system").when(own, "assistant").otherwise("user").alias("chat_role"),
        rendered.alias("rendered"),
        F.when(own, F.char_length("c__head")).otherwise(0).cast("long").alias("mask_start"),
        F.when(own, F.char_length("c__head") + F.char_length("content") + len(END)).otherwise(0).cast("long").alias("mask_end"),
    )


def assemble(rotated: DataFrame, part_turns: int = 256) -> DataFrame:
    """Joins rendered turns into texts of at most ``part_turns`` turn numbers.

    Rows: conv_id, perspective, part, text, spans (start, end of what is
    trained on).  For conversations whose turn numbers are distinct.
    """
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1).cast("long")).alias("part")
    piece = F.struct("turn", "speaker", "rendered", "mask_start", "mask_end")
    df = rotated.groupBy("conv_id", "perspective", part).agg(F.array_sort(F.collect_list(piece)).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        span = F.array(F.struct((state["at"] + x["mask_start"]).alias("start"), (state["at"] + x["mask_end"]).alias("end")))
        return F.struct((state["at"] + F.char_length(x["rendered"])).alias("at"), F.when(x["mask_end"] > x["mask_start"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return df.select("conv_id", "perspective", "part", F.array_join(F.transform("p", lambda x: x["rendered"]), "").alias("text"), F.aggregate("p", start, step)["spans"].alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE = f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '{NOBODY}') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
heads AS (SELECT s.*, perspective, CASE WHEN speaker = 'system' THEN '{BEGIN}system' WHEN speaker = perspective THEN '{BEGIN}assistant' ELSE '{BEGIN}user name=' || replace(replace(replace(speaker, '<|', '< |'), chr(13), ' '), chr(10), ' ') END || chr(10) AS head,
  speaker = perspective AS own FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id)
SELECT conv_id, perspective, turn, speaker, CASE WHEN speaker = 'system' THEN 'system' WHEN own THEN 'assistant' ELSE 'user' END AS chat_role,
head || content || '{END}' || chr(10) AS rendered, CASE WHEN own THEN length(head) ELSE 0 END::BIGINT AS mask_start,
CASE WHEN own THEN length(head) + length(content) + {len(END)} ELSE 0 END::BIGINT AS mask_end FROM heads"""
