"""Multi-party perspective rotation of dialogues.

For every participant of a dialogue the whole dialogue is rendered with that
speaker as the assistant and all others as named users; a loss mask covers the
text of the speaker's own turns and nothing else. Turns of a system role are
context: they are rendered as system in every perspective and take no part.

The rendering is kept as one row per perspective and turn, with the turn's place
in the rendered dialogue, so that a dialogue of any length is never gathered in
one row or task; ``assembled`` joins the turns, long dialogues in parts. A dialogue of t turns and s speakers has
t * s rows: that is the task.

A turn cannot forge another: the beginnings of marks inside a text get a blank, and blanks in a
name become underscores.

Defined cases: a null role is the participant ``unknown``; null text is empty;
turns of the same number are ordered by role and text; a null turn comes first;
a dialogue of system turns alone has no perspective; an empty table gives an empty result; very long texts are
rendered whole; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import saved

#: Turns whose lengths are added up in one task: longer dialogues are prefix-summed in two steps.
BLOCK = 256
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: How a mark begins, and what stands for that inside a text.
MARK, INSTEAD = "<|im_", "<| im_"


def rotate(turns: DataFrame, system_roles: Sequence[str] = ("system",)) -> DataFrame:
    """One row per dialogue, participant and turn.

    speaker: whose perspective it is; role, name: of the turn in it; segment: its
    rendered text; start_char, end_char: where that is in the rendered dialogue;
    mask_start, mask_end: the part to learn, null where there is none.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("by"), F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(INSTEAD)).alias("content"))
    system = F.col("by").isin(*system_roles)
    speakers = rows.filter(~system).select(F.col("conv_id").alias("_c"), F.col("by").alias("speaker")).distinct()
    own = F.col("by") == F.col("speaker")
    out = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    out = out.withColumn("role", F.when(system, "system").when(own, "assistant").otherwise("user"))
    out = out.withColumn("name", F.when(F.col("role") == "user", F.col("by")))
    head = F.concat(F.lit(BEGIN), F.col("role"), F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), F.regexp_replace("name", r"[\x20\x09-\x0D]", "_"))).otherwise(""), F.lit("\n"))
    out = out.withColumn("segment", F.concat(head, F.col("content"), F.lit(END))).withColumn("_head", F.length(head))
    out = out.withColumn("_block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK).cast("long"))
    out = saved(out.select("conv_id", "speaker", "turn", "by", "role", "name", "segment", "_head", "_block", F.length("content").alias("_content"), F.length("segment").alias("_len")), "turns")
    key = ("conv_id", "speaker", "_block")
    inside = W.partitionBy(*key).orderBy("turn", "by", "segment").rowsBetween(W.unboundedPreceding, -1)
    over = W.partitionBy("conv_id", "speaker").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = out.groupBy(*key).agg(F.sum("_len").alias("_sum"))
    blocks = blocks.select(F.col("conv_id").alias("_c"), F.col("speaker").alias("_s"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    out = out.withColumn("_in", F.coalesce(F.sum("_len").over(inside), F.lit(0)))
    out = out.join(blocks, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("speaker") == F.col("_s")) & (F.col("_block") == F.col("_b")))
    start = F.col("_before") + F.col("_in")
    mine = F.col("role") == "assistant"
    return out.select(
        "conv_id",
        "speaker",
        "turn",
        "role",
        "name",
        "segment",
        start.alias("start_char"),
        (start + F.col("_len")).alias("end_char"),
        F.when(mine, start + F.col("_head")).alias("mask_start"),
        F.when(mine, start + F.col("_head") + F.col("_content")).alias("mask_end"),
    )


def assembled(rotated: DataFrame, max_chars: int = 1 << 22) -> DataFrame:
    """conv_id, speaker, part, rendered, masks (pairs of places in the whole) of the perspectives.

    A part has the turns that begin within max_chars characters: no turn is left out, and no row is larger than that and a turn.
    """
    rows = rotated.withColumn("part", F.floor(F.col("start_char") / max_chars).cast("long"))
    rows = rows.groupBy("conv_id", "speaker", "part").agg(F.array_sort(F.collect_list(F.struct("start_char", "segment", "mask_start", "mask_end"))).alias("_t"))
    masks = F.filter("_t", lambda t: t["mask_start"].isNotNull())
    return rows.select("conv_id", "speaker", "part", F.array_join(F.transform("_t", lambda t: t["segment"]), "").alias("rendered"), F.transform(masks, lambda t: F.struct(t["mask_start"].alias("start"), t["mask_end"].alias("end"))).alias("masks"))


#: The same rows in DuckDB.
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS "by", replace(coalesce(text, ''), '{MARK}', '{INSTEAD}') AS content FROM conversations),
s AS (SELECT DISTINCT conv_id, "by" AS speaker FROM t WHERE "by" <> 'system'),
r AS (SELECT t.conv_id, speaker, turn, "by", content,
        CASE WHEN "by" = 'system' THEN 'system' WHEN "by" = speaker THEN 'assistant' ELSE 'user' END AS role
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
h AS (SELECT *, CASE WHEN role = 'user' THEN "by" END AS name,
        '{BEGIN}' || role || CASE WHEN role = 'user' THEN ' name=' || regexp_replace("by", '[\\x20\\x09-\\x0D]', '_', 'g') ELSE '' END || chr(10) AS head FROM r),
g AS (SELECT *, head || content || '<|im_end|>' || chr(10) AS segment FROM h),
p AS (SELECT *, CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, "by", segment
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM g)
SELECT conv_id, speaker, turn, role, name, segment, a AS start_char, a + length(segment) AS end_char,
  CASE WHEN role = 'assistant' THEN a + length(head) END AS mask_start,
  CASE WHEN role = 'assistant' THEN a + length(head) + length(content) END AS mask_end
FROM p
"""
