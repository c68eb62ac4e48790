"""Multi-party perspective rotation of dialogues, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clearbrook.llm.shared import load

#: Turns whose numbers share a block are placed by one window; blocks are then placed by their totals.
BLOCK_TURNS = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _safe(text: Column) -> Column:
    """Text that can't open or close a turn: every ``<|`` in it becomes ``< |``."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate_perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", shared: tuple[str, ...] = ("system",), block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row for each perspective and turn: the dialogue of each conversation as each of its participants sees it.

    In the view of a participant its own turns are the assistant's and are trained on; all other speakers are
    users under their names; turns of a ``shared`` speaker stay what they are. Returns conv_id, perspective,
    position (from 0), turn, speaker, view_role, segment (the rendered turn), start and end (characters of the
    rendered dialogue) and mask_start and mask_end (the part to train on: text and end mark; null for others).
    The segments of a perspective, joined by position, are its rendered dialogue. No dialogue is ever held
    whole, so one may have any number of turns.

    Turns are ordered by number (null last), then speaker and text; repeated rows are kept. A null speaker is
    ``unknown``, a null text empty. A turn without conversation is a dialogue of its own. A conversation of
    shared speakers only has no participant and so no rows. Other columns are left out.
    """
    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"), _safe(F.col(text)).alias("text"))
    placed = t.where(F.col("conv_id").isNotNull())
    seats = placed.where(~F.col("speaker").isin(*shared)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    views = _rendered(placed.join(seats, "conv_id"), shared).withColumn("block", F.floor(F.col("turn") / block_turns))
    order = [F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("text")]
    here = Window.partitionBy("conv_id", "perspective", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = views.withColumns({"_n": F.coalesce(F.sum(F.lit(1)).over(here), F.lit(0)), "_at": F.coalesce(F.sum(F.length("segment").cast("long")).over(here), F.lit(0))})
    earlier = Window.partitionBy("conv_id", "perspective").orderBy(F.col("block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = views.groupBy("conv_id", "perspective", "block").agg(F.count("*").alias("n"), F.sum(F.length("segment").cast("long")).alias("size"))
    blocks = blocks.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("block").alias("_b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("_at0"))
    whole = inside.join(blocks, (F.col("conv_id") == F.col("_c")) & (F.col("perspective") == F.col("_p")) & F.col("block").eqNullSafe(F.col("_b")))
    whole = whole.withColumns({"position": F.col("_n0") + F.col("_n"), "start": F.col("_at0") + F.col("_at")})
    alone = t.where(F.col("conv_id").isNull() & ~F.col("speaker").isin(*shared)).withColumn("perspective", F.col("speaker"))
    alone = _rendered(alone, shared).withColumns({"position": F.lit(0).cast("long"), "start": F.lit(0).cast("long")})
    return _placed(whole).unionByName(_placed(alone))


def _rendered(df: DataFrame, shared: tuple[str, ...]) -> DataFrame:
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker").isin(*shared), F.col("speaker")).otherwise("user")
    head = F.concat(F.lit(OPEN), F.col("view_role"), F.when(F.col("view_role") == "user", F.concat(F.lit(" name="), _safe(F.col("speaker")))).otherwise(""), F.lit("\n"))
    return df.withColumn("view_role", role).withColumn("_head", head).withColumn("segment", F.concat("_head", "text", F.lit(CLOSE)))


def _placed(df: DataFrame) -> DataFrame:
    end = F.col("start") + F.length("segment")
    own = F.col("view_role") == "assistant"
    return df.select("conv_id", "perspective", "position", "turn", "speaker", "view_role", "segment", "start", end.alias("end"), F.when(own, F.col("start") + F.length("_head")).alias("mask_start"), F.when(own, end).alias("mask_end"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(load(spark, sf_dir, "conversations"))


OP4_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
seats AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
v AS (SELECT conv_id, perspective, turn, speaker, text,
  CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS view_role FROM t JOIN seats USING (conv_id)),
h AS (SELECT *, '<|im_start|>' || view_role || CASE WHEN view_role = 'user' THEN ' name=' || replace(speaker, '<|', '< |') ELSE '' END || chr(10) AS head FROM v),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, row_number() OVER w - 1 AS position, CAST(coalesce(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, speaker, view_role, segment, start, start + length(segment) AS "end",
  CASE WHEN view_role = 'assistant' THEN start + length(head) END AS mask_start, CASE WHEN view_role = 'assistant' THEN start + length(segment) END AS mask_end
FROM o
"""
