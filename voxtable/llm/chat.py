"""Chat formatting by perspective rotation, with DataFrame functions alone.

For every participant of a conversation the dialogue is rendered once, with that speaker as
the assistant, the others as named users, and a mask of the characters the assistant says.
Speakers with a fixed role (system) keep it in every rendering and are no participants.

A rendering is cut into blocks of ``BLOCK_TURNS`` turn numbers, so the longest conversation is
spread over tasks and rows; blocks in order give the whole dialogue, and offsets count in
code points from the start of their block.

Defined results: turns sort by number (null first), then speaker and text; a row that
repeats another one is one utterance. A null speaker is named "unknown", a null text is
empty. A null conversation id joins nothing: each such row is a dialogue of its own. A
conversation of fixed roles alone gives one rendering without a perspective and with an empty
mask. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TURNS = 256
FIXED_ROLES = ("system",)
END = "<|end|>"


def _before(sizes: Column, upto: Column) -> Column:
    return F.aggregate(F.slice(sizes, F.lit(1), upto), F.lit(0), lambda a, x: a + x)


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text",
    fixed: Sequence[str] = FIXED_ROLES, block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """One row per conversation, block and participant: rendered text and loss mask."""
    said = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{speaker_col}`").cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ).withColumns({
        "block": F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-1)).cast("long"),
        "alone": F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "speaker", "text")).otherwise(F.lit(0)),
        "is_fixed": F.col("speaker").isin(*fixed) if fixed else F.lit(False),
    })
    key = ["conv_id", "alone"]
    blocks = said.groupBy(*key, "block").agg(F.array_sort(F.collect_set(F.struct("turn", "speaker", "text", "is_fixed"))).alias("said"))
    people = said.groupBy(*key).agg(F.array_sort(F.collect_set(F.when(~F.col("is_fixed"), F.col("speaker")))).alias("people"))
    same = [blocks[k].eqNullSafe(people[k]) for k in key]
    each = blocks.join(people, same).select(blocks["conv_id"], "block", "said", F.explode_outer("people").alias("perspective"))

    def opening(t: Column) -> Column:
        own = t["speaker"] == F.coalesce(F.col("perspective"), F.lit(""))
        named = F.concat(F.lit("<|user|>"), t["speaker"], F.lit("\n"))
        return F.when(t["is_fixed"], F.concat(F.lit("<|"), t["speaker"], F.lit("|>\n"))).when(own & F.col("perspective").isNotNull(), F.lit("<|assistant|>\n")).otherwise(named)

    parts = each.withColumn("parts", F.transform("said", lambda t: F.struct(
        opening(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (~t["is_fixed"] & t["speaker"].eqNullSafe(F.col("perspective"))).alias("own"),
    )))
    sizes = F.transform("parts", lambda p: F.length(p["head"]) + F.length(p["body"]) + 1)
    spans = F.transform("parts", lambda p, i: F.struct(
        p["own"].alias("own"), (_before(F.col("sizes"), i) + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("size"),
    ))
    marked = parts.withColumn("sizes", sizes).withColumn("spans", F.filter(spans, lambda s: s["own"]))
    return marked.select(
        "conv_id", "block", "perspective", F.size("said").cast("long").alias("n_turns"), F.size("spans").cast("long").alias("n_own_turns"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["start"] + s["size"])), ",").alias("mask"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["size"]).alias("n_masked_in"),
    )


# The same rows in SQL, for the column names of ``conversations`` and the constants above.
ORACLE = f"""
with said as (
  select distinct conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text, coalesce(cast(floor(turn / {BLOCK_TURNS}.0) as bigint), -1) as block
  from conversations where conv_id is not null
), people as (
  select conv_id, speaker as perspective from said where speaker <> 'system' group by all
), convs as (select distinct conv_id from said),
each as (
  select s.*, p.perspective from said s join convs using (conv_id) left join people p on p.conv_id = s.conv_id
), parts as (
  select *, speaker <> 'system' and speaker is not distinct from perspective as own,
    case when speaker = 'system' then '<|system|>' || chr(10) when speaker is not distinct from perspective then '<|assistant|>' || chr(10)
      else '<|user|>' || speaker || chr(10) end as head, text || '{END}' as body
  from each
), placed as (
  select *, coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, block, perspective order by turn nulls first, speaker, text
    rows between unbounded preceding and 1 preceding), 0) + length(head) as start from parts
)
select conv_id, block, perspective, count(*) as n_turns, count(*) filter (where own) as n_own_turns,
  string_agg(head || body || chr(10), '' order by turn nulls first, speaker, text) as rendered,
  coalesce(string_agg(start || ':' || (start + length(body)), ',' order by turn nulls first, speaker, text) filter (where own), '') as mask,
  cast(coalesce(sum(length(body)) filter (where own), 0) as bigint) as n_masked_in
from placed group by conv_id, block, perspective
"""
