"""Chat formatting by perspective rotation: each participant's view of a dialogue, with loss masks.

For every participant of a conversation (every speaker but the system) the dialogue is rendered with that speaker as
assistant and the others as users under their names. A rendered dialogue is the concatenation of its turns' segments in order; a row is
one segment with its character range in the dialogue and the range that the loss covers (the speaker's own words and the end mark). Ranges
are running sums in two levels, over blocks of BLOCK turn numbers and then within a block, so that a conversation of any length is
spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.runtime import materialize

BLOCK = 1024
START, END = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, seq, speaker, segment, start, end, loss_start, loss_end, one row a turn and perspective.

    turns: conv_id, turn, role, text. seq counts the rows of one turn number from 0 (ties: by role, then text), so that
    repeated rows each get a segment. start and end are character offsets in the rendered dialogue; loss_start and loss_end are null
    where the speaker isn't the perspective. Null texts are empty, null roles are 'unknown', null turns come first; a conversation
    with only system turns has no perspective and no rows. Null conversation ids are one conversation.
    """
    base = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    key = [F.coalesce(F.xxhash64("conv_id"), F.lit(0)).alias("k"), F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(-1 << 40)).alias("block")]
    order = Window.partitionBy("k", "block").orderBy("turn", "role", "text")
    same = Window.partitionBy("k", "block", "turn").orderBy("role", "text")
    one = base.select("*", *key).withColumn("nth", F.row_number().over(order)).withColumn("seq", F.row_number().over(same) - 1)
    one = materialize(one)
    who = one.where("role <> 'system'").groupBy("k", "role").agg(F.lit(1).alias("x")).select("k", F.col("role").alias("perspective"))
    view = one.join(who, "k")
    own = F.col("role") == F.col("perspective")
    head = F.when(F.col("role") == "system", F.lit("system")).when(own, F.lit("assistant"))
    head = F.concat(F.lit(START), F.coalesce(head, F.concat(F.lit("user name="), F.col("role"))), F.lit("\n"))
    view = view.select("*", head.alias("head")).withColumn("segment", F.concat("head", "text", F.lit(END)))
    view = view.withColumn("size", F.char_length("segment").cast("long"))
    blocks = Window.partitionBy("k", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = view.groupBy("k", "perspective", "block").agg(F.sum("size").alias("n"))
    start = start.withColumn("before", F.coalesce(F.sum("n").over(blocks), F.lit(0))).drop("n")
    inside = Window.partitionBy("k", "perspective", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    view = view.withColumn("upto", F.sum("size").over(inside)).join(start, ["k", "perspective", "block"])
    end = F.col("before") + F.col("upto")
    begin = end - F.col("size")
    return view.select(
        "conv_id", "perspective", "turn", "seq", F.col("role").alias("speaker"), "segment",
        begin.alias("start"), end.alias("end"),
        F.when(own, begin + F.char_length("head")).alias("loss_start"),
        F.when(own, end - 1).alias("loss_end"),
    )


def dialogues(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, text and loss ranges of whole dialogues: for conversations that fit a task's memory."""
    part = F.struct("start", "segment", "loss_start", "loss_end")
    x = segments.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(part)).alias("p"))
    spans = F.transform(F.filter("p", lambda s: s["loss_start"].isNotNull()), lambda s: F.struct(s["loss_start"].alias("start"), s["loss_end"].alias("end")))
    return x.select("conv_id", "perspective", F.array_join(F.transform("p", lambda s: s["segment"]), "").alias("text"), spans.alias("loss"))


ORACLE = """with b as (select conv_id, cast(turn as bigint) as turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
  n as (select *, row_number() over (partition by conv_id, turn order by role, text) - 1 as seq,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as nth from b),
  v as (select n.*, perspective, '<|im_start|>' || case when role = 'system' then 'system' when role = perspective then 'assistant'
      else 'user name=' || role end || chr(10) as head
    from n join (select distinct conv_id, role as perspective from b where role <> 'system') using (conv_id)),
  s as (select *, head || text || '<|im_end|>' || chr(10) as segment from v),
  r as (select *, sum(length(segment)) over (partition by conv_id, perspective order by nth) as stop from s)
select conv_id, perspective, turn, cast(seq as int) as seq, role as speaker, segment, cast(stop - length(segment) as bigint) as start, cast(stop as bigint) as "end",
  cast(case when role = perspective then stop - length(segment) + length(head) end as bigint) as loss_start,
  cast(case when role = perspective then stop - 1 end as bigint) as loss_end
from r"""
