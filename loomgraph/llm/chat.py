"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the whole dialogue is rendered with that speaker
as the assistant, all others as named users, system turns as system, and a mask over the
characters that the assistant says.

A conversation is cut into parts of ``SPAN`` consecutive turn numbers, so one with a third
of all rows is spread over many groups; a part with too many rows of equal turn numbers is
dealt out further.  Only the parts' numbers and sizes of a conversation meet in one task.  A participant's dialogue is its parts
in order (nearly always one), each with the offset of its first message.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.plans.store import materialize

SPAN = 256  # turn numbers of a part
MOST = 4096  # rows of a part, about
OPEN, CLOSE, END = "<|im_start|>", "<|im_end|>", "\n"


def _head(speaker: Column, perspective: Column) -> Column:
    role = F.when(speaker == "system", F.lit("system")).when(speaker == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), speaker))
    return F.concat(F.lit(OPEN), role, F.lit(END))


def rotate_perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation, participant and part.

    Columns: conv_id, participant, part, offset (messages before it), n_messages,
    n_trained, rendered, spans (array of [start, end) character ranges to learn from).
    A null role speaks as ``unknown``, a null text is empty, a null turn counts as 0 and a
    null conversation is one of its own.  A row that repeats is one message as often as it
    occurs.  Turns with equal numbers are ordered by role and text.  System turns are in every
    rendering but make no participant, so a conversation of system turns only gives no row.
    Template marks inside a text are broken with a blank, so a text can't open a turn.
    """
    safe = F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    speaker = F.translate(F.coalesce(F.col(role).cast("string"), F.lit("unknown")), "\n<>|", "____")
    rows = turns.select(F.col(conv).alias("conv_id"), F.coalesce(F.col(turn).cast("long"), F.lit(0).cast("long")).alias("turn"), speaker.alias("speaker"), safe.alias("text"))
    rows = rows.withColumn("span", F.floor(F.col("turn") / SPAN))
    # Rows that repeat travel once, with their number.
    rows = rows.groupBy("conv_id", "span", "turn", "speaker", "text").agg(F.count(F.lit(1)).alias("copies"))
    loads = turns.groupBy(F.col(conv).alias("conv_id"), F.floor(F.coalesce(F.col(turn).cast("long"), F.lit(0).cast("long")) / SPAN).alias("span")).agg(F.count(F.lit(1)).alias("load"))
    dealt = rows.alias("r").join(loads.alias("l"), F.col("r.conv_id").eqNullSafe(F.col("l.conv_id")) & (F.col("r.span") == F.col("l.span")))
    cols = [F.col("r.conv_id").alias("conv_id"), F.col("r.span").alias("span"), F.col("r.turn").alias("turn"), "speaker", "text", "copies"]
    none = F.lit(0).cast("long")
    pieces = dealt.where(F.col("load") <= MOST).select(*cols).withColumns({"step": none, "deal": none})
    hot = loads.where(F.col("load") > MOST).agg(F.sum("load")).first()[0]
    if hot:  # ranges of a global sort, so that dealt-out rows stay in the order of turn, role and text
        ranges = dealt.where(F.col("load") > MOST).select(*cols).repartitionByRange(-(-hot // MOST), "conv_id", "span", "turn", "speaker", "text")
        ranges = ranges.withColumns({"step": F.col("turn"), "deal": F.spark_partition_id().cast("long")})
        pieces = pieces.unionByName(materialize(ranges, "ranges"))
    place = ["conv_id", "span", "step", "deal"]
    parts = pieces.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text", "copies"))).alias("m"), F.sum("copies").alias("n"))
    parts = materialize(parts, "parts")
    # Parts are numbered and paired with participants by their keys alone; texts join last, part by part.
    order = W.partitionBy("conv_id").orderBy("span", "step", "deal")
    placed = parts.select(*place, "n").withColumn("part", (F.row_number().over(order) - 1).cast("long")).withColumn("offset", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"))
    who = turns.select(F.col(conv).alias("c"), speaker.alias("participant")).where("participant <> 'system'").distinct()
    named = placed.drop("n").join(who, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    same = reduce(lambda x, y: x & y, [F.col(f"k.{c}").eqNullSafe(F.col(f"m.{c}")) for c in place])
    both = named.alias("k").join(parts.alias("m"), same).select("k.*", "m.m")
    each = F.flatten(F.transform("m", lambda x: F.array_repeat(F.struct(x["speaker"].alias("speaker"), x["text"].alias("text")), x["copies"].cast("int"))))
    said = both.withColumn("e", each)
    made = said.withColumn("heads", F.transform("e", lambda x: _head(x["speaker"], F.col("participant"))))
    whole = F.transform("e", lambda x, i: F.concat(F.get("heads", i), x["text"], F.lit(CLOSE + END)))
    built = made.withColumn("messages", whole).withColumn("lengths", F.transform("messages", lambda x: F.length(x)))
    ends = F.aggregate("lengths", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    timed = built.withColumn("starts", ends)
    span = lambda x, i: F.struct((F.get("starts", i) + F.length(F.get("heads", i))).alias("start"), (F.get("starts", i) + F.length(F.get("heads", i)) + F.length(x["text"])).alias("end"), x["speaker"].alias("s"))
    spans = F.transform(F.filter(F.transform("e", span), lambda x: x["s"] == F.col("participant")), lambda x: F.struct(x["start"], x["end"]))
    return timed.withColumn("spans", spans).select("conv_id", "participant", "part", F.col("offset").cast("long").alias("offset"), F.size("e").cast("long").alias("n_messages"), F.size("spans").cast("long").alias("n_trained"), F.array_join("messages", "").alias("rendered"), "spans")


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = rotate_perspectives(turns)
    return out.withColumn("trained", F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")).drop("spans")


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, translate(coalesce(role, 'unknown'), chr(10) || '<>|', '____') AS speaker, replace(coalesce("text", ''), '<|', '< |') AS tx FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> 'system'),
h AS (SELECT t.*, participant, row_number() OVER (PARTITION BY t.conv_id, participant ORDER BY turn, speaker, tx) AS k,
  '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
m AS (SELECT *, head || tx || '<|im_end|>' || chr(10) AS msg FROM h),
s AS (SELECT *, coalesce(sum(length(msg)) OVER (PARTITION BY conv_id, participant ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS a FROM m)
SELECT conv_id, participant, 0::BIGINT AS part, 0::BIGINT AS "offset", count(*) AS n_messages, count(*) FILTER (speaker = participant) AS n_trained,
  string_agg(msg, '' ORDER BY k) AS rendered, coalesce(string_agg(a || '-' || (a + length(tx)), ',' ORDER BY k) FILTER (speaker = participant), '') AS trained
FROM s GROUP BY conv_id, participant
"""
