"""Multi-party perspective rotation of conversations.

For every participant the dialogue is rendered with that speaker as the assistant, the others as named users, and
a mask over the assistant's words. System turns stay system turns and are no participant.

A dialogue is cut into parts of bounded length at turn boundaries (by each turn's offset in the whole
rendering), so that one very long conversation is many rows. Offsets are running sums in two levels,
blocks of turns and then totals of blocks; no window holds a whole long dialogue.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .text import read

SYSTEM, UNNAMED, END = "system", "unnamed", "<|end|>"
PART_CHARS, BLOCK_TURNS = 65_536, 512


def rotate(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> one row per (conv_id, perspective, part).

    Columns: n_turns, ``text`` (parts in order concatenate to the whole rendering), ``mask`` ("start:end" pairs in
    code points of the part, comma-joined: the assistant's words and their end mark), ``n_masked`` (their length).
    Turns go by turn number (null last), then role, then text; repeated rows are repeated turns. A null role speaks
    as "unnamed", a null text says nothing, rows with a null conv_id are one conversation. ``<|`` in
    names and texts becomes ``<||``, so that marks can't be forged. A conversation of system turns alone has no
    perspective. Other columns are not read; an empty table gives an empty result.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<||"))
    t = turns.select(F.col("conv_id").alias("c"), "turn", F.coalesce(F.col("role"), F.lit(UNNAMED)).alias("role"),
                     safe(F.coalesce(F.col("text"), F.lit(""))).alias("body"))
    who = t.where(F.col("role") != SYSTEM).select(F.col("c").alias("pc"), F.col("role").alias("perspective")).distinct()
    r = t.join(who, F.col("c").eqNullSafe(F.col("pc"))).drop("pc")
    mine = (F.col("role") == F.col("perspective")) & (F.col("role") != SYSTEM)
    head = F.when(F.col("role") == SYSTEM, F.lit("<|system|>\n")).when(mine, F.lit("<|assistant|>\n")).otherwise(
        F.concat(F.lit("<|user name="), safe(F.col("role")), F.lit("|>\n")))
    r = r.select("c", "perspective", "turn", "role", "body", mine.alias("mine"), F.length(head).alias("h"),
                 F.concat(head, "body", F.lit(END + "\n")).alias("seg"),
                 F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit((1 << 62))).alias("block"))
    r = r.withColumn("len", F.length("seg").cast("bigint"))
    inside = Window.partitionBy("c", "perspective", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "body")
    r = r.withColumn("k", F.row_number().over(inside)).withColumn("at", F.sum("len").over(
        inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len"))
    totals = r.groupBy("c", "perspective", "block").agg(F.sum("len").alias("total"))
    before = Window.partitionBy("c", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("c").alias("tc"), F.col("perspective").alias("tp"), F.col("block").alias("tb"),
                           F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    r = r.join(totals, F.col("c").eqNullSafe(F.col("tc")) & (F.col("perspective") == F.col("tp")) & (F.col("block") == F.col("tb")))
    r = r.withColumn("at", F.col("at") + F.col("first")).withColumn("part", F.floor(F.col("at") / part_chars).cast("bigint"))
    g = r.groupBy("c", "perspective", "part").agg(F.min("at").alias("p0"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list(
        F.struct("at", "block", "k", "seg", "h", "mine", "len"))).alias("s"))
    mask = F.transform(F.filter("s", lambda x: x["mine"]), lambda x: F.concat_ws(
        ":", (x["at"] - F.col("p0") + x["h"]).cast("string"), (x["at"] - F.col("p0") + x["len"] - 1).cast("string")))
    masked = F.aggregate(F.filter("s", lambda x: x["mine"]), F.lit(0).cast("bigint"), lambda a, x: a + x["len"] - 1 - x["h"])
    return g.select(F.col("c").alias("conv_id"), "perspective", "part", "n_turns",
                    F.array_join(F.transform("s", lambda x: x["seg"]), "").alias("text"),
                    F.array_join(mask, ",").alias("mask"), masked.alias("n_masked"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all conversations from every participant's side."""
    return rotate(read(spark, sf_dir, "conversations"))


ORACLE = f"""
with t as (select conv_id, turn, coalesce(role, '{UNNAMED}') as role, replace(coalesce(text, ''), '<|', '<||') as body from conversations),
p as (select distinct conv_id, role as perspective from t where role <> '{SYSTEM}'),
r as (select t.*, perspective, role = perspective as mine,
        case when role = '{SYSTEM}' then '<|system|>' || chr(10) when role = perspective then '<|assistant|>' || chr(10)
             else '<|user name=' || replace(role, '<|', '<||') || '|>' || chr(10) end as head
      from t join p on t.conv_id is not distinct from p.conv_id),
s as (select *, head || body || '{END}' || chr(10) as seg, row_number() over w as k,
        sum(length(head || body) + {len(END) + 1}) over (w rows between unbounded preceding and current row) - length(head || body) - {len(END) + 1} as st
      from r window w as (partition by conv_id, perspective order by turn nulls last, role, body)),
q as (select *, floor(st / {PART_CHARS})::bigint as part from s),
u as (select *, min(st) over (partition by conv_id, perspective, part) as p0 from q)
select conv_id, perspective, part, count(*) as n_turns, string_agg(seg, '' order by k) as text,
  coalesce(string_agg((st - p0 + length(head))::bigint || ':' || (st - p0 + length(seg) - 1)::bigint, ',' order by k) filter (mine), '') as mask,
  coalesce(sum(length(seg) - 1 - length(head)) filter (mine), 0)::bigint as n_masked
from u group by conv_id, perspective, part
"""
