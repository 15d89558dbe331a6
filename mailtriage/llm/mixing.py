"""Mixing sources to target weights by systematic sampling.

A source's rate is its target divided by its size; every document of it is expected that many times. The
expected copies are prefix-summed over the source's documents, one random offset is added, and a document is emitted
once for each integer the running sum crosses. The documents of a source stand in order of size class and then of
a seeded hash, so the sample holds every size in proportion and its words come near the target.

The prefix sum is a rank times the rate, and the rank is found in two levels: cells of (source, size class, hash
range), whose counts are summed over cells, and a row number inside each cell. The number of hash ranges follows
the largest source's rows, so no cell grows with the input.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from mailtriage.session import cut

from .text import free_name, read, words

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"
#: Rows of a source for each range of hash values, by which their number is chosen.
CELL_ROWS = 20_000


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes(source, source_size)`` -> plus ``weight`` and ``target``.

    Weights repeat over the sources in code point order, null last. Targets share ``share`` times all sizes by
    weight; none is over ``most`` times its source, and what is over is shared again. The result is a common level
    per weight: sources are taken in the order of cap / weight, and the level is that of the first source that stays below its cap. One row per source: a small table.
    """
    every = Window.partitionBy()
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    choose = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.select("source", "source_size", choose.alias("weight")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    t = t.withColumn("all", F.sum("source_size").over(every) * F.lit(float(share))).withColumn(
        "level", (F.col("all") - F.coalesce(F.sum("cap").over(upto), zero))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), zero)))
    t = t.withColumn("free", F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level")))
    level = F.max("free").over(every)
    return t.select("source", "source_size", "weight",
                    F.coalesce(F.least(F.col("cap"), F.col("weight") * level), F.col("cap")).alias("target"))


def mix(docs: DataFrame, seed: str = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every row of ``docs`` plus ``size``, ``source_size``, ``target`` and ``copies`` (0, 1 or 2).

    Null texts have size 0 and null sources are a source. Rows of one doc_id (null ids too) are ordered by the md5
    of their texts; rows equal in both share their places in the order. Sources without a word have target 0 and
    no copies. An empty table gives an empty result. Columns of ``docs`` with those four names are refused.
    """
    clash = {c.lower() for c in docs.columns} & {"size", "source_size", "target", "copies"}
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    own = {n: free_name(docs.columns, n) for n in ("class", "u", "part", "n", "first", "rank", "rate", "s")}
    docs = docs.withColumn("size", F.size(words(F.col("text"))).cast("bigint"))
    counts = cut(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    ranges = max(1, -(-(counts.agg(F.max("n")).first()[0] or 0) // cell_rows))
    t = targets(counts).select(F.col("source").alias(own["s"]), "source_size", "target",
                               F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(own["rate"]))
    t = cut(t, "targets")
    row = docs.withColumn(own["class"], F.floor(F.sqrt("size")).cast("int")).withColumn(
        own["u"], unit(F.lit(seed), F.col("doc_id").cast("string"))).withColumn(
        own["part"], F.floor(F.col(own["u"]) * ranges).cast("int"))
    cell = ["source", own["class"], own["part"]]
    cells = cut(row.groupBy(*cell).agg(F.count("*").alias(own["n"])), "cells")
    before = Window.partitionBy("source").orderBy(own["class"], own["part"]).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn(own["first"], F.coalesce(F.sum(own["n"]).over(before), F.lit(0))).drop(own["n"])
    cells = cut(cells.join(t, F.col("source").eqNullSafe(F.col(own["s"])), "left").drop(own["s"]), "cells")
    inside = Window.partitionBy(*cell).orderBy(own["u"], F.col("doc_id"), F.md5("text"))
    row = row.withColumn(own["rank"], F.row_number().over(inside))
    c = cells.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(cell)], own["first"], own["rate"], "source_size", "target")
    row = row.join(c, F.col(cell[0]).eqNullSafe(F.col("__0")) & (F.col(cell[1]) == F.col("__1")) & (F.col(cell[2]) == F.col("__2")))
    place = F.col(own["first"]) + F.col(own["rank"])
    off = unit(F.lit(seed), F.lit("offset"), F.col("source"))
    rate = F.col(own["rate"])
    copies = (F.floor(place * rate + off) - F.floor((place - 1) * rate + off)).cast("int")
    keep = [c for c in docs.columns]
    return row.select(*keep, "source_size", "target", copies.alias("copies"))


def repeated(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Pipeline form: the columns of ``docs``, each row as often as the mix takes it."""
    cols = docs.columns
    k = free_name(cols, "copy")
    mixed = mix(docs, seed).where("copies > 0")
    return mixed.select(*cols, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(k)).select(*cols)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: how often the mix takes each document."""
    out = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


ORACLE = r"""
with d as (select doc_id, source, text,
             len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size from documents),
s0 as (select source, sum(size)::bigint as source_size, count(*) as n from d group by source),
s1 as (select source, source_size, n, ([5.0, 2.0, 1.0])[((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int]::double as weight,
         source_size * 2.0::double as cap from s0),
s2 as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
       from s1 window w as (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding)),
s3 as (select *, max(case when cap / weight >= level then level end) over () as lv from s2),
s as (select source, source_size, coalesce(least(cap, weight * lv), cap) as target from s3),
r as (select d.*, ('0x' || substr(md5(concat_ws('|', 'mix-1', doc_id::varchar)), 1, 8))::bigint / 4294967296.0::double as u,
        floor(sqrt(size::double))::int as class from d),
k as (select r.*, s.source_size, s.target, case when s.source_size > 0 then s.target / s.source_size else 0 end as rate,
        row_number() over (partition by r.source order by class, u, doc_id, md5(text)) as place,
        ('0x' || substr(md5(concat_ws('|', 'mix-1', 'offset', r.source)), 1, 8))::bigint / 4294967296.0::double as off
      from r join s on r.source is not distinct from s.source)
select doc_id, size, source_size, target, ((floor(place * rate + off) - floor((place - 1) * rate + off)) * size)::bigint as taken from k
"""
