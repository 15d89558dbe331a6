"""Document fingerprints: threshold-scaled sketches.

A sketch holds every distinct 63-bit hash of the text's 5-word shingles (lower case) that is below
``2^63 / SCALE``, a fixed fraction of all hashes. Short texts have few, so the sketch is filled up to ``LEAST`` with
the next smallest hashes. ``cover`` is the value up to which the sketch is complete, so two sketches are
compared, or merged, over the hashes both would have retained. Containment of the smaller in the larger works
between documents of very unequal length.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from mailtriage.session import cut

from .text import free_name, hex16, read, refuse, words

SHINGLE, SCALE, LEAST = 5, 8, 16
TOP = (1 << 63) - 1
#: Documents of a range of the id order, and ranges at most (their heads are broadcast: 40 bytes each).
RANGE_ROWS, RANGES = 100_000, 100_000


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` plus column ``name``: struct(hashes sorted, cover). No word: an empty sketch that covers everything.
    Fewer than 5 words are one shingle."""
    w, h, s, a = (f"__{name}_{x}" for x in "whsa")
    d = df.withColumn(w, words(F.lower(F.col(text))))
    shingles = F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(
        *[F.get(F.col(w), i + k) for k in range(SHINGLE)]))).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(
        F.array().cast("array<bigint>"))
    d = d.withColumn(h, F.transform(shingles, lambda x: F.shiftrightunsigned(x, 1)))
    limit = TOP // SCALE
    d = d.withColumn(s, F.sort_array(F.array_distinct(F.filter(F.col(h), lambda x: x <= limit))))
    d = d.withColumn(a, F.when(F.size(s) < LEAST, F.sort_array(F.array_distinct(F.col(h)))))
    few = F.struct(F.slice(F.col(a), 1, LEAST).alias("hashes"),
                   F.when(F.size(a) <= LEAST, F.lit(TOP)).otherwise(F.get(F.col(a), LEAST - 1)).alias("cover"))
    d = d.withColumn(name, F.when(F.col(a).isNotNull(), few).otherwise(F.struct(F.col(s).alias("hashes"), F.lit(limit).alias("cover"))))
    return d.drop(w, h, s, a)


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger, over what both cover. Two empty sketches: 1, one: 0."""
    cover = F.least(a["cover"], b["cover"])
    x = F.filter(a["hashes"], lambda v: v <= cover)
    y = F.filter(b["hashes"], lambda v: v <= cover)
    small = F.least(F.size(x), F.size(y))
    both_empty = (F.size(a["hashes"]) == 0) & (F.size(b["hashes"]) == 0)
    return F.when(both_empty, F.lit(1.0)).when(small == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(x, y)) / small)


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts together: what both cover, united."""
    cover = F.least(a["cover"], b["cover"])
    return F.struct(F.sort_array(F.filter(F.array_union(a["hashes"], b["hashes"]), lambda v: v <= cover)).alias("hashes"), cover.alias("cover"))


def as_text(sketch: Column) -> Column:
    """The whole sketch: ``cover``, then the hashes in order, 16 hex digits each; ``from_text`` reads it back."""
    return F.concat(hex16(sketch["cover"]), F.array_join(F.transform(sketch["hashes"], hex16), ""))


def from_text(fingerprint: Column) -> Column:
    """The sketch written by ``as_text``, to compare or merge fingerprints that were stored."""
    numbers = F.transform(F.sequence(F.lit(0), F.floor(F.length(fingerprint) / 16).cast("int") - 1),
                          lambda i: F.conv(F.substring(fingerprint, i * 16 + 1, F.lit(16)), 16, 10).cast("bigint"))
    return F.struct(F.slice(numbers, 2, F.size(numbers)).alias("hashes"), F.get(numbers, F.lit(0)).alias("cover"))


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``sketch``. Whole texts; null as empty. Equal texts have equal sketches; rows are judged one by one.
    A column named sketch is refused."""
    refuse(docs.columns, ["sketch"])
    t = free_name(docs.columns, "__t")
    return with_sketch(docs.withColumn(t, F.coalesce(F.col(text), F.lit(""))), t, "sketch").drop(t)


def with_next(docs: DataFrame, carry: dict[str, Column], ask: Column | None = None, derive=lambda rows: rows) -> DataFrame:
    """``derive(docs)`` plus ``next_<c>`` for each item of ``carry``, an expression over the next row by descending
    doc_id, the first row's after the last. It may use ``asked``, which is ``ask`` of the row that it goes to, so that no more
    than is wanted of a long text is sent. Null ids come last, equal ids in order of the text's hashes. Rows
    equal in id and text follow each other, so all but one of them have themselves as next; their other columns are
    taken from one of them. No column may be named asked or start with two underscores.

    Order is found on ids and hashes alone: sorted by range, each range ranked apart, and a ring of one row a range leads
    from the last of one to the first of the next. Ranges have equal numbers of rows, whatever the ids are. The values come by a join.
    """
    key = ["__null", "__k", "__h", "__g"]
    own, kind = [c for c in docs.columns if c != "doc_id"], docs.schema["doc_id"].dataType
    ask = F.lit(None) if ask is None else ask
    docs = (docs.withColumn("__null", F.col("doc_id").isNull()).withColumn("__k", F.coalesce("doc_id", F.lit(0)).cast("bigint"))
            .withColumn("__h", F.xxhash64("text")).withColumn("__g", F.xxhash64(F.lit(1), "text")))
    keys = cut(docs.groupBy(*key).agg(F.count("*").alias("__n"), F.max(ask.cast("bigint")).alias("__ask")), "keys")
    ranges = max(1, min(RANGES, -(-keys.count() // RANGE_ROWS)))
    order = [F.col("__null"), F.col("__k").desc(), F.col("__h"), F.col("__g")]
    dealt = cut(keys.repartitionByRange(ranges, *order).withColumn("__b", F.spark_partition_id()), "ranges")
    to = F.struct(*key, "__ask")
    # at most RANGES rows: the last row of the range before each (before the first: of the last)
    rank = F.struct("__null", -F.col("__k").cast("decimal(38,0)"), "__h", "__g")
    tails = dealt.groupBy("__b").agg(F.max_by(to, rank).alias("__tail"))
    ring = Window.orderBy("__b")
    everything = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tails = cut(tails.select("__b", F.coalesce(F.lag("__tail").over(ring), F.last("__tail").over(everything)).alias("__tail")), "ring")
    links = dealt.withColumn("__to", F.lag(to).over(Window.partitionBy("__b").orderBy(*order))).join(F.broadcast(tails), "__b")
    links = links.select(*key, "__n", "__ask", F.coalesce("__to", "__tail").alias("__to"))
    rows = docs.groupBy(*key).agg(*[F.first(c).alias(c) for c in own])  # one of each, combined before the shuffle
    rows = derive(rows.withColumn("doc_id", F.when(~F.col("__null"), F.col("__k")).cast(kind)))
    sent = rows.join(links, key).withColumn("asked", F.col("__to.__ask"))
    sent = sent.select(*[F.col(f"__to.{k}").alias(f"{k}2") for k in key], *[v.alias(f"next_{c}") for c, v in carry.items()])
    both = rows.join(links, key).join(sent, [F.col(k) == F.col(f"{k}2") for k in key])
    both = both.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n")))).withColumn("asked", F.col("__ask"))
    return both.select(*[c for c in rows.columns if c not in key], *[
        F.when(F.col("__copy") == 1, F.col(f"next_{c}")).otherwise(v).alias(f"next_{c}") for c, v in carry.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: fingerprints of every text and of its edited form, and their likeness."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    head = F.substring(F.col("text"), F.lit(1), F.col("asked").cast("int"))
    d = with_next(docs, {"head": head, "sketch": F.col("sketch")}, half, lambda rows: with_sketch(rows, "text", "sketch"))
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.col("next_head")))
    d = with_sketch(d, "edited", "edited_sketch")
    return d.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
                    likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                    likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
