"""Two-pass external shuffle into shards.

Pass 1 scatters: a row's shard is the winner among the shards' seeded hashes with its id (highest random
weight), so the id and the number of shards decide, and one more shard takes rows only into itself. Inside a
shard, rows go to memory-sized buckets by a seeded hash of the whole row; a shard has as many as its own size asks for, and
copies of one row that would make a bucket too large by themselves are numbered and spread. Pass 2 reads one
bucket at a time, puts it into a fixed order, shuffles it by Fisher-Yates with the bucket's seed, and writes
it to the shard's folder. Bucket after bucket, a shard is then in random order, and a rerun or a retried task gives the same.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from mailtriage.session import checkpoint_dir, cut

SHARDS, SEED = 40, 20240201
#: Bytes of a bucket, by which their number is chosen from the table's size.
BUCKET_BYTES = 16 << 20
#: Rows with more copies than this part of the table's bytes are spread; so there are fewer of them than this.
HOT = 200_000


def row_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 16


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Highest random weight: the shard whose seeded hash with the key is largest (ties: the larger number)."""
    return F.greatest(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("w"), F.lit(s).alias("s"))
                        for s in range(shards)])["s"]


def _fisher_yates(seed: int):
    def run(key, rows, start):
        import numpy as np
        import pyarrow as pa

        shard, bucket = key[0].as_py(), key[1].as_py()
        order = np.lexsort((rows.column("h2").to_numpy(), rows.column("h1").to_numpy()))  # equal rows are interchangeable
        draws = np.random.default_rng([seed, shard, bucket]).integers(0, np.arange(1, rows.num_rows + 1)).tolist()
        order = order.tolist()
        for i in range(rows.num_rows - 1, 0, -1):  # Fisher-Yates: place i gets any of the first i + 1
            order[i], order[draws[i]] = order[draws[i]], order[i]
        out = rows.take(pa.array(order, pa.int64())).drop_columns(["bucket", "h1", "h2"])
        return out.append_column("slot", pa.array(start.column("first")[0].as_py() + np.arange(rows.num_rows)))

    return run


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text: str = "text",
                   bucket_bytes: int = BUCKET_BYTES, folder: str | None = None) -> DataFrame:
    """The columns of ``docs`` plus ``shard`` and ``slot`` (0, 1, ... in the shard), read from the written shards.

    The shards are folders ``shard=N`` below ``folder`` (default: a new one in the shared work folder). A file holds whole
    buckets, in the order of the slots, which isn't broken by a later sort or join. Null texts
    count 16 bytes. All rows of one id, null ids included, share a shard, as the law demands; they still spread
    over the shard's buckets by the hash of the whole row. Rows equal in every column are interchangeable; copies with more bytes
    than a quarter of a bucket (or the ``HOT``-th part of the table) spread by their number. Columns of ``docs`` named shard, slot
    or the like are refused. An empty table gives an empty result, and so no folder of a shard.
    """
    clash = {c.lower() for c in docs.columns} & {"shard", "slot", "bucket", "h1", "h2", "n", "copy", "hot"}
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    cols = docs.columns
    whole = [F.col(c) for c in cols]
    placed = docs.select(*cols, shard_of(F.col(id_col), shards, seed).alias("shard"), F.xxhash64(F.lit(seed), *whole).alias("h1"),
                         F.xxhash64(F.lit(1), F.lit(seed), *whole).alias("h2"))
    # 32 bytes a different row: how often it is there, and how large it is
    rows = cut(placed.groupBy("shard", "h1", "h2").agg(F.count("*").alias("n"), F.max(row_bytes(F.col(text))).alias("size")), "rows")
    sizes = {r["shard"]: r["b"] for r in rows.groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).alias("b")).collect()}  # one a shard
    count = F.array(*[F.lit(max(1, -(-sizes.get(s, 0) // bucket_bytes))) for s in range(shards)])
    bucket = F.pmod(F.xxhash64("h1", "copy"), F.get(count, F.col("shard"))).cast("int").alias("bucket")
    most = max(bucket_bytes // 4, sum(sizes.values()) // HOT)
    is_hot = (F.col("n") > 1) & (F.col("n") * F.col("size") > most)
    numbers = F.explode(F.when(is_hot, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array(F.lit(0).cast("bigint")))).alias("copy")
    counts = (rows.select("shard", "h1", "n", is_hot.alias("hot"), numbers).select("shard", bucket, F.when(F.col("hot"), 1).otherwise(F.col("n")).alias("n"))
              .groupBy("shard", "bucket").agg(F.sum("n").alias("n")))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # fewer than HOT rows: each stands for more than a HOT-th of the table
    hot = F.broadcast(rows.where(is_hot).select("shard", "h1", "h2"))
    key = ["shard", "h1", "h2"]
    single = placed.join(hot, key, "left_anti").withColumn("copy", F.lit(0).cast("bigint"))
    copied = (placed.join(hot, key, "left_semi").groupBy(*placed.columns).agg(F.count("*").alias("n"))
              .select(*placed.columns, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")))
    dealt = single.select(*placed.columns, "copy").unionByName(copied).select(*cols, "shard", bucket, "h1", "h2")
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    mixed = dealt.groupBy("shard", "bucket").cogroup(starts.groupBy("shard", "bucket")).applyInArrow(_fisher_yates(seed), schema)
    folder = folder or f"{checkpoint_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    mixed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.schema(schema).parquet(folder).select(*cols, "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents in 40 shards under the key law."""
    from .text import read
    out = shuffle_shards(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", row_bytes(F.col("text")).alias("size"),
                      F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
                      F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"))
