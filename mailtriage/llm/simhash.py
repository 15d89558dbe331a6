"""SimHash near-duplicates by segment popcounts.

A document's fingerprint has 64 bits; bit k is 1 if over half of its shingle hashes have bit k set. The bits
are cut into 32 segments of two, and a fingerprint is embedded as the vector of its segments' bit counts,
each count written in unary (0: 00, 1: 01, 2: 11). The Manhattan distance of two vectors is then the number
of differing bits of their embeddings, and never more than the fingerprints' own distance.

Grid range-join: the vector is cut into ``max_bits // 2 + 1`` blocks. If two fingerprints are within
``max_bits``, some block's vectors are within Manhattan distance 1, so they lie in the same or in neighbouring
grid cells of that block. Candidates meet on (block, cell); their whole Manhattan distance is the lower bound
checked first, the distance of the fingerprints decides.

Groups of copies stay cheap: equal fingerprints are one node, and before any pair is joined every node is
compared with the most frequent node of its cell (a star, linear in the cell). Only nodes that are still in
different components meet in the pair join, so a large group of near copies isn't expanded into its pairs,
and no link is lost.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from mailtriage.session import cut

from .text import free_name, hex16, refuse, tidy
from .union_find import components

PAIRS = 0x5555555555555555


def fingerprint_batches(shingle: int):
    """Arrow batches (.., text) -> (.., fp): the text column is replaced by the signed 64-bit fingerprint."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_digest

        def fingerprint(text: str | None) -> int:
            w = (text or "").encode().lower().split()  # bytes: A-Z and the six white space characters only
            if not w:
                return 0
            shingles = [b" ".join(w)] if len(w) <= shingle else list(map(b" ".join, zip(*(w[i:] for i in range(shingle)))))
            ones, n = np.zeros(64, np.int64), len(shingles)
            for at in range(0, n, 16384):
                packed = np.frombuffer(b"".join([digest(s, 42) for s in shingles[at:at + 16384]]), np.uint8)
                ones += np.unpackbits(packed.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
            return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)

        for b in batches:
            fp = pa.array([fingerprint(t.as_py()) for t in b.column(b.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fp], names=[*b.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, keys: list[str], shingle: int = 3, text: str = "text") -> DataFrame:
    """``keys`` and ``fp`` (signed long) of every row; whole texts. Null or wordless texts have fingerprint 0."""
    part = docs.select(*keys, F.col(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1]] + ["fp bigint"])
    return part.mapInArrow(tidy(fingerprint_batches(shingle)), schema)


def _bits(value: Column) -> Column:
    return F.bit_count(value)


def embedding(fp: Column) -> Column:
    """Unary bit counts of the 32 two-bit segments."""
    up = F.shiftrightunsigned(fp, 1)
    low = fp.bitwiseOR(up).bitwiseAND(F.lit(PAIRS))
    high = fp.bitwiseAND(up).bitwiseAND(F.lit(PAIRS))
    return low.bitwiseOR(F.shiftleft(high, 1))


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block: two-bit segments dealt out evenly."""
    n = max_bits // 2 + 1
    cuts = [2 * (32 * i // n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _cells(e: Column, max_bits: int, upper: bool) -> Column:
    """Array of (block, cell, own): the cells of an embedding; with ``upper`` also the cells one count higher."""
    out = []
    for k, (at, bits) in enumerate(_blocks(max_bits)):
        c = F.shiftrightunsigned(e, at).bitwiseAND(F.lit((1 << bits) - 1)) if bits < 64 else e
        out.append(F.struct(F.lit(k).alias("block"), c.alias("cell"), F.lit(True).alias("own")))
        if upper:
            for s in range(0, bits, 2):
                one, two = F.lit(1 << s), F.lit((2 << s) if s < 62 else -(1 << 63))
                raised = F.when(c.bitwiseAND(one) == 0, c.bitwiseOR(one)).when(c.bitwiseAND(two) == 0, c.bitwiseOR(two))
                out.append(F.struct(F.lit(k).alias("block"), raised.alias("cell"), F.lit(False).alias("own")))
    return F.array(*out)


def link_components(nodes: DataFrame, max_bits: int) -> DataFrame:
    """``nodes(fp, copies)``, one row per fingerprint -> ``(id, root)`` of all but the root of each component."""
    nodes = nodes.select("fp", "copies", embedding(F.col("fp")).alias("e"))
    near = lambda a, b: _bits(F.col(a).bitwiseXOR(F.col(b))) <= max_bits
    cell = nodes.select("fp", "copies", "e", F.inline(_cells(F.col("e"), max_bits, False)))
    rank = F.shiftleft(F.least("copies", F.lit((1 << 22) - 1)), 40).bitwiseOR(F.shiftrightunsigned(F.xxhash64("fp"), 24))
    heads = (cell.groupBy("block", "cell").agg(F.count("*").alias("n"), F.max_by("fp", rank).alias("head"))
             .where("n > 1").drop("n"))
    star = (cell.join(heads, ["block", "cell"]).where(F.col("fp") != F.col("head")).where(near("fp", "head"))
            .select(F.col("fp").alias("a"), F.col("head").alias("b")))
    star = cut(star.distinct(), "star")
    first = components(star)
    at = nodes.select("fp", "e").join(first.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    at = cut(at, "nodes")
    left = at.select("fp", "e", "root", F.inline(_cells(F.col("e"), max_bits, False))).drop("own")
    right = (at.select("fp", "e", "root", F.inline(_cells(F.col("e"), max_bits, True))).where("cell is not null")
             .select("block", "cell", "own", F.col("fp").alias("fp2"), F.col("e").alias("e2"), F.col("root").alias("root2")))
    links = (left.join(right, ["block", "cell"]).where("root <> root2 and (not own or fp < fp2)")
             .where(near("e", "e2")).where(near("fp", "fp2"))
             .select(F.col("root").alias("a"), F.col("root2").alias("b"))).distinct()
    between = components(links)
    named = at.select("fp", "root").join(between.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left")
    return named.select(F.col("fp").alias("id"), F.coalesce("top", "root").alias("root")).where("id <> root")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                    text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, any ``keep`` columns, ``fp``, ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most ``max_bits`` differing bits (null ids
    are passed over; it is null if a component has only null ids). Null, empty and wordless texts have
    fingerprint 0 and are linked like any other. Repeated rows are kept; rows with one id but different texts
    are separate rows, each in the component of its own text. An empty table gives an empty result. An id or
    ``keep`` column named fp or component_id is refused.
    """
    refuse([id_col, *(keep or [])], ["fp", "component_id"])
    fps = cut(fingerprints(docs, [id_col, *(keep or [])], shingle, text), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.count("*").alias("copies"), F.min(id_col).alias("first"))
    nodes = cut(nodes, "distinct")
    roots = link_components(nodes, max_bits)
    top = nodes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    top = cut(top, "roots")
    least = top.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = cut(top.join(least, "root").select("fp", "component_id"), "components")
    return fps.join(by_fp, "fp").select(id_col, *(keep or []), "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one document of each near-duplicate component: the smallest doc_id.

    A component whose ids are all null keeps its rows with the smallest text hash. Where several rows share
    the kept id, the smallest text hash decides; rows equal in id and text are one document and stay together.
    """
    h, lost_id, lost_hash = (free_name(docs.columns, c) for c in ("text_hash", "lost_id", "lost_hash"))
    marked = cut(near_duplicates(docs.withColumn(h, F.xxhash64("text")), shingle, max_bits, keep=[h]), "marked")
    lost = marked.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = marked.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # a null id is kept only in a component without ids; such components differ by fp and share the null key
    least = kept.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("f")).agg(F.min(h).alias("m"))
    tied = (kept.withColumn("f", F.when(F.col("component_id").isNull(), F.col("fp"))).alias("k")
            .join(least.alias("l"), F.col("k.component_id").eqNullSafe(F.col("l.component_id")) & F.col("k.f").eqNullSafe(F.col("l.f")))
            .where(F.col(f"k.{h}") != F.col("l.m")).select("k.doc_id", f"k.{h}"))
    drop = cut(lost.select("doc_id", h).unionAll(tied).distinct().toDF(lost_id, lost_hash), "dropped")
    out = docs.join(drop, F.col("doc_id").eqNullSafe(F.col(lost_id)) & (F.xxhash64("text") == F.col(lost_hash)), "left_anti")
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op4: fingerprints and components of all documents."""
    from .text import read
    out = near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
