"""Embedding near-duplicates by lattice hashing.

A table projects every unit vector by random normal directions to ``blocks`` times eight numbers and decodes each eight
to the nearest point of the E8 lattice; the points together are the vector's home cell. It is also entered as a guest in
the ``PROBES`` cells nearest to it (the home point moved by one of the lattice's 240 shortest vectors in some blocks).
Two vectors meet if one's home is the other's home or guest cell in any table. ``plan`` measures, on random pairs at the
threshold, how often that happens, and takes as many tables as the wanted recall needs; the number of blocks follows
the number of vectors, so that strangers per cell stay few.

Meetings are checked in two steps: 64 signs of random hyperplanes must nearly agree (a bound set so that a pair at the
threshold fails with about 1e-5), then the cosine itself decides, in double precision.

Large groups aren't expanded into pairs. Equal vectors are one node. Every node of a cell is first compared with one
home node of it; then only cells whose nodes are still in different components are joined, nodes outside the cell's
largest component against the others. Inside a component the links of each vector are counted by matrix products
of bounded chunks, and only counts leave a task.
"""
from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from mailtriage.session import cut

from .text import free_name
from .union_find import components

SCALE, PROBES, MOVES, RECALL, STRANGERS = 0.5, 16, 6, 0.97, 8.0
#: Pairs for measuring a table's recall, directions of the sign sketch, rows of a chunk in counting.
PAIRS, SIGNS, CHUNK = 4000, 64, 1024


def shortest() -> "np.ndarray":
    """The 240 shortest vectors of E8: two entries of 1 or -1, or eight halves with an even number of minus signs."""
    import numpy as np
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for x, y in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = x, y
            out.append(v)
    out += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def decode(x: "np.ndarray") -> "np.ndarray":
    """Nearest point of E8 to each row: the nearer of the nearest points of D8 and of D8 moved by halves."""
    import numpy as np

    def d8(y):
        near = np.rint(y)
        off = y - near
        odd = np.flatnonzero(near.sum(1) % 2)
        worst = np.abs(off[odd]).argmax(1)
        near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
        return near

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Table:
    """One hash table: projections of ``blocks`` times eight directions, and a linear 64-bit hash of the points."""

    def __init__(self, seed: int, number: int, dim: int, blocks: int):
        import numpy as np
        r = np.random.default_rng([seed, number, dim, blocks])
        self.project = r.normal(size=(blocks, dim, 8)) * SCALE
        self.mix = r.integers(-(2 ** 63), 2 ** 63 - 1, size=(blocks, 8), dtype=np.int64)
        self.salt = r.integers(-(2 ** 63), 2 ** 63 - 1, dtype=np.int64)
        self.moves = shortest()
        self.steps = [((2 * self.moves).astype(np.int64) * m).sum(1) for m in self.mix]

    def cells(self, unit: "np.ndarray") -> "np.ndarray":
        """Home cell and ``PROBES`` guest cells of each row, nearest first."""
        import numpy as np
        n = len(unit)
        cost, key = np.zeros((n, 1)), np.full((n, 1), self.salt)
        row = np.arange(n)[:, None]
        for p, mix, step in zip(self.project, self.mix, self.steps):
            y = unit @ p
            c = decode(y)
            gain = (y - c) @ self.moves.T
            best = np.argpartition(-gain, MOVES, axis=1)[:, :MOVES] if len(self.steps) > 1 else np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
            home = ((2 * c).astype(np.int64) * mix).sum(1)[:, None]
            cost_b = np.concatenate([np.zeros((n, 1)), 2 - 2 * gain[row, best]], axis=1)
            key_b = np.concatenate([home, home + step[best]], axis=1)
            cost = (cost[:, :, None] + cost_b[:, None, :]).reshape(n, -1)
            key = (key[:, :, None] + key_b[:, None, :]).reshape(n, -1)
        rest = cost[:, 1:]  # the first is the home cell
        near = np.argpartition(rest, PROBES - 1, axis=1)[:, :PROBES] if rest.shape[1] > PROBES else np.broadcast_to(np.arange(rest.shape[1]), rest.shape)
        return np.concatenate([key[:, :1], key[:, 1:][row, near]], axis=1)


def plan(n: int, dim: int, cosine: float = 0.9, recall: float = RECALL, seed: int = 7) -> tuple[int, int]:
    """(blocks, tables) for ``n`` vectors, from simulated pairs at the threshold."""
    import numpy as np
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    if dim < 2:
        return 1, 1
    u = unit(r.normal(size=(PAIRS, dim)))
    w = r.normal(size=(PAIRS, dim))
    w = unit(w - (w * u).sum(1)[:, None] * u)
    v = cosine * u + math.sqrt(max(0.0, 1 - cosine * cosine)) * w
    blocks = 1
    while True:
        t = Table(seed, 0, dim, blocks)
        a, b = t.cells(u), t.cells(v)
        found = np.mean((a == b[:, :1]).any(1) | (b == a[:, :1]).any(1))
        _, count = np.unique(a[:, 0], return_counts=True)
        strange = (count * (count - 1)).sum() / (PAIRS * (PAIRS - 1))
        # beyond what the simulation can show, each block cuts the strangers by the first one's share
        first = strange if blocks == 1 else first
        if n * first ** blocks <= STRANGERS or blocks == 4 or found < 0.02:
            return blocks, max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-9, 1 - found))))
        blocks += 1


def hash_batches(seed: int, dims: dict[int, tuple[int, int]]):
    """Arrow batches (nid, v) -> (nid, sketch, cells): the cells of all tables, each home cell before its guests."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        made = {}
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                sizes = np.array(part.column(1).value_lengths())
                for dim in np.unique(sizes).tolist():
                    own = part.filter(pa.array(sizes == dim))
                    x = own.column(1).flatten().to_numpy().reshape(own.num_rows, dim)
                    if dim not in made:
                        blocks, tables = dims[dim]
                        r = np.random.default_rng([seed, dim])
                        made[dim] = [Table(seed, k, dim, blocks) for k in range(tables)], r.normal(size=(dim, SIGNS))
                    tables, planes = made[dim]
                    sketch = np.packbits(x @ planes >= 0, axis=1, bitorder="little").view(np.int64).ravel()
                    cells = np.concatenate([t.cells(x) for t in tables], axis=1)
                    flat = pa.array(cells.ravel(), pa.int64())
                    ends = pa.array(np.arange(0, cells.size + 1, cells.shape[1]), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [own.column(0), pa.array(sketch), pa.ListArray.from_arrays(ends, flat),
                         pa.array(np.full(own.num_rows, cells.shape[1] // len(tables)), pa.int32())],
                        names=["nid", "sketch", "cells", "width"])

    return run


def unit_vectors(rows: DataFrame, vec: str) -> DataFrame:
    """``v``: the vector divided by its length, as doubles; null where it has no direction (null, empty, zero, or a
    null or non-finite component)."""
    x = F.col(vec).cast("array<double>")
    finite = F.forall(x, lambda e: F.coalesce((F.abs(e) < F.lit(float("inf"))) & ~F.isnan(e), F.lit(False)))
    # scaled by the largest component first: squares neither overflow nor vanish
    peak = F.array_max(F.transform(x, lambda e: F.abs(e)))
    ok = F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite, F.lit(False))
    t = rows.withColumn("v", F.when(ok, x)).withColumn("peak", F.when(ok, peak))
    t = t.withColumn("v", F.when(F.col("peak") > 0, F.transform("v", lambda e: e / F.col("peak"))))
    t = t.withColumn("peak", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)))
    return t.withColumn("v", F.transform("v", lambda e: e / F.col("peak") + F.lit(0.0))).drop("peak")


def _near(a: Column, b: Column, most: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= most


def _linked(pairs: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """The pairs (a, b) of node ids whose cosine reaches the threshold."""
    x, y = nodes.select(F.col("nid").alias("a"), F.col("v").alias("va")), nodes.select(F.col("nid").alias("b"), F.col("v").alias("vb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    both = pairs.join(x, "a").join(y, "b").where(F.size("va") == F.size("vb"))
    return both.where(dot >= cosine).select("a", "b")


def link_nodes(nodes: DataFrame, n: int, dims: list[int], cosine: float, seed: int, recall: float) -> DataFrame:
    """``nodes(nid, v)`` -> ``(id, root)`` of all nodes but the smallest of each component."""
    turn = math.acos(cosine) / math.pi
    most = math.ceil(SIGNS * turn + 4.5 * math.sqrt(SIGNS * turn * (1 - turn)))
    plans = {d: plan(n, d, cosine, recall, seed) for d in dims}
    hashed = nodes.select("nid", "v").mapInArrow(hash_batches(seed, plans), "nid bigint, sketch bigint, cells array<bigint>, width int")
    entry = cut(hashed.select("nid", "sketch", "width", F.posexplode("cells").alias("at", "cell"))
                .select("cell", "nid", "sketch", (F.col("at") % F.col("width") == 0).alias("home")), "cells")
    host = F.when(F.col("home"), F.struct("nid", "sketch"))
    cells = (entry.groupBy("cell").agg(F.count("*").alias("n"), F.min(host).alias("host"))
             .where("n > 1 and host is not null").drop("n"))
    live = cut(entry.join(cells, "cell"), "live")
    star = (live.where(F.col("nid") != F.col("host.nid")).where(_near(F.col("sketch"), F.col("host.sketch"), most))
            .select(F.col("nid").alias("a"), F.col("host.nid").alias("b")).distinct())
    first = cut(components(_linked(star, nodes, cosine)), "first")
    at = cut(live.drop("host").join(first.withColumnRenamed("id", "nid"), "nid", "left")
             .withColumn("root", F.coalesce("root", "nid")), "entered")
    mixed = (at.groupBy("cell", "root").agg(F.count("*").alias("k"), F.max("home").alias("h")).groupBy("cell")
             .agg(F.count("*").alias("roots"), F.max("h").alias("h"), F.max_by("root", F.struct("k", "root")).alias("main"))
             .where("roots > 1 and h").select("cell", "main"))
    at = cut(at.join(mixed, "cell").withColumn("most", F.col("root") == F.col("main")).drop("main"), "mixed")
    other = at.select("cell", F.col("nid").alias("b"), F.col("sketch").alias("s2"), F.col("root").alias("r2"), F.col("most").alias("m2"))

    def met(hosts: DataFrame, guests: DataFrame) -> DataFrame:
        return (hosts.join(guests, "cell").where(F.col("root") != F.col("r2")).where(_near(F.col("sketch"), F.col("s2"), most))
                .select(F.least("nid", "b").alias("a"), F.greatest("nid", "b").alias("b")))

    pairs = met(at.where("home and not most"), other).unionAll(met(at.where("home and most"), other.where("not m2"))).distinct()
    rest = _linked(pairs, nodes, cosine)
    names = at.select("nid", "root").distinct()
    up = names.select(F.col("nid").alias("a"), F.col("root").alias("ra")), names.select(F.col("nid").alias("b"), F.col("root").alias("rb"))
    links = cut(rest.join(up[0], "a").join(up[1], "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    between = cut(components(links), "between")
    # a component of the first round may hang below another now
    low = first.join(between.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return low.unionAll(between.join(first.select("id"), "id", "left_anti").select("id", "root"))


def count_links(members: DataFrame, cosine: float, chunk: int = CHUNK) -> DataFrame:
    """``members(root, nid, v, copies)`` -> ``(nid, linked)``: copies of the other nodes of its component at the threshold.

    Small components share a task; a component of over ``chunk`` nodes is dealt into chunks, and each pair of chunks is
    a task of its own that returns counts only.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("m"))
    m = members.join(sizes, "root").withColumn("parts", F.ceil(F.col("m") / F.lit(chunk)).cast("int"))
    m = cut(m, "members")
    total = m.where("parts = 1").count()
    small = m.where("parts = 1").select(F.pmod(F.xxhash64("root"), F.lit(max(1, total // chunk))).alias("g"), F.lit(-1).alias("ca"), F.lit(-1).alias("cb"),
                                        "root", "nid", "v", "copies", F.lit(0).alias("own"))
    own = F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int")
    large = (m.where("parts > 1").withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select(F.col("root").alias("g"), F.least("own", "o").alias("ca"), F.greatest("own", "o").alias("cb"), "root", "nid", "v", "copies", "own"))

    def count(key, t):
        import numpy as np
        import pyarrow as pa
        root, nid, copies, part = (t[c].to_numpy() for c in ("root", "nid", "copies", "own"))
        sizes = np.array(t["v"].combine_chunks().value_lengths())
        flat, ends = t["v"].combine_chunks().flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
        order = np.lexsort((sizes, root))
        cuts = np.flatnonzero((np.diff(root[order]) != 0) | (np.diff(sizes[order]) != 0)) + 1
        ids, sums = [], []
        for at in np.split(order, cuts):
            x = np.stack([flat[ends[i]:ends[i + 1]] for i in at])
            for s in range(0, len(at), 512):  # a strip of the matrix at a time
                near = x[s:s + 512] @ x.T >= cosine
                near[np.arange(len(near)), np.arange(s, s + len(near))] = False
                if key[1].as_py() != key[2].as_py():  # two chunks: only across
                    near &= part[at[s:s + 512]][:, None] != part[at][None, :]
                ids.append(nid[at[s:s + 512]])
                sums.append(near @ copies[at])
        none = np.zeros(0, np.int64)
        return pa.table({"nid": pa.array(np.concatenate(ids or [none])), "linked": pa.array(np.concatenate(sums or [none]).astype(np.int64))})

    each = small.unionAll(large).groupBy("g", "ca", "cb").applyInArrow(count, "nid bigint, linked bigint")
    return each.groupBy("nid").agg(F.sum("linked").alias("linked"))


def near_duplicates(rows: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec: str = "embedding", seed: int = 7,
                    recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: ``id_col``, n_links, component_id, kept.

    Vectors without a direction (null, empty, zero, or with a null or non-finite component) link with nothing and are
    their own component. Vectors of different lengths don't link. Rows equal in the vector are linked copies; repeated
    ids are rows of their own. ``component_id`` is the smallest id of the component (nulls are passed over; null if all
    are), ``kept`` says whether the row has that id (repeated rows with it are all kept; null equals null). Other
    columns aren't read; an id column named like a result column raises ValueError. An empty table gives an empty result.
    """
    if id_col.lower() in {"n_links", "component_id", "kept", "v", "peak"}:
        raise ValueError(f"rename the id column {id_col}: a result column has that name")
    t = cut(unit_vectors(rows.select(F.col(id_col), F.col(vec).alias(free_name([id_col], "vec"))), free_name([id_col], "vec")).select(id_col, "v"), "units")
    nodes = cut(t.where("v is not null").groupBy("v").agg(F.count("*").alias("copies"), F.min(id_col).alias("first"))
                .withColumn("nid", F.monotonically_increasing_id()), "nodes")
    sizes = {r["d"]: r["n"] for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    spread = link_nodes(nodes, sum(sizes.values()), sorted(sizes), cosine, seed, recall) if sizes else None
    if spread is None:
        return t.select(id_col, F.lit(0).cast("bigint").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    spread = cut(spread, "components")
    roots = spread.unionAll(spread.select(F.col("root").alias("id"), "root").distinct()).withColumnRenamed("id", "nid")
    linked = cut(nodes.join(roots, "nid"), "linked")
    counts = count_links(linked.select("root", "nid", "v", "copies"), cosine, chunk)
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    told = cut(linked.join(counts, "nid", "left").join(least, "root").select("nid", "linked", "least"), "told")
    named = (nodes.join(told, "nid", "left")
             .select("v", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
                     F.when(F.col("linked").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")))
    out = t.where("v is not null").join(named, "v").select(id_col, "n_links", "component_id")
    alone = t.where("v is null").select(id_col, F.lit(0).cast("bigint").alias("n_links"), F.col(id_col).alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: near-duplicates of all embeddings at cosine 0.9."""
    from .text import read
    return near_duplicates(read(spark, sf_dir, "embeddings"))
