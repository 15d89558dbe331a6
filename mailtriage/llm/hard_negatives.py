"""Hard negatives over an inverted multi-index.

Vectors are cut into two halves, each with a codebook of ``CODES`` centres (k-means on a bounded sample); a pair of codes
is a cell. A row's score with an anchor is at most the sum of two half scores: anchor half times centre, plus the anchor
half's length times the radius of the code. Each anchor's two lists of half bounds are sorted, and the multi-sequence
heap yields cells by falling sum. The best rows seen are final as soon as the next sum lies below the last of them
(rows that equal it may still win the tie by id), or below the window: the window is then certified and the visit ends.

Every row is indexed. Rows are dealt by hash into shards of about ``SHARD_ROWS``, each an index of its own with its own
radii, and anchors into groups of about ``ANCHOR_ROWS``; every pair of shard and group is one bounded task. The best
rows of all shards meet in one ranking. First the positives are found so, then the negatives of all their windows.
"""
from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from mailtriage.session import cut

#: Centres of a half, rows of the k-means sample and its rounds, rows of a shard, anchors of a group.
CODES, SAMPLE, ROUNDS, SHARD_ROWS, ANCHOR_ROWS = 16, 4096, 8, 8192, 2048


def codebook(x: "np.ndarray", codes: int, rounds: int = ROUNDS) -> "np.ndarray":
    """Centres of k-means; starts from rows spread evenly over the sample, so reruns agree."""
    import numpy as np
    c = x[np.linspace(0, len(x) - 1, min(codes, len(x))).astype(int)]
    for _ in range(rounds):
        at = nearest(x, c)
        c = np.stack([x[at == k].mean(0) if (at == k).any() else c[k] for k in range(len(c))])
    return c


def nearest(x: "np.ndarray", c: "np.ndarray") -> "np.ndarray":
    return ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)


def matrix(column, dim: int) -> "np.ndarray":
    """Vectors as rows of ``dim`` integers (shorter ones padded with zeros)."""
    import numpy as np
    column = column.combine_chunks()
    flat, sizes = column.flatten().to_numpy(), np.array(column.value_lengths())
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    for k, (end, n) in enumerate(zip(np.cumsum(sizes), sizes)):
        out[k, :n] = flat[end - n:end]
    return out


class MultiIndex:
    """The rows of one shard, sorted by cell."""

    def __init__(self, x: "np.ndarray", books: tuple, exact_floats: bool):
        import numpy as np
        self.half = books[0].shape[1]
        f = x.astype(np.float64)
        halves = f[:, :self.half], f[:, self.half:]
        code = [nearest(h, b) for h, b in zip(halves, books)]
        n = len(books[1])
        self.order = np.argsort(code[0] * n + code[1], kind="stable")
        #: integers as doubles while their products and sums are exact, else as Python integers
        self.x = f[self.order] if exact_floats else x[self.order].astype(object)
        self.cells = np.searchsorted((code[0] * n + code[1])[self.order], np.arange(len(books[0]) * n + 1))
        self.books, self.n = books, n
        self.used = [np.unique(c) for c in code]
        self.radius = [np.array([np.sqrt(((h[c == k] - b[k]) ** 2).sum(1).max()) for k in u]) for h, b, c, u in zip(halves, books, code, self.used)]

    def visit(self, q: "np.ndarray", above: float = float("inf")):
        """``(positions, bound)`` by falling upper bound, in growing batches of cells; ``bound`` holds for all later rows.

        Cells whose every score lies above ``above`` are passed over.
        """
        import numpy as np
        f = q.astype(np.float64)
        parts, tops, lows = (f[:self.half], f[self.half:]), [], []
        for p, b, u, r in zip(parts, self.books, self.used, self.radius):
            mid, slack = b[u] @ p, np.sqrt(p @ p) * r
            slack = slack * (1 + 1e-9) + 1e-6 * (1 + np.abs(mid))  # rounding
            order = np.argsort(-(mid + slack), kind="stable")
            tops.append([(float(v), int(k)) for v, k in zip((mid + slack)[order], u[order])])
            lows.append(dict(zip(u.tolist(), (mid - slack).tolist())))
        heap, batch, size = [(-(tops[0][0][0] + tops[1][0][0]), 0, 0)], [], 8
        while heap:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(tops[1]):
                heapq.heappush(heap, (-(tops[0][i][0] + tops[1][j + 1][0]), i, j + 1))
            if j == 0 and i + 1 < len(tops[0]):
                heapq.heappush(heap, (-(tops[0][i + 1][0] + tops[1][0][0]), i + 1, 0))
            a, b = tops[0][i][1], tops[1][j][1]
            s, e = self.cells[a * self.n + b], self.cells[a * self.n + b + 1]
            if e > s and lows[0][a] + lows[1][b] <= above:
                batch.append((s, e))
            if len(batch) == size or not heap:
                if batch:
                    yield np.concatenate([np.arange(s, e) for s, e in batch]), -heap[0][0] if heap else -float("inf")
                batch, size = [], size * 2


def best_of(score, ids, at, k: int) -> tuple:
    """The first ``k`` by falling score, ties by smaller id."""
    import numpy as np
    o = np.lexsort((ids, -score))[:k]
    return score[o], ids[o], at[o]


def find_best(index: MultiIndex, q, fits, ids, k: int):
    """The ``k`` best positions among those that ``fits`` (a mask over sorted positions), exactly."""
    import numpy as np
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at, bound in index.visit(q):
        at = at[fits[at]]
        score = (index.x[at] @ q).astype(np.int64) if len(at) else np.zeros(0, np.int64)
        best = best_of(np.concatenate([best[0], score]), np.concatenate([best[1], ids[at]]), np.concatenate([best[2], at]), k)
        if len(best[0]) == k and best[0][-1] > bound:
            break
    return best


def find_windows(index: MultiIndex, q, fits, ids, windows: list[tuple[int, int]], k: int) -> list[tuple]:
    """For each window (low, high) of scores the ``k`` best that fit, exactly."""
    import numpy as np
    none = np.zeros(0, np.int64)
    found, open_ = [(none, none, none) for _ in windows], {w for w, (lo, hi) in enumerate(windows) if lo <= hi}
    if not open_:
        return found
    low, high = min(windows[w][0] for w in open_), max(windows[w][1] for w in open_)
    for at, bound in index.visit(q, high):
        at = at[fits[at]]
        score = (index.x[at] @ q).astype(np.int64) if len(at) else none
        inside = (score >= low) & (score <= high)
        at, score = at[inside], score[inside]
        for w in list(open_):
            lo, hi = windows[w]
            mine = (score >= lo) & (score <= hi)
            found[w] = best_of(*(np.concatenate(p) for p in zip(found[w], (score[mine], ids[at[mine]], at[mine]))), k)
            if bound < lo or len(found[w][0]) == k and found[w][0][-1] > bound:
                open_.discard(w)
        if not open_:
            break
    return found


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         codes: int = CODES, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """``rows(id bigint, label, v array<bigint>)`` -> anchor_id, positive_id, rank, negative_id, and both scores.

    Anchors are the rows where ``anchor`` (a condition on ``id``, ``label``) holds. A score is the integer inner product;
    higher first, ties by smaller id. An anchor's positives are its ``positives`` best other rows of its label; for
    each of them come the ``negatives`` best rows of another label whose score times 100 lies between ``low`` and ``high``
    times the positive's. Rows with a null id, label, vector or component take no part. Shorter vectors count as padded
    with zeros. Repeated ids are rows of their own (equal scores and ids are interchangeable, so results agree).
    Scores must fit a long. Other columns aren't read. An empty table, or one without anchors, gives an empty result.
    """
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark = rows.sparkSession
    t = rows.select(F.col("id").cast("bigint").alias("id"), "label", F.col("v").cast("array<bigint>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    t = t.where("id is not null and label is not null and v is not null and forall(v, e -> e is not null)")
    t = cut(t.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    size = t.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("q"), F.max(F.size("v")).alias("dim"),
                 F.max(F.array_max(F.transform("v", lambda e: F.abs(e)))).alias("peak")).first()
    n, n_anchors, dim, peak = size["n"], size["q"], max(2, size["dim"] or 0), size["peak"] or 0
    if not n or not n_anchors:
        return spark.createDataFrame([], schema)
    some = matrix_rows(t.orderBy(F.xxhash64("rid"), "rid").limit(sample).select("v"), dim)
    half = dim // 2
    books = codebook(some[:, :half].astype(float), codes), codebook(some[:, half:].astype(float), codes)
    exact = peak * peak * dim < 2 ** 53
    shards, groups = -(-n // shard_rows), -(-n_anchors // anchor_rows)
    deal = lambda k: F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    indexed = t.select(deal(shards).alias("shard"), every(groups).alias("grp"), "rid", "id", "label", "v")
    asked = t.where("is_anchor").select(every(shards).alias("shard_"), deal(groups).alias("grp_"), F.col("rid").alias("arid"), F.col("id").alias("aid"), F.col("label").alias("alabel"), F.col("v").alias("av"))

    def load(left):
        import numpy as np
        index = MultiIndex(matrix(left["v"], dim), books, exact)
        o = index.order
        labels = left["label"].combine_chunks().dictionary_encode()
        names = {v.as_py(): k for k, v in enumerate(labels.dictionary)}
        return index, labels.indices.to_numpy()[o], names, left["id"].to_numpy()[o], left["rid"].to_numpy()[o]

    def queries(right):
        import numpy as np
        q = matrix(right["av"], dim)
        return q.astype(np.float64) if exact else q.astype(object)

    def first(left, right):
        import pyarrow as pa
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            index, labels, names, ids, rid = load(left)
            for q, arid, aid, label in zip(queries(right), right["arid"].to_pylist(), right["aid"].to_pylist(), right["alabel"].to_pylist()):
                if label in names:
                    score, who, at = find_best(index, q, (labels == names[label]) & (rid != arid), ids, positives)
                    for c, v in zip(out, ([arid] * len(score), score.tolist(), who.tolist(), rid[at].tolist())):
                        c.extend(v)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["arid", "score", "id", "prid"])

    near = indexed.groupBy("shard", "grp").cogroup(asked.groupBy("shard_", "grp_")).applyInArrow(first, "arid bigint, score bigint, id bigint, prid bigint")
    order = Window.partitionBy("arid").orderBy(F.desc("score"), "id", "prid")
    near = cut(near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives), "positives")
    wanted = near.groupBy("arid").agg(F.sort_array(F.collect_set("score")).alias("scores"))
    asked2 = asked.join(wanted, "arid")

    def second(left, right):
        import pyarrow as pa
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            index, labels, names, ids, _ = load(left)
            for q, arid, label, scores in zip(queries(right), right["arid"].to_pylist(), right["alabel"].to_pylist(), right["scores"].to_pylist()):
                windows = [(-(-low * s // 100), high * s // 100) for s in scores]
                found = find_windows(index, q, labels != names.get(label, -1), ids, windows, negatives)
                for s, (score, who, _) in zip(scores, found):
                    for c, v in zip(out, ([arid] * len(score), [s] * len(score), score.tolist(), who.tolist())):
                        c.extend(v)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["arid", "positive_score", "negative_score", "negative_id"])

    far = indexed.groupBy("shard", "grp").cogroup(asked2.groupBy("shard_", "grp_")).applyInArrow(
        second, "arid bigint, positive_score bigint, negative_score bigint, negative_id bigint")
    order = Window.partitionBy("arid", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    pos = near.select("arid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    anchors = t.where("is_anchor").select(F.col("rid").alias("arid"), F.col("id").alias("anchor_id"))
    out = anchors.join(pos, "arid").join(far, ["arid", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def matrix_rows(rows: DataFrame, dim: int) -> "np.ndarray":
    return matrix(rows.toArrow()["v"], dim)


def contract_rows(vectors: DataFrame) -> DataFrame:
    """The query's rows: valid vectors in steps of 1/256, every seventh label moved on by one."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    ok = F.forall(x, lambda e: F.coalesce((F.abs(e) < F.lit(float("inf"))) & ~F.isnan(e), F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(ok)
            .select(F.col("vec_id").alias("id"), label.alias("label"), F.transform(x, lambda e: F.floor(e * 256)).alias("v")))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: hard negatives of every fiftieth embedding among all."""
    from .text import read
    return mine(contract_rows(read(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0)


#: All scores of the anchors, ranked: the same rows by plain SQL.
ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(CAST(e AS DOUBLE) * 256) AS DOUBLE) FOR e IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a, r b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
