"""op11-op13 against brute force, and on awkward rows."""
from __future__ import annotations

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F

from mailtriage.llm import alignment, hard_negatives, lattice

INF, NAN = float("inf"), float("nan")


# op11

@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*alignment.default_tokenizers())


def brute_ids(pair, whole, text):
    """Both id lists of the whole text, by the libraries themselves; None if the bytes aren't the text's."""
    if not text:
        return None
    a, b, want = whole(" " + text), pair.b.encode(text), (" " + text).encode()
    if any(b"".join(t[k] for k in x) != want for t, x in ((pair.bytes_a, a), (pair.bytes_b, b))):
        return None
    return a, b


def brute_groups(pair, ids):
    ends = [np.cumsum([len(t[k]) for k in x]).tolist() for t, x in zip((pair.bytes_a, pair.bytes_b), ids)]
    out, low = [], 0
    for c in sorted(set(ends[0]) & set(ends[1])):
        out.append(tuple([k for k, e in zip(x, end) if low < e <= c] for x, end in zip(ids, ends)))
        low = c
    return out


def texts(n, seed=5):
    r = random.Random(seed)
    chars = "ab  \n\n\t\r\x0b  　é漢字😀.'s-_1²①٣▁<>|endoftext\x1c\x85​́ßİ\x00ʼ"
    words = ["the", "The", "Encyclopaedia", "naïveté,", "x=1;", "don't", "<|endoftext|>", "</s>", "<0x41>", "12345", "foo\nbar", "", "…"]
    return ["".join(r.choice(chars) for _ in range(r.randrange(1, 40))) if k % 2 else " ".join(r.choice(words) for _ in range(r.randrange(1, 60)))
            for k in range(n)]


@pytest.mark.parametrize("seed", range(30))
def test_runs(seed):
    r = random.Random(seed)
    last = r.randrange(1, 200)
    a, b = (sorted({*r.sample(range(1, last), r.randrange(0, last)), last}) if last > 1 else [1] for _ in range(2))
    if seed % 3 == 0:
        b = sorted({*a, *r.sample(range(1, last + 1), min(3, last))} - set(r.sample(a[:-1], min(3, len(a) - 1))))
    got, low = [], (0, 0)
    for i, j, n, m in alignment.runs(a, b):
        assert (i, j) == low
        if m:
            got.append((a[i:i + n], b[j:j + m]))
            low = i + n, j + m
        else:
            got.extend(([a[i + k]], [b[j + k]]) for k in range(n))
            low = i + n, j + n
    want, low = [], 0
    for c in sorted(set(a) & set(b)):
        want.append(([x for x in a if low < x <= c], [x for x in b if low < x <= c]))
        low = c
    assert got == want


def test_encode_pieces(pair):
    whole = alignment.whole_engine(alignment.default_tokenizers()[0])
    assert pair.cuts
    some = texts(3000) + ["  a", "a  ", " ", "a b ", "</s>", "a ▁b", "x" * 5000, "word " * 3000]
    for at in range(0, len(some), 500):
        for text, got in zip(some[at:at + 500], pair.encode(some[at:at + 500])):
            want = brute_ids(pair, whole, text)
            assert (got is None) == (want is None), repr(text)
            if got:
                assert [x.tolist() for x in got] == list(want), repr(text)


@pytest.mark.parametrize("block", [50, 2_000_000])
def test_alignment(spark, make, pair, block):
    whole = alignment.whole_engine(alignment.default_tokenizers()[0])
    rows = [(100 + k, t) for k, t in enumerate(texts(150))] + ODD + [(900, "same text twice"), (901, "same text twice")]
    docs = make(rows).repartition(3)
    got = alignment.link_statistics(docs.withColumn("pairs", F.lit(1)).withColumn("n_a", F.lit("x")), block_links=block).collect()
    ids = [brute_ids(pair, whole, r[1]) for r in rows]
    groups = [brute_groups(pair, x) if x else [] for x in ids]
    count = collections.Counter((g[0][-1], g[1][-1]) for doc in groups for g in doc)
    top = collections.defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    want = collections.Counter()
    for (doc_id, *_), x, doc in zip(rows, ids, groups):
        links = [(g[0][-1], g[1][-1]) for g in doc]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in doc)
        want[(doc_id, len(x[0]) if x else 0, len(x[1]) if x else 0, len(doc), len(links), sum(count[p] == top[p[1]] for p in links),
              sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if doc else "")] += 1
    assert collections.Counter(map(tuple, got)) == want


def test_align_output(spark, make, pair):
    whole = alignment.whole_engine(alignment.default_tokenizers()[0])
    rows = [(k, t) for k, t in enumerate(texts(40))] + [(99, None)]
    for r, (_, text) in zip(sorted(alignment.align(make(rows)).collect(), key=lambda r: r["doc_id"]), rows):
        ids = brute_ids(pair, whole, text)
        doc = brute_groups(pair, ids) if ids else []
        assert (r["a_ids"], r["b_ids"]) == (tuple(ids) if ids else ([], []))
        assert list(zip(r["a_sizes"], r["b_sizes"])) == [(len(a), len(b)) for a, b in doc]


def test_alignment_edges(spark, make):
    assert alignment.link_statistics(make([])).count() == 0
    with pytest.raises(ValueError):
        alignment.link_statistics(make([(1, "a")]).withColumn("n_a", F.lit(1)), keys=["doc_id", "n_a"])


# op12

EMB = "vec_id bigint, embedding array<float>, label int"


def vectors(n, seed=3, dim=8, odd=True):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)).astype(np.float32)
    x[n // 3:n // 2] = x[0] + r.normal(size=(n // 2 - n // 3, dim)).astype(np.float32) * 0.05
    x[-5:] = x[1]
    rows = [(k, v.tolist(), int(r.integers(0, 4))) for k, v in enumerate(x)]
    if odd:
        rows += [(10_000, None, 1), (10_050, [None] + [0.5] * (dim - 1), 1), (10_100, [NAN] * dim, 1), (10_150, [INF] * dim, 2),
                 (10_200, [0.0] * dim, 2), (10_250, [1.0] * dim, None), (None, [1.0] * dim, 3), (10_300, [], 3)]
    return rows


def brute_negatives(rows):
    keep = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v, lab in rows
            if i is not None and v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    for k, (i, lab, v) in enumerate(keep):
        if i % 50:
            continue
        scored = sorted(((-dot(v, w), j, lab2) for m, (j, lab2, w) in enumerate(keep) if m != k))
        for s, p, _ in [x for x in scored if x[2] == lab][:5]:
            fit = [x for x in scored if x[2] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, p, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit)]
    return out


@pytest.mark.parametrize("shard,group,codes", [(64, 4, 4), (10_000, 10_000, 16)])
def test_negatives(spark, shard, group, codes):
    rows = vectors(700)
    df = spark.createDataFrame(rows, EMB).withColumn("rid", F.lit(0)).repartition(5)
    got = hard_negatives.mine(hard_negatives.contract_rows(df), F.col("id") % 50 == 0, codes=codes, sample=200,
                              shard_rows=shard, anchor_rows=group)
    assert sorted(map(tuple, got.collect())) == sorted(brute_negatives(rows))


def test_negatives_edges(spark):
    run = lambda rows: hard_negatives.mine(hard_negatives.contract_rows(spark.createDataFrame(rows, EMB)), F.col("id") % 50 == 0)
    assert run([]).count() == 0
    assert run([(1, [1.0, 2.0], 1)]).count() == 0          # no anchor
    assert run([(50, [1.0, 2.0], 1)]).count() == 0         # no other row
    same = [(50 * k, [1.0, 1.0], k % 2) for k in range(1, 5)] + [(50, [1.0, 1.0], 1), (51, [0.7, 0.7], 0)]
    assert sorted(map(tuple, run(same).collect())) == sorted(brute_negatives(same))


def test_negatives_large_numbers(spark):
    """Scores past the exact range of doubles."""
    rows = [(50, [2 ** 30, 3], 1), (51, [2 ** 30, 5], 1), (52, [2 ** 29, 2 ** 29 + 1], 0), (53, [2 ** 29 + 7, 1], 0)]
    df = spark.createDataFrame(rows, "id bigint, v array<bigint>, label int")
    got = hard_negatives.mine(df, F.col("id") == 50).collect()
    score = 2 ** 60 + 15
    fit = sorted([(-(2 ** 59 + 3 * (2 ** 29 + 1)), 52), (-(2 ** 30 * (2 ** 29 + 7) + 3), 53)])
    assert [(r["negative_id"], r["negative_score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(j, -s) for s, j in fit if score <= 2 * -s]


def test_certified_early():
    """With far clusters the visit ends before all cells are read."""
    r = np.random.default_rng(1)
    centres = np.repeat(np.eye(8) * 4000, 50, axis=0)
    x = np.floor(centres + r.normal(size=centres.shape) * 10).astype(np.int64)
    books = hard_negatives.codebook(x[:, :4].astype(float), 8), hard_negatives.codebook(x[:, 4:].astype(float), 8)
    index = hard_negatives.MultiIndex(x, books, True)
    seen = 0
    for at, bound in index.visit(x[0].astype(float)):
        seen += len(at)
        if bound < 4000 * 3000:
            break
    assert seen < len(x)
    score, ids, _ = hard_negatives.find_best(index, x[0].astype(float), np.ones(len(x), bool), index.order, 5)
    want = sorted(((-int(x[0] @ v), k) for k, v in enumerate(x)))[:5]
    assert list(zip((-score).tolist(), ids.tolist())) == want


def test_negatives_oracle(spark):
    rows = vectors(300, odd=False)
    df = spark.createDataFrame(rows, EMB)
    got = sorted(map(tuple, hard_negatives.mine(hard_negatives.contract_rows(df), F.col("id") % 50 == 0).collect()))
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    assert sorted(con.sql(hard_negatives.ORACLE).fetchall()) == got


# op13

def test_e8_decode():
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8)) * 2
    near = lattice.decode(x)
    moves = lattice.shortest()
    assert len({tuple(m) for m in moves}) == 240 and np.allclose((moves ** 2).sum(1), 2)
    twice = np.rint(2 * near).astype(int)
    assert (2 * near == twice).all() and (twice.sum(1) % 4 == 0).all()  # E8: doubled sums are multiples of four
    assert ((twice % 2).min(1) == (twice % 2).max(1)).all()
    own = ((x - near) ** 2).sum(1)
    assert (own <= 1 + 1e-9).all()  # covering radius
    assert (own[:, None] <= ((x[:, None] - near[:, None] - moves[None]) ** 2).sum(2) + 1e-9).all()


@pytest.mark.parametrize("n,cosine", [(50_000, 0.9), (50_000, 0.93), (50_000_000, 0.9)])
def test_recall_at_threshold(n, cosine):
    r = np.random.default_rng(9)
    blocks, tables = lattice.plan(n, 64)
    u = r.normal(size=(3000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = r.normal(size=u.shape)
    w -= (w * u).sum(1)[:, None] * u
    v = cosine * u + np.sqrt(1 - cosine ** 2) * w / np.linalg.norm(w, axis=1)[:, None]
    hit = np.zeros(len(u), bool)
    for k in range(tables):
        t = lattice.Table(7, k, 64, blocks)
        a, b = t.cells(u), t.cells(v)
        hit |= (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
    assert hit.mean() >= 0.95


def brute_links(rows, cosine=0.9):
    unit = {}
    for k, (_, v, *_rest) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            unit[k] = x / np.linalg.norm(x)
    links = {k: {m for m in unit if m != k and len(unit[m]) == len(unit[k]) and unit[k] @ unit[m] >= cosine} for k in unit}
    seen, out = {}, {}
    for k in unit:
        if k not in seen:
            todo, mine = [k], set()
            while todo:
                x = todo.pop()
                if x not in mine:
                    mine.add(x)
                    todo += links[x]
            ids = [rows[m][0] for m in mine if rows[m][0] is not None]
            for m in mine:
                seen[m] = min(ids) if ids else None
    for k, r in enumerate(rows):
        comp = seen[k] if k in seen else r[0]
        out[k] = (r[0], len(links.get(k, ())), comp, r[0] == comp)
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("chunk", [16, 1024])
def test_lattice(spark, chunk):
    """Chains, a large group of near copies, exact copies, odd rows: the same links as brute force."""
    r = np.random.default_rng(4)
    rows = vectors(300, dim=32, odd=True)
    turn = [[float(np.cos(a)), float(np.sin(a))] + [0.0] * 30 for a in np.arange(0, 3, 0.3)]
    rows += [(20_000 + k, v, 0) for k, v in enumerate(turn)]
    rows += [(30_000 + k, (np.array(rows[2][1]) * (k + 1)).tolist(), 0) for k in range(4)]  # one direction
    rows += [rows[7], rows[7], (5, rows[9][1], 1), (40_000, [1.0, 1.0], 0), (40_001, [2.0, 2.1], 0), (40_002, [1e-30] * 32, 0), (40_003, [3e30] * 32, 0)]
    df = spark.createDataFrame(rows, EMB).withColumn("cell", F.lit(1)).withColumn("n_links", F.lit("x"))
    got = lattice.near_duplicates(df, chunk=chunk)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_links(rows)
    assert r is not None


def test_lattice_edges(spark):
    empty = lattice.near_duplicates(spark.createDataFrame([], EMB))
    assert empty.count() == 0
    none = lattice.near_duplicates(spark.createDataFrame([(1, None, 1), (2, [0.0, 0.0], 1), (None, [], 1)], EMB))
    assert sorted(map(tuple, none.collect()), key=str) == sorted([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)], key=str)
    with pytest.raises(ValueError):
        lattice.near_duplicates(spark.createDataFrame([(1, [1.0])], "kept bigint, embedding array<float>"), id_col="kept")


def test_language_stage_makes_its_compressors_once_a_task(monkeypatch):
    """The pipeline's filter gets Arrow arrays, and its dictionaries are prepared once for all batches of a task."""
    import pyarrow as pa
    from pyspark.sql.types import BooleanType

    from mailtriage.llm import langid
    made, real = [], langid.predictions
    monkeypatch.setattr(langid, "predictions", lambda *a: made.append(1) or real(*a))
    known = {"a": b"the cat sat on the mat and the dog ran off " * 9, "b": b"der hund lief weg und die katze sass still " * 9}
    ok = langid._verdict(known, 0.02, BooleanType()).func
    out = list(ok(iter([pa.array(["the cat sat on the mat and the dog ran off", None]), pa.array([], pa.string()), pa.array(["1 2 3"])])))
    assert [x.to_pylist() for x in out] == [[True, False], [], [False]] and len(made) == 1


def test_tidy_passes_every_batch():
    from mailtriage.llm.text import tidy
    assert list(tidy(lambda it: (x * 2 for x in it))(iter([1, 2, 3]))) == [2, 4, 6]


def batch_sizes(spark, stage):
    """The sizes in bytes of the Arrow batches that the pipeline's packing stage reads from one partition of 20 MB."""
    docs = spark.range(4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    return [x["length"] for x in stage(spark, docs, "").select("length").collect()]


def test_packing_stage_reads_bounded_batches(spark, monkeypatch):
    """A task's batch is bounded in bytes, whatever its rows hold, unless the session has a bound of its own."""
    import corpus_pipeline

    from mailtriage.llm import packing
    from mailtriage.session import BATCH_BYTES, BATCH_SETTING

    def sizes(*_):
        def run(batches):
            import pyarrow as pa
            for b in batches:
                names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes if n == "length" else 0], pa.int64()) for n in names], names=names)
        return run

    monkeypatch.setattr(packing, "_pack", sizes)
    before = spark.conf.get(BATCH_SETTING, None)
    try:
        spark.conf.unset(BATCH_SETTING)
        got = batch_sizes(spark, corpus_pipeline.pack)
        assert sum(got) > 4000 * 5000 and max(got) < BATCH_BYTES + 20_000
        spark.conf.set(BATCH_SETTING, str(8 << 20))
        assert BATCH_BYTES + 20_000 < max(batch_sizes(spark, corpus_pipeline.pack)) < (8 << 20) + 20_000
    finally:
        spark.conf.unset(BATCH_SETTING)
        if before is not None:
            spark.conf.set(BATCH_SETTING, before)
