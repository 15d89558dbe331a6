"""Term counts without a shuffle of terms, repeated and null ids, and feeds whose files don't grow."""
from __future__ import annotations

import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mailtriage.operators import features as FE
from mailtriage.operators import linear as LN
from mailtriage.plans import q_stream as Q

ROWS = [("a", "red red blue"), ("b", "blue"), ("b", "blue green"), (None, "red"), (None, "red grün"), ("c", ""), ("d", None), ("e", "x !")]


def expected(rows):
    out = Counter()
    for i, text in rows:
        out.update((i, t) for t in re.findall(r"\w{2,}", (text or "").lower()))
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [ROWS, ROWS[:2], ROWS[5:]])
def test_term_counts_by_id(spark, rows):
    df = spark.createDataFrame(rows, "id string, snippet string")
    got = {(r["id"], r["term"]): r["cnt"] for r in FE.term_counts(df, FE.snippet_terms()).collect()}
    assert got == dict(expected(rows))


def test_terms_of_unique_ids_are_not_shuffled(spark):
    df = spark.createDataFrame([("a", "Red red", "red blue"), ("b", "blue", "blue")], "id string, subject string, snippet string")
    assert "Exchange" not in plan(FE.row_counts(df, {"": FE.snippet_terms()}, "id"))
    assert FE.split_repeated(df)[1] is None
    got = {(r["id"], r["block"], r["key"]): r["cnt"] for r in LN.block_counts(df).collect()}
    assert got == {("a", "subject", "red"): 2, ("a", "subject", "red red"): 1, ("a", "snippet", "red"): 1, ("a", "snippet", "blue"): 1,
                   ("b", "subject", "blue"): 1, ("b", "snippet", "blue"): 1}


def test_weights_shuffle_the_texts_and_nothing_else(spark):
    df = spark.createDataFrame(ROWS, "id string, snippet string")
    vocab = spark.createDataFrame([("red", 1.5), ("blue", 2.0), ("green", 3.0)], "term string, idf double")
    one = FE.tfidf_weights(df.where("id in ('a', 'c')"), FE.snippet_terms(), F.broadcast(vocab))
    assert plan(one).count("Exchange hashpartitioning") == 1
    got = {(r["id"], r["term"]): r["w"] for r in FE.tfidf_weights(df, FE.snippet_terms(), vocab).collect()}
    idf = {"red": 1.5, "blue": 2.0, "green": 3.0}
    raw = {k: (1 + math.log(n)) * idf[k[1]] for k, n in expected(ROWS).items() if k[1] in idf}
    want = {k: w / math.sqrt(sum(x * x for (i, _), x in raw.items() if i == k[0])) for k, w in raw.items()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("repeat", [False, True])
def test_arrays_of_both_blocks(spark, repeat):
    rows = [("a", "red red", "blue"), ("b", "blue", "zzz")] + ([("a", "blue", "blue")] if repeat else [])
    df = spark.createDataFrame(rows, "id string, subject string, snippet string")
    v = FE.Vocabulary(["blue", "red"], [2.0, 1.5])
    got = {r["id"]: r for r in FE.tfidf_arrays(df, {"_s": (FE.subject_terms(), v, 0), "_n": (FE.snippet_terms(), v, 2)}).collect()}
    red = (1 + math.log(2)) * 1.5
    norm = math.hypot(2.0, red)
    assert got["a"]["_s_idx"] == ([0, 1] if repeat else [1]) and got["a"]["_n_idx"] == [2]
    assert got["a"]["_s_w"] == pytest.approx([2.0 / norm, red / norm] if repeat else [1.0])
    assert got["a"]["_n_w"] == pytest.approx([1.0])
    assert got["b"]["_s_idx"] == [0] and got["b"]["_n_idx"] == []


def test_norm_and_tokens_once_a_row(spark):
    """The norm isn't summed again for each of a mail's terms, and a subject is split into tokens once."""
    df = spark.createDataFrame([("a", "red red blue", "blue")], "id string, subject string, snippet string")
    v = FE.Vocabulary(["blue", "red"], [2.0, 1.5])
    out = FE.tfidf_arrays(df, {"_s": (FE.subject_terms(), v, 0), "_n": (FE.snippet_terms(), v, 2)})
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("aggregate(") == 2 and "/ SQRT(" not in text
    assert text.count("regexp_extract_all(lower(coalesce(subject") == 1
    assert df.select(FE.subject_terms()).first()[0] == ["red", "red", "blue", "red red", "red blue"]


def test_a_feed_has_files_by_its_size(spark, tmp_path, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100).alias("text"), F.lit("src1").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(Q, "FILE_BYTES", 10_000)
    folder, per = Q._message_feed(spark, str(tmp_path))
    files = [os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.startswith("part-")]
    assert len(files) == Q.BATCHES * per > Q.BATCHES and max(files) < 15_000
    assert spark.read.text(folder).count() == 400
    monkeypatch.undo()
    assert Q._message_feed(spark, str(tmp_path))[1] == 1
