"""The dense index, assembled vectors and the relational scorer."""
from __future__ import annotations

import pytest
from paths import SF_SMALL
from pyspark.sql import Window, functions as F

from mailtriage.operators import features as FE
from mailtriage.operators import linear as LN
from mailtriage.operators import model as M
from mailtriage.plans import q_features as QF
from mailtriage.plans import q_model as QM
from mailtriage.session import AS_OF
from mailtriage.sources import fixtures as fx


@pytest.fixture(scope="module")
def trained(spark):
    return QM.trained(spark, SF_SMALL, ("logistic",)).best


def test_dense_index(spark):
    values = [None, "", "b", "a", "ä", "B", "a", "zz", " "]
    ix = FE.dense_index(spark.createDataFrame([(v,) for v in values], "v string").repartition(4), "v")
    want = sorted({v for v in values if v is not None}, key=lambda v: v.encode())
    assert {r["value"]: r["idx"] for r in ix.table.collect()} == {v: k for k, v in enumerate(want)} and ix.size == len(want)
    none = FE.dense_index(spark.createDataFrame([], "v string"), "v")
    assert none.size == 0 and none.table.count() == 0


def test_dense_index_many_domains(spark):
    """200,000 domains, one on a third of all rows: dense, ordered, nothing but the count on the driver."""
    n = 200_000
    mail = spark.range(3 * n // 2).select(F.when(F.col("id") < n, F.concat(F.md5(F.col("id").cast("string")), F.lit(".example")))
                                          .otherwise(F.lit("hot.example")).alias("sender_domain"))
    ix = FE.fit_domains(mail)
    row = ix.table.agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.min("idx").alias("a"), F.max("idx").alias("b")).first()
    assert (row["n"], row["d"], row["a"], row["b"], ix.size) == (n + 1, n + 1, 0, n, n + 1)
    pairs = ix.table.select("value", "idx", F.lead("value").over(Window.orderBy("idx")).alias("after"))
    assert pairs.where("after <= value").count() == 0
    got = FE.domain_index(mail.limit(0).unionAll(spark.createDataFrame([("hot.example",), ("",), (None,), ("unseen.example",)], "sender_domain string")), ix)
    assert sorted((r["sender_domain"] or "", r["domain_idx"] is not None) for r in got.collect()) == [
        ("", False), ("", False), ("hot.example", True), ("unseen.example", False)]
    assert "BatchEvalPython" not in got._jdf.queryExecution().toString()


def test_scorer_equals_spark_ml(spark, trained):
    mail = fx.raw_emails(spark, SF_SMALL)
    a = M.score(trained, mail, AS_OF).select("id", F.col("p_spam").alias("a"))
    b = M.score_vectors(trained, mail, AS_OF).select("id", F.col("p_spam").alias("b"))
    both = a.join(b, "id", "full")
    row = both.agg(F.count("*").alias("n"), F.count_if(F.expr("a is null or b is null")).alias("gone"), F.max(F.abs(F.col("a") - F.col("b"))).alias("far")).first()
    assert row["n"] == mail.count() and row["gone"] == 0 and row["far"] < 1e-9


def test_scorer_plan(spark, trained):
    """No Python, no driver-held vocabulary; counts combine before the shuffle."""
    plan = M.score(trained, fx.raw_emails(spark, SF_SMALL), AS_OF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert "partial_count" in plan and "partial_sum" in plan


def test_scorer_edges(spark, trained):
    table = LN.coefficient_table(trained)
    schema = "id string, sender_domain string, subject string, snippet string, received_at timestamp_ntz"
    rows = [("a", None, None, None, None), ("b", "", "", "", AS_OF), ("c", "unseen.example", "qqq zzz", "qqq", AS_OF)]
    got = LN.score_table(spark.createDataFrame(rows, schema), table, "v").collect()
    assert len(got) == 3 and all(0.0 < r["p_spam"] < 1.0 for r in got)
    assert LN.score_table(spark.createDataFrame([], schema), table, "v").count() == 0


def test_saved_model_scores_alike(spark, trained, tmp_path):
    path = M.save_model(spark, trained, f"{tmp_path}/m", f"{tmp_path}/r", AS_OF)
    mail = fx.raw_emails(spark, SF_SMALL).limit(50)
    back = M.load_model(spark, path)
    got, want = ({r["id"]: r["p_spam"] for r in M.score(m, mail, AS_OF).collect()} for m in (back, trained))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_log_odds_one_class(spark):
    train = QF._train(spark, SF_SMALL)
    keep = LN.fit_log_odds(train.where("user_label = 'keep'"))
    assert keep.where("coef is null or isnan(coef)").count() == 0
    none = LN.fit_log_odds(train.limit(0))
    assert {(r["block"], r["coef"]) for r in none.collect()} == {("bias", 0.0), ("number", 0.0)}
