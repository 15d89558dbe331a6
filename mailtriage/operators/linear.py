"""M14 as a relational scorer: a linear model is a table, a score is a join and a sum.

The model table ``(block, key, scale, coef)`` has one row per subject term, snippet term, sender domain and number, and
one for the intercept. A mail's terms are counted in its row and joined to the table; per block the weighted
sum is divided by the L2 norm, so the score equals the dot product of the assembled vector without building it. Nothing
of the vocabulary or of the domains reaches the driver or a closure, so neither needs a cap; Spark broadcasts the table
only below its own size limit, and a very common term is split by AQE's skew-join handling otherwise.

Two sources of the table: ``coefficient_table`` of a trained logistic regression, and ``fit_log_odds``, a closed-form
model of two aggregations over any number of training rows and terms.
"""
from __future__ import annotations

import datetime as _dt
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import AS_OF, cut
from . import features as FE

COLUMNS = ("block", "key", "scale", "coef")
TEXT_BLOCKS = {"subject": (FE.subject_terms, 2), "snippet": (FE.snippet_terms, 3)}  # terms, min_df
MAX_DF = 0.9


def block_counts(feats: DataFrame, *keep: str) -> DataFrame:
    """(id, block, key, cnt): the different terms of each mail, in one pass over both texts and without a shuffle of terms."""
    blocks = {b: terms() for b, (terms, _) in TEXT_BLOCKS.items()}
    return FE.block_term_counts(feats, blocks, "id", *keep).withColumnRenamed("term", "key")


def coefficient_table(tm) -> DataFrame:
    """The table of a trained logistic regression."""
    import pandas as pd
    fm = tm.features
    spark = fm.domains.table.sparkSession
    w = tm.classifier.coefficients.toArray()
    coefs = spark.createDataFrame(pd.DataFrame({"at": range(len(w)), "coef": w}), "at bigint, coef double")
    off_n = fm.subject.size
    off_d = off_n + fm.snippet.size
    off_x = off_d + fm.domains.size
    text = [FE.vocabulary_frame(spark, v).select(F.lit(b).alias("block"), F.col("term").alias("key"), F.col("idf").alias("scale"),
                                                 (F.col("idx") + off).cast("bigint").alias("at"))
            for b, v, off in (("subject", fm.subject, 0), ("snippet", fm.snippet, off_n))]
    domains = fm.domains.table.select(F.lit("domain").alias("block"), F.col("value").alias("key"), F.lit(1.0).alias("scale"),
                                      (F.col("idx") + off_d).alias("at"))
    numbers = spark.createDataFrame([("number", c, 1.0 / s, off_x + k) for k, (c, s) in enumerate(zip(FE.SCALED_COLS, fm.stds))],
                                    "block string, key string, scale double, at bigint")
    keyed = text[0].unionByName(text[1]).unionByName(domains).unionByName(numbers)
    bias = spark.createDataFrame([("bias", "", 1.0, float(tm.classifier.intercept))], "block string, key string, scale double, coef double")
    return cut(keyed.join(coefs, "at").select(*COLUMNS).unionByName(bias), "coefficients")


def fit_log_odds(train: DataFrame, label_col: str = "user_label") -> DataFrame:
    """A closed-form linear model over rows of ``build_features`` with a label (spam / keep).

    A term's or domain's coefficient is its log odds between the classes, ln((s + 1) / (S + 2)) - ln((k + 1) / (K + 2))
    with s of S spam and k of K keep rows that hold it; terms keep M4's limits (df >= 2 or 3, df <= 0.9 n) without a cap.
    A number's is the difference of the class means over its standard deviation, spread over all 16. The intercept is
    ln((S + 1) / (K + 1)). Only the class counts and the 16 numbers come to the driver. No rows give the intercept 0.
    """
    spam = F.col(label_col) == "spam"
    cols = FE.SCALED_COLS
    num = lambda c: F.col(c).cast("double")
    row = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(spam).alias("s"), *[F.stddev_pop(num(c)).alias(f"d_{c}") for c in cols],
                    *[F.avg(F.when(spam, num(c))).alias(f"s_{c}") for c in cols],
                    *[F.avg(F.when(~spam, num(c))).alias(f"k_{c}") for c in cols]).first()
    n, s = row["n"], row["s"]

    def odds(hits: DataFrame) -> DataFrame:
        held = hits.groupBy("block", "key").agg(F.count(F.lit(1)).alias("df"), F.count_if("spam").alias("s"))
        coef = F.log((F.col("s") + 1.0) / (s + 2.0)) - F.log((F.col("df") - F.col("s") + 1.0) / (n - s + 2.0))
        return held.withColumn("coef", coef)

    least = F.element_at(F.create_map(*[x for b, (_, m) in TEXT_BLOCKS.items() for x in (F.lit(b), F.lit(m))]), F.col("block"))
    text = odds(block_counts(train.withColumn("spam", spam), "spam"))
    text = text.where((F.col("df") >= least) & (F.col("df") <= F.lit(MAX_DF * n))).withColumn(
        "scale", F.log(F.lit(float(1 + n)) / (F.col("df") + 1)) + 1)
    dom = odds(train.where(F.col("sender_domain") != "").select(F.lit("domain").alias("block"), F.col("sender_domain").alias("key"), spam.alias("spam")))
    std = [row[f"d_{c}"] or 1.0 for c in cols]
    fixed = [("number", c, 1.0 / d, ((row[f"s_{c}"] or 0.0) - (row[f"k_{c}"] or 0.0)) / d / len(cols)) for c, d in zip(cols, std)]
    fixed.append(("bias", "", 1.0, 0.0 if not n else math.log((s + 1.0) / (n - s + 1.0))))
    small = train.sparkSession.createDataFrame(fixed, "block string, key string, scale double, coef double")
    return text.select(*COLUMNS).unionByName(dom.withColumn("scale", F.lit(1.0)).select(*COLUMNS)).unionByName(small)


def score_table(emails: DataFrame, model: DataFrame, version: str, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """(id, p_spam, model_version) of every mail from a model table; ids are the mail's key.

    Mail without a known term, domain or text has the intercept and its numbers only. Sums combine map-side, so what is
    shuffled by id is a row or so a mail; the 16 numbers and the intercept are literals.
    """
    fixed = {(r["block"], r["key"]): (r["scale"], r["coef"]) for r in model.where(F.col("block").isin("number", "bias")).collect()}
    feats = FE.build_features(emails.select("id", "sender_domain", "subject", "snippet", "received_at"), as_of)
    z = F.lit(fixed.get(("bias", ""), (1.0, 0.0))[1])
    for c in FE.SCALED_COLS:
        scale, coef = fixed.get(("number", c), (1.0, 0.0))
        z = z + F.col(c).cast("double") * F.lit(scale) * F.lit(coef)
    text = model.where(F.col("block").isin(*TEXT_BLOCKS))
    w = (F.lit(1.0) + F.log(F.col("cnt").cast("double"))) * F.col("scale")
    sums = [x for b in TEXT_BLOCKS for x in (F.sum(F.when(F.col("block") == b, F.col("w") * F.col("coef"))).alias(f"{b}_dot"),
                                            F.sum(F.when(F.col("block") == b, F.col("w") * F.col("w"))).alias(f"{b}_sq"))]
    per = block_counts(feats).join(text, ["block", "key"]).select("id", "block", "coef", w.alias("w")).groupBy("id").agg(*sums)
    part = sum((F.coalesce(F.col(f"{b}_dot") / F.sqrt(f"{b}_sq"), F.lit(0.0)) for b in TEXT_BLOCKS), F.lit(0.0))
    dom = model.where(F.col("block") == "domain").select(F.col("key").alias("sender_domain"), F.col("coef").alias("domain_coef"))
    base = feats.select("id", "sender_domain", z.alias("z")).join(dom, "sender_domain", "left")
    total = F.col("z") + F.coalesce("domain_coef", F.lit(0.0)) + part
    return base.join(per, "id", "left").select("id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-total))).alias("p_spam"), F.lit(version).alias("model_version"))


def table_scorer(model: DataFrame, version: str, as_of: _dt.datetime = AS_OF):
    """Scoring step for ``plans.triage.triage``: mail that no rule decides gets its score from the model table."""
    def run(routed: DataFrame) -> DataFrame:
        routed = cut(routed, "routed")
        open_mail = routed.where(F.col("hit").isNull())
        decided = routed.where(F.col("hit").isNotNull()).select(
            "*", F.lit(None).cast("double").alias("p_spam"), F.lit(None).cast("string").alias("model_version"))
        return open_mail.join(score_table(open_mail, model, version, as_of), "id", "left").unionByName(decided)
    return run
