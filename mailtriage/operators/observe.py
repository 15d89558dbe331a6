"""Observation jobs (B1-B3) and their set algebra, counts and top lists
(J1-J4, U2, U3, G3, G4, G11, W4, W5).

The reference sends id lists to the database (``= ANY``) and does set algebra
in Python; here every step is a semi / anti join or a set operation on
DataFrames, so id lists of any length stay distributed.
"""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.packs import BOOTSTRAP_SOURCES, REPORT_SUBJECT_CHARS
from ..session import AS_OF
from ..sources import scans as SC
from . import labeling as L
from . import tables as K


# J1-J4, U2, U3 ---------------------------------------------------------------
def join_mail_feedback(emails: DataFrame, feedback: DataFrame) -> DataFrame:
    """Inner equi join of mail and its feedback."""
    return emails.join(feedback.withColumnRenamed("email_id", "id"), "id", "inner")


def semi_known_ids(ids: DataFrame, emails: DataFrame) -> DataFrame:
    """Requested ids that have a mail row (left semi join: each id once, no mail columns)."""
    return ids.select("id").distinct().join(emails.select("id"), "id", "left_semi")


def anti_already_labeled(ids: DataFrame, emails: DataFrame, feedback: DataFrame, label: str) -> DataFrame:
    """Known ids that have no feedback with ``label`` yet (the key is never null, so
    ``NOT IN`` and ``left_anti`` agree)."""
    labeled = feedback.filter(F.col("user_label") == label).select(F.col("email_id").alias("id"))
    return semi_known_ids(ids, emails).join(labeled, "id", "left_anti")


def anti_unknown_ids(ids: DataFrame, emails: DataFrame) -> DataFrame:
    """Requested ids with no mail row."""
    return ids.select("id").distinct().join(emails.select("id"), "id", "left_anti")


def except_ids(ids: DataFrame, emails: DataFrame) -> DataFrame:
    """Window ids minus known ids as a set operation (EXCEPT DISTINCT)."""
    return ids.select("id").subtract(emails.select("id"))


def union_new_ids(known_unlabeled: DataFrame, unknown: DataFrame) -> DataFrame:
    """Known-but-unlabeled UNION unknown, distinct."""
    return known_unlabeled.select("id").union(unknown.select("id")).distinct()


# G3 / G4 / W4 / W5 ------------------------------------------------------------
def state_counts(observed: DataFrame) -> DataFrame:
    """Spam / keep / uncertain (= all - labeled) of one observation run, one row."""
    st = F.col("state")
    return observed.agg(F.count_if(st == "spam").alias("spam"), F.count_if(st == "keep").alias("keep"),
                        F.count_if(st.isNull()).alias("uncertain"), F.count(F.lit(1)).alias("scanned"))


def sender_domain_counts(labeled: DataFrame, label_col: str = "state") -> DataFrame:
    """Newly labeled mail per label and sender domain (partial aggregation copes with hot domains)."""
    return labeled.filter(F.col(label_col).isNotNull()).groupBy(
        F.col(label_col).alias("label"), "sender_domain").agg(F.count(F.lit(1)).alias("n"))


def top_domains(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent domains per label (domain breaks ties); ranks after counting."""
    w = Window.partitionBy("label").orderBy(F.col("n").desc(), F.col("sender_domain"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def newest_samples(rows: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest rows by (time, domain, subject) descending, as in the report."""
    return (rows.select("id", "received_at", "sender_domain",
                        S.truncate_text(F.coalesce(F.col("subject"), F.lit("")), REPORT_SUBJECT_CHARS).alias("subject"),
                        F.col("subject").alias("_full"))
            .orderBy(F.col("received_at").desc_nulls_last(), F.col("sender_domain").desc(), F.col("_full").desc(),
                     F.col("id").desc())
            .limit(n).drop("_full"))


# B1 ----------------------------------------------------------------------------
def bootstrap_history(mailbox: DataFrame, mail: DataFrame, feedback: DataFrame,
                      as_of: _dt.datetime = AS_OF) -> tuple[DataFrame, DataFrame, DataFrame]:
    """B1: one scan of a year of mail -> K1 mail rows -> R12 labels -> K4, first source wins.

    Returns (new mail table, new feedback table, per-source report).
    """
    scanned = SC.scan_bootstrap_sources(mailbox, as_of)
    rank = F.array_position(F.array(*[F.lit(s) for s in BOOTSTRAP_SOURCES]), F.col("source"))
    new_mail = K.insert_if_absent(mail, scanned.select(*mail.columns), F.col("received_at"))
    lab = scanned.select(F.col("id").alias("email_id"),
                         L.bootstrap_label(F.col("source"), F.col("received_at"), "labels", as_of).alias("user_label"),
                         "source", S.as_of_ntz(as_of).alias("created_at"), rank.alias("rank"))
    new_fb = K.insert_if_absent(feedback, lab.filter(F.col("user_label").isNotNull()), F.col("rank"),
                                key="email_id")
    known = mail.select("id").withColumn("_known", F.lit(True))
    had_fb = feedback.select(F.col("email_id").alias("id")).withColumn("_had", F.lit(True))
    rep = (scanned.select("id", "source").join(known, "id", "left").join(had_fb, "id", "left")
           .join(lab.select(F.col("email_id").alias("id"), "user_label"), "id")
           .groupBy("source").agg(
               F.count(F.lit(1)).alias("scanned"),
               F.count_if(F.col("_known").isNull()).alias("inserted_mail"),
               F.count_if(F.col("user_label").isNotNull()).alias("labeled"),
               F.count_if(F.col("user_label").isNotNull() & F.col("_had").isNull()).alias("inserted_feedback")))
    return new_mail, new_fb, rep


# B2 ----------------------------------------------------------------------------
def daily_observe(mailbox: DataFrame, mail: DataFrame, feedback: DataFrame, as_of: _dt.datetime = AS_OF,
                  days: int = 2, protect_human: bool = True) -> dict[str, DataFrame]:
    """B2: S2 -> K2 (labels) -> R11 -> K5 ``daily_observation`` -> G3, G4, W4 (15)."""
    recent = SC.scan_recent(mailbox, as_of, days)
    upserted = K.upsert_mail_labels(mail, recent.select(*mail.columns), F.col("received_at"))
    observed = recent.select("id", "sender_domain", "labels", L.label_state("labels").alias("state"))
    changes = observed.filter(F.col("state").isNotNull()).select(
        F.col("id").alias("email_id"), F.col("state").alias("user_label"),
        F.lit("daily_observation").alias("source"), S.as_of_ntz(as_of).alias("created_at"))
    new_fb = K.upsert_feedback_latest(feedback, changes, protect_human=protect_human)
    counts = sender_domain_counts(observed)
    return {"mail": upserted.drop("outcome"), "outcome_counts": K.upsert_outcome_counts(upserted),
            "feedback": new_fb, "state_counts": state_counts(observed), "domain_counts": counts,
            "top_domains": top_domains(counts, 15)}


# B3 ----------------------------------------------------------------------------
def detect_changes(mailbox: DataFrame, mail: DataFrame, feedback: DataFrame,
                   as_of: _dt.datetime = AS_OF, days: int = 30) -> dict[str, DataFrame]:
    """TRASH and read-INBOX windows -> new observations (J3 UNION J4) -> K2, K5 -> reports.

    One pass over the mailbox: two left joins (mail ids; feedback labels, one
    row per mail each) say whether a mail is known and how it is labeled. A step
    (spam: TRASH; keep: INBOX and read) takes a mail that is unknown (J4) or
    known without the step's label (J3). The keep step sees what the spam step
    wrote: a mail that the spam step took is then known and labeled spam, so the
    keep step takes it too, and it ends as keep.
    """
    has = lambda x: S.has_label("labels", x)
    known = mail.select(F.col("id").alias("_kid"), F.lit(True).alias("_k"))
    labeled = feedback.select(F.col("email_id").alias("_lid"), F.col("user_label").alias("_llab"))
    win = mailbox.filter(SC.window_filter(mailbox, as_of, days))
    t = win.join(known, win["id"] == F.col("_kid"), "left").join(labeled, win["id"] == F.col("_lid"), "left")
    is_known = F.coalesce(F.col("_k"), F.lit(False))
    lacks = lambda label: ~is_known | F.coalesce(F.col("_llab") != label, F.lit(True))
    spam = has("TRASH") & lacks("spam")
    keep = has("INBOX") & ~has("UNREAD") & (spam | lacks("keep"))
    take = lambda hit, label, step, seen: F.when(hit, F.struct(
        F.lit(label).alias("label"), F.lit(step).alias("step"), seen.alias("_known")))
    new = (t.select(*[win[c] for c in mailbox.columns], F.explode(F.array_compact(F.array(
        take(spam, "spam", 0, is_known), take(keep, "keep", 1, is_known | spam)))).alias("_s"))
        .select(*mailbox.columns, "_s.*"))
    counts = new.groupBy("label").agg(
        F.count(F.lit(1)).alias("new_total"),
        F.count_if("_known").alias("known_unlabeled"),
        F.count_if(~F.col("_known")).alias("unknown"))
    new_mail = K.upsert_mail_labels(mail, new.select(*mail.columns, "step"), order=F.col("step"))
    fb_changes = new.select(F.col("id").alias("email_id"), F.col("label").alias("user_label"),
                            F.lit("daily_observation").alias("source"), S.as_of_ntz(as_of).alias("created_at"), "step")
    new_fb = K.upsert_feedback_latest(feedback, fb_changes, protect_human=False, seq=F.col("step"))
    labeled_rows = new.select("id", "sender_domain", "subject", "received_at", F.col("label").alias("state"))
    dom = sender_domain_counts(labeled_rows)
    return {"mail": new_mail.drop("outcome"), "feedback": new_fb, "counts": counts,
            "domain_counts": dom, "top_domains": top_domains(dom, 10),
            "newest_spam": newest_samples(labeled_rows.filter(F.col("state") == "spam"), 10),
            "labeled": labeled_rows}
