"""Review and evaluation questions.

Joins are equi joins on the mail id; aggregates are partial + final hash
aggregates; the review list is a TakeOrderedAndProject of a bounded size.
"""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.packs import (HUMAN_SOURCES, REVIEW_SNIPPET_CHARS, REVIEW_WINDOW,
                               STATS_WINDOW)
from ..session import AS_OF

PRECISION_TARGET = 0.95   # fixed value: auto-trash precision goal


def auto_action(source: Column) -> Column:
    """``source LIKE 'auto_clean:%'`` (``_`` is a wildcard there, as in SQL)."""
    return source.like("auto_clean:%")


def recent(ts: Column, interval: str, as_of: _dt.datetime = AS_OF) -> Column:
    """``ts > as_of - interval`` (open bound)."""
    return ts > (S.as_of_ntz(as_of) - F.expr(f"INTERVAL {interval}"))


def review_queue(feedback: DataFrame, emails: DataFrame, as_of: _dt.datetime = AS_OF,
                 limit: int | None = None) -> DataFrame:
    """Automatic decisions of the last 7 days with their mail. All of them by default; with ``limit``
    the newest page of that many rows (``packs.REVIEW_LIMIT`` is the review page's).

    Filter first (both predicates on ``feedback``), then the join; a page is a
    TakeOrderedAndProject: each task keeps its top ``limit`` rows.
    """
    f = feedback.filter(auto_action(F.col("source")) & recent(F.col("created_at"), REVIEW_WINDOW, as_of))
    j = f.join(emails.withColumnRenamed("id", "email_id"), "email_id", "inner")
    rows = j.select(F.col("email_id").alias("id"), "sender_domain", "subject", "snippet", "received_at",
                    "user_label", "source", F.col("created_at").alias("decided_at"))
    return rows if limit is None else rows.orderBy(F.col("decided_at").desc(), F.col("id")).limit(limit)


def review_stats(feedback: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """Count per label of automatic decisions of the last 24 hours."""
    f = feedback.filter(auto_action(F.col("source")) & recent(F.col("created_at"), STATS_WINDOW, as_of))
    return f.groupBy("user_label").agg(F.count(F.lit(1)).alias("cnt"))


def flagged_count(queue: DataFrame) -> DataFrame:
    """Number of spam rows in the review list."""
    return queue.agg(F.count_if(F.col("user_label") == "spam").alias("flagged"))


def review_page(queue: DataFrame) -> DataFrame:
    """The rows the review page shows (time, domain, subject, 100-char snippet, rule)."""
    return queue.select("id", S.display_time("received_at").alias("shown_at"), "sender_domain", "subject",
                        S.truncate_text("snippet", REVIEW_SNIPPET_CHARS).alias("snippet"),
                        S.strip_source_prefix("source").alias("rule"), "user_label", "decided_at")


def human_feedback(feedback: DataFrame) -> DataFrame:
    return feedback.filter(F.col("source").isin(*HUMAN_SOURCES))


def pending_review(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Decisions with no explicit human feedback yet (left anti join)."""
    return decisions.join(human_feedback(feedback).select("email_id"), "email_id", "left_anti")


def _judged(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    h = human_feedback(feedback).select("email_id", "user_label", "source")
    return decisions.join(h, "email_id", "left")


def _ratio(num: Column, den: Column) -> Column:
    return F.round(F.when(den > 0, num / den).otherwise(F.lit(0.0)), 6)


def _quality(judged_cols):
    d, ul, src = F.col("decision"), F.col("user_label"), F.col("source")
    tp = F.count_if((d == "spam") & (ul == "spam"))
    fp = F.count_if((d == "spam") & (ul == "keep"))
    fn = F.count_if((d != "spam") & (ul == "spam"))
    trashed = F.count_if((d == "spam") & F.col("executed"))
    restored = F.count_if((d == "spam") & F.col("executed") & (src == "user_restore"))
    return tp, fp, fn, trashed, restored


def weekly_evaluation(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Per 7-day window of ``decided_at``: precision, recall and restore rate of automatic
    decisions against explicit human feedback (0 on an empty denominator)."""
    j = _judged(decisions, feedback)
    tp, fp, fn, trashed, restored = _quality(j)
    g = j.groupBy(F.window("decided_at", "7 days").start.alias("week_start")).agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), trashed.alias("trashed"), restored.alias("restored"))
    return g.select("week_start", "tp", "fp", "fn", "trashed", "restored",
                    _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                    _ratio(F.col("restored"), F.col("trashed")).alias("restore_rate"))


def precision_gate(decisions: DataFrame, feedback: DataFrame, target: float = PRECISION_TARGET) -> DataFrame:
    """Per model version, precision on human-reviewed decisions and whether it meets the target."""
    j = _judged(decisions, feedback)
    tp, fp, _, _, _ = _quality(j)
    g = j.groupBy("model_version").agg(tp.alias("tp"), fp.alias("fp"))
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return g.select("model_version", "tp", "fp", p.alias("precision"), (p >= target).alias("passes"))


def audit_coverage(decisions: DataFrame, audit_log: DataFrame) -> DataFrame:
    """Share of automatic actions (executed trash decisions) that have an audit row."""
    acts = decisions.filter((F.col("decision") == "spam") & F.col("executed")).select("email_id")
    audited = audit_log.select("email_id").distinct().withColumn("_a", F.lit(True))
    j = acts.join(audited, "email_id", "left")
    return j.agg(F.count(F.lit(1)).alias("actions"), F.count_if(F.col("_a")).alias("audited")).select(
        "actions", "audited", _ratio(F.col("audited"), F.col("actions")).alias("coverage"))
