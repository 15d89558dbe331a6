"""The decision pass (T1-T4) and its reports.

``triage`` is one narrow stage: scan filter -> rules -> (model) -> route
column. No shuffle happens until a report aggregates. Every mail lands in
exactly one route:

    unmatched      no rule hit, no model
    ml             no rule hit, p(spam) >= threshold      (trashed)
    ml_below       no rule hit, p(spam) <  threshold
    deletable      deletable rule hit                     (trashed)
    protected      keep hit and (no time, or younger than 7 days, or read)
    grace_expired  keep hit, unread, 7 days or older      (trashed)
"""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.packs import (DEFAULT_PACK, GRACE_PERIOD_DAYS, ML_SPAM_THRESHOLD,
                               SUBJECT_SAMPLE_CHARS, TRIAGE_WINDOW_DAYS)
from ..operators.rules import apply_rules
from ..session import AS_OF
from ..sources.scans import scan_inbox_window

def commit_feedback(routed: DataFrame, acts: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """T3's feedback: one row per trashed mail with its source tag."""
    hit = routed.join(acts.select("id"), "id", "left_semi")
    return hit.select(F.col("id").alias("email_id"), F.lit("spam").alias("user_label"),
                      S.source_tag("route", F.coalesce("rule_id", F.lit(""))).alias("source"),
                      S.as_of_ntz(as_of).alias("created_at"))


TRASH_ROUTES = ("deletable", "grace_expired", "ml")

ROUTE_ORDER = {"deletable": 0, "grace_expired": 1, "ml": 2, "ml_below": 3, "protected": 4, "unmatched": 5}


def route_column(hit: Column, p_spam: Column, received_at: Column, age: Column, unread: Column,
                 threshold: float = ML_SPAM_THRESHOLD) -> Column:
    """R9 + R10: first match wins (see module doc)."""
    return (F.when(hit.isNull() & p_spam.isNull(), F.lit("unmatched"))
            .when(hit.isNull() & (p_spam >= F.lit(threshold)), F.lit("ml"))
            .when(hit.isNull(), F.lit("ml_below"))
            .when(hit["decision"] == "deletable", F.lit("deletable"))
            .when(received_at.isNull() | (age < GRACE_PERIOD_DAYS) | ~unread, F.lit("protected"))
            .otherwise(F.lit("grace_expired")))


def triage(emails: DataFrame, as_of: _dt.datetime = AS_OF, pack: str = DEFAULT_PACK,
           scorer=None, days_window: int | None = TRIAGE_WINDOW_DAYS,
           threshold: float = ML_SPAM_THRESHOLD, match_on: str = "text") -> DataFrame:
    """T1 (with ``scorer``) / T2 (``scorer=None``): one routed row per scanned mail.

    ``scorer(routed) -> routed`` adds ``p_spam`` and ``model_version`` to mail
    without a rule hit (see ``operators.model.scorer``).
    """
    df = scan_inbox_window(emails, as_of, days_window) if days_window is not None else emails
    received = F.col("received_at")
    df = apply_rules(df.select(
        "id", "thread_id", "sender", "sender_domain", "subject", "snippet", "labels", "received_at",
        S.is_unread("labels").alias("is_unread"),
        S.age_days(received, as_of).alias("age_days"),
    ), pack, match_on=match_on)
    if scorer is not None:
        df = scorer(df)
        p = F.when(F.col("hit").isNull(), F.col("p_spam"))
        ver = F.when(F.col("hit").isNull(), F.col("model_version"))
    else:
        p, ver = F.lit(None).cast("double"), F.lit(None).cast("string")
    df = df.withColumn("p_spam", p).withColumn("model_version", ver)
    route = route_column(F.col("hit"), F.col("p_spam"), received, F.col("age_days"), F.col("is_unread"), threshold)
    return df.select(
        "id", "thread_id", "sender", "sender_domain", "subject", "snippet", "labels", "received_at",
        "age_days", "is_unread", route.alias("route"),
        F.col("hit.decision").alias("decision"),
        F.when(F.col("hit").isNull() & F.col("model_version").isNotNull(),
               F.concat(F.lit("ml:"), F.col("model_version"))).otherwise(F.col("hit.rule_id")).alias("rule_id"),
        F.col("hit.reason").alias("reason"),
        "p_spam", "model_version",
    )


def triage_summary(routed: DataFrame) -> DataFrame:
    """G1: one row of counters, a single partial + final aggregate."""
    r = F.col("route")
    return routed.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(r == "deletable").alias("deletable_rules"),
        F.count_if(r == "ml").alias("deletable_ml"),
        F.count_if(r == "grace_expired").alias("grace_expired"),
        F.count_if(r == "ml_below").alias("ml_below_threshold"),
        F.count_if(r == "protected").alias("protected_by_rule"),
        F.count_if(r == "unmatched").alias("unmatched_no_model"),
    )


def hit_key(routed: DataFrame) -> Column:
    return (F.when(F.col("route") == "deletable", F.concat(F.lit("DEL:"), F.col("rule_id")))
            .when(F.col("route") == "grace_expired", F.concat(F.lit("GRACE:"), F.col("rule_id")))
            .when(F.col("route") == "ml", F.concat(F.lit("ML:"), F.col("model_version"))))


def rule_hit_counts(routed: DataFrame) -> DataFrame:
    """Count per DEL:/GRACE:/ML: key, most frequent first, key as tie-break."""
    k = hit_key(routed)
    return (routed.filter(F.col("route").isin(*TRASH_ROUTES))
            .groupBy(k.alias("hit")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("hit")))


def rule_hit_map(routed: DataFrame) -> DataFrame:
    """G2 as one ``map<string,bigint>`` (bounded by the number of rules and model versions).

    Spark maps carry no order; ``rule_hit_counts`` is the ordered form."""
    k = hit_key(routed)
    counts = (routed.filter(F.col("route").isin(*TRASH_ROUTES))
              .groupBy(k.alias("hit")).agg(F.count(F.lit(1)).alias("n")))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "hit", "n")))
    return counts.agg(F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["hit"], e["n"])))
                      .alias("rule_hits"))


def route_samples(routed: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` mails per route in scan order (newest first, id breaks ties).

    ``row_number`` over a partition with a ``<= n`` filter is planned as a
    WindowGroupLimit, so each task keeps only its top ``n`` per route before
    the shuffle: a huge route never lands whole on one task.
    """
    w = Window.partitionBy("route").orderBy(F.col("received_at").desc(), F.col("id"))
    return (routed.select("route", "id", "rule_id", "age_days", "p_spam",
                          S.truncate_text(F.coalesce(F.col("subject"), F.lit("")), SUBJECT_SAMPLE_CHARS).alias("subject"),
                          F.row_number().over(w).alias("rn"))
            .filter(F.col("rn") <= n))


def ml_top_samples(routed: DataFrame, n: int = 5) -> DataFrame:
    """``n`` highest scores among ML-trashed mail (TakeOrderedAndProject)."""
    return (routed.filter(F.col("route") == "ml")
            .select("id", "rule_id", S.round_score("p_spam", 3).alias("p_spam"),
                    S.truncate_text(F.coalesce(F.col("subject"), F.lit("")), SUBJECT_SAMPLE_CHARS).alias("subject"))
            .orderBy(F.col("p_spam").desc(), F.col("id")).limit(n))


def actions(routed: DataFrame) -> DataFrame:
    """The three trash lists in their fixed order (deletable, grace, ml) as one frame.

    A filter plus an order key replaces three list concatenations; no union.
    """
    action = (F.when(F.col("route") == "deletable", F.lit("deletable"))
              .when(F.col("route") == "grace_expired", F.lit("grace_expired"))
              .otherwise(S.ml_action(F.col("p_spam"))))
    return (routed.filter(F.col("route").isin(*TRASH_ROUTES))
            .select("id", "route", "rule_id", "p_spam",
                    F.when(F.col("route") == "deletable", 0).when(F.col("route") == "grace_expired", 1)
                    .otherwise(2).alias("list_no"),
                    action.alias("action"),
                    S.source_tag(action, F.col("rule_id")).alias("source")))


def decision_to_mail(actions_df: DataFrame, emails: DataFrame) -> DataFrame:
    """Mail row of each action by id (equi join; inner, missing ids dropped)."""
    return actions_df.select("id", "route", "rule_id").join(emails, "id", "inner")
