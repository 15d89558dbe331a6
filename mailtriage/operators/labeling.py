"""Labels derived from mailbox state.

All are ``when`` chains over columns of the same row: no shuffle, no UDF.
"""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.packs import (CLASS_TAXONOMY, CURATED_PREFIX, DEFAULT_PACK, HUMAN_SOURCES,
                               INBOX_KEEP_AGE_DAYS, LABEL_OUTCOMES, RECOVERY_DAYS)
from ..session import AS_OF
from .rules import read_later, transactional_rules


def label_state(labels: Column | str = "labels") -> Column:
    """TRASH/SPAM -> spam; not INBOX -> keep; INBOX and read -> keep; else null (undecided)."""
    has = lambda x: S.has_label(labels, x)
    return (F.when(has("TRASH") | has("SPAM"), F.lit("spam"))
            .when(~has("INBOX"), F.lit("keep"))
            .when(~has("UNREAD"), F.lit("keep")))


def inbox_age_label(received_at: Column, labels: Column | str, as_of: _dt.datetime = AS_OF) -> Column:
    """Read and older than 30 days -> keep; otherwise (or no time) null."""
    return F.when(received_at.isNotNull() & ~S.is_unread(labels)
                  & (S.age_days(received_at, as_of) > INBOX_KEEP_AGE_DAYS), F.lit("keep"))


def bootstrap_label(source: Column, received_at: Column, labels: Column | str,
                    as_of: _dt.datetime = AS_OF) -> Column:
    """Trash, spam -> spam; archived -> keep; inbox -> R13."""
    return (F.when(source.isin("bootstrap_trash", "bootstrap_spam"), F.lit("spam"))
            .when(source == "bootstrap_archived", F.lit("keep"))
            .when(source == "bootstrap_inbox", inbox_age_label(received_at, labels, as_of)))


def observe_final_state(labels: Column | str = "labels") -> Column:
    """SPAM, TRASH, STARRED, no INBOX, UNREAD, else read_kept (first wins)."""
    has = lambda x: S.has_label(labels, x)
    return (F.when(has("SPAM"), F.lit("spam_folder"))
            .when(has("TRASH"), F.lit("deleted"))
            .when(has("STARRED"), F.lit("starred"))
            .when(~has("INBOX"), F.lit("archived"))
            .when(has("UNREAD"), F.lit("unread_kept"))
            .otherwise(F.lit("read_kept")))


def _outcome(key: str, rule: Column | None = None) -> Column:
    cls, train, target, reason = LABEL_OUTCOMES[key]
    if "{rule}" in reason:
        pre, post = reason.split("{rule}")
        reason_col = F.concat(F.lit(pre), rule, F.lit(post))
    else:
        reason_col = F.lit(reason)
    # Q7: as coded the default keep has the class of mail to delete; cls_fixed has the class of its target
    fixed = CLASS_TAXONOMY["keep_critical"] if target == "keep" else cls
    return F.struct(F.lit(cls).alias("cls"), F.lit(train).alias("include_in_training"),
                    F.lit(target).cast("string").alias("train_target"), reason_col.alias("reason"),
                    F.lit(fixed).alias("cls_fixed"))


def derive_label(df: DataFrame, pack: str = DEFAULT_PACK, user_label: str | None = "user_label",
                 out: str = "label") -> DataFrame:
    """Four classes + train flag + target + reason, first match wins.

    Inputs are used as given (no strip / lower), null -> '' (R14, R16).
    """
    d = transactional_rules(df, pack, out="_tx")
    labels = S.upper_label_set("labels")
    in_trash = F.array_contains(labels, "TRASH")
    in_inbox = F.array_contains(labels, "INBOX")
    tx = F.col("_tx")
    later = read_later(F.col("sender"), F.col("sender_domain"))
    ul = F.col(user_label) if user_label else F.lit(None).cast("string")
    label = (F.when(tx.isNotNull() & in_trash, _outcome("tx_in_trash", tx))
             .when(tx.isNotNull(), _outcome("tx", tx))
             .when(later & in_trash, _outcome("read_later_in_trash"))
             .when(later, _outcome("read_later"))
             .when((ul == "spam") | (in_trash & ~in_inbox), _outcome("spam"))
             .otherwise(_outcome("default_keep")))
    return d.withColumn(out, label).drop("_tx")


def documented_class(cls: Column) -> Column:
    """Coded class name -> documented name."""
    back = {v: k for k, v in CLASS_TAXONOMY.items()}
    m = F.create_map(*[F.lit(x) for kv in back.items() for x in kv])
    return F.coalesce(m[cls], cls)


def training_eligible(source: Column, label: Column | None = None) -> Column:
    """Explicit human signals and curated bootstrap only; never ``auto_clean:%`` or
    passive observation; and not a class R15 excludes."""
    ok = source.isin(*HUMAN_SOURCES) | source.startswith(CURATED_PREFIX)
    if label is not None:
        ok = ok & label["include_in_training"]
    return ok


def purge_candidates(decisions: DataFrame, feedback: DataFrame, as_of: _dt.datetime = AS_OF,
                     days: int = RECOVERY_DAYS) -> DataFrame:
    """Executed trash decisions older than the recovery time, never restored (anti join)."""
    restored = feedback.filter(F.col("source") == "user_restore").select("email_id")
    old = decisions.filter((F.col("decision") == "spam") & F.col("executed")
                           & (F.col("decided_at") < S.as_of_ntz(as_of - _dt.timedelta(days=days))))
    return old.join(restored, "email_id", "left_anti")
