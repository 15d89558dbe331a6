"""Scans by place, read state and age.

A mailbox search such as ``in:inbox -in:unread newer_than:30d`` becomes a
Column predicate built in Python (``mail_filter``); there is no parser for the
search language. The time bound is a plain comparison on ``received_at``, so
Catalyst pushes it into the Parquet scan (row-group min/max); the label tests
run right after, in the same stage.
"""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.packs import (BOOTSTRAP_WINDOW_DAYS, OBSERVE_WINDOW_DAYS,
                               TRIAGE_WINDOW_DAYS)
from ..session import AS_OF


DAY_COLUMN = "received_day"   # partition column of a stored mail table (see ``write_mail_table``)


def newer_than(as_of: _dt.datetime, days: int) -> Column:
    """``received_at`` within the last ``days`` days (a literal bound, pushed down)."""
    bound = as_of - _dt.timedelta(days=days)
    return F.col("received_at") >= S.as_of_ntz(bound)


def window_filter(df: DataFrame, as_of: _dt.datetime, days: int) -> Column:
    """``newer_than`` plus, on a table partitioned by receipt day, the same bound on the
    partition column, so whole day folders are skipped (partition pruning)."""
    cond = newer_than(as_of, days)
    if DAY_COLUMN in df.columns:
        bound = (as_of - _dt.timedelta(days=days)).date()
        cond = cond & (F.col(DAY_COLUMN) >= F.lit(bound.isoformat()).cast("date"))
    return cond


def write_mail_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store mail partitioned by receipt day, sorted by domain and id inside each file, so
    time windows prune folders and Parquet min/max statistics serve domain filters."""
    (df.withColumn(DAY_COLUMN, F.to_date("received_at"))
     .repartition(DAY_COLUMN).sortWithinPartitions("sender_domain", "id")
     .write.mode(mode).partitionBy(DAY_COLUMN).parquet(path))


def mail_filter(in_: list[str] | tuple = (), not_in: list[str] | tuple = (),
                newer_than_days: int | None = None, as_of: _dt.datetime = AS_OF) -> Column:
    """Conjunction of ``in:X`` / ``-in:X`` / ``newer_than:Nd`` as one predicate."""
    cond = F.lit(True)
    if newer_than_days is not None:
        cond = newer_than(as_of, newer_than_days)
    for lab in in_:
        cond = cond & S.has_label("labels", lab.upper())
    for lab in not_in:
        cond = cond & ~S.has_label("labels", lab.upper())
    return cond


def scan_inbox_window(emails: DataFrame, as_of: _dt.datetime = AS_OF,
                      days: int = TRIAGE_WINDOW_DAYS) -> DataFrame:
    """INBOX mail younger than ``days`` days. No cap (see ``capped_scan``)."""
    return emails.filter(window_filter(emails, as_of, days) & mail_filter(["INBOX"]))


def scan_recent(emails: DataFrame, as_of: _dt.datetime = AS_OF,
                days: int = OBSERVE_WINDOW_DAYS, exclude_trash_spam: bool = False) -> DataFrame:
    """All mail younger than ``days`` days, every place included; ``exclude_trash_spam`` leaves out
    TRASH and SPAM, as a provider's list call does that doesn't ask for them (Q27)."""
    recent = emails.filter(window_filter(emails, as_of, days))
    return recent.filter(mail_filter(not_in=["TRASH", "SPAM"])) if exclude_trash_spam else recent


def scan_trash_window(emails: DataFrame, as_of: _dt.datetime = AS_OF, days: int = 30) -> DataFrame:
    """S3: TRASH, ``days`` days."""
    return emails.filter(window_filter(emails, as_of, days) & mail_filter(["TRASH"]))


def scan_read_inbox(emails: DataFrame, as_of: _dt.datetime = AS_OF, days: int = 30) -> DataFrame:
    """INBOX and not UNREAD, ``days`` days."""
    return emails.filter(window_filter(emails, as_of, days) & mail_filter(["INBOX"], ["UNREAD"]))


def bootstrap_source(labels: Column | str = "labels") -> Column:
    """The first of trash, spam, archived (none of INBOX/TRASH/SPAM), inbox that holds."""
    has = lambda x: S.has_label(labels, x)
    return (F.when(has("TRASH"), F.lit("bootstrap_trash"))
            .when(has("SPAM"), F.lit("bootstrap_spam"))
            .when(~has("INBOX"), F.lit("bootstrap_archived"))
            .otherwise(F.lit("bootstrap_inbox")))


def scan_bootstrap_sources(emails: DataFrame, as_of: _dt.datetime = AS_OF,
                           days: int = BOOTSTRAP_WINDOW_DAYS) -> DataFrame:
    """One pass over a year of mail, each row tagged with its (single) source."""
    return emails.filter(window_filter(emails, as_of, days)).withColumn("source", bootstrap_source("labels"))


def capped_scan(emails: DataFrame, max_results: int) -> DataFrame:
    """The newest ``max_results`` mails (id breaks ties). Opt-in; the jobs default to no cap.

    Planned as TakeOrderedAndProject: each task keeps its own top ``n``, the
    driver merges ``n`` x tasks rows; ``max_results`` is the caller's bound.
    """
    return emails.orderBy(F.col("received_at").desc(), F.col("id")).limit(max_results)
