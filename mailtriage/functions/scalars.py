"""Scalar column functions (projections): all built-in expressions, so they
stay inside whole-stage codegen. Each takes and returns ``Column``s.
"""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .packs import GRACE_PERIOD_DAYS, KEYWORD_PATTERNS
from .regex import spark_regex

MICROS_PER_DAY = 86_400_000_000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_lit(as_of: _dt.datetime) -> Column:
    """``as_of`` (naive = UTC) as a ``timestamp`` literal; text avoids the Python zone."""
    return as_of_ntz(as_of).cast("timestamp")


def as_of_ntz(as_of: _dt.datetime) -> Column:
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


# P1 -------------------------------------------------------------------------
def header_lookup(headers, name: str) -> Column:
    """Value of the first header whose name equals ``name`` ignoring case, else ''."""
    hit = F.filter(_c(headers), lambda h: F.lower(h["name"]) == F.lit(name.lower()))
    return F.coalesce(F.get(hit, 0)["value"], F.lit(""))


# P6 helper: Python str.strip() removes Unicode white space at both ends.
def strip(c) -> Column:
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


# P2 -------------------------------------------------------------------------
def sender_address(from_header) -> Column:
    """Address part: text from the first '<' to the next '>' when both occur."""
    full = strip(F.coalesce(_c(from_header), F.lit("")))
    return F.when(F.contains(full, F.lit("<")) & F.contains(full, F.lit(">")),
                  F.regexp_extract(full, r"<([^>]*)", 1)).otherwise(full)


def sender_domain(from_header) -> Column:
    """Lower-cased text after the first '@' of the address, else ''."""
    email = sender_address(from_header)
    at = F.instr(email, "@")
    return F.when(at > 0, F.lower(F.substring(email, at + 1, 1 << 30))).otherwise(F.lit(""))


def parse_sender(from_header) -> tuple[Column, Column]:
    return strip(F.coalesce(_c(from_header), F.lit(""))), sender_domain(from_header)


# P3 -------------------------------------------------------------------------
def epoch_ms_to_ts(ms_text) -> Column:
    """Milliseconds since epoch (as text) -> ``timestamp_ntz`` (UTC); bad or missing -> null."""
    return F.timestamp_millis(_c(ms_text).try_cast("bigint")).cast("timestamp_ntz")


# P4 -------------------------------------------------------------------------
def truncate_text(c, n: int) -> Column:
    return F.substring(_c(c), 1, n)


# P5 -------------------------------------------------------------------------
def default_missing(c, default) -> Column:
    return F.coalesce(_c(c), default if isinstance(default, Column) else F.lit(default))


def labels_or_empty(labels) -> Column:
    return F.coalesce(_c(labels), F.array().cast("array<string>"))


# P6 -------------------------------------------------------------------------
def normalize_inputs(sender, domain, subject) -> tuple[Column, Column, Column]:
    return (strip(F.coalesce(_c(sender), F.lit(""))),
            F.lower(strip(F.coalesce(_c(domain), F.lit("")))),
            F.coalesce(_c(subject), F.lit("")))


# P7 -------------------------------------------------------------------------
def text_length(c) -> Column:
    return F.length(F.coalesce(_c(c), F.lit("")))


# P8 -------------------------------------------------------------------------
def age_days(received_at, as_of: _dt.datetime) -> Column:
    """Whole elapsed 24 h periods since receipt, rounded down (negative in the future)."""
    diff = F.unix_micros(as_of_lit(as_of)) - F.unix_micros(_c(received_at).cast("timestamp"))
    return F.floor(diff / F.lit(float(MICROS_PER_DAY))).cast("bigint")


def age_days_clipped(received_at, as_of: _dt.datetime) -> Column:
    return F.greatest(age_days(received_at, as_of), F.lit(0).cast("bigint"))


# P9 -------------------------------------------------------------------------
def hour_received(received_at) -> Column:
    return F.coalesce(F.hour(_c(received_at)), F.lit(0))


# P10 ------------------------------------------------------------------------
def keyword_flags(subject) -> list[Column]:
    subj = F.coalesce(_c(subject), F.lit(""))
    return [subj.rlike(spark_regex(p)).cast("int").alias(name) for name, p in KEYWORD_PATTERNS]


# P11 ------------------------------------------------------------------------
def ml_action(p_spam) -> Column:
    """``ml_p0.93``: the score with two decimals, ties to even."""
    return F.concat(F.lit("ml_p"), F.format_string("%.2f", F.bround(_c(p_spam), 2)))


def source_tag(action, rule_id) -> Column:
    return F.concat(F.lit("auto_clean:"), _c(action), F.lit(":"), _c(rule_id))


# P12 ------------------------------------------------------------------------
def strip_source_prefix(source) -> Column:
    """Remove the first 'auto_clean:' wherever it occurs."""
    return F.regexp_replace(_c(source), r"^(.*?)auto_clean:", "$1")


# P13 ------------------------------------------------------------------------
def display_time(ts) -> Column:
    return F.date_format(_c(ts), "dd.MM, HH:mm")


# P14 ------------------------------------------------------------------------
def parse_iso_time(text) -> Column:
    """ISO-8601 text, 'Z' or offset allowed, no zone = UTC -> ``timestamp_ntz`` in UTC."""
    return F.try_to_timestamp(_c(text)).cast("timestamp_ntz")


# P15 ------------------------------------------------------------------------
def round_score(p, digits: int = 3) -> Column:
    return F.bround(_c(p), digits)


# P16 ------------------------------------------------------------------------
def upper_label_set(labels) -> Column:
    return F.array_distinct(F.transform(labels_or_empty(labels), lambda x: F.upper(x)))


# P17 ------------------------------------------------------------------------
def has_label(labels, label: str) -> Column:
    return F.array_contains(labels_or_empty(labels), label)


def is_unread(labels) -> Column:
    return has_label(labels, "UNREAD")


# R8 -------------------------------------------------------------------------
def in_grace_period(received_at, unread: Column, as_of: _dt.datetime) -> Column:
    return unread & (age_days(received_at, as_of) < GRACE_PERIOD_DAYS)
