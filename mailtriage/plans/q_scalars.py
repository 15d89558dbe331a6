"""Registered queries: scans and sources (S2-S10) and scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import AS_OF
from ..sources import fixtures as fx
from ..sources import ingest as I
from ..sources import scans as SC
from . import oracle_sql as O
from .registry import query

RE = fx.oracle_with("raw_emails")
RED = fx.oracle_with("raw_emails_dirty")
FB = fx.oracle_with("feedback")
DEC = fx.oracle_with("decisions")
LE = fx.oracle_with("label_events")

MAIL_COLS = "id, thread_id, sender, sender_domain, subject, snippet, labels, received_at"


def emails(spark, sf):
    return fx.raw_emails(spark, sf)


def messages(spark, sf):
    return I.parse_json_column(fx.raw_messages(spark, sf))


# --- scans ------------------------------------------------------------------
@query("scan_recent", sql=RE + f"SELECT id, received_at FROM raw_emails WHERE {O.newer_than(2)}")
def q_scan_recent(spark, sf):
    return SC.scan_recent(emails(spark, sf), AS_OF).select("id", "received_at")


@query("scan_trash_window", sql=RE + f"SELECT id, received_at FROM raw_emails WHERE {O.has('TRASH')} AND {O.newer_than(30)}")
def q_scan_trash_window(spark, sf):
    return SC.scan_trash_window(emails(spark, sf), AS_OF).select("id", "received_at")


@query("scan_read_inbox", sql=RE + f"""SELECT id, received_at FROM raw_emails
WHERE {O.has('INBOX')} AND NOT {O.has('UNREAD')} AND {O.newer_than(30)}""")
def q_scan_read_inbox(spark, sf):
    return SC.scan_read_inbox(emails(spark, sf), AS_OF).select("id", "received_at")


@query("scan_bootstrap_sources", sql=RE + f"""SELECT id, CASE WHEN {O.has('TRASH')} THEN 'bootstrap_trash'
 WHEN {O.has('SPAM')} THEN 'bootstrap_spam' WHEN NOT {O.has('INBOX')} THEN 'bootstrap_archived'
 ELSE 'bootstrap_inbox' END AS source FROM raw_emails WHERE {O.newer_than(365)}""")
def q_scan_bootstrap_sources(spark, sf):
    return SC.scan_bootstrap_sources(emails(spark, sf), AS_OF).select("id", "source")


@query("mail_predicate", sql=RE + f"""SELECT id FROM raw_emails
WHERE {O.has('INBOX')} AND NOT {O.has('STARRED')} AND NOT {O.has('UNREAD')} AND {O.newer_than(14)}""")
def q_mail_predicate(spark, sf):
    # in:inbox -in:starred -in:unread newer_than:14d
    return emails(spark, sf).filter(SC.mail_filter(["inbox"], ["starred", "unread"], 14, AS_OF)).select("id")


@query("capped_scan", sql=RE + "SELECT id, received_at FROM raw_emails ORDER BY received_at DESC, id LIMIT 500")
def q_capped_scan(spark, sf):
    return SC.capped_scan(emails(spark, sf), 500).select("id", "received_at")


@query("ingest_messages", bench=True, sql=RE + f"SELECT {MAIL_COLS} FROM raw_emails")
def q_ingest_messages(spark, sf):
    return I.to_raw_emails(messages(spark, sf))


@query("fetch_known_ids", sql=fx.oracle_with("raw_emails", "label_events") + """
SELECT r.id, r.sender_domain FROM raw_emails r WHERE r.id IN (SELECT id FROM label_events)""")
def q_fetch_known_ids(spark, sf):
    ids = fx.label_events(spark, sf).select("id")
    return I.fetch_known_ids(ids, emails(spark, sf)).select("id", "sender_domain")


@query("load_training_rows", sql=fx.oracle_with("raw_emails", "feedback") + f"""
SELECT r.id, r.sender, r.sender_domain, r.subject, r.snippet, r.labels, r.received_at, f.user_label
FROM raw_emails r JOIN feedback f ON r.id = f.email_id""")
def q_load_training_rows(spark, sf):
    return I.load_training_rows(emails(spark, sf), fx.feedback(spark, sf))


# --- scalar functions -------------------------------------------------------
@query("header_lookup", sql=RE + "SELECT id, sender AS from_value, subject FROM raw_emails")
def q_header_lookup(spark, sf):
    m = messages(spark, sf)
    return m.select("id", S.header_lookup("payload.headers", "from").alias("from_value"),
                    S.header_lookup("payload.headers", "SUBJECT").alias("subject"))


_ADDR = ("CASE WHEN strpos(s, '<') > 0 AND strpos(s, '>') > 0 "
         "THEN regexp_extract(s, '<([^>]*)', 1) ELSE s END")


@query("parse_sender", sql=RE + f"""
SELECT id, s AS sender, CASE WHEN strpos(a, '@') > 0 THEN lower(substring(a, strpos(a, '@') + 1)) ELSE '' END AS domain
FROM (SELECT id, s, {_ADDR} AS a FROM (SELECT id, {O.norm_sender()} AS s FROM raw_emails))""")
def q_parse_sender(spark, sf):
    full, dom = S.parse_sender("sender")
    return emails(spark, sf).select("id", full.alias("sender"), dom.alias("domain"))


@query("epoch_ms_to_ts", sql=RE + "SELECT id, received_at FROM raw_emails")
def q_epoch_ms_to_ts(spark, sf):
    return messages(spark, sf).select("id", S.epoch_ms_to_ts("internalDate").alias("received_at"))


@query("truncate_text", sql=RE + """
SELECT id, substring(subject, 1, 70) AS subject70, substring(snippet, 1, 100) AS snippet100,
 substring(subject, 1, 60) AS subject60, substring(snippet, 1, 200) AS snippet200 FROM raw_emails""")
def q_truncate_text(spark, sf):
    return emails(spark, sf).select("id", S.truncate_text("subject", 70).alias("subject70"),
                                    S.truncate_text("snippet", 100).alias("snippet100"),
                                    S.truncate_text("subject", 60).alias("subject60"),
                                    S.truncate_text("snippet", 200).alias("snippet200"))


@query("default_missing", sql=RED + """
SELECT id, coalesce(thread_id, '') AS thread_id, coalesce(subject, '') AS subject,
 coalesce(labels, []::VARCHAR[]) AS labels FROM raw_emails_dirty""")
def q_default_missing(spark, sf):
    return fx.raw_emails_dirty(spark, sf).select(
        "id", S.default_missing("thread_id", "").alias("thread_id"), S.default_missing("subject", "").alias("subject"),
        S.labels_or_empty("labels").alias("labels"))


@query("normalize_inputs", sql=RED + f"""
SELECT id, {O.norm_sender()} AS s, {O.norm_domain()} AS d, {O.norm_subject()} AS t FROM raw_emails_dirty""")
def q_normalize_inputs(spark, sf):
    s, d, t = S.normalize_inputs(F.col("sender"), F.col("sender_domain"), F.col("subject"))
    return fx.raw_emails_dirty(spark, sf).select("id", s.alias("s"), d.alias("d"), t.alias("t"))


@query("text_lengths", sql=RED + """
SELECT id, length(coalesce(subject, '')) AS subject_len, length(coalesce(snippet, '')) AS snippet_len FROM raw_emails_dirty""")
def q_text_lengths(spark, sf):
    return fx.raw_emails_dirty(spark, sf).select("id", S.text_length("subject").alias("subject_len"),
                                                 S.text_length("snippet").alias("snippet_len"))


@query("age_days", sql=RED + f"""
SELECT id, {O.age_days()} AS age_days, greatest({O.age_days()}, 0) AS age_days_clipped FROM raw_emails_dirty""")
def q_age_days(spark, sf):
    return fx.raw_emails_dirty(spark, sf).select(
        "id", S.age_days("received_at", AS_OF).alias("age_days"),
        S.age_days_clipped("received_at", AS_OF).alias("age_days_clipped"))


@query("hour_received", sql=RED + "SELECT id, coalesce(hour(received_at), 0) AS hour_received FROM raw_emails_dirty")
def q_hour_received(spark, sf):
    return fx.raw_emails_dirty(spark, sf).select("id", S.hour_received("received_at").alias("hour_received"))


@query("keyword_flags", sql=RE + f"SELECT id, {O.keyword_flags_sql(O.norm_subject())} FROM raw_emails")
def q_keyword_flags(spark, sf):
    return emails(spark, sf).select("id", *S.keyword_flags("subject"))


@query("source_tag", sql=DEC + """
SELECT email_id, 'auto_clean:' || 'ml_p' || printf('%.2f', confidence) || ':' || 'ml:' || model_version AS source
FROM decisions""")
def q_source_tag(spark, sf):
    d = fx.decisions(spark, sf)
    return d.select("email_id", S.source_tag(S.ml_action("confidence"),
                                             F.concat(F.lit("ml:"), "model_version")).alias("source"))


@query("strip_source_prefix", sql=FB + """
SELECT email_id, regexp_replace(source, 'auto_clean:', '') AS rule_text FROM feedback""")
def q_strip_source_prefix(spark, sf):
    return fx.feedback(spark, sf).select("email_id", S.strip_source_prefix("source").alias("rule_text"))


@query("display_time", sql=FB + "SELECT email_id, strftime(created_at, '%d.%m, %H:%M') AS shown FROM feedback")
def q_display_time(spark, sf):
    return fx.feedback(spark, sf).select("email_id", S.display_time("created_at").alias("shown"))


@query("parse_iso_time", sql=RE + "SELECT id, received_at AS parsed, received_at AS parsed_offset FROM raw_emails")
def q_parse_iso_time(spark, sf):
    e = emails(spark, sf)
    iso_z = F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    iso_off = F.date_format(F.col("received_at") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    return e.select("id", S.parse_iso_time(iso_z).alias("parsed"), S.parse_iso_time(iso_off).alias("parsed_offset"))


@query("round_score", sql=DEC + "SELECT email_id, round_even(confidence / 7, 3) AS p FROM decisions")
def q_round_score(spark, sf):
    return fx.decisions(spark, sf).select("email_id", S.round_score(F.col("confidence") / 7, 3).alias("p"))


@query("upper_label_set", sql=LE + """
SELECT id, seq, list_sort(list_distinct(list_transform(coalesce(labels, []::VARCHAR[]), lambda x: upper(x)))) AS label_set
FROM label_events""")
def q_upper_label_set(spark, sf):
    return fx.label_events(spark, sf).select("id", "seq", F.array_sort(S.upper_label_set("labels")).alias("label_set"))


@query("is_unread", sql=RE + f"""
SELECT id, {O.has('UNREAD')} AS is_unread, {O.has('TRASH')} AS in_trash, {O.has('INBOX')} AS in_inbox FROM raw_emails""")
def q_is_unread(spark, sf):
    return emails(spark, sf).select("id", S.is_unread("labels").alias("is_unread"),
                                    S.has_label("labels", "TRASH").alias("in_trash"),
                                    S.has_label("labels", "INBOX").alias("in_inbox"))
