"""Registered queries: review page and evaluation."""
from __future__ import annotations

from ..functions.packs import REVIEW_LIMIT
from ..operators import review as RV
from ..session import AS_OF
from ..sources import fixtures as fx
from . import oracle_sql as O
from .registry import query

A = O.AS_OF
QUEUE = fx.oracle_with("raw_emails", "feedback") + f""",
q AS (SELECT f.email_id AS id, r.sender_domain, r.subject, r.snippet, r.received_at, f.user_label, f.source,
  f.created_at AS decided_at FROM feedback f JOIN raw_emails r ON r.id = f.email_id
  WHERE f.source LIKE 'auto_clean:%' AND f.created_at > {A} - INTERVAL 7 DAY
  ORDER BY f.created_at DESC, f.email_id)
"""
PAGE = QUEUE + f", p AS (SELECT * FROM q ORDER BY decided_at DESC, id LIMIT {REVIEW_LIMIT})\n"


def _queue(spark, sf, limit=None):
    return RV.review_queue(fx.feedback(spark, sf), fx.raw_emails(spark, sf), AS_OF, limit)


@query("review_queue", sql=PAGE + "SELECT * FROM p")
def q_review_queue(spark, sf):
    return _queue(spark, sf, REVIEW_LIMIT)


@query("review_stats_24h", sql=fx.oracle_with("feedback") + f"""
SELECT user_label, count(*) AS cnt FROM feedback
WHERE source LIKE 'auto_clean:%' AND created_at > {A} - INTERVAL 24 HOUR GROUP BY user_label""")
def q_review_stats_24h(spark, sf):
    return RV.review_stats(fx.feedback(spark, sf), AS_OF)


@query("flagged_count", sql=QUEUE + "SELECT count(*) FILTER (WHERE user_label = 'spam') AS flagged FROM q")
def q_flagged_count(spark, sf):
    return RV.flagged_count(_queue(spark, sf))


@query("review_page", sql=PAGE + """
SELECT id, strftime(received_at, '%d.%m, %H:%M') AS shown_at, sender_domain, subject, substring(snippet, 1, 100) AS snippet,
 regexp_replace(source, 'auto_clean:', '') AS rule, user_label, decided_at FROM p""")
def q_review_page(spark, sf):
    return RV.review_page(_queue(spark, sf, REVIEW_LIMIT))


@query("pending_review", sql=fx.oracle_with("decisions", "feedback") + """
SELECT email_id, decision, model_version FROM decisions
WHERE email_id NOT IN (SELECT email_id FROM feedback WHERE source IN ('user_restore', 'user_confirm'))""")
def q_pending_review(spark, sf):
    return RV.pending_review(fx.decisions(spark, sf), fx.feedback(spark, sf)).select(
        "email_id", "decision", "model_version")


JUDGED = fx.oracle_with("decisions", "feedback") + """,
j AS (SELECT d.*, h.user_label, h.source FROM decisions d
  LEFT JOIN (SELECT * FROM feedback WHERE source IN ('user_restore', 'user_confirm')) h ON h.email_id = d.email_id)
"""


def _r(num, den):
    return f"round(CASE WHEN ({den}) > 0 THEN ({num}) / ({den}) ELSE 0.0 END, 6)"


@query("weekly_evaluation", sql=JUDGED + f"""
SELECT week_start, tp, fp, fn, trashed, restored, {_r('tp', 'tp + fp')} AS precision, {_r('tp', 'tp + fn')} AS recall,
 {_r('restored', 'trashed')} AS restore_rate
FROM (SELECT TIMESTAMP '1970-01-01' + to_days(CAST(floor(epoch(decided_at) / 604800) * 7 AS INTEGER)) AS week_start,
  count(*) FILTER (WHERE decision = 'spam' AND user_label = 'spam') AS tp, count(*) FILTER (WHERE decision = 'spam' AND user_label = 'keep') AS fp,
  count(*) FILTER (WHERE decision <> 'spam' AND user_label = 'spam') AS fn, count(*) FILTER (WHERE decision = 'spam' AND executed) AS trashed,
  count(*) FILTER (WHERE decision = 'spam' AND executed AND source = 'user_restore') AS restored
  FROM j GROUP BY 1)""")
def q_weekly_evaluation(spark, sf):
    return RV.weekly_evaluation(fx.decisions(spark, sf), fx.feedback(spark, sf))


@query("precision_gate", sql=JUDGED + f"""
SELECT model_version, tp, fp, {_r('tp', 'tp + fp')} AS precision, {_r('tp', 'tp + fp')} >= 0.95 AS passes
FROM (SELECT model_version, count(*) FILTER (WHERE decision = 'spam' AND user_label = 'spam') AS tp,
  count(*) FILTER (WHERE decision = 'spam' AND user_label = 'keep') AS fp FROM j GROUP BY 1)""")
def q_precision_gate(spark, sf):
    return RV.precision_gate(fx.decisions(spark, sf), fx.feedback(spark, sf))


@query("audit_coverage", sql=fx.oracle_with("decisions", "audit_log") + f"""
SELECT count(*) AS actions, count(*) FILTER (WHERE email_id IN (SELECT email_id FROM audit_log)) AS audited,
 {_r('count(*) FILTER (WHERE email_id IN (SELECT email_id FROM audit_log))', 'count(*)')} AS coverage
FROM decisions WHERE decision = 'spam' AND executed""")
def q_audit_coverage(spark, sf):
    return RV.audit_coverage(fx.decisions(spark, sf), fx.audit_log(spark, sf))
