"""Registered queries: observation jobs and their parts.

Fixture roles: the provider's current mailbox is ``raw_emails_dirty`` (it
holds ids the mail table has never seen), the mail table is ``raw_emails``,
the label table is ``feedback``.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import observe as OB
from ..session import AS_OF
from ..sources import fixtures as fx
from ..sources import scans as SC
from . import oracle_sql as O
from .registry import query

A = O.AS_OF
MAIL = "id, thread_id, sender, sender_domain, subject, snippet, labels, received_at"


def mailbox(spark, sf):
    return fx.raw_emails_dirty(spark, sf).distinct()


B3_SQL = fx.oracle_with("raw_emails", "raw_emails_dirty", "feedback") + f""",
mb AS (SELECT DISTINCT * FROM raw_emails_dirty),
tw AS (SELECT * FROM mb WHERE {O.has('TRASH')} AND {O.newer_than(30)}),
rw AS (SELECT * FROM mb WHERE {O.has('INBOX')} AND NOT {O.has('UNREAD')} AND {O.newer_than(30)}),
ku_s AS (SELECT DISTINCT id FROM tw WHERE id IN (SELECT id FROM raw_emails)
  AND id NOT IN (SELECT email_id FROM feedback WHERE user_label = 'spam')),
un_s AS (SELECT DISTINCT id FROM tw WHERE id NOT IN (SELECT id FROM raw_emails)),
new_s AS (SELECT id FROM ku_s UNION SELECT id FROM un_s),
ku_k AS (SELECT DISTINCT id FROM rw WHERE id IN (SELECT id FROM raw_emails)
  AND id NOT IN (SELECT email_id FROM feedback WHERE user_label = 'keep')
  UNION SELECT id FROM rw WHERE id IN (SELECT id FROM new_s)),
un_k AS (SELECT DISTINCT id FROM rw WHERE id NOT IN (SELECT id FROM raw_emails) AND id NOT IN (SELECT id FROM new_s)),
new_k AS (SELECT id FROM ku_k UNION SELECT id FROM un_k),
lab AS (SELECT id, sender_domain, subject, received_at, 'spam' AS state, 0 AS step FROM tw WHERE id IN (SELECT id FROM new_s)
  UNION ALL SELECT id, sender_domain, subject, received_at, 'keep', 1 FROM rw WHERE id IN (SELECT id FROM new_k)),
dom AS (SELECT state AS label, sender_domain, count(*) AS n FROM lab GROUP BY 1, 2)
"""


def _b3(spark, sf):
    return OB.detect_changes(mailbox(spark, sf), fx.raw_emails(spark, sf), fx.feedback(spark, sf), AS_OF)


def _trash_ids(spark, sf):
    return SC.scan_trash_window(mailbox(spark, sf), AS_OF).select("id")


@query("join_mail_feedback", sql=fx.oracle_with("raw_emails", "feedback") + """
SELECT r.id, r.sender_domain, f.user_label, f.source FROM raw_emails r JOIN feedback f ON f.email_id = r.id""")
def q_join_mail_feedback(spark, sf):
    j = OB.join_mail_feedback(fx.raw_emails(spark, sf), fx.feedback(spark, sf))
    return j.select("id", "sender_domain", "user_label", "source")


@query("semi_known_ids", sql=B3_SQL + "SELECT DISTINCT id FROM tw WHERE id IN (SELECT id FROM raw_emails)")
def q_semi_known_ids(spark, sf):
    return OB.semi_known_ids(_trash_ids(spark, sf), fx.raw_emails(spark, sf))


@query("anti_already_labeled", sql=B3_SQL + "SELECT id FROM ku_s")
def q_anti_already_labeled(spark, sf):
    return OB.anti_already_labeled(_trash_ids(spark, sf), fx.raw_emails(spark, sf), fx.feedback(spark, sf), "spam")


@query("anti_unknown_ids", sql=B3_SQL + "SELECT id FROM un_s")
def q_anti_unknown_ids(spark, sf):
    return OB.anti_unknown_ids(_trash_ids(spark, sf), fx.raw_emails(spark, sf))


@query("except_ids", sql=B3_SQL + "SELECT id FROM tw EXCEPT SELECT id FROM raw_emails")
def q_except_ids(spark, sf):
    return OB.except_ids(_trash_ids(spark, sf), fx.raw_emails(spark, sf))


@query("union_new_ids", sql=B3_SQL + "SELECT id FROM new_s")
def q_union_new_ids(spark, sf):
    ids, e, f = _trash_ids(spark, sf), fx.raw_emails(spark, sf), fx.feedback(spark, sf)
    return OB.union_new_ids(OB.anti_already_labeled(ids, e, f, "spam"), OB.anti_unknown_ids(ids, e))


@query("new_observation_counts", sql=B3_SQL + """
SELECT 'spam' AS label, (SELECT count(*) FROM new_s) AS new_total, (SELECT count(*) FROM ku_s) AS known_unlabeled,
 (SELECT count(*) FROM un_s) AS unknown
UNION ALL SELECT 'keep', (SELECT count(*) FROM new_k), (SELECT count(*) FROM ku_k), (SELECT count(*) FROM un_k)""")
def q_new_observation_counts(spark, sf):
    return _b3(spark, sf)["counts"]


@query("top_domains", sql=B3_SQL + """
SELECT * FROM (SELECT label, sender_domain, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, sender_domain) AS rank
 FROM dom) WHERE rank <= 10""")
def q_top_domains(spark, sf):
    return _b3(spark, sf)["top_domains"]


@query("newest_samples", sql=B3_SQL + """
SELECT id, received_at, sender_domain, substring(coalesce(subject, ''), 1, 60) AS subject FROM lab WHERE state = 'spam'
ORDER BY received_at DESC NULLS LAST, sender_domain DESC, subject DESC, id DESC LIMIT 10""")
def q_newest_samples(spark, sf):
    return _b3(spark, sf)["newest_spam"]


@query("detect_changes", sql=B3_SQL + f""",
u AS (SELECT email_id, user_label, source, created_at, 0 AS b, 0 AS s FROM feedback
  UNION ALL SELECT id, state, 'daily_observation', {A}, 1, step FROM lab)
SELECT email_id, arg_max(user_label, (created_at, b, s)) AS user_label, arg_max(source, (created_at, b, s)) AS source,
 max(created_at) AS created_at FROM u GROUP BY email_id""")
def q_detect_changes(spark, sf):
    return _b3(spark, sf)["feedback"]


B2_SQL = fx.oracle_with("raw_emails", "feedback") + f""",
rec AS (SELECT id, sender_domain, CASE WHEN {O.has('TRASH')} OR {O.has('SPAM')} THEN 'spam'
 WHEN NOT {O.has('INBOX')} THEN 'keep' WHEN NOT {O.has('UNREAD')} THEN 'keep' END AS state
 FROM raw_emails WHERE {O.newer_than(2)})
"""


def _b2(spark, sf):
    e = fx.raw_emails(spark, sf)
    return OB.daily_observe(e, e, fx.feedback(spark, sf), AS_OF)


@query("state_counts", sql=B2_SQL + """
SELECT count(*) FILTER (WHERE state = 'spam') AS spam, count(*) FILTER (WHERE state = 'keep') AS keep, count(*) FILTER (WHERE state IS NULL) AS uncertain,
 count(*) AS scanned FROM rec""")
def q_state_counts(spark, sf):
    return _b2(spark, sf)["state_counts"]


@query("sender_domain_counts", sql=B2_SQL + """
SELECT state AS label, sender_domain, count(*) AS n FROM rec WHERE state IS NOT NULL GROUP BY 1, 2""")
def q_sender_domain_counts(spark, sf):
    return _b2(spark, sf)["domain_counts"]


@query("daily_observe", sql=B2_SQL + f""",
ch AS (SELECT id AS email_id, state AS user_label, 'daily_observation' AS source, {A} AS created_at FROM rec
 WHERE state IS NOT NULL AND id NOT IN (SELECT email_id FROM feedback WHERE source IN ('user_restore', 'user_confirm'))),
u AS (SELECT email_id, user_label, source, created_at, 0 AS b FROM feedback
  UNION ALL SELECT email_id, user_label, source, created_at, 1 FROM ch)
SELECT email_id, arg_max(user_label, (created_at, b)) AS user_label, arg_max(source, (created_at, b)) AS source,
 max(created_at) AS created_at FROM u GROUP BY email_id""")
def q_daily_observe(spark, sf):
    return _b2(spark, sf)["feedback"]


@query("bootstrap_history", sql=fx.oracle_with("raw_emails", "feedback") + f"""
SELECT source, count(*) AS scanned, count(*) FILTER (WHERE NOT known) AS inserted_mail, count(label) AS labeled,
 count(label) FILTER (WHERE NOT had) AS inserted_feedback
FROM (SELECT coalesce(received_at < {A} - INTERVAL 10 DAY, false) AS known, id IN (SELECT email_id FROM feedback) AS had, CASE WHEN {O.has('TRASH')} THEN 'bootstrap_trash' WHEN {O.has('SPAM')} THEN 'bootstrap_spam'
  WHEN NOT {O.has('INBOX')} THEN 'bootstrap_archived' ELSE 'bootstrap_inbox' END AS source,
  CASE WHEN {O.has('TRASH')} OR {O.has('SPAM')} THEN 'spam' WHEN NOT {O.has('INBOX')} THEN 'keep'
  WHEN received_at IS NOT NULL AND NOT {O.has('UNREAD')} AND {O.age_days()} > 30 THEN 'keep' END AS label
  FROM raw_emails WHERE {O.newer_than(365)}) GROUP BY source""")
def q_bootstrap_history(spark, sf):
    """B1 on tables that know the mail of ten days ago and all feedback; report per source."""
    e = fx.raw_emails(spark, sf)
    mail = e.filter(F.col("received_at") < S.as_of_ntz(AS_OF) - F.expr("INTERVAL 10 DAY"))
    _, _, rep = OB.bootstrap_history(e, mail, fx.feedback(spark, sf), AS_OF)
    return rep
