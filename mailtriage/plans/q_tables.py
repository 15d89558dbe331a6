"""Registered queries: table changes, checks and foreign keys."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.packs import BOOTSTRAP_SOURCES
from ..operators import labeling as L
from ..operators import review as RV
from ..operators import tables as K
from ..session import AS_OF
from ..sources import fixtures as fx
from ..sources import scans as SC
from . import oracle_sql as O
from . import triage as T
from .registry import query

A = O.AS_OF
MAIL = "id, thread_id, sender, sender_domain, subject, snippet, labels, received_at"


def _latest_events(spark, sf):
    return K.latest_per_key(fx.label_events(spark, sf), "id", ["changed_at", "seq"])


LATEST_EV_SQL = """latest_ev AS (SELECT id, arg_max(labels, (changed_at, seq)) AS labels FROM label_events GROUP BY id)"""


@query("latest_per_key", sql=fx.oracle_with("label_events") + f""", {LATEST_EV_SQL},
chk AS (SELECT id, labels FROM (SELECT id, labels, row_number() OVER (PARTITION BY id ORDER BY changed_at DESC, seq DESC) AS rn
  FROM label_events) WHERE rn = 1)
SELECT l.id, list_sort(l.labels) AS labels FROM latest_ev l JOIN chk c ON c.id = l.id AND c.labels = l.labels""")
def q_latest_per_key(spark, sf):
    return _latest_events(spark, sf).select("id", F.array_sort("labels").alias("labels"))


@query("insert_if_absent_mail", sql=fx.oracle_with("raw_emails", "raw_emails_dirty") + f"""
SELECT {MAIL} FROM raw_emails UNION ALL
SELECT DISTINCT {MAIL} FROM raw_emails_dirty d WHERE d.id NOT IN (SELECT id FROM raw_emails)""")
def q_insert_if_absent_mail(spark, sf):
    return K.insert_if_absent(fx.raw_emails(spark, sf), fx.raw_emails_dirty(spark, sf), F.col("received_at"))


def _label_changes(spark, sf):
    d = fx.raw_emails_dirty(spark, sf)
    ev = _latest_events(spark, sf).select("id", F.col("labels").alias("_ev"))
    return d.join(ev, "id", "left").withColumn("labels", F.coalesce("_ev", "labels")).drop("_ev")


UPSERT_SQL = fx.oracle_with("raw_emails", "raw_emails_dirty", "label_events") + f""", {LATEST_EV_SQL},
ch AS (SELECT d.id, d.thread_id, d.sender, d.sender_domain, d.subject, d.snippet,
  coalesce(e.labels, d.labels) AS labels, d.received_at
  FROM (SELECT DISTINCT * FROM raw_emails_dirty) d LEFT JOIN latest_ev e ON e.id = d.id),
up AS (SELECT coalesce(o.id, n.id) AS id,
  CASE WHEN o.id IS NOT NULL THEN o.thread_id ELSE n.thread_id END AS thread_id,
  CASE WHEN o.id IS NOT NULL THEN o.sender ELSE n.sender END AS sender,
  CASE WHEN o.id IS NOT NULL THEN o.sender_domain ELSE n.sender_domain END AS sender_domain,
  CASE WHEN o.id IS NOT NULL THEN o.subject ELSE n.subject END AS subject,
  CASE WHEN o.id IS NOT NULL THEN o.snippet ELSE n.snippet END AS snippet,
  CASE WHEN n.id IS NOT NULL THEN n.labels ELSE o.labels END AS labels,
  CASE WHEN o.id IS NOT NULL THEN o.received_at ELSE n.received_at END AS received_at,
  CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'unchanged' ELSE 'updated' END AS outcome
  FROM raw_emails o FULL OUTER JOIN ch n ON o.id = n.id)
"""


@query("upsert_mail_labels", bench=True, sql=UPSERT_SQL + "SELECT * FROM up")
def q_upsert_mail_labels(spark, sf):
    return K.upsert_mail_labels(fx.raw_emails(spark, sf), _label_changes(spark, sf), F.col("received_at"))


@query("upsert_outcome_counts", sql=UPSERT_SQL + "SELECT outcome, count(*) AS n FROM up WHERE outcome <> 'unchanged' GROUP BY outcome")
def q_upsert_outcome_counts(spark, sf):
    return K.upsert_outcome_counts(K.upsert_mail_labels(fx.raw_emails(spark, sf), _label_changes(spark, sf), F.col("received_at")))


def _bootstrap_feedback(spark, sf):
    e = SC.scan_bootstrap_sources(fx.raw_emails(spark, sf), AS_OF)
    lab = L.bootstrap_label(F.col("source"), F.col("received_at"), "labels", AS_OF)
    rank = F.array_position(F.array(*[F.lit(s) for s in BOOTSTRAP_SOURCES]), F.col("source"))
    return (e.select(F.col("id").alias("email_id"), lab.alias("user_label"), "source",
                     S.as_of_ntz(AS_OF).alias("created_at"), rank.alias("rank"))
            .filter(F.col("user_label").isNotNull()))


BOOT_SQL = f"""boot AS (SELECT id AS email_id, CASE WHEN source IN ('bootstrap_trash', 'bootstrap_spam') THEN 'spam'
 WHEN source = 'bootstrap_archived' THEN 'keep'
 WHEN received_at IS NOT NULL AND NOT {O.has('UNREAD')} AND {O.age_days()} > 30 THEN 'keep' END AS user_label,
 source, {A} AS created_at
 FROM (SELECT *, CASE WHEN {O.has('TRASH')} THEN 'bootstrap_trash' WHEN {O.has('SPAM')} THEN 'bootstrap_spam'
  WHEN NOT {O.has('INBOX')} THEN 'bootstrap_archived' ELSE 'bootstrap_inbox' END AS source
  FROM raw_emails WHERE {O.newer_than(365)}))"""


@query("insert_if_absent_feedback", sql=fx.oracle_with("raw_emails", "feedback") + f""", {BOOT_SQL}
SELECT email_id, user_label, source, created_at FROM feedback UNION ALL
SELECT email_id, user_label, source, created_at FROM boot
WHERE user_label IS NOT NULL AND email_id NOT IN (SELECT email_id FROM feedback)""")
def q_insert_if_absent_feedback(spark, sf):
    b = _bootstrap_feedback(spark, sf)
    return K.insert_if_absent(fx.feedback(spark, sf), b, F.col("rank"), key="email_id")


def _observed(spark, sf):
    e = fx.raw_emails(spark, sf)
    return (e.select(F.col("id").alias("email_id"), L.label_state("labels").alias("user_label"),
                     F.lit("daily_observation").alias("source"), S.as_of_ntz(AS_OF).alias("created_at"))
            .filter(F.col("user_label").isNotNull()))


OBS_SQL = f"""obs AS (SELECT id AS email_id, CASE WHEN {O.has('TRASH')} OR {O.has('SPAM')} THEN 'spam'
 WHEN NOT {O.has('INBOX')} THEN 'keep' WHEN NOT {O.has('UNREAD')} THEN 'keep' END AS user_label,
 'daily_observation' AS source, {A} AS created_at FROM raw_emails)"""


def _k5_sql(protect: bool):
    guard = ("AND NOT (o.email_id IN (SELECT email_id FROM feedback WHERE source IN ('user_restore', 'user_confirm')))"
             if protect else "")
    return fx.oracle_with("raw_emails", "feedback") + f""", {OBS_SQL},
ch AS (SELECT * FROM obs o WHERE user_label IS NOT NULL {guard}),
u AS (SELECT email_id, user_label, source, created_at, 0 AS b FROM feedback
      UNION ALL SELECT email_id, user_label, source, created_at, 1 AS b FROM ch)
SELECT email_id, arg_max(user_label, (created_at, b)) AS user_label, arg_max(source, (created_at, b)) AS source,
 max(created_at) AS created_at FROM u GROUP BY email_id"""


@query("upsert_feedback_latest", sql=_k5_sql(True))
def q_upsert_feedback_latest(spark, sf):
    return K.upsert_feedback_latest(fx.feedback(spark, sf), _observed(spark, sf), protect_human=True)


@query("upsert_feedback_latest_legacy", sql=_k5_sql(False))
def q_upsert_feedback_latest_legacy(spark, sf):
    """K5 as coded in the reference: passive observation overwrites human labels (Q12)."""
    return K.upsert_feedback_latest(fx.feedback(spark, sf), _observed(spark, sf), protect_human=False)


QUEUE_SQL = f"""q AS (SELECT f.email_id AS id, f.user_label FROM feedback f JOIN raw_emails r ON r.id = f.email_id
 WHERE f.source LIKE 'auto_clean:%' AND f.created_at > {A} - INTERVAL 7 DAY
)"""


def _queue(spark, sf):
    return RV.review_queue(fx.feedback(spark, sf), fx.raw_emails(spark, sf), AS_OF)


@query("restore_feedback", sql=fx.oracle_with("raw_emails", "feedback") + f""", {QUEUE_SQL}
SELECT email_id, CASE WHEN email_id IN (SELECT id FROM q) THEN 'keep' ELSE user_label END AS user_label,
 CASE WHEN email_id IN (SELECT id FROM q) THEN 'user_restore' ELSE source END AS source,
 CASE WHEN email_id IN (SELECT id FROM q) THEN {A} ELSE created_at END AS created_at,
 email_id IN (SELECT id FROM q) AS restored FROM feedback""")
def q_restore_feedback(spark, sf):
    ids = _queue(spark, sf).select(F.col("id").alias("email_id"))
    return K.restore_feedback(fx.feedback(spark, sf), ids, AS_OF)


@query("confirm_feedback", sql=fx.oracle_with("raw_emails", "feedback") + f""", {QUEUE_SQL}
SELECT email_id, CASE WHEN email_id IN (SELECT id FROM q WHERE user_label = 'spam') THEN 'spam' ELSE user_label END AS user_label,
 CASE WHEN email_id IN (SELECT id FROM q WHERE user_label = 'spam') THEN 'user_confirm' ELSE source END AS source,
 CASE WHEN email_id IN (SELECT id FROM q WHERE user_label = 'spam') THEN {A} ELSE created_at END AS created_at FROM feedback""")
def q_confirm_feedback(spark, sf):
    ids = _queue(spark, sf).filter(F.col("user_label") == "spam").select(F.col("id").alias("email_id"))
    return K.confirm_feedback(fx.feedback(spark, sf), ids, AS_OF)


@query("restore_full", sql=fx.oracle_with("raw_emails", "feedback") + f""", {QUEUE_SQL}
SELECT r.id, list_sort(list_distinct(list_filter(r.labels, lambda x: x <> 'TRASH') || ['INBOX'])) AS labels,
 'restore' AS action, 'keep' AS user_label FROM raw_emails r WHERE r.id IN (SELECT id FROM q)""")
def q_restore_full(spark, sf):
    ids = _queue(spark, sf).select(F.col("id").alias("email_id"))
    fb, moved, audit = K.restore_full(fx.raw_emails(spark, sf), fx.feedback(spark, sf), ids, AS_OF)
    j = moved.join(audit.select(F.col("email_id").alias("id"), "action"), "id").join(
        fb.select(F.col("email_id").alias("id"), "user_label"), "id")
    return j.select("id", F.array_sort("labels").alias("labels"), "action", "user_label")


@query("apply_label_changes", sql=O.with_routed() + """
SELECT id, list_sort(list_distinct(list_filter(labels, lambda x: x <> 'INBOX') || ['TRASH'])) AS labels
FROM routed WHERE route IN ('deletable', 'grace_expired', 'ml')""")
def q_apply_label_changes(spark, sf):
    r = T.triage(fx.raw_emails(spark, sf), AS_OF).filter(F.col("route").isin(*T.TRASH_ROUTES))
    return r.select("id", F.array_sort(K.apply_label_changes(F.col("labels"), *K.LABEL_ACTIONS["trash"])).alias("labels"))


@query("action_outbox")
def q_action_outbox(spark, sf):
    """Trash requests for the triaged mail, in groups of at most 1,000 ids (rows-only check)."""
    r = T.triage(fx.raw_emails(spark, sf), AS_OF).filter(F.col("route").isin(*T.TRASH_ROUTES))
    return K.action_outbox(r.select("id"))


ROUTED = O.with_routed()


@query("append_decisions", sql=fx.oracle_with("decisions").rstrip() + ",\n" + O.routed_sql().strip().replace(
    "FROM raw_emails", "FROM (" + fx.ORACLE_VIEWS["raw_emails"][0].strip() + ") raw_emails", 1) + f""",
nd AS (SELECT id AS email_id, CASE WHEN route IN ('deletable', 'grace_expired', 'ml') THEN 'spam'
  WHEN route IN ('protected', 'ml_below') THEN 'keep' ELSE 'uncertain' END AS decision,
  CASE WHEN route = 'unmatched' THEN 0.0 ELSE 1.0 END AS confidence, 'rules:web' AS model_version, {A} AS decided_at,
  route IN ('deletable', 'grace_expired', 'ml') AS executed FROM routed)
SELECT email_id, decision, confidence, model_version, executed, decided_at FROM decisions UNION ALL
SELECT email_id, decision, confidence, model_version, executed, decided_at FROM nd""")
def q_append_decisions(spark, sf):
    new = K.decisions_from_triage(T.triage(fx.raw_emails(spark, sf), AS_OF), "web", AS_OF)
    cur = fx.decisions(spark, sf)
    return K.append_decisions(cur, new.select(*cur.columns))


@query("append_audit", sql=ROUTED + f"""
SELECT sha256(id || '|auto_trash|' || CAST({A} AS VARCHAR)) AS id, id AS email_id, 'auto_trash' AS action,
 {A} AS performed_at, json_object('route', route, 'rule_id', rule_id)::VARCHAR AS metadata
FROM routed WHERE route IN ('deletable', 'grace_expired', 'ml')""")
def q_append_audit(spark, sf):
    return K.audit_from_actions(T.actions(T.triage(fx.raw_emails(spark, sf), AS_OF)), AS_OF)


@query("run_log", sql=ROUTED + f"""
SELECT {A} AS run_at, 'OK' AS status, count(*) AS scanned,
 count(*) FILTER (WHERE route IN ('deletable', 'grace_expired', 'ml')) AS trashed, count(*) FILTER (WHERE route = 'deletable') AS rules,
 0::BIGINT AS ml, count(*) FILTER (WHERE route = 'grace_expired') AS grace, count(*) FILTER (WHERE route = 'protected') AS protected,
 0::BIGINT AS ml_below, NULL::VARCHAR AS error FROM routed""")
def q_run_log(spark, sf):
    return K.run_log_row(T.triage_summary(T.triage(fx.raw_emails(spark, sf), AS_OF)), AS_OF)


# --- checks -------------------------------------------------------------------
@query("check_primary_key", sql=fx.oracle_with("raw_emails_dirty") + """
SELECT id, count(*) AS n FROM raw_emails_dirty GROUP BY id HAVING count(*) > 1""")
def q_check_primary_key(spark, sf):
    return K.check_primary_key(fx.raw_emails_dirty(spark, sf), ["id"])


@query("check_not_null", sql=fx.oracle_with("raw_emails_dirty") + """
SELECT id, list_filter([CASE WHEN sender IS NULL THEN 'sender' END, CASE WHEN sender_domain IS NULL THEN 'sender_domain' END,
 CASE WHEN received_at IS NULL THEN 'received_at' END], lambda x: x IS NOT NULL) AS null_columns
FROM raw_emails_dirty WHERE sender IS NULL OR sender_domain IS NULL OR received_at IS NULL""")
def q_check_not_null(spark, sf):
    return K.check_not_null(fx.raw_emails_dirty(spark, sf), ["sender", "sender_domain", "received_at"]).select(
        "id", "null_columns")


@query("check_enum", sql=fx.oracle_with("raw_emails") + f""", {OBS_SQL}
SELECT email_id, final_state FROM (SELECT email_id, CASE user_label WHEN 'spam' THEN 'deleted' ELSE user_label END AS final_state FROM obs)
WHERE final_state NOT IN ('deleted', 'read_kept', 'unread_kept', 'archived', 'starred', 'spam_folder')""")
def q_check_enum(spark, sf):
    o = _observed(spark, sf).select("email_id", F.when(F.col("user_label") == "spam", "deleted")
                                    .otherwise(F.col("user_label")).alias("final_state"))
    return K.check_enum(o, "final_state", K.ENUMS["final_state"])


@query("check_range", sql=fx.oracle_with("decisions") + """
SELECT email_id, confidence * 1.5 - 0.25 AS confidence FROM decisions
WHERE NOT (confidence * 1.5 - 0.25 BETWEEN 0 AND 1)""")
def q_check_range(spark, sf):
    d = fx.decisions(spark, sf).select("email_id", (F.col("confidence") * 1.5 - 0.25).alias("confidence"))
    return K.check_range(d, "confidence", 0.0, 1.0)


@query("apply_defaults", sql=fx.oracle_with("raw_emails_dirty") + f"""
SELECT id, coalesce(received_at, {A}) AS received_at, coalesce(subject, '') AS subject, {A} AS fetched_at
FROM raw_emails_dirty""")
def q_apply_defaults(spark, sf):
    d = fx.raw_emails_dirty(spark, sf).select("id", "received_at", "subject",
                                              F.lit(None).cast("timestamp_ntz").alias("fetched_at"))
    now = S.as_of_ntz(AS_OF)
    return K.apply_defaults(d, {"received_at": now, "subject": F.lit(""), "fetched_at": now})


@query("fk_orphans", sql=fx.oracle_with("raw_emails", "feedback", "decisions", "audit_log") + """
SELECT 'feedback' AS child, email_id FROM feedback WHERE email_id NOT IN (SELECT id FROM raw_emails)
UNION ALL SELECT 'decisions', email_id FROM decisions WHERE email_id NOT IN (SELECT id FROM raw_emails)
UNION ALL SELECT 'audit_log', email_id FROM audit_log WHERE email_id NOT IN (SELECT id FROM raw_emails)""")
def q_fk_orphans(spark, sf):
    parent = fx.raw_emails(spark, sf)
    out = None
    for name, child in [("feedback", fx.feedback(spark, sf)), ("decisions", fx.decisions(spark, sf)),
                        ("audit_log", fx.audit_log(spark, sf))]:
        o = K.fk_orphans(child.select("email_id"), parent).select(F.lit(name).alias("child"), "email_id")
        out = o if out is None else out.unionByName(o)
    return out


@query("cascade_delete", sql=fx.oracle_with("decisions", "feedback") + f""",
gone AS (SELECT email_id FROM decisions d WHERE decision = 'spam' AND executed AND decided_at < {A} - INTERVAL 30 DAY
 AND NOT EXISTS (SELECT 1 FROM feedback f WHERE f.email_id = d.email_id AND f.source = 'user_restore'))
SELECT email_id, decision, model_version FROM decisions WHERE email_id NOT IN (SELECT email_id FROM gone)""")
def q_cascade_delete(spark, sf):
    gone = L.purge_candidates(fx.decisions(spark, sf), fx.feedback(spark, sf), AS_OF).select("email_id")
    return K.cascade_delete(fx.decisions(spark, sf), gone).select("email_id", "decision", "model_version")
