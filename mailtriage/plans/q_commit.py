"""Registered queries: the commit protocol (T3 dry run and rules-only commit, Q10's split, Q17's counts)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commit as C
from ..session import AS_OF
from ..sources import fixtures as fx
from ..streaming.stream import scratch
from . import oracle_sql as O
from .registry import query

ROUTED = O.with_routed(views=("raw_emails", "decisions", "feedback"))
ACTED = "(SELECT * FROM routed WHERE route IN ('deletable', 'grace_expired', 'ml'))"


@query("triage_dry_run", sql=O.with_routed() + f"""
SELECT id, route, rule_id, route AS action, 'auto_clean:' || route || ':' || rule_id AS source,
 CASE route WHEN 'deletable' THEN 0 ELSE 1 END AS list_no, sender, subject, received_at, age_days FROM {ACTED}""")
def q_triage_dry_run(spark, sf):
    """T3 dry run: the plan of what would be trashed; nothing is written to the store."""
    store = C.Store(spark, scratch(spark, "store"))
    plan = C.triage_commit(store, fx.raw_emails(spark, sf), "dry", AS_OF, dry_run=True)
    return plan.select("id", "route", "rule_id", "action", "source", "list_no", "sender", "subject", "received_at", "age_days")


def _seeded(spark, sf) -> C.Store:
    """A store whose first version holds the fixture's decisions and feedback and the mail older than ten days."""
    store = C.Store(spark, scratch(spark, "store"))
    cut = F.lit("2024-01-22 00:00:00").cast("timestamp_ntz")
    d = fx.decisions(spark, sf).withColumns({"used_llm": F.lit(False), "llm_reasoning": F.lit(None).cast("string")})
    seed = {"decisions": d.select("email_id", "decision", "confidence", "model_version", "used_llm", "llm_reasoning", "decided_at", "executed"),
            "feedback": fx.feedback(spark, sf).select("email_id", "user_label", "source", "created_at"),
            "raw_emails": fx.raw_emails(spark, sf).where(F.col("received_at") < cut)}
    store.switch(0, {n: store.write(n, t) for n, t in seed.items()}, "seed")
    return store


@query("triage_commit_rules", sql=ROUTED + f""",
acted AS (SELECT * FROM {ACTED}), old AS (SELECT id FROM raw_emails WHERE received_at < TIMESTAMP '2024-01-22 00:00:00')
SELECT 'decisions' AS "table", (SELECT count(*) FROM decisions) + (SELECT count(*) FROM routed) AS rows
UNION ALL SELECT 'audit_log', count(*) FROM acted
UNION ALL SELECT 'raw_emails', count(*) FROM (SELECT id FROM old UNION SELECT id FROM acted)
UNION ALL SELECT 'feedback', count(*) FROM (SELECT email_id FROM feedback UNION SELECT id FROM acted)
UNION ALL SELECT 'label_changes', count(*) FROM acted
UNION ALL SELECT 'plan', count(*) FROM routed
UNION ALL SELECT 'quarantine', count(*) FROM raw_emails WHERE id IS NULL OR thread_id IS NULL OR sender IS NULL OR sender_domain IS NULL OR received_at IS NULL
UNION ALL SELECT 'outbox_ids', count(*) FROM acted""")
def q_triage_commit_rules(spark, sf):
    """T3 live: the rules' decisions committed to a seeded store; rows of each table after it."""
    store = _seeded(spark, sf)
    rows = C.triage_commit(store, fx.raw_emails(spark, sf), "run-1", AS_OF)
    ids = store.current("outbox").agg(F.coalesce(F.sum("n_ids"), F.lit(0)).alias("rows")).select(F.lit("outbox_ids").alias("table"), "rows")
    return rows.where("table <> 'outbox'").unionByName(ids)


@query("quarantine", sql=fx.oracle_with("raw_emails_dirty") + """
SELECT id, list_filter([CASE WHEN sender IS NULL THEN 'sender' END, CASE WHEN sender_domain IS NULL THEN 'sender_domain' END,
 CASE WHEN received_at IS NULL THEN 'received_at' END], lambda x: x IS NOT NULL) AS null_columns FROM raw_emails_dirty""")
def q_quarantine(spark, sf):
    """Q10 / V2: valid and offending rows of one pass, both sides together."""
    good, bad = C.split_not_null(fx.raw_emails_dirty(spark, sf), ("sender", "sender_domain", "received_at"), scratch(spark, "split"))
    return good.select("id", F.array().cast("array<string>").alias("null_columns")).unionByName(bad.select("id", "null_columns"))


@query("scanned_counts", sql=fx.oracle_with("raw_emails", "decisions") + f"""
SELECT count(DISTINCT d.email_id) AS listed, count(DISTINCT r.id) AS fetched
FROM decisions d LEFT JOIN (SELECT id FROM raw_emails WHERE {O.has('INBOX')}) r ON r.id = d.email_id""")
def q_scanned_counts(spark, sf):
    """Q17: ids a scan listed, and those still in the inbox when fetched."""
    from ..functions import scalars as S
    inbox = fx.raw_emails(spark, sf).where(S.has_label("labels", "INBOX"))
    return C.scanned_counts(fx.decisions(spark, sf).select(F.col("email_id").alias("id")), inbox)
