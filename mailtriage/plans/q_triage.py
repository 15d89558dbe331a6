"""Registered queries: triage and its reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.rules import apply_rules
from ..session import AS_OF
from ..sources import fixtures as fx
from ..sources.scans import scan_inbox_window
from . import oracle_sql as O
from . import triage as T
from .registry import query

W = O.with_routed()


def routed(spark, sf):
    return T.triage(fx.raw_emails(spark, sf), AS_OF)


@query("scan_inbox_window", sql=fx.oracle_with("raw_emails") + f"""
SELECT id, sender_domain, received_at FROM raw_emails WHERE {O.has('INBOX')} AND {O.newer_than(30)}""")
def q_scan_inbox_window(spark, sf):
    return scan_inbox_window(fx.raw_emails(spark, sf), AS_OF).select("id", "sender_domain", "received_at")


@query("apply_rules", bench=True, sql=fx.oracle_with("raw_emails") + f"""
, n AS (SELECT id, {O.norm_sender()} AS s, {O.norm_domain()} AS d, {O.norm_subject()} AS t FROM raw_emails)
SELECT id, {O.first_hit_case('decision')} AS decision, {O.first_hit_case('rule_id')} AS rule_id,
       {O.first_hit_case('reason')} AS reason FROM n""")
def q_apply_rules(spark, sf):
    e = apply_rules(fx.raw_emails(spark, sf))
    return e.select("id", "hit.decision", "hit.rule_id", "hit.reason")


@query("triage_rules_only", bench=True, sql=W + """
SELECT id, route, rule_id, decision, age_days FROM routed""")
def q_triage_rules_only(spark, sf):
    return routed(spark, sf).select("id", "route", "rule_id", "decision", "age_days")


@query("triage_summary", bench=True, sql=W + """
SELECT count(*) AS scanned, count(*) FILTER (WHERE route = 'deletable') AS deletable_rules, 0::BIGINT AS deletable_ml,
 count(*) FILTER (WHERE route = 'grace_expired') AS grace_expired, 0::BIGINT AS ml_below_threshold,
 count(*) FILTER (WHERE route = 'protected') AS protected_by_rule, count(*) FILTER (WHERE route = 'unmatched') AS unmatched_no_model
FROM routed""")
def q_triage_summary(spark, sf):
    return T.triage_summary(routed(spark, sf))


@query("rule_hit_counts", sql=W + """
SELECT CASE route WHEN 'deletable' THEN 'DEL:' ELSE 'GRACE:' END || rule_id AS hit, count(*) AS n
FROM routed WHERE route IN ('deletable', 'grace_expired') GROUP BY 1""")
def q_rule_hit_counts(spark, sf):
    return T.rule_hit_counts(routed(spark, sf))


@query("route_samples", sql=W + """
SELECT * FROM (SELECT route, id, rule_id, age_days, substring(coalesce(subject, ''), 1, 70) AS subject,
  row_number() OVER (PARTITION BY route ORDER BY received_at DESC, id) AS rn FROM routed) WHERE rn <= 5""")
def q_route_samples(spark, sf):
    return T.route_samples(routed(spark, sf)).drop("p_spam")


@query("grace_predicate", sql=fx.oracle_with("raw_emails") + f"""
SELECT id, {O.has('UNREAD')} AND {O.age_days()} < 7 AS in_grace FROM raw_emails""")
def q_grace_predicate(spark, sf):
    e = fx.raw_emails(spark, sf)
    return e.select("id", S.in_grace_period(F.col("received_at"), S.is_unread("labels"), AS_OF).alias("in_grace"))


@query("grace_routing", sql=W + """
SELECT id, route, age_days, is_unread FROM routed WHERE decision = 'keep'""")
def q_grace_routing(spark, sf):
    return routed(spark, sf).filter(F.col("decision") == "keep").select("id", "route", "age_days", "is_unread")


@query("union_actions", sql=W + """
SELECT id, route, rule_id, CASE route WHEN 'deletable' THEN 0 WHEN 'grace_expired' THEN 1 ELSE 2 END AS list_no,
 route AS action, 'auto_clean:' || route || ':' || rule_id AS source
FROM routed WHERE route IN ('deletable', 'grace_expired', 'ml')""")
def q_union_actions(spark, sf):
    return T.actions(routed(spark, sf)).drop("p_spam")


@query("decision_to_mail", sql=W + """
SELECT a.id, a.route, a.rule_id, r.sender, r.sender_domain, r.subject, r.received_at
FROM routed a JOIN raw_emails r ON r.id = a.id WHERE a.route IN ('deletable', 'grace_expired', 'ml')""")
def q_decision_to_mail(spark, sf):
    e = fx.raw_emails(spark, sf)
    j = T.decision_to_mail(T.actions(routed(spark, sf)), e)
    return j.select("id", "route", "rule_id", "sender", "sender_domain", "subject", "received_at")
