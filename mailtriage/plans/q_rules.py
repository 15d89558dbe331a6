"""Registered queries: rules, packs and labeling."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.packs import LABEL_OUTCOMES
from ..functions.regex import sql_str
from ..operators import labeling as L
from ..operators import rules as R
from ..session import AS_OF
from ..sources import fixtures as fx
from ..sources import scans as SC
from . import oracle_sql as O
from .registry import query

RE = fx.oracle_with("raw_emails")
N = RE + f""", n AS (SELECT id, {O.norm_sender()} AS s, {O.norm_domain()} AS d, {O.norm_subject()} AS t FROM raw_emails)
"""


def emails(spark, sf):
    return fx.raw_emails(spark, sf)


def _layer_query(layer):
    def q(spark, sf):
        h = R.apply_rules(emails(spark, sf), layers=(layer,))
        return h.filter(F.col("hit").isNotNull()).select("id", F.col("hit.rule_id").alias("rule_id"))
    q.__doc__ = f"First rule of layer {layer} that fires."
    return q


def _layer_sql(layer):
    return N + f"SELECT * FROM (SELECT id, {O.first_hit_case('rule_id', layers=(layer,))} AS rule_id FROM n) WHERE rule_id IS NOT NULL"


for _key, _layer in [("rule_keep_combo", "combo"), ("rule_keep_domain", "keep_domain"),
                     ("rule_keep_subject", "keep_subject"), ("rule_deletable_domain", "deletable_domain")]:
    query(_key, sql=_layer_sql(_layer))(_layer_query(_layer))


@query("apply_rules_table", sql=N + f"""
SELECT id, {O.first_hit_case('decision')} AS decision, {O.first_hit_case('rule_id')} AS rule_id,
       {O.first_hit_case('reason')} AS reason FROM n""")
def q_apply_rules_table(spark, sf):
    """R5 as a broadcast nested-loop join against the rule table (the large-rule-table path)."""
    hits = R.first_hit_table(emails(spark, sf).select("id", "sender", "sender_domain", "subject"),
                             R.rule_table(spark))
    return hits.select("id", "hit.decision", "hit.rule_id", "hit.reason")


@query("apply_rules_index", sql=N + f"""
SELECT id, {O.first_hit_case('decision')} AS decision, {O.first_hit_case('rule_id')} AS rule_id,
       {O.first_hit_case('reason')} AS reason FROM n""")
def q_apply_rules_index(spark, sf):
    """R5 by an index over the patterns' required pieces: regexes run on candidates only."""
    hits = R.first_hit_index(emails(spark, sf).select("id", "sender", "sender_domain", "subject"), R.rule_table(spark))
    return hits.select("id", "hit.decision", "hit.rule_id", "hit.reason")


@query("rule_packs", sql=N + f"""
SELECT id, {O.first_hit_case('rule_id', 'web')} AS rule_web, {O.first_hit_case('rule_id', 'api')} AS rule_api,
 {O.first_hit_case('rule_id', 'packages')} AS rule_packages FROM n""")
def q_rule_packs(spark, sf):
    e = emails(spark, sf).select("id", "sender", "sender_domain", "subject")
    for pack in ("web", "api", "packages"):
        e = R.apply_rules(e, pack, out=f"_h_{pack}")
    return e.select("id", F.col("_h_web.rule_id").alias("rule_web"), F.col("_h_api.rule_id").alias("rule_api"),
                    F.col("_h_packages.rule_id").alias("rule_packages"))


@query("rule_match_all", sql=N + ", a AS (" + O.all_hits_values() + ") SELECT * FROM a")
def q_rule_match_all(spark, sf):
    h = R.all_hits(emails(spark, sf).select("id", "sender", "sender_domain", "subject"))
    return h.select("id", F.inline("hits")).select("id", "layer", "layer_no", "ord", "decision", "rule_id")


TX = ("combo", "keep_domain", "keep_subject")
NRAW = RE + """, n AS (SELECT id, coalesce(sender, '') AS s, coalesce(sender_domain, '') AS d,
 coalesce(subject, '') AS t FROM raw_emails)
"""


@query("transactional_rule", sql=NRAW + f"SELECT id, {O.first_hit_case('rule_id', layers=TX)} AS tx_rule FROM n")
def q_transactional_rule(spark, sf):
    return R.transactional_rules(emails(spark, sf)).select("id", "tx_rule")


@query("read_later_domains", sql=NRAW + f"SELECT id, {O.read_later_sql('s', 'd')} AS read_later FROM n")
def q_read_later_domains(spark, sf):
    e = emails(spark, sf)
    return e.select("id", R.read_later(F.col("sender"), F.col("sender_domain")).alias("read_later"))


def _outcome_sql(key, rule="tx"):
    cls, train, target, reason = LABEL_OUTCOMES[key]
    if "{rule}" in reason:
        pre, post = reason.split("{rule}")
        reason_sql = f"{sql_str(pre)} || {rule} || {sql_str(post)}"
    else:
        reason_sql = sql_str(reason)
    return (sql_str(cls), "true" if train else "false", sql_str(target) if target else "NULL", reason_sql)


def _derive_label_sql():
    order = ["tx_in_trash", "tx", "read_later_in_trash", "read_later", "spam", "default_keep"]
    conds = ["tx IS NOT NULL AND tr", "tx IS NOT NULL", "later AND tr", "later",
             "user_label = 'spam' OR (tr AND NOT inb)", "true"]
    cols = []
    for i, name in enumerate(["cls", "include_in_training", "train_target", "reason"]):
        whens = " ".join(f"WHEN {c} THEN {_outcome_sql(k)[i]}" for c, k in zip(conds, order))
        cols.append(f"CASE {whens} END AS {name}")
    return fx.oracle_with("raw_emails", "feedback") + f""",
n AS (SELECT r.id, coalesce(r.sender, '') AS s, coalesce(r.sender_domain, '') AS d, coalesce(r.subject, '') AS t,
  list_distinct(list_transform(coalesce(r.labels, []::VARCHAR[]), lambda x: upper(x))) AS lab, f.user_label, f.source
  FROM raw_emails r LEFT JOIN feedback f ON f.email_id = r.id),
x AS (SELECT *, {O.first_hit_case('rule_id', layers=TX)} AS tx, {O.read_later_sql('s', 'd')} AS later,
  list_contains(lab, 'TRASH') AS tr, list_contains(lab, 'INBOX') AS inb FROM n),
lab AS (SELECT id, user_label, source, tx AS tx_rule, {", ".join(cols)} FROM x)
"""


def _labeled(spark, sf):
    e = emails(spark, sf)
    f = fx.feedback(spark, sf).select(F.col("email_id").alias("id"), "user_label", "source")
    return L.derive_label(e.join(f, "id", "left"))


@query("derive_label", sql=_derive_label_sql() + """
SELECT id, tx_rule, cls, include_in_training, train_target, reason FROM lab""")
def q_derive_label(spark, sf):
    d = R.transactional_rules(_labeled(spark, sf), out="tx_rule")
    return d.select("id", "tx_rule", "label.cls", "label.include_in_training", "label.train_target", "label.reason")


@query("training_eligible", sql=_derive_label_sql() + """
SELECT id, user_label, source, cls FROM lab
WHERE (source IN ('user_restore', 'user_confirm') OR starts_with(source, 'bootstrap_')) AND include_in_training""")
def q_training_eligible(spark, sf):
    d = _labeled(spark, sf)
    return (d.filter(L.training_eligible(F.col("source"), F.col("label")))
            .select("id", "user_label", "source", F.col("label.cls").alias("cls")))


@query("class_taxonomy", sql=_derive_label_sql() + """
SELECT id, cls, CASE cls WHEN 'archival_after_handled' THEN 'handled_done' WHEN 'transactional_keep' THEN 'keep_critical'
 ELSE cls END AS cls_doc FROM lab""")
def q_class_taxonomy(spark, sf):
    d = _labeled(spark, sf)
    return d.select("id", F.col("label.cls").alias("cls"), L.documented_class(F.col("label.cls")).alias("cls_doc"))


@query("label_state", sql=RE + f"""
SELECT id, CASE WHEN {O.has('TRASH')} OR {O.has('SPAM')} THEN 'spam' WHEN NOT {O.has('INBOX')} THEN 'keep'
 WHEN NOT {O.has('UNREAD')} THEN 'keep' END AS state FROM raw_emails""")
def q_label_state(spark, sf):
    return emails(spark, sf).select("id", L.label_state("labels").alias("state"))


_INBOX_AGE = f"CASE WHEN received_at IS NOT NULL AND NOT {O.has('UNREAD')} AND {O.age_days()} > 30 THEN 'keep' END"


@query("inbox_age_label", sql=RE + f"SELECT id, {_INBOX_AGE} AS label FROM raw_emails WHERE {O.has('INBOX')}")
def q_inbox_age_label(spark, sf):
    e = emails(spark, sf).filter(S.has_label("labels", "INBOX"))
    return e.select("id", L.inbox_age_label(F.col("received_at"), "labels", AS_OF).alias("label"))


@query("bootstrap_label", sql=RE + f"""
SELECT id, source, CASE WHEN source IN ('bootstrap_trash', 'bootstrap_spam') THEN 'spam'
 WHEN source = 'bootstrap_archived' THEN 'keep' ELSE {_INBOX_AGE} END AS label
FROM (SELECT *, CASE WHEN {O.has('TRASH')} THEN 'bootstrap_trash' WHEN {O.has('SPAM')} THEN 'bootstrap_spam'
 WHEN NOT {O.has('INBOX')} THEN 'bootstrap_archived' ELSE 'bootstrap_inbox' END AS source
 FROM raw_emails WHERE {O.newer_than(365)})""")
def q_bootstrap_label(spark, sf):
    e = SC.scan_bootstrap_sources(emails(spark, sf), AS_OF)
    return e.select("id", "source", L.bootstrap_label(F.col("source"), F.col("received_at"), "labels", AS_OF).alias("label"))


@query("observe_final_state", sql=RE + f"""
SELECT id, CASE WHEN {O.has('SPAM')} THEN 'spam_folder' WHEN {O.has('TRASH')} THEN 'deleted'
 WHEN {O.has('STARRED')} THEN 'starred' WHEN NOT {O.has('INBOX')} THEN 'archived'
 WHEN {O.has('UNREAD')} THEN 'unread_kept' ELSE 'read_kept' END AS final_state FROM raw_emails""")
def q_observe_final_state(spark, sf):
    return emails(spark, sf).select("id", L.observe_final_state("labels").alias("final_state"))


@query("purge_candidates", sql=fx.oracle_with("decisions", "feedback") + f"""
SELECT email_id, decided_at FROM decisions d
WHERE decision = 'spam' AND executed AND decided_at < {O.AS_OF} - INTERVAL 30 DAY
 AND NOT EXISTS (SELECT 1 FROM feedback f WHERE f.email_id = d.email_id AND f.source = 'user_restore')""")
def q_purge_candidates(spark, sf):
    p = L.purge_candidates(fx.decisions(spark, sf), fx.feedback(spark, sf), AS_OF)
    return p.select("email_id", "decided_at")


@query("uncertain_band", sql=fx.oracle_with("decisions") + """
SELECT email_id, confidence FROM decisions WHERE confidence > 0.3 AND confidence < 0.7""")
def q_uncertain_band(spark, sf):
    from ..operators.model import uncertain_band
    return uncertain_band(fx.decisions(spark, sf), "confidence").select("email_id", "confidence")


@query("auto_action_filter", sql=fx.oracle_with("feedback") + """
SELECT email_id, source FROM feedback WHERE source LIKE 'auto_clean:%'""")
def q_auto_action_filter(spark, sf):
    from ..operators.review import auto_action
    return fx.feedback(spark, sf).filter(auto_action(F.col("source"))).select("email_id", "source")


@query("recent_filter", sql=fx.oracle_with("feedback") + f"""
SELECT email_id, created_at, created_at > {O.AS_OF} - INTERVAL 24 HOUR AS in_24h FROM feedback
WHERE created_at > {O.AS_OF} - INTERVAL 7 DAY""")
def q_recent_filter(spark, sf):
    from ..operators.review import recent
    f = fx.feedback(spark, sf)
    return f.filter(recent(F.col("created_at"), "7 days", AS_OF)).select(
        "email_id", "created_at", recent(F.col("created_at"), "24 hours", AS_OF).alias("in_24h"))


# --- options of SURVEY 2.11 -----------------------------------------------------
@query("apply_rules_address", sql=fx.oracle_with("raw_emails") + f"""
, f AS (SELECT id, {O.norm_sender()} AS f, {O.norm_domain()} AS d, {O.norm_subject()} AS t FROM raw_emails),
n AS (SELECT id, CASE WHEN contains(f, '<') AND contains(f, '>') THEN regexp_extract(f, '<([^>]*)', 1) ELSE f END AS s, d, t FROM f)
SELECT id, {O.first_hit_case('decision')} AS decision, {O.first_hit_case('rule_id')} AS rule_id FROM n""")
def q_apply_rules_address(spark, sf):
    """Q2: sender rules on the address instead of the From text."""
    return R.apply_rules(emails(spark, sf), match_on="address").select("id", "hit.decision", "hit.rule_id")


@query("derive_label_fixed", sql=_derive_label_sql() + """
SELECT id, cls, CASE WHEN train_target = 'keep' THEN 'transactional_keep' ELSE cls END AS cls_fixed FROM lab""")
def q_derive_label_fixed(spark, sf):
    """Q7: the coded class and the class that fits the target."""
    return _labeled(spark, sf).select("id", "label.cls", "label.cls_fixed")


@query("scan_recent_places", sql=fx.oracle_with("raw_emails") + f"""
SELECT id, received_at FROM raw_emails WHERE {O.newer_than(30)} AND NOT {O.has('TRASH')} AND NOT {O.has('SPAM')}""")
def q_scan_recent_places(spark, sf):
    """Q27: recent mail without trash and spam."""
    from ..sources.scans import scan_recent
    return scan_recent(emails(spark, sf), AS_OF, 30, exclude_trash_spam=True).select("id", "received_at")


@query("build_features_feedback_clock", sql=fx.oracle_with("raw_emails", "feedback") + f"""
SELECT r.id, coalesce(greatest(CAST(floor((epoch_us(coalesce(f.created_at, {O.AS_OF})) - epoch_us(r.received_at)) / 86400000000.0) AS BIGINT), 0), 0) AS age_days
FROM raw_emails r JOIN feedback f ON f.email_id = r.id""")
def q_build_features_feedback_clock(spark, sf):
    """Q20: a training mail's age at the time of its feedback."""
    from ..operators.features import build_features
    f = fx.feedback(spark, sf).select(F.col("email_id").alias("id"), F.col("created_at").alias("labeled_at"))
    return build_features(emails(spark, sf).join(f, "id"), AS_OF, clock="labeled_at").select("id", "age_days")
