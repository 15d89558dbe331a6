"""Rule and scalar edge cases (FIXTURES.md hand-made rows, SURVEY Q2-Q5)."""
from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mailtriage.functions import scalars as S
from mailtriage.operators.rules import all_hits, apply_rules, read_later, transactional_rules
from mailtriage.plans import triage as T

AS_OF = dt.datetime(2024, 2, 1)
SCHEMA = "id string, sender string, sender_domain string, subject string"


def first_rule(spark, sender, domain, subject, pack="web"):
    df = spark.createDataFrame([("1", sender, domain, subject)], SCHEMA)
    return apply_rules(df, pack).select("hit.rule_id").first()[0]


@pytest.mark.parametrize("subject,rule", [
    ("TWOJE ZAMÓWIENIE nr 5", "kw_order"),
    ("KUPIŁEŚ i ZAPŁACIŁEŚ", "kw_allegro_purchase"),
    ("Faktura VAT 1/2024", "kw_invoice_subject"),
    ("Security alert: new login", "kw_security_alert"),
    ("Failed production deployment", "kw_deploy_fail"),
    ("Termin płatności mija", "kw_payment_due"),
    ("Walne Zgromadzenie", "kw_shareholders_meeting"),
    ("pismo urząd skarbowy", "kw_gov_official"),
    ("decyzj urząd", "kw_gov_official"),       # Q4: the stem must end at a word boundary
    ("sitemap could not be read", "kw_search_console"),
])
def test_keep_subject_hits(spark, subject, rule):
    assert first_rule(spark, "a@x.example.com", "x.example.com", subject) == rule


@pytest.mark.parametrize("subject", ["żfaktur", "łorder", "decyzja urząd", "hello there", ""])
def test_keep_subject_misses(spark, subject):
    assert first_rule(spark, "a@x.example.com", "x.example.com", subject) is None


def test_sender_dollar_rules_see_raw_text(spark):          # Q2
    assert first_rule(spark, "security@vercel.com", "vercel.com", "x") == "vercel_security"
    assert first_rule(spark, "V <security@vercel.com>", "vercel.com", "x") is None


def test_layer_order_and_combo(spark):
    # combo beats keep domain / subject; keep beats deletable
    assert first_rule(spark, "n@business-updates.facebook.com", "business-updates.facebook.com",
                      "Nowa transakcja") == "meta_ads_billing"
    assert first_rule(spark, "n@newsletter.allegro.pl", "newsletter.allegro.pl", "Faktura") == "kw_invoice_subject"
    assert first_rule(spark, "n@newsletter.allegro.pl", "newsletter.allegro.pl", "hi") == "promo_allegro_newsletter"
    assert first_rule(spark, "  n@mbank.pl  ", " MBANK.PL ", None) == "bank_mbank"     # P6 normalising


def test_older_pack_trailing_boundary(spark):            # Q3
    assert first_rule(spark, "a@x.io", "x.io", "faktura 1", pack="packages") is None
    assert first_rule(spark, "a@x.io", "x.io", "faktur 1", pack="packages") == "kw_invoice_subject"


def test_shadowed_rules_reported(spark):                 # Q5 / R7
    df = spark.createDataFrame([("1", "a@mail.autenti.com", "mail.autenti.com", "x")], SCHEMA)
    hits = all_hits(df).select(F.col("hits.rule_id")).first()[0]
    assert hits[:2] == ["esign_autenti", "esign_autenti_mail"]


def test_transactional_and_read_later(spark):
    df = spark.createDataFrame([("1", "x@substack.com", "substack.com", None)], SCHEMA)
    r = transactional_rules(df).select("tx_rule", read_later(F.col("sender"), F.col("sender_domain")).alias("rl")).first()
    assert r["tx_rule"] is None and r["rl"] is True


@pytest.mark.parametrize("sender,domain", [
    ("Bank <a@mbank.pl>", "mbank.pl"), ("a@b@c.pl", "b@c.pl"), ("x> <a@b.pl", "b.pl"), ("mailer-daemon", ""),
])
def test_parse_sender(spark, sender, domain):
    df = spark.createDataFrame([(sender,)], "s string")
    assert df.select(S.sender_domain(F.col("s"))).first()[0] == domain


def test_reply_flag_nbsp(spark):
    df = spark.createDataFrame([("RE: x",)], "subject string")
    flags = df.select(*S.keyword_flags("subject")).first().asDict()
    assert flags["kw_reply_fwd"] == 1


def _route(spark, received, labels, subject="Faktura 1"):
    df = spark.createDataFrame([("1", "t", "a@x.io", "x.io", subject, "", labels, received)],
                               "id string, thread_id string, sender string, sender_domain string, subject string, "
                               "snippet string, labels array<string>, received_at timestamp_ntz")
    return T.triage(df, AS_OF, days_window=None).select("route").first()[0]


def test_grace_boundaries(spark):
    seven = AS_OF - dt.timedelta(days=7)
    assert _route(spark, seven, ["INBOX", "UNREAD"]) == "grace_expired"
    assert _route(spark, seven + dt.timedelta(microseconds=1), ["INBOX", "UNREAD"]) == "protected"
    assert _route(spark, AS_OF + dt.timedelta(days=2), ["INBOX", "UNREAD"]) == "protected"   # future
    assert _route(spark, None, ["INBOX", "UNREAD"]) == "protected"                            # null time
    assert _route(spark, seven, ["INBOX"]) == "protected"                                     # read
    assert _route(spark, seven, ["INBOX"], subject="nothing") == "unmatched"


def test_score_threshold_and_band(spark):
    df = spark.createDataFrame([(0.85,), (0.8499999,), (0.3,), (0.7,), (0.5,)], "p double")
    route = T.route_column(F.lit(None).cast("struct<decision:string>"), F.col("p"), F.lit(None), F.lit(0),
                           F.lit(True))
    got = [r[0] for r in df.select(route).collect()]
    assert got[:2] == ["ml", "ml_below"]
    from mailtriage.operators.model import uncertain_band
    assert [r.p for r in uncertain_band(df, "p").collect()] == [0.5]


def test_label_state_null_and_empty(spark):
    from mailtriage.operators.labeling import label_state
    df = spark.createDataFrame([(None,), ([],)], "labels array<string>")
    assert [r[0] for r in df.select(label_state("labels")).collect()] == ["keep", "keep"]


def test_match_on_address(spark):
    """Q2: a sender rule that ends in $ sees the bare address, not the closing bracket of the From text."""
    rows = [("a", "Vercel <notify@vercel.com>", "", ""), ("b", "notify@vercel.com", "", ""), ("c", "no address", "", ""), ("d", None, None, None)]
    df = spark.createDataFrame(rows, "id string, sender string, sender_domain string, subject string")
    text, address = ({r["id"]: r["rule_id"] for r in apply_rules(df, match_on=m).select("id", F.col("hit.rule_id").alias("rule_id")).collect()}
                     for m in ("text", "address"))
    assert address["a"] == address["b"] == text["b"] and text["c"] == address["c"] and text["d"] == address["d"]
    with pytest.raises(ValueError):
        apply_rules(df, match_on="name")
