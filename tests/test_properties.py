"""Properties of the operators."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from mailtriage.operators import tables as K
from mailtriage.plans import triage as T
from mailtriage.session import AS_OF
from mailtriage.sources import fixtures as fx

from paths import SF_SMALL


def test_every_mail_in_exactly_one_route(spark):
    e = fx.raw_emails(spark, SF_SMALL)
    r = T.triage(e, AS_OF, days_window=None)
    assert r.count() == e.count()
    assert r.filter(F.col("route").isNull()).count() == 0
    assert r.select("id").distinct().count() == e.count()


def test_as_of_shift_changes_only_age_routes(spark):
    e = fx.raw_emails(spark, SF_SMALL)
    a = T.triage(e, AS_OF, days_window=None).select("id", F.col("route").alias("a"))
    b = T.triage(e, AS_OF + dt.timedelta(days=3), days_window=None).select("id", F.col("route").alias("b"))
    changed = a.join(b, "id").filter(F.col("a") != F.col("b"))
    assert changed.filter(~F.col("a").isin("protected", "grace_expired")
                          | ~F.col("b").isin("protected", "grace_expired")).count() == 0


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_upserts_are_idempotent(spark):
    mail, dirty = fx.raw_emails(spark, SF_SMALL), fx.raw_emails_dirty(spark, SF_SMALL)
    once = K.insert_if_absent(mail, dirty, F.col("received_at"))
    assert _same(once, K.insert_if_absent(once, dirty, F.col("received_at")))
    fb = fx.feedback(spark, SF_SMALL)
    ch = fb.select("email_id", F.lit("spam").alias("user_label"), F.lit("user_confirm").alias("source"),
                   F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz").alias("created_at"))
    f1 = K.upsert_feedback_latest(fb, ch)
    assert _same(f1, K.upsert_feedback_latest(f1, ch))
    up1 = K.upsert_mail_labels(mail, dirty, F.col("received_at")).drop("outcome")
    assert _same(up1, K.upsert_mail_labels(up1, dirty, F.col("received_at")).drop("outcome"))


def test_outbox_contract(spark):
    ids = fx.label_events(spark, SF_SMALL).select("id").union(fx.raw_emails(spark, SF_SMALL).select("id"))
    box = K.action_outbox(ids, group_size=7, partitions=3)
    rows = box.collect()
    flat = [i for r in rows for i in r.ids]
    assert len(flat) == len(set(flat)) == ids.distinct().count()
    assert max(r.n_ids for r in rows) <= 7


def test_checks_find_dirty_rows(spark):
    d = fx.raw_emails_dirty(spark, SF_SMALL)
    assert K.check_primary_key(d, ["id"]).count() > 0
    assert K.check_not_null(d, ["sender", "received_at"]).count() > 0


def test_rule_hit_map_equals_counts(spark):
    r = T.triage(fx.raw_emails(spark, SF_SMALL), AS_OF)
    m = T.rule_hit_map(r).first()["rule_hits"]
    c = {row.hit: row.n for row in T.rule_hit_counts(r).collect()}
    assert dict(m) == c


def test_triage_is_order_free(spark):
    e = fx.raw_emails(spark, SF_SMALL)
    a = T.triage(e, AS_OF).select("id", "route", "rule_id")
    shuffled = e.repartition(5, F.rand(seed=7)).orderBy(F.rand(seed=3))
    b = T.triage(shuffled, AS_OF).select("id", "route", "rule_id")
    assert _same(a, b)


def test_corrupt_message_lines_are_kept_aside(spark):
    import uuid
    from mailtriage.session import checkpoint_dir
    from mailtriage.sources import ingest as I
    d = f"{checkpoint_dir(spark)}/msgs-{uuid.uuid4().hex[:8]}"
    good = fx.raw_messages(spark, SF_SMALL)
    bad = spark.createDataFrame([("{not json",), ('{"id": "x1", "internalDate": "oops"}',)], "value string")
    good.unionByName(bad).coalesce(1).write.text(d)
    m = I.read_messages(spark, d).cache()
    assert m.filter(F.col(I.CORRUPT).isNotNull()).count() == 1
    rows = I.to_raw_emails(m.filter(F.col(I.CORRUPT).isNull()))
    assert rows.count() == good.count() + 1
    assert rows.filter(F.col("id") == "x1").select("received_at").first()[0] is None   # bad time -> null
