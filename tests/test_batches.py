"""Streams over several batches, step order of the change detection, uncut texts and reviews."""
from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mailtriage.operators import observe as OB, review as RV, tables as K
from mailtriage.plans import triage as T
from mailtriage.session import AS_OF
from mailtriage.sources import fixtures as fx
from mailtriage.streaming import stream as ST

from paths import SF_SMALL

DAY = dt.timedelta(days=1)


def test_ingest_keeps_old_mail_and_first_copy(spark):
    src = ST.scratch(spark, "t-msgs")
    msgs = fx.raw_messages(spark, SF_SMALL)
    for part in range(3):  # one file a batch; the second batch brings the first one's messages again
        msgs.where(F.pmod(F.xxhash64("value"), F.lit(2)) == part % 2).coalesce(1).write.mode("append").text(src)
    out = ST.stream_ingest(spark, src, ST.scratch(spark, "t-out"), ST.scratch(spark, "t-ckpt"), files_per_trigger=1)
    n = msgs.count()
    assert out.count() == n and out.select("id").distinct().count() == n


def test_ingest_cost_does_not_grow(spark):
    """50 batches with one copy of old ids each: every batch reads its own rows only, the state holds each id once."""
    src = ST.scratch(spark, "t-many")
    line = lambda i, subject, ms: ('{"id":"m%d","threadId":"t","snippet":"s","labelIds":["INBOX"],"internalDate":"%d",'  # noqa: E731
                                   '"payload":{"headers":[{"name":"Subject","value":"%s"}]}}' % (i, ms, subject))
    for b in range(50):  # the id m0 comes in every batch, the first batch's copy stays; 2b comes twice in its own batch
        rows = [(line(0, f"copy {b}", 1000 - b),), (line(2 * b + 1, "new", 5),), (line(2 * b + 2, "later", 9),), (line(2 * b + 2, "earlier", 7),)]
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(src)
    progress = []
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        out = ST.stream_ingest(spark, src, ST.scratch(spark, "t-mo"), ST.scratch(spark, "t-mc"), files_per_trigger=1, progress=progress)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {r["id"]: r["subject"] for r in out.collect()}
    assert len(got) == out.count() == 101 and got["m0"] == "copy 0"
    assert all(got[f"m{2 * b + 2}"] == "earlier" for b in range(50))
    assert len(progress) >= 40 and all(p["numInputRows"] <= 4 for p in progress)
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 101


def _grace(spark, batches):
    src = ST.scratch(spark, "t-grace")
    schema = "id string, kind string, event_ts timestamp, unread boolean, rule_id string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = ST.stream_grace_expiry(spark, stream, ST.scratch(spark, "t-go"), ST.scratch(spark, "t-gc"), watermark="3 days")
    return {r["id"] for r in out.collect()}


def test_grace_over_batches(spark):
    t = dt.datetime(2024, 1, 1)
    got = _grace(spark, [
        [("a", "arrival", t, True, "r"), ("late", "arrival", t, True, "r"), ("early", "change", t + DAY, False, None)],
        [("early", "arrival", t + DAY / 2, True, "r"), ("x", "arrival", t + 20 * DAY, True, "r")],
        # the watermark has passed t + 7 days: a change of an answered mail, and a change of one never seen
        [("late", "change", t + 18 * DAY, True, None), ("new", "change", t + 18 * DAY, False, None)],
        [("", "clock", t + 60 * DAY, False, None)],
        [("", "clock", t + 61 * DAY, False, None)]])
    assert got == {"a", "late", "x"}  # "early" was read before its arrival came in


@pytest.mark.parametrize("seed", range(4))
def test_grace_any_order(spark, seed):
    """Arrivals and reads in any order of batches, far behind the clock: the same answers."""
    t, r = dt.datetime(2024, 1, 1), random.Random(seed)
    days = [10, 25, 30, 2, 3, 50]
    rows = [(f"d{d}", "arrival", t + d * DAY, True, "r") for d in days]
    rows += [("read", "arrival", t + 5 * DAY, True, "r"), ("no time", "arrival", None, True, "r"), (None, "arrival", t, True, "r")]
    if seed:
        r.shuffle(rows)
    else:  # days 10, 25, 30, then 2 and 3
        rows.sort(key=lambda x: days.index(int(x[0][1:])) if x[0] and x[0][1:].isdigit() else 9)
    read = ("read", "change", t + 6 * DAY, False, None)
    at = next(k for k, x in enumerate(rows) if x[0] == "read")
    batches = [[x] if k != at else [read, x] for k, x in enumerate(rows)] + [[("", "clock", t + 40 * DAY, False, None)]]
    assert _grace(spark, batches) == {"d10", "d25", "d30", "d2", "d3", None}


def test_changes_keep_step_sees_spam_step(spark):
    cols = "id string, thread_id string, sender string, sender_domain string, subject string, snippet string, labels array<string>, received_at timestamp_ntz"
    at = AS_OF - DAY
    row = lambda i, labels: (i, "t", "s", "d", "x", "y", labels, at)
    box = spark.createDataFrame([row("both", ["TRASH", "INBOX"]), row("un", ["TRASH", "INBOX"]), row("k", ["INBOX"])], cols)
    mail = spark.createDataFrame([row("both", ["INBOX"]), row("k", ["INBOX"])], cols)
    fb = spark.createDataFrame([("both", "keep", "bootstrap_inbox", at - DAY), ("k", "keep", "bootstrap_inbox", at - DAY)],
                               "email_id string, user_label string, source string, created_at timestamp_ntz")
    out = OB.detect_changes(box, mail, fb)
    assert {r["email_id"]: r["user_label"] for r in out["feedback"].collect()} == {"both": "keep", "un": "keep", "k": "keep"}
    counts = {r["label"]: (r["new_total"], r["known_unlabeled"], r["unknown"]) for r in out["counts"].collect()}
    assert counts == {"spam": (2, 1, 1), "keep": (2, 2, 0)}


def test_last_change_is_the_latest(spark):
    cols = "id string, subject string, labels array<string>, received_at timestamp_ntz"
    now = [("1", "a", ["INBOX"], AS_OF - 3 * DAY)]
    changes = [("1", "z", ["OLD"], AS_OF - 2 * DAY), ("1", "b", ["NEW"], AS_OF - DAY)]
    out = K.upsert_mail_labels(spark.createDataFrame(now, cols), spark.createDataFrame(changes, cols), F.col("received_at"))
    assert out.first()["labels"] == ["NEW"]


def test_whole_texts_and_whole_queue(spark):
    mail = fx.raw_emails(spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert mail.agg(F.max(F.length("snippet"))).first()[0] == docs.agg(F.max(F.length("text"))).first()[0] > 200
    fb = spark.createDataFrame([(str(i), "spam", "auto_clean:deletable:x", AS_OF - DAY) for i in range(150)],
                               "email_id string, user_label string, source string, created_at timestamp_ntz")
    q = RV.review_queue(fb, mail)
    assert q.count() == 150 and RV.flagged_count(q).first()[0] == 150
    assert RV.review_queue(fb, mail, limit=20).count() == 20


def test_commit_feedback(spark):
    routed = T.triage(fx.raw_emails(spark, SF_SMALL))
    acts = T.actions(routed)
    fb = T.commit_feedback(routed, acts)
    assert fb.count() == acts.select("id").distinct().count() > 0
    assert fb.where(~F.col("source").rlike("^auto_clean:(deletable|grace_expired|ml):")).count() == 0



def test_daily_counts_over_batches(spark):
    """One file a batch, days far out of order: closed days are written once, late rows beside them, none is lost."""
    src, out_dir, ckpt = (ST.scratch(spark, f"t-{x}") for x in ("days", "do", "dc"))
    schema = "email_id string, decision string, model_version string, decided_at timestamp_ntz"
    t = dt.datetime(2024, 1, 20, 12)
    for day in (0, 9, 1, 9, 0, 3):
        rows = [(f"{day}-{i}", "ab"[i % 2], "v1", t - day * DAY) for i in range(4)] + [(f"n{day}", None, "v1", None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: {(r["day"] and 20 - r["day"].day, r["decision"]): r["n"] for r in ST.stream_daily_counts(
        spark, src, schema, out_dir, ckpt, files_per_trigger=1).collect()}
    want = {(d, x): n for d, n in ((0, 4), (9, 4), (1, 2), (3, 2)) for x in "ab"} | {(None, None): 6}
    assert run() == want
    rows = ST.daily_rows(spark, out_dir, ckpt).groupBy("day_ms", "late").agg(F.sum("n").alias("n")).collect()
    noon = lambda d: int((dt.datetime(2024, 1, 20) - d * DAY - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    assert {(r["day_ms"], r["late"], r["n"]) for r in rows} == {
        (noon(0), None, 8), (noon(9), True, 8), (noon(1), True, 4), (noon(3), True, 4), (ST.NO_DAY, True, 6)}
    # a later run goes on: day 0 closes once, its late row stands beside it
    for day in (-3, 0):
        spark.createDataFrame([(f"{day}-z", "a", "v1", t - day * DAY)], schema).coalesce(1).write.mode("append").parquet(src)
    assert run() == want | {(0, "a"): 5, (-3, "a"): 1}
    zero = ST.daily_rows(spark, out_dir, ckpt).where(F.col("day_ms") == noon(0)).groupBy("late").agg(F.sum("n").alias("n")).collect()
    assert {(r["late"], r["n"]) for r in zero} == {(False, 8), (True, 1)}
