"""Dry run, journal, restart after a crash between any two tables, quarantine, run log; K5 ties."""
from __future__ import annotations

import datetime as dt

import pytest
from paths import SF_SMALL
from pyspark.sql import functions as F

from mailtriage.operators import commit as C
from mailtriage.operators import tables as K
from mailtriage.plans import triage as T
from mailtriage.session import AS_OF
from mailtriage.sources import fixtures as fx
from mailtriage.streaming import stream as ST

STEPS = ["scanned", "quarantine", "plan", "decisions", "audit_log", "raw_emails", "feedback", "label_changes", "outbox", "switch", "run_log"]
TABLES = ["decisions", "audit_log", "raw_emails", "feedback", "label_changes", "outbox", "quarantine"]


def mail(spark):
    """Clean mail, and rows that break NOT NULL."""
    m = fx.raw_emails(spark, SF_SMALL).where(F.col("id").cast("int") < 60)
    bad = m.where(F.col("id").cast("int") < 4)
    return m.unionByName(bad.withColumn("sender", F.lit(None).cast("string")).withColumn("id", F.concat(F.lit("s"), "id"))) \
        .unionByName(bad.withColumn("received_at", F.lit(None).cast("timestamp_ntz")).withColumn("id", F.concat(F.lit("r"), "id")))


def content(store):
    _, paths, _ = store.manifest()
    return {n: sorted(map(str, store.current(n, paths).drop("batch_id").collect())) for n in TABLES if n in paths}


@pytest.fixture(scope="module")
def whole(spark):
    """What one undisturbed run leaves."""
    store = C.Store(spark, ST.scratch(spark, "t-store"))
    rows = {r["table"]: r["rows"] for r in C.triage_commit(store, mail(spark), "run-1").collect()}
    return store, rows, content(store)


def test_commit(spark, whole):
    store, rows, tables = whole
    acts = T.actions(T.triage(mail(spark).where("sender is not null and received_at is not null"))).count()
    assert acts > 0 and rows["audit_log"] == rows["raw_emails"] == rows["feedback"] == rows["label_changes"] == acts
    assert rows["quarantine"] > 0 and rows["plan"] == rows["decisions"]
    for name in ("raw_emails",):
        t = store.current(name)
        assert K.check_not_null(t, C.NOT_NULL).count() == 0 and K.check_primary_key(t, ["id"]).count() == 0
    assert {r["null_columns"][0] for r in store.current("quarantine").collect()} == {"sender", "received_at"}
    assert K.fk_orphans(store.current("feedback"), store.current("raw_emails")).count() == 0  # Q16
    log = store.run_log().collect()
    assert [(r["status"], r["trashed"]) for r in log] == [("OK", acts)]


def test_dry_run_leaves_the_store_alone(spark):
    store = C.Store(spark, ST.scratch(spark, "t-store"))
    plan = C.triage_commit(store, mail(spark), "run-1", dry_run=True)
    want = T.actions(T.triage(mail(spark).where("sender is not null and received_at is not null")))
    assert sorted(r["id"] for r in plan.collect()) == sorted(r["id"] for r in want.collect())
    assert store.manifest() == (0, {}, set()) and store.run_log().count() == 0 and not store.journal("run-1")


class Crash(Exception):
    pass


@pytest.mark.parametrize("at", ["quarantine", "plan", "decisions", "raw_emails", "outbox", "switch", "run_log"])
def test_crash_at_any_step(spark, whole, at):
    """A run that dies at a step leaves all tables as they were; started again it ends as an undisturbed one."""
    store = C.Store(spark, ST.scratch(spark, "t-store"))

    def die(step):
        if step == at:
            raise Crash(step)

    with pytest.raises(Crash):
        C.triage_commit(store, mail(spark), "run-1", on_step=die)
    if at != "run_log":
        assert store.manifest()[0] == 0 and content(store) == {}
    seen = []
    C.triage_commit(store, mail(spark), "run-1", on_step=seen.append)
    after = STEPS[STEPS.index(at):]
    assert seen == after and content(store) == whole[2] and store.manifest()[0] == 1
    log = {(r["status"], r["error"]) for r in store.run_log().collect()}
    assert log == {("OK", None), ("ERROR", f"Crash: {at}")}


def test_committed_run_does_nothing_again(spark, whole):
    store, _, tables = whole
    seen = []
    C.triage_commit(store, mail(spark), "run-1", on_step=seen.append)
    assert seen == ["run_log"] and store.manifest()[0] == 1 and content(store) == tables and store.run_log().count() == 1


def test_second_run_and_stale_run(spark):
    """A run that died before another one committed doesn't undo the other's work."""
    store = C.Store(spark, ST.scratch(spark, "t-store"))
    a, b = (mail(spark).where(F.pmod(F.xxhash64("id"), F.lit(2)) == k) for k in (0, 1))

    def die(step):
        if step == "switch":
            raise Crash(step)

    with pytest.raises(Crash):
        C.triage_commit(store, a, "run-a", on_step=die)
    C.triage_commit(store, b, "run-b")
    C.triage_commit(store, a, "run-a")
    assert store.manifest()[0] == 2 and store.manifest()[2] == {"run-a", "run-b"}
    ids = lambda t, c="email_id": {r[c] for r in store.current(t).select(c).collect()}
    clean = mail(spark).where("sender is not null and received_at is not null")
    assert ids("decisions") == {r["id"] for r in T.triage(clean).select("id").collect()}
    acts = {r["id"] for r in T.actions(T.triage(clean)).select("id").collect()}
    assert ids("raw_emails", "id") == ids("feedback") == acts


def test_two_runs_from_one_manifest(spark):
    store = C.Store(spark, ST.scratch(spark, "t-store"))
    store.switch(0, {"decisions": store.write("decisions", store.current("decisions"))}, "x")
    with pytest.raises(Exception):
        store.switch(0, {"decisions": "elsewhere"}, "y")
    assert store.manifest()[0] == 1 and store.manifest()[2] == {"x"}


def test_split_edges(spark):
    df = spark.createDataFrame([(1, None), (None, "x"), (2, "y"), (None, None)], "a int, b string")
    good, bad = C.split_not_null(df, ("a", "b"), ST.scratch(spark, "t-split"))
    assert [tuple(r) for r in good.collect()] == [(2, "y")]
    assert sorted(tuple(r["null_columns"]) for r in bad.collect()) == [("a",), ("a", "b"), ("b",)]
    good, bad = C.split_not_null(df.limit(0), ("a", "b"), ST.scratch(spark, "t-split"))
    assert good.count() == bad.count() == 0 and good.columns == ["a", "b"]
    good, bad = C.split_not_null(df.where("a = 2"), ("a", "b"), ST.scratch(spark, "t-split"))
    assert good.count() == 1 and bad.count() == 0
    with pytest.raises(ValueError):
        C.split_not_null(df.withColumnRenamed("a", "_OK"), ("b",), ST.scratch(spark, "t-split"))


def test_feedback_ties_do_not_depend_on_order(spark):
    """K5: two changes with one id and time give one answer in either order."""
    cols, t = "email_id string, user_label string, source string, created_at timestamp_ntz", AS_OF - dt.timedelta(days=1)
    rows = [("1", "spam", "user_confirm", t), ("1", "keep", "user_restore", t)]
    got = {K.upsert_feedback_latest(spark.createDataFrame([], cols), spark.createDataFrame(r, cols)).first()["user_label"]
           for r in (rows, rows[::-1])}
    assert len(got) == 1
