"""Structured Streaming paths (ST1-ST5): same meaning as the batch operators.

Every query keeps its checkpoint under the shared ``spark.checkpoint.dir``
(``session.checkpoint_dir``), so a restarted driver or a lost executor
resumes from the last committed batch. Sinks are idempotent per batch id:
``foreachBatch`` writers overwrite the folder of their own batch.
"""
from __future__ import annotations

import datetime as _dt
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import scalars as S
from ..functions.packs import GRACE_PERIOD_DAYS
from ..operators.rules import apply_rules
from ..plans import triage as TR
from ..session import AS_OF, checkpoint_dir
from ..sources.ingest import MESSAGE_SCHEMA, to_raw_emails


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _run(writer, timeout_s: float | None = None):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(timeout_s)
    if q.exception() is not None:
        raise q.exception()
    return q


CLOCK = "\x00clock"
CLOCK_KEYS = 32


def clocked(events: DataFrame, ts_col: str, key: str, delay: str) -> DataFrame:
    """``events`` with an event-time clock of its own, so that no row is ever too late for a stateful step.

    Spark drops rows whose watermark column lies behind the watermark before a stateful operator sees them. Here each
    event comes twice: as data with a null ``clock_ts``, which can't be late, and as a bare tick that has the time and a
    key of its own (spread over ``CLOCK_KEYS``). Ticks move the watermark; the state function ignores their keys
    (``is_clock``) and decides late data itself, by ``getCurrentWatermarkMs``. Events without a time only come as data.
    """
    both = events.withColumn("_tick", F.explode(F.array(F.lit(False), F.lit(True))))
    both = both.where(~F.col("_tick") | F.col(ts_col).isNotNull())
    rest = [c for c in events.columns if c not in (key, ts_col)]
    spread = F.pmod(F.xxhash64(key), F.lit(CLOCK_KEYS)).cast("string")
    out = both.select(F.when(F.col("_tick"), F.concat(F.lit(CLOCK), spread)).otherwise(F.col(key)).alias(key), ts_col,
                      *[F.when(~F.col("_tick"), F.col(c)).alias(c) for c in rest],
                      F.when(F.col("_tick"), F.col(ts_col)).alias("clock_ts"))
    return out.withWatermark("clock_ts", delay)


def is_clock(key) -> bool:
    return key is not None and str(key).startswith(CLOCK)


# ST1 -------------------------------------------------------------------------
def read_message_stream(spark: SparkSession, src_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(MESSAGE_SCHEMA)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.json(src_dir)


def _first_fn(columns):
    def first(key, pdfs, state):
        """Per id: the first copy of the first batch that has one; the state says only that the id was seen."""
        if state.exists:
            return
        rows = pd.concat(list(pdfs))
        state.update((True,))
        yield rows.sort_values(["received_at", "_h"], na_position="first", kind="stable")[columns].head(1)
    return first


def stream_ingest(spark: SparkSession, src_dir: str, out_dir: str, ckpt: str,
                  files_per_trigger: int | None = None, progress: list | None = None) -> DataFrame:
    """ST1: new mail as a stream: parse (P1-P5), first copy of an id wins, however old the mail is.

    The seen ids are keyed state (one flag each, RocksDB on the executors, changelog checkpoints): a batch looks up
    its own ids only, so its cost doesn't grow with the mail already written. Within a batch the earliest received
    copy wins, ties by the row's hash. There is no watermark, so no row is lost to one; rows without an id share the
    null id. A retried batch overwrites its own folder. ``progress`` collects Spark's figures of each batch.
    """
    mail = to_raw_emails(read_message_stream(spark, src_dir, files_per_trigger))
    columns, schema = mail.columns, mail.schema
    firsts = mail.withColumn("_h", F.xxhash64(*columns)).groupBy("id").applyInPandasWithState(
        _first_fn(columns), schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    q = _run(firsts.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt))
    if progress is not None:
        progress.extend(q.recentProgress)
    return spark.read.schema(schema).parquet(out_dir).select(*columns)


def first_copies(rows: DataFrame) -> DataFrame:
    """One batch's copies, as ST1 picks them."""
    pick = F.struct(*rows.columns)
    order = F.struct("received_at", F.xxhash64(*rows.columns))
    return rows.groupBy("id").agg(F.min_by(pick, order).alias("_r")).select("_r.*")


# ST2 -------------------------------------------------------------------------
def stream_triage(spark: SparkSession, src_dir: str, out_dir: str, ckpt: str,
                  as_of: _dt.datetime | None = AS_OF, scorer=None, days_window: int | None = 30,
                  files_per_trigger: int | None = None) -> DataFrame:
    """ST2: T1 per micro-batch; ``as_of=None`` uses the time at which the batch was first begun, which is
    stored with it, so a retry decides alike.

    The writer overwrites ``out_dir/batch_id=N``, so a retried batch replaces
    its own output (idempotent).
    """
    msgs = read_message_stream(spark, src_dir, files_per_trigger)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        now = as_of or _batch_clock(batch.sparkSession, f"{out_dir}-clock/batch_id={batch_id}")
        routed = TR.triage(to_raw_emails(batch), now, scorer=scorer, days_window=days_window)
        routed.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    _run(msgs.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt))
    return spark.read.parquet(out_dir)


def _batch_clock(spark: SparkSession, path: str) -> _dt.datetime:
    now = spark.range(1).select(F.lit(_dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")).alias("now"))
    now.write.mode("ignore").parquet(path)
    return _dt.datetime.strptime(spark.read.parquet(path).first()["now"], "%Y-%m-%d %H:%M:%S")


# ST3 -------------------------------------------------------------------------
LABEL_EVENT_SCHEMA = "id string, seq bigint, changed_at timestamp_ntz, labels array<string>"


def stream_label_upsert(spark: SparkSession, src_dir: str, out_dir: str, ckpt: str,
                        files_per_trigger: int | None = None) -> DataFrame:
    """ST3: label-change feed -> last state per mail; a late change never overwrites a newer one.

    The streaming aggregation keeps ``max_by(labels, (changed_at, seq))`` per id
    in the state store and emits only the ids that changed (update mode); each
    batch's updates go to their own folder, and the table is the latest
    update per id (the same ``max_by`` over the update folders).
    """
    reader = spark.readStream.schema(LABEL_EVENT_SCHEMA)
    ev = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(src_dir)
    agg = ev.groupBy("id").agg(F.max_by(F.struct("labels", "changed_at", "seq"),
                                        F.struct("changed_at", "seq")).alias("last"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.select("id", "last.labels", "last.changed_at", "last.seq") \
            .write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    _run(agg.writeStream.outputMode("update").foreachBatch(per_batch).option("checkpointLocation", ckpt))
    return current_labels(spark.read.parquet(out_dir))


def current_labels(updates: DataFrame) -> DataFrame:
    return (updates.groupBy("id")
            .agg(F.max_by(F.struct("labels", "changed_at", "seq"), F.struct("changed_at", "seq")).alias("r"))
            .select("id", "r.labels", "r.changed_at", "r.seq"))


# ST4 -------------------------------------------------------------------------
GRACE_OUT = T.StructType([T.StructField("id", T.StringType()), T.StructField("expired_at", T.TimestampType()),
                          T.StructField("rule_id", T.StringType())])
GRACE_STATE = T.StructType([T.StructField("received_ms", T.LongType()), T.StructField("unread", T.BooleanType()),
                            T.StructField("rule_id", T.StringType()), T.StructField("seen_ms", T.LongType())])
GRACE_MS = GRACE_PERIOD_DAYS * 86_400_000
NOT_YET = -1  # received_ms of a mail of which only changes have been seen


def _grace_fn(key, pdfs, state):
    """Per mail: one event-time timer at receipt + 7 days; reading the mail first cancels it.

    Events may come in any order over batches, however late: the one with the latest event time says whether the mail
    is unread, and a read that comes before its arrival is kept. A mail whose time is already past the watermark is
    answered at once.
    """
    (mail_id,) = key
    if is_clock(mail_id):
        return
    received_ms, unread, rule_id, seen_ms = state.get if state.exists else (NOT_YET, True, None, NOT_YET)
    expired = state.hasTimedOut
    if not expired:
        for pdf in pdfs:
            for rec in pdf.sort_values(["event_ms"]).itertuples(index=False):
                if rec.kind == "arrival":
                    received_ms, rule_id = int(rec.event_ms), rec.rule_id
                if rec.event_ms >= seen_ms:
                    unread, seen_ms = bool(rec.unread), int(rec.event_ms)
        # without an arrival, the change is remembered for one more period
        fires = (received_ms if received_ms != NOT_YET else seen_ms) + GRACE_MS - 1
        expired = fires <= state.getCurrentWatermarkMs()
        if not expired:
            state.update((received_ms, unread, rule_id, seen_ms))
            state.setTimeoutTimestamp(fires)
            return
    if state.exists:
        state.remove()
    if unread and received_ms != NOT_YET:
        yield pd.DataFrame({"id": [mail_id], "expired_at": [pd.Timestamp(received_ms + GRACE_MS, unit="ms")],
                            "rule_id": [rule_id]})


def stream_grace_expiry(spark: SparkSession, events: DataFrame, out_dir: str, ckpt: str,
                        watermark: str = "0 seconds") -> DataFrame:
    """ST4: keep-mail that stays unread turns ``grace_expired`` 7 days after receipt.

    ``events`` is a streaming frame of (id, kind arrival|change, event_ts, unread, rule_id).
    The state per mail is four fields; its timer is event time, so the result
    depends on the data, not on when the job runs. The clock is ``clocked``: a late arrival is decided
    like any other, in whatever batch it comes. Events without a time start no clock and are left out. An arrival that
    is delivered again after its mail was answered gives the same row, which counts once.
    """
    ev = events.where("event_ts is not null").select("id", "kind", "event_ts", "unread", "rule_id")
    ev = clocked(ev, "event_ts", "id", watermark).withColumn("event_ms", F.unix_millis(F.col("event_ts")))
    out = ev.groupBy("id").applyInPandasWithState(
        _grace_fn, GRACE_OUT, GRACE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    _run(out.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", ckpt)
         .outputMode("append"))
    return spark.read.schema(GRACE_OUT).parquet(out_dir).distinct()


def grace_events(mail: DataFrame, as_of: _dt.datetime = AS_OF, days_window: int = 30) -> DataFrame:
    """Arrival events of unread keep-hit INBOX mail (the rows whose grace clock runs)."""
    from ..sources.scans import scan_inbox_window
    m = apply_rules(scan_inbox_window(mail, as_of, days_window))
    return (m.filter((F.col("hit.decision") == "keep") & F.col("received_at").isNotNull())
            .select("id", F.lit("arrival").alias("kind"), F.col("received_at").cast("timestamp").alias("event_ts"),
                    S.is_unread("labels").alias("unread"), F.col("hit.rule_id").alias("rule_id")))


# ST5 -------------------------------------------------------------------------
DAY_MS = 86_400_000
DAY_SALT = 32
NO_DAY = -(1 << 62)


def _day_fn(key, pdfs, state):
    """Per (group, day, salt): rows are counted until the watermark passes the day's end; later rows go out at once."""
    group, day_ms, _ = key
    if is_clock(group):
        return
    n, closed, late = (state.get[0] if state.exists else 0), state.hasTimedOut, False
    if not closed:
        n += sum(len(p) for p in pdfs)
        late = day_ms == NO_DAY or day_ms + DAY_MS <= state.getCurrentWatermarkMs()
        if not late:
            state.update((n,))
            state.setTimeoutTimestamp(int(day_ms) + DAY_MS)
            return
    if state.exists:
        state.remove()
    yield pd.DataFrame({"group": [group], "day_ms": [int(day_ms)], "n": [n], "late": [late]})


DAY_ROWS = "group string, day_ms bigint, n bigint, late boolean"


def stream_daily_counts(spark: SparkSession, src_dir: str, schema: str, out_dir: str, ckpt: str,
                        ts_col: str = "decided_at", keys: tuple[str, ...] = ("model_version", "decision"),
                        files_per_trigger: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """ST5: decisions per day and key, by event time: a tumbling day closes when the watermark passes its end.

    State is one number per open (day, keys, salt) and goes when the day closes, so it is bounded by the open days; the
    salt (``DAY_SALT``) keeps a key with very many rows from one task. A closed day's counts are written once. Rows that
    come after that are written as rows of their own (``late``). The table sums both and the open days, which are read
    from the state of the last finished batch, so no row is lost and no written row changes.
    Rows without a time count under a null day. Each run goes on from the checkpoint.
    """
    reader = spark.readStream.schema(schema)
    d = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(src_dir)
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    ts = F.col(ts_col).cast("timestamp")
    d = d.select(group.alias("group"), ts.alias("ts"), F.coalesce(F.unix_millis(F.date_trunc("day", ts)), F.lit(NO_DAY)).alias("day_ms"),
                 F.pmod(F.xxhash64(*d.columns), F.lit(DAY_SALT)).cast("int").alias("salt"))
    out = clocked(d, "ts", "group", delay).groupBy("group", "day_ms", "salt").applyInPandasWithState(
        _day_fn, DAY_ROWS, "n bigint", "append", GroupStateTimeout.EventTimeTimeout)
    _run(out.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", ckpt).outputMode("append"))
    types = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema.fields}
    row = T.StructType([T.StructField(k, types[k]) for k in keys])
    both = daily_rows(spark, out_dir, ckpt).groupBy("group", "day_ms").agg(F.sum("n").alias("n"))
    day = F.when(F.col("day_ms") != NO_DAY, F.timestamp_millis("day_ms")).cast("timestamp_ntz")
    return both.select(day.alias("day"), F.from_json("group", row).alias("g"), "n").select("day", "g.*", "n")


def daily_rows(spark: SparkSession, out_dir: str, ckpt: str) -> DataFrame:
    """What ST5 holds: written rows (``late`` false: a closed day's count, true: a row after it) and open days (``late`` null)."""
    written = spark.read.schema(DAY_ROWS).parquet(out_dir)
    state = spark.read.format("statestore").load(ckpt)
    open_days = state.where(F.col("value.groupState").isNotNull()).select(
        F.col("key.group"), F.col("key.day_ms"), F.col("value.groupState.n"), F.lit(None).cast("boolean").alias("late"))
    return written.unionByName(open_days)
