"""Registered queries: streaming (ST1-ST5).

Each query writes a feed derived from the driver's tables into the shared
checkpoint folder, runs the stream to completion (``availableNow``) and reads
its sink. A stream's final table equals a batch question, so most have an
oracle too.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..session import AS_OF
from ..sources import fixtures as fx
from ..streaming import stream as ST
from . import oracle_sql as O
from .registry import query


#: Micro-batches a feed is read in, and the bytes of a file that one task writes.
BATCHES, FILE_BYTES = 4, 64 << 20


def files_a_batch(n_bytes: int) -> int:
    """How many files of a feed one batch reads: a feed has ``BATCHES`` times as many, so that no file grows with the feed."""
    return max(1, -(-n_bytes // (BATCHES * FILE_BYTES)))


def _message_feed(spark, sf) -> tuple[str, int]:
    """The feed's folder and its files a batch."""
    d = ST.scratch(spark, "feed-messages")
    texts = F.sum(F.coalesce(F.octet_length("subject"), F.lit(0)) + F.coalesce(F.octet_length("snippet"), F.lit(0)))
    mail = fx.raw_emails(spark, sf).agg(texts, F.count(F.lit(1))).first()
    per = files_a_batch((mail[0] or 0) + 512 * mail[1])         # a message is its texts and about half a kilobyte
    fx.raw_messages(spark, sf).repartition(BATCHES * per).write.text(d)
    return d, per


@query("stream_ingest", sql=fx.oracle_with("raw_emails") + """
SELECT id, thread_id, sender, sender_domain, subject, snippet, labels, received_at FROM raw_emails""")
def q_stream_ingest(spark, sf):
    src, per = _message_feed(spark, sf)
    return ST.stream_ingest(spark, src, ST.scratch(spark, "st1-out"), ST.scratch(spark, "st1-ckpt"), files_per_trigger=per)


@query("stream_triage", sql=O.with_routed() + "SELECT id, route, rule_id, decision, age_days FROM routed")
def q_stream_triage(spark, sf):
    src, per = _message_feed(spark, sf)
    out = ST.stream_triage(spark, src, ST.scratch(spark, "st2-out"), ST.scratch(spark, "st2-ckpt"), AS_OF,
                           files_per_trigger=per)
    return out.select("id", "route", "rule_id", "decision", "age_days")


@query("stream_label_upsert", sql=fx.oracle_with("label_events") + """
SELECT id, arg_max(labels, (changed_at, seq)) AS labels, max(changed_at) AS changed_at,
 arg_max(seq, (changed_at, seq)) AS seq FROM label_events GROUP BY id""")
def q_stream_label_upsert(spark, sf):
    src = ST.scratch(spark, "feed-labels")
    ev = fx.label_events(spark, sf)
    per = files_a_batch(64 * ev.count())                        # an event is well below 64 bytes in a file
    ev.repartition(BATCHES * per).write.parquet(src)
    return ST.stream_label_upsert(spark, src, ST.scratch(spark, "st3-out"), ST.scratch(spark, "st3-ckpt"), files_per_trigger=per)


@query("stream_grace_expiry", sql=O.with_routed() + """
SELECT id, received_at + INTERVAL 7 DAY AS expired_at, rule_id FROM routed WHERE route = 'grace_expired'""")
def q_stream_grace_expiry(spark, sf):
    src = ST.scratch(spark, "feed-grace")
    ev = ST.grace_events(fx.raw_emails(spark, sf), AS_OF)
    # one job writes the feed; its files come in any order of event time. Then the clock: one control record that
    # moves the watermark to as_of
    per = files_a_batch(64 * ev.count())
    ev.repartition(BATCHES * per).write.parquet(src)
    clock = spark.range(1).select(F.lit("").alias("id"), F.lit("clock").alias("kind"),
                                  F.lit(AS_OF.isoformat(sep=" ")).cast("timestamp").alias("event_ts"),
                                  F.lit(False).alias("unread"), F.lit(None).cast("string").alias("rule_id"))
    clock.write.mode("append").parquet(src)
    stream = spark.readStream.schema(
        "id string, kind string, event_ts timestamp, unread boolean, rule_id string"
    ).option("maxFilesPerTrigger", per).parquet(src)
    out = ST.stream_grace_expiry(spark, stream, ST.scratch(spark, "st4-out"), ST.scratch(spark, "st4-ckpt"))
    return out.select("id", F.col("expired_at").cast("timestamp_ntz").alias("expired_at"), "rule_id")


@query("stream_daily_counts", sql=fx.oracle_with("decisions") + """
SELECT date_trunc('day', decided_at) AS day, model_version, decision, count(*) AS n FROM decisions GROUP BY 1, 2, 3""")
def q_stream_daily_counts(spark, sf):
    src = ST.scratch(spark, "feed-decisions")
    fx.decisions(spark, sf).write.parquet(src)
    schema = ("email_id string, decision string, confidence double, model_version string, executed boolean, "
              "decided_at timestamp_ntz")
    return ST.stream_daily_counts(spark, src, schema, ST.scratch(spark, "st5-out"), ST.scratch(spark, "st5-ckpt"),
                                  files_per_trigger=1)
