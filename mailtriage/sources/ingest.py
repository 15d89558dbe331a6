"""Message ingest and id lookups.

Raw provider messages arrive as JSON lines (files or a stream), one message per
line, with the schema below. They are read with an explicit schema (no
inference pass over the data) and turned into ``raw_emails`` rows by column
expressions only (P1-P5); malformed lines land in ``_corrupt_record`` instead
of failing the job.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

HEADER = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
MESSAGE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("threadId", T.StringType()),
    T.StructField("payload", T.StructType([T.StructField("headers", T.ArrayType(HEADER))])),
    T.StructField("internalDate", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("labelIds", T.ArrayType(T.StringType())),
])
CORRUPT = "_corrupt_record"

RAW_EMAILS_COLUMNS = ["id", "thread_id", "sender", "sender_domain", "subject", "snippet", "labels", "received_at"]


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines message files -> one struct column per field (bad lines kept in ``_corrupt_record``)."""
    schema = T.StructType(MESSAGE_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def parse_json_column(df: DataFrame, col: str = "value") -> DataFrame:
    """JSON text column -> message columns (the stream / table form of ``read_messages``)."""
    return df.select(F.from_json(F.col(col), MESSAGE_SCHEMA).alias("m")).select("m.*")


def to_raw_emails(messages: DataFrame) -> DataFrame:
    """Message columns -> ``raw_emails`` rows."""
    headers = F.col("payload.headers")
    from_h = S.header_lookup(headers, "From")
    full, domain = S.parse_sender(from_h)
    return messages.select(
        F.col("id"),
        S.default_missing("threadId", "").alias("thread_id"),
        full.alias("sender"),
        domain.alias("sender_domain"),
        S.header_lookup(headers, "Subject").alias("subject"),
        S.default_missing("snippet", "").alias("snippet"),
        S.labels_or_empty("labelIds").alias("labels"),
        S.epoch_ms_to_ts(F.col("internalDate")).alias("received_at"),
    )


def fetch_known_ids(ids: DataFrame, emails: DataFrame, id_col: str = "id") -> DataFrame:
    """Mail rows of the requested ids; ids that are gone are skipped, not an error.

    ``ids`` is deduplicated first, so the inner join returns each mail once.
    The missing ids are ``missing_ids``.
    """
    return emails.join(ids.select(F.col(id_col).alias("id")).distinct(), "id", "inner")


def missing_ids(ids: DataFrame, emails: DataFrame, id_col: str = "id") -> DataFrame:
    """Requested ids with no mail row (left anti join)."""
    return ids.select(F.col(id_col).alias("id")).distinct().join(emails.select("id"), "id", "left_anti")


def load_training_rows(emails: DataFrame, feedback: DataFrame) -> DataFrame:
    """Mail joined with its label, the 8 columns training reads."""
    return (emails.join(feedback.select(F.col("email_id").alias("id"), "user_label"), "id", "inner")
            .select("id", "sender", "sender_domain", "subject", "snippet", "labels", "received_at", "user_label"))


def epoch_ms_text(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp")).cast("string")
