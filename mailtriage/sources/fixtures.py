"""Mail-shaped tables derived from the driver's tables (FIXTURES.md).

The driver ships ``documents``, ``labels`` and ``events``; the mail tables
(``raw_emails``, ``feedback``, ``label_events``, ``decisions``, ``audit_log``,
``raw_emails_dirty``, ``raw_messages``) are pure projections of them: arithmetic
on ids, no randomness, no clock. Each Spark view below has a DuckDB twin in
``ORACLE_VIEWS`` used by the oracle SQL of ``__spark_entry__.oracle_sql``.

All Spark views read only the columns they need, so the Parquet scan is pruned.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF_SQL = "TIMESTAMP_NTZ '2024-02-01 00:00:00'"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _seconds_before_as_of(secs: Column) -> Column:
    # as_of minus a whole number of seconds, staying timestamp_ntz
    return F.expr(AS_OF_SQL) - F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), secs.cast("decimal(18,6)"))


def raw_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    base = docs.select(
        "doc_id", "text",
        ((F.col("doc_id") * 7919 + 13) % 1009).alias("h1"),
        ((F.col("doc_id") * 6151 + 5) % 991).alias("h3"),
        ((F.col("doc_id") * 57 + 11) % 109).alias("h4"),
        F.when(F.col("source") == "src5", F.lit("security"))
         .otherwise(F.concat(F.lit("user"), (F.col("doc_id") % 97).cast("string"))).alias("loc"),
        F.expr("""CASE source WHEN 'src0' THEN 'mbank.pl' WHEN 'src1' THEN 'newsletter.allegro.pl'
                 WHEN 'src2' THEN 'substack.com' WHEN 'src3' THEN 'business-updates.facebook.com'
                 WHEN 'src4' THEN 'mail.beehiiv.com' WHEN 'src5' THEN 'vercel.com'
                 ELSE concat(source, '.example.com') END""").alias("dom"),
        F.expr("""CASE WHEN source = 'src3' THEN 'Nowa transakcja ' ELSE
                 CASE (doc_id * 104729 + 7) % 997 % 12 WHEN 0 THEN 'Faktura VAT ' WHEN 1 THEN 'Re: '
                 WHEN 2 THEN 'TWOJE ZAMÓWIENIE ' WHEN 3 THEN 'Weekly digest ' WHEN 4 THEN 'Security alert: '
                 WHEN 5 THEN 'Potwierdzenie płatności ' ELSE '' END END""").alias("pref"),
    )
    secs = F.when(F.col("h3") % 4 == 0, (F.col("doc_id") * 48271 * 61) % (400 * 86400)) \
            .otherwise((F.col("doc_id") * 48271 * 61) % (30 * 86400))
    return base.select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("t"), (F.col("doc_id") - F.col("doc_id") % 3).cast("string")).alias("thread_id"),
        F.when(F.col("h4") % 2 == 0, F.concat("loc", F.lit("@"), "dom"))
         .otherwise(F.concat(F.lit("Sender <"), "loc", F.lit("@"), "dom", F.lit(">"))).alias("sender"),
        F.col("dom").alias("sender_domain"),
        F.concat("pref", F.split_part("text", F.lit("\n"), F.lit(1))).alias("subject"),
        F.col("text").alias("snippet"),
        F.expr("""CASE h1 % 10 WHEN 0 THEN array('TRASH') WHEN 1 THEN array('TRASH','UNREAD')
                 WHEN 2 THEN array('SPAM') WHEN 3 THEN array('CATEGORY_UPDATES')
                 WHEN 4 THEN array('INBOX','STARRED') WHEN 5 THEN array('INBOX')
                 ELSE array('INBOX','UNREAD') END""").alias("labels"),
        _seconds_before_as_of(secs).alias("received_at"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = _read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return lab.select(
        F.col("doc_id").cast("string").alias("email_id"),
        F.when((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit("spam")).otherwise(F.lit("keep")).alias("user_label"),
        F.expr("""CASE (doc_id * 7919 + 3) % 1013 % 5 WHEN 0 THEN 'bootstrap_trash' WHEN 1 THEN 'daily_observation'
                 WHEN 2 THEN 'auto_clean:deletable:promo_temu' WHEN 3 THEN 'user_restore'
                 ELSE 'user_confirm' END""").alias("source"),
        _seconds_before_as_of((F.col("doc_id") * 48271 * 61) % (14 * 86400)).alias("created_at"),
    )


def label_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return ev.select(
        F.col("user_id").cast("string").alias("id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp_ntz").alias("changed_at"),
        F.expr("""CASE event_type WHEN 'signup' THEN array('INBOX','UNREAD') WHEN 'view' THEN array('INBOX')
                 WHEN 'click' THEN array('CATEGORY_UPDATES') WHEN 'purchase' THEN array('INBOX','STARRED')
                 ELSE array('TRASH') END""").alias("labels"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_emails(spark, sf_dir).select("id", "received_at")
    n = F.col("id").try_cast("bigint")
    return r.select(
        F.col("id").alias("email_id"),
        F.expr("""CASE TRY_CAST(id AS BIGINT) * 37 % 10 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'keep'
                 WHEN 2 THEN 'keep' ELSE 'spam' END""").alias("decision"),
        ((n * 37 % 101).cast("double") / 100).alias("confidence"),
        F.when(n % 3 == 0, F.lit("v2")).otherwise(F.lit("v1")).alias("model_version"),
        (n % 4 != 0).alias("executed"),
        (F.col("received_at") + F.expr("INTERVAL 1 DAY")).alias("decided_at"),
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir)
    return d.filter((F.col("decision") == "spam") & F.col("executed")
                    & (F.col("email_id").try_cast("bigint") % 7 != 0)).select(
        F.col("email_id").try_cast("int").alias("id"), "email_id",
        F.lit("auto_trash").alias("action"), F.col("decided_at").alias("performed_at"))


def raw_emails_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_emails(spark, sf_dir)
    n = F.col("id").try_cast("bigint")
    return r.unionAll(r.filter(n % 50 == 0)).unionAll(
        r.filter(n % 41 == 0).select(
            F.concat(F.lit("n"), "id").alias("id"), "thread_id", F.lit(None).cast("string").alias("sender"),
            "sender_domain", "subject", "snippet", "labels", "received_at")
    ).unionAll(
        r.filter(n % 43 == 0).select(
            F.concat(F.lit("r"), "id").alias("id"), "thread_id", "sender", "sender_domain",
            F.lit(None).cast("string").alias("subject"), "snippet", "labels",
            F.lit(None).cast("timestamp_ntz").alias("received_at"))
    )


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw provider JSON, one message per row (``value``), as a message feed would hold it."""
    r = raw_emails(spark, sf_dir)
    n = F.col("id").try_cast("bigint")
    headers = F.array(
        F.struct(F.lit("Date").alias("name"), F.lit("x").alias("value")),
        F.struct(F.when(n % 2 == 0, F.lit("FROM")).otherwise(F.lit("From")).alias("name"),
                 F.col("sender").alias("value")),
        F.struct(F.lit("subject").alias("name"), F.col("subject").alias("value")),
    )
    return r.select(F.to_json(F.struct(
        F.col("id").alias("id"), F.col("thread_id").alias("threadId"),
        F.struct(headers.alias("headers")).alias("payload"),
        F.unix_millis(F.col("received_at").cast("timestamp")).cast("string").alias("internalDate"),
        F.col("snippet").alias("snippet"), F.col("labels").alias("labelIds"))).alias("value"))


SPARK_VIEWS = {
    "raw_emails": raw_emails, "feedback": feedback, "label_events": label_events,
    "decisions": decisions, "audit_log": audit_log, "raw_emails_dirty": raw_emails_dirty,
    "raw_messages": raw_messages,
}


# ---------------------------------------------------------------------------
# DuckDB twins, used only in oracle SQL (FIXTURES.md, DuckDB form).
# ---------------------------------------------------------------------------
_AS_OF_DUCK = "TIMESTAMP '2024-02-01 00:00:00'"

ORACLE_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "raw_emails": (f"""
SELECT CAST(doc_id AS VARCHAR) AS id, 't' || CAST(doc_id - doc_id % 3 AS VARCHAR) AS thread_id,
 CASE WHEN h4 % 2 = 0 THEN loc || '@' || dom ELSE 'Sender <' || loc || '@' || dom || '>' END AS sender,
 dom AS sender_domain, pref || split_part(text, chr(10), 1) AS subject, text AS snippet,
 CASE h1 % 10 WHEN 0 THEN ['TRASH'] WHEN 1 THEN ['TRASH','UNREAD'] WHEN 2 THEN ['SPAM'] WHEN 3 THEN ['CATEGORY_UPDATES'] WHEN 4 THEN ['INBOX','STARRED'] WHEN 5 THEN ['INBOX'] ELSE ['INBOX','UNREAD'] END AS labels,
 {_AS_OF_DUCK} - to_seconds(CASE WHEN h3 % 4 = 0 THEN (doc_id * 48271 * 61) % (400 * 86400) ELSE (doc_id * 48271 * 61) % (30 * 86400) END) AS received_at
FROM (SELECT doc_id, text, (doc_id * 7919 + 13) % 1009 AS h1, (doc_id * 6151 + 5) % 991 AS h3, (doc_id * 57 + 11) % 109 AS h4,
  CASE WHEN source = 'src5' THEN 'security' ELSE 'user' || CAST(doc_id % 97 AS VARCHAR) END AS loc,
  CASE source WHEN 'src0' THEN 'mbank.pl' WHEN 'src1' THEN 'newsletter.allegro.pl' WHEN 'src2' THEN 'substack.com' WHEN 'src3' THEN 'business-updates.facebook.com' WHEN 'src4' THEN 'mail.beehiiv.com' WHEN 'src5' THEN 'vercel.com' ELSE source || '.example.com' END AS dom,
  CASE WHEN source = 'src3' THEN 'Nowa transakcja ' ELSE CASE (doc_id * 104729 + 7) % 997 % 12 WHEN 0 THEN 'Faktura VAT ' WHEN 1 THEN 'Re: ' WHEN 2 THEN 'TWOJE ZAMÓWIENIE ' WHEN 3 THEN 'Weekly digest ' WHEN 4 THEN 'Security alert: ' WHEN 5 THEN 'Potwierdzenie płatności ' ELSE '' END END AS pref FROM documents) q
""", ()),
    "feedback": (f"""
SELECT CAST(doc_id AS VARCHAR) AS email_id, CASE WHEN quality = 0 OR toxic = 1 THEN 'spam' ELSE 'keep' END AS user_label,
 CASE (doc_id * 7919 + 3) % 1013 % 5 WHEN 0 THEN 'bootstrap_trash' WHEN 1 THEN 'daily_observation' WHEN 2 THEN 'auto_clean:deletable:promo_temu' WHEN 3 THEN 'user_restore' ELSE 'user_confirm' END AS source,
 {_AS_OF_DUCK} - to_seconds((doc_id * 48271 * 61) % (14 * 86400)) AS created_at FROM labels
""", ()),
    "label_events": ("""
SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, ts AS changed_at,
 CASE event_type WHEN 'signup' THEN ['INBOX','UNREAD'] WHEN 'view' THEN ['INBOX'] WHEN 'click' THEN ['CATEGORY_UPDATES'] WHEN 'purchase' THEN ['INBOX','STARRED'] ELSE ['TRASH'] END AS labels FROM events
""", ()),
    "decisions": ("""
SELECT id AS email_id, CASE TRY_CAST(id AS BIGINT) * 37 % 10 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'keep' WHEN 2 THEN 'keep' ELSE 'spam' END AS decision,
 CAST(CAST(id AS BIGINT) * 37 % 101 AS DOUBLE) / 100 AS confidence, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'v2' ELSE 'v1' END AS model_version,
 CAST(id AS BIGINT) % 4 <> 0 AS executed, received_at + INTERVAL 1 DAY AS decided_at FROM raw_emails
""", ("raw_emails",)),
    "audit_log": ("""
SELECT CAST(email_id AS INT) AS id, email_id, 'auto_trash' AS action, decided_at AS performed_at FROM decisions WHERE decision = 'spam' AND executed AND CAST(email_id AS BIGINT) % 7 <> 0
""", ("decisions",)),
    "raw_emails_dirty": ("""
SELECT * FROM raw_emails UNION ALL SELECT * FROM raw_emails WHERE CAST(id AS BIGINT) % 50 = 0
UNION ALL SELECT 'n' || id, thread_id, NULL, sender_domain, subject, snippet, labels, received_at FROM raw_emails WHERE CAST(id AS BIGINT) % 41 = 0
UNION ALL SELECT 'r' || id, thread_id, sender, sender_domain, NULL, snippet, labels, NULL FROM raw_emails WHERE CAST(id AS BIGINT) % 43 = 0
""", ("raw_emails",)),
}


def oracle_with(*names: str) -> str:
    """``WITH`` prefix defining the named DuckDB views and their dependencies."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in ORACLE_VIEWS[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return ""
    return "WITH " + ",\n".join(f"{n} AS ({ORACLE_VIEWS[n][0].strip()})" for n in order) + "\n"
