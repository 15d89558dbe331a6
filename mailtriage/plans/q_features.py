"""Registered queries: features (M1-M9).

Training rows are the labeled mail (J1: ``raw_emails`` joined with ``feedback``)
through M1, split by M9; vocabularies, the domain index and the scaler are
fitted on the training part and applied to all mail.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.packs import KEYWORD_COLS
from ..operators import features as FE
from ..session import AS_OF, cut
from ..sources import fixtures as fx
from ..sources import ingest as I
from . import oracle_sql as O
from .registry import query

A = O.AS_OF
TOK = r"'[\p{L}\p{N}_]{2,}'"
KW_SQL = O.keyword_flags_sql("subject")

TRAIN_SQL = fx.oracle_with("raw_emails", "feedback") + f""",
rows AS (SELECT r.id, lower(coalesce(r.sender_domain, '')) AS sender_domain, coalesce(r.subject, '') AS subject,
  coalesce(r.snippet, '') AS snippet, r.received_at, f.user_label
  FROM raw_emails r JOIN feedback f ON r.id = f.email_id),
feat AS (SELECT id, sender_domain, subject, snippet, user_label, length(subject) AS subject_len, length(snippet) AS snippet_len,
  coalesce(greatest({O.age_days()}, 0), 0) AS age_days, coalesce(hour(received_at), 0) AS hour_received, {KW_SQL},
  CASE WHEN substring(md5(id || ':42'), 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS split FROM rows),
train AS (SELECT * FROM feat WHERE split = 'train')
"""


def _train_rows(spark, sf):
    return FE.build_features(I.load_training_rows(fx.raw_emails(spark, sf), fx.feedback(spark, sf)), AS_OF)


def _train(spark, sf):
    tr, _ = FE.stratified_split(_train_rows(spark, sf))
    return tr


@query("build_features", sql=TRAIN_SQL + f"""
SELECT id, sender_domain, subject_len, snippet_len, age_days, hour_received, {", ".join(KEYWORD_COLS)} FROM feat""")
def q_build_features(spark, sf):
    return _train_rows(spark, sf).select("id", "sender_domain", "subject_len", "snippet_len", "age_days",
                                         "hour_received", *KEYWORD_COLS)


@query("stratified_split", sql=TRAIN_SQL + "SELECT id, user_label, split FROM feat")
def q_stratified_split(spark, sf):
    return _train_rows(spark, sf).select("id", "user_label", FE.split_column().alias("split"))


@query("tokenize", sql=fx.oracle_with("raw_emails") + f"""
SELECT id, regexp_extract_all(lower(coalesce(subject, '')), {TOK}) AS subject_tokens,
 regexp_extract_all(lower(coalesce(snippet, '')), {TOK}) AS snippet_tokens FROM raw_emails""")
def q_tokenize(spark, sf):
    return fx.raw_emails(spark, sf).select("id", FE.tokens(F.col("subject")).alias("subject_tokens"),
                                           FE.tokens(F.col("snippet")).alias("snippet_tokens"))


BIGRAM_SQL = f"""tok AS (SELECT id, regexp_extract_all(lower(coalesce(subject, '')), {TOK}) AS t FROM raw_emails),
terms AS (SELECT id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS terms FROM tok)"""


@query("ngrams_subject", sql=fx.oracle_with("raw_emails") + f", {BIGRAM_SQL} SELECT id, terms FROM terms")
def q_ngrams_subject(spark, sf):
    return fx.raw_emails(spark, sf).select("id", FE.subject_terms().alias("terms"))


def _vocab_sql(col: str, min_df: int, bigrams: bool) -> str:
    toks = f"regexp_extract_all(lower({col}), {TOK})"
    terms = (f"list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]))"
             if bigrams else "tk")
    return f""",
n_docs AS (SELECT count(*) AS n FROM train),
tt AS (SELECT id, {terms} AS terms FROM (SELECT id, {toks} AS tk FROM train)),
per AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM tt) GROUP BY id, term),
stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM per GROUP BY term),
vocab AS (SELECT term, df, total, ln((1 + (SELECT n FROM n_docs)) / (1 + df)) + 1 AS idf FROM stats
  WHERE df >= {min_df} AND df <= 0.9 * (SELECT n FROM n_docs))
"""


@query("vocabulary", sql=TRAIN_SQL + _vocab_sql("subject", 2, True) + """
SELECT term, df, total, round(idf, 6) AS idf FROM vocab""")
def q_vocabulary(spark, sf):
    """M4: the subject vocabulary (uni- and bigrams, df >= 2, df <= 0.9 n)."""
    tr = _train(spark, sf)
    n = tr.count()
    v = FE.select_vocabulary(FE.term_stats(tr, FE.subject_terms()), n, min_df=2)
    return v.select("term", "df", "total", F.round("idf", 6).alias("idf"))


def _tfidf_sql(col: str, min_df: int, bigrams: bool) -> str:
    toks = f"regexp_extract_all(lower(coalesce({col}, '')), {TOK})"
    terms = (f"list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]))"
             if bigrams else "tk")
    return (TRAIN_SQL + _vocab_sql(col, min_df, bigrams) + f""",
alltok AS (SELECT id, {terms} AS terms FROM (SELECT id, {toks} AS tk FROM raw_emails)),
ap AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM alltok) GROUP BY id, term),
w AS (SELECT ap.id, ap.term, (1 + ln(ap.tf)) * v.idf AS w FROM ap JOIN vocab v ON v.term = ap.term)
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w""")


def _tfidf_query(col: str, min_df: int, bigrams: bool):
    def q(spark, sf):
        terms = FE.subject_terms(col) if bigrams else FE.snippet_terms(col)
        v = FE.vocabulary_table(_train(spark, sf), terms, min_df=min_df)
        return FE.tfidf_long(fx.raw_emails(spark, sf), terms, v, digits=6)
    q.__doc__ = f"M5: sublinear TF-IDF of {col}, L2-normalised, long form (id, term, weight)."
    return q


query("tfidf_subject", sql=_tfidf_sql("subject", 2, True), bench=True)(_tfidf_query("subject", 2, True))
query("tfidf_snippet", sql=_tfidf_sql("snippet", 3, False))(_tfidf_query("snippet", 3, False))


@query("domain_onehot", sql=TRAIN_SQL + """,
dv AS (SELECT sender_domain, row_number() OVER (ORDER BY sender_domain) - 1 AS idx
  FROM (SELECT DISTINCT sender_domain FROM train WHERE sender_domain <> ''))
SELECT r.id, dv.idx AS domain_idx FROM raw_emails r LEFT JOIN dv ON dv.sender_domain = lower(coalesce(r.sender_domain, ''))""")
def q_domain_onehot(spark, sf):
    """M6: index of the mail's domain in the fitted domain vocabulary (null = all-zero block)."""
    idx = FE.fit_domains(_train(spark, sf))
    e = fx.raw_emails(spark, sf).select("id", F.lower(F.coalesce("sender_domain", F.lit(""))).alias("sender_domain"))
    return FE.domain_index(e, idx).select("id", "domain_idx")


@query("scale_numeric", sql=TRAIN_SQL + "SELECT " + ", ".join(
    f"round(coalesce(nullif(stddev_pop({c}), 0), 1), 6) AS {c}" for c in FE.SCALED_COLS) + " FROM train")
def q_scale_numeric(spark, sf):
    """M7: population standard deviation per numeric column (0 -> 1), the divisor of the scaler."""
    tr = _train(spark, sf)
    return tr.agg(*[F.round(F.coalesce(F.nullif(F.stddev_pop(F.col(c).cast("double")), F.lit(0.0)), F.lit(1.0)), 6)
                    .alias(c) for c in FE.SCALED_COLS])


@query("assemble")
def q_assemble(spark, sf):
    """M8: the full sparse feature vector per mail (rows-only: vectors have no SQL twin)."""
    fm = FE.fit_features(cut(_train(spark, sf), "training"))
    feats = FE.build_features(fx.raw_emails(spark, sf), AS_OF)
    return FE.assemble(feats, fm, keep=("id",)).select("id", "features")
