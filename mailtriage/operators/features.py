"""Text and numeric features (M1-M9), with the formulas of the reference's model.

Fit steps aggregate over the training rows and keep only bounded results:
a vocabulary of at most ``max_features`` terms per text column, 16
standard deviations, and a written table of all domains. Transform steps: tokens and in-row term counts per row,
a broadcast hash join with the (bounded) vocabulary, and one aggregation by
id for the L2 norm. A mail's terms are counted in its own row, so that no row per term is shuffled; only mails whose
id repeats are counted together by (id, term).

TF-IDF (scikit-learn's ``TfidfVectorizer`` with ``sublinear_tf=True``):
    tf  = 1 + ln(count in the row)
    idf = ln((1 + n) / (1 + df)) + 1          n = training rows
    w   = tf * idf, then divided by the row's L2 norm
Spark ML's ``IDF`` uses ln((n + 1) / (df + 1)) without the +1 and applies no
norm, so it is not used.
"""
from __future__ import annotations

import datetime as _dt
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions.packs import KEYWORD_COLS, NUMERIC_COLS
from ..session import AS_OF, cut

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"      # tokens of >= 2 word characters (Unicode)
SPLIT_SEED = 42
MODEL_FEATURES = 5000                      # terms per text block of a trained model (its size, not the vocabulary's)
TEST_FRACTION_HEX = "33333333"             # md5 prefix below this: ~20 % test rows


# M1 --------------------------------------------------------------------------
def build_features(df: DataFrame, as_of: _dt.datetime = AS_OF, snippet_chars: int | None = None,
                   clock: str | None = None) -> DataFrame:
    """M1: P5 + P7-P10 in one projection; mailbox labels are deliberately not features.

    Whole texts by default; ``snippet_chars`` (``packs.SNIPPET_CHARS`` is the classic value) cuts the snippet.
    ``clock`` names a time column that the age is measured at instead of ``as_of`` (Q20: the feedback's time); where
    that is null, ``as_of`` holds.
    """
    subject = F.coalesce(F.col("subject"), F.lit(""))
    snippet = F.coalesce(F.col("snippet"), F.lit(""))
    if snippet_chars is not None:
        snippet = S.truncate_text(snippet, snippet_chars)
    keep = [c for c in df.columns if c not in ("subject", "snippet", "sender_domain")]
    age = S.age_days_clipped(F.col("received_at"), as_of)
    if clock is not None:
        micros = F.unix_micros(F.col(clock).cast("timestamp")) - F.unix_micros(F.col("received_at").cast("timestamp"))
        at_clock = F.greatest(F.floor(micros / F.lit(float(S.MICROS_PER_DAY))).cast("bigint"), F.lit(0).cast("bigint"))
        age = F.when(F.col(clock).isNotNull() & F.col("received_at").isNotNull(), at_clock).otherwise(age)
    return df.select(
        *keep,
        F.lower(F.coalesce(F.col("sender_domain"), F.lit(""))).alias("sender_domain"),
        subject.alias("subject"), snippet.alias("snippet"),
        F.length(subject).alias("subject_len"), F.length(snippet).alias("snippet_len"),
        F.coalesce(age, F.lit(0).cast("bigint")).alias("age_days"),
        S.hour_received(F.col("received_at")).alias("hour_received"),
        *S.keyword_flags(subject),
    )


# M2 / M3 ---------------------------------------------------------------------
def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once a row, as the element of an array. A column of its own would be copied to
    each place that uses it, also into a lambda, where it is worked out for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def tokens(text: Column) -> Column:
    """M2: lower-cased runs of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def with_bigrams(tok: Column) -> Column:
    """M3: unigrams followed by space-joined bigrams."""
    return once(tok, _with_bigrams)


def _with_bigrams(tok: Column) -> Column:
    n = F.greatest(F.size(tok) - 1, F.lit(0))
    big = F.zip_with(F.slice(tok, 1, n), F.slice(tok, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(tok, big)


def subject_terms(col: str = "subject") -> Column:
    return with_bigrams(tokens(F.col(col)))


def snippet_terms(col: str = "snippet") -> Column:
    return tokens(F.col(col))


# M4 --------------------------------------------------------------------------
def term_stats(docs: DataFrame, terms: Column, id_col: str = "id") -> DataFrame:
    """Per term: document frequency and total count over ``docs``.

    Terms are counted in the row, then by term, which combines map-side, so a very common term is one row per task.
    """
    return (term_counts(docs, terms, id_col).groupBy("term")
            .agg(F.count(F.lit(1)).alias("df"), F.sum("cnt").cast("bigint").alias("total")))


def select_vocabulary(stats: DataFrame, n_docs: int, min_df: int, max_df: float = 0.9,
                      max_features: int | None = None) -> DataFrame:
    """M4: df >= min_df, df <= max_df * n, with the smoothed idf. All terms by default;
    ``max_features`` keeps those of highest total count (term breaks ties)."""
    v = stats.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n_docs)))
    if max_features is not None:
        v = v.orderBy(F.col("total").desc(), F.col("term")).limit(max_features)
    idf = F.log(F.lit(float(1 + n_docs)) / (F.col("df") + 1)) + 1
    return v.select("term", "df", "total", idf.alias("idf"))


@dataclass
class Vocabulary:
    """A fitted vocabulary: terms in index order (alphabetical, as scikit-learn) and idf."""
    terms: list[str]
    idf: list[float]
    n_docs: int = 0

    @property
    def size(self) -> int:
        return len(self.terms)


def vocabulary_table(docs: DataFrame, terms: Column, min_df: int, max_df: float = 0.9) -> DataFrame:
    """The uncut vocabulary (term, df, total, idf) as a written table; nothing comes to the driver but the row count."""
    return cut(select_vocabulary(term_stats(docs, terms), docs.count(), min_df, max_df), "vocabulary")


def fit_vocabulary(docs: DataFrame, terms: Column, min_df: int, max_df: float = 0.9,
                   max_features: int = MODEL_FEATURES, n_docs: int | None = None) -> Vocabulary:
    """Fit for a model: the selected terms, ``max_features`` at most (the model's documented size), come back to the driver."""
    n = n_docs if n_docs is not None else docs.count()
    rows = select_vocabulary(term_stats(docs, terms), n, min_df, max_df, max_features).collect()
    rows.sort(key=lambda r: r["term"])
    return Vocabulary([r["term"] for r in rows], [float(r["idf"]) for r in rows], n)


# M5 --------------------------------------------------------------------------
def vocabulary_frame(spark, v: Vocabulary) -> DataFrame:
    """The fitted vocabulary as a small DataFrame (term, idx, idf): at most ``max_features`` rows."""
    rows = [(t, i, w) for i, (t, w) in enumerate(zip(v.terms, v.idf))]
    return spark.createDataFrame(rows, "term string, idx int, idf double")


def split_repeated(df: DataFrame, id_col: str = "id", always: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id is there once, and the other rows (None: there are none; ``always``: a frame all the same, which
    costs nothing once Spark finds the ids empty). Nulls count as one id.

    Only ids are shuffled to tell them apart; the repeated ones are written, so Spark knows the size of what it joins.
    """
    n = df.groupBy(F.col(id_col).alias("_rid")).agg(F.count(F.lit(1)).alias("_n"))
    ids = cut(n.where("_n > 1").select("_rid"), "repeated-ids")
    same = F.col(id_col).eqNullSafe(F.col("_rid"))
    none = ids.isEmpty()
    single = df if none else df.join(ids, same, "left_anti")
    return single, None if none and not always else df.join(ids, same, "left_semi")


def row_counts(df: DataFrame, blocks: dict[str, Column], *keep: str) -> DataFrame:
    """(keep, block, term, cnt): the different terms of each row with their count, by the runs of the sorted terms."""
    t = df.select(*keep, *[F.sort_array(c).alias(f"_t{k}") for k, c in enumerate(blocks.values())])
    none = F.array().cast("array<int>")

    def starts(k: int) -> Column:
        arr = F.col(f"_t{k}")
        places = F.when(F.size(arr) > 0, F.sequence(F.lit(0), F.size(arr) - 1)).otherwise(none)
        return F.filter(places, lambda i: ~F.get(arr, i).eqNullSafe(F.get(arr, i - 1))).alias(f"_s{k}")

    def runs(k: int, block: str) -> Column:
        arr, first = F.col(f"_t{k}"), F.col(f"_s{k}")
        return F.transform(first, lambda x, i: F.struct(
            F.lit(block).alias("block"), F.get(arr, x).alias("term"),
            (F.coalesce(F.get(first, i + 1), F.size(arr)) - x).cast("bigint").alias("cnt")))

    t = t.select("*", *[starts(k) for k in range(len(blocks))])
    return t.select(*keep, F.inline(F.concat(*[runs(k, b) for k, b in enumerate(blocks)])))


def grouped_counts(df: DataFrame, blocks: dict[str, Column], *keep: str) -> DataFrame:
    """As ``row_counts``, over all rows with the same ``keep`` (counts combine map-side)."""
    tag = lambda b, c: F.transform(c, lambda t: F.struct(F.lit(b).alias("block"), t.alias("term")))
    t = df.select(*keep, F.inline(F.concat(*[tag(b, c) for b, c in blocks.items()])))
    return t.groupBy(*keep, "block", "term").agg(F.count(F.lit(1)).alias("cnt"))


def block_term_counts(df: DataFrame, blocks: dict[str, Column], id_col: str = "id", *keep: str) -> DataFrame:
    """(id, keep, block, term, cnt): each mail's distinct terms with their count, rows of a repeated id taken together."""
    single, repeated = split_repeated(df, id_col, always=True)
    return row_counts(single, blocks, id_col, *keep).unionByName(grouped_counts(repeated, blocks, id_col, *keep))


def term_counts(df: DataFrame, terms: Column, id_col: str = "id") -> DataFrame:
    """(id, term, cnt): each mail's distinct terms with their count (linear in the text, no shuffle of terms)."""
    return block_term_counts(df, {"": terms}, id_col).drop("block")


def _normed(counts: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    j = counts.join(vocab, "term", "inner")
    j = j.withColumn("_w", (F.lit(1.0) + F.log(F.col("cnt").cast("double"))) * F.col("idf"))
    from pyspark.sql import Window
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return j.select(id_col, "term", (F.col("_w") / norm).alias("w"))


def tfidf_weights(df: DataFrame, terms: Column, vocab: DataFrame, id_col: str = "id") -> DataFrame:
    """M5: (id, term, w) with L2-normalised sublinear TF-IDF weights.

    Plan: the texts are dealt by id once -> counts in the row -> hash join with the vocabulary, which Spark
    broadcasts only if its size allows -> one window aggregation per id for the norm, on the partitioning by id.
    """
    single, repeated = split_repeated(df, id_col)
    out = _normed(row_counts(single.repartition(id_col), {"": terms}, id_col), vocab, id_col)
    if repeated is not None:
        out = out.unionByName(_normed(grouped_counts(repeated, {"": terms}, id_col), vocab, id_col))
    return out


def tfidf_long(df: DataFrame, terms: Column, vocab: DataFrame, id_col: str = "id", digits: int = 9) -> DataFrame:
    """M5 in long form: one row per (mail, term) with its weight (the relational feature matrix),
    over a vocabulary table of any size."""
    return tfidf_weights(df, terms, vocab, id_col).select(id_col, "term", F.round("w", digits).alias("weight"))


def tfidf_arrays(df: DataFrame, blocks: dict[str, tuple[Column, Vocabulary, int]], id_col: str = "id") -> DataFrame:
    """Per id and block (terms, vocabulary, offset): ``{block}_idx``, ``{block}_w`` arrays sorted by index, shifted by the
    offset. Ids without a known term are absent (join back with ``left``).

    The texts of ids that are there once are dealt by id, and nothing after that is shuffled.
    """
    spark = df.sparkSession
    terms = {b: t for b, (t, _, _) in blocks.items()}
    vocab = None
    for b, (_, v, off) in blocks.items():
        t = vocabulary_frame(spark, v).select(F.lit(b).alias("block"), "term", (F.col("idx") + off).alias("i"), "idf")
        vocab = t if vocab is None else vocab.unionByName(t)

    def collected(counts: DataFrame) -> DataFrame:
        j = counts.join(F.broadcast(vocab), ["block", "term"])      # at most max_features rows a block
        w = ((F.lit(1.0) + F.log(F.col("cnt").cast("double"))) * F.col("idf")).alias("w")
        g = j.select(id_col, "block", "i", w).groupBy(id_col).agg(
            *[F.sort_array(F.collect_list(F.when(F.col("block") == b, F.struct("i", "w")))).alias(f"_e_{b}") for b in blocks])

        def divided(b: str) -> Column:
            w = F.col(f"_e_{b}.w")
            norm = F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x))
            return once(norm, lambda n: F.transform(w, lambda x: x / n)).alias(f"{b}_w")

        return g.select(id_col, *[c for b in blocks for c in (F.col(f"_e_{b}.i").alias(f"{b}_idx"), divided(b))])

    single, repeated = split_repeated(df, id_col)
    out = collected(row_counts(single.repartition(id_col), terms, id_col))
    return out if repeated is None else out.unionByName(collected(grouped_counts(repeated, terms, id_col)))


# M6 --------------------------------------------------------------------------
@dataclass
class ValueIndex:
    """A fitted dense index: a written table (value, idx) in the order of the values, and its size."""
    table: DataFrame
    size: int


def dense_index(values: DataFrame, col: str) -> ValueIndex:
    """Every different non-null value of ``col`` with its place (0, 1, ..) in ascending order.

    The values are range-partitioned and written sorted; each row's place in its partition plus the running count of
    the partitions before it is its index. Only the number of values comes to the driver, and the table of counts has one
    row per partition. No values give an empty table.
    """
    distinct = values.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
    placed = cut(distinct.repartitionByRange("value").sortWithinPartitions("value")
                 .select("value", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")), "index-places")
    per = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    from pyspark.sql import Window
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    start = per.select("_p", "_first", F.coalesce(before, F.lit(0)).alias("_start"))
    table = cut(placed.join(F.broadcast(start), "_p").select("value", (F.col("_m") - F.col("_first") + F.col("_start")).alias("idx")), "index")
    return ValueIndex(table, table.count())


def fit_domains(docs: DataFrame, col: str = "sender_domain") -> ValueIndex:
    """M6: all non-empty domains seen, alphabetical, as a table of any size."""
    return dense_index(docs.where(F.col(col) != ""), col)


def domain_index(df: DataFrame, index: ValueIndex, col: str = "sender_domain", out: str = "domain_idx") -> DataFrame:
    """Index of the domain in the fitted table, null for '' / null / unseen (an all-zero block): a join, no closure."""
    t = index.table.select(F.col("value").alias("_value"), F.col("idx").cast("int").alias(out))
    return df.join(t, F.col(col) == F.col("_value"), "left").drop("_value")


# M7 --------------------------------------------------------------------------
SCALED_COLS = NUMERIC_COLS + KEYWORD_COLS


def fit_scaler(df: DataFrame, cols: list[str] = SCALED_COLS) -> list[float]:
    """M7: population std per column (one aggregate); 0 -> 1, so constants stay unchanged."""
    row = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return [float(row[c]) if row[c] not in (None, 0.0) and not math.isnan(row[c]) else 1.0 for c in cols]


def scaled(cols: list[str], stds: list[float]) -> list[Column]:
    """Divide by the std, no centering."""
    return [(F.col(c).cast("double") / F.lit(s)).alias(c) for c, s in zip(cols, stds)]


# M8 --------------------------------------------------------------------------
@dataclass
class FeatureModel:
    """Everything the transform needs: two vocabularies, the domain table, 16 stds."""
    subject: Vocabulary
    snippet: Vocabulary
    domains: ValueIndex
    stds: list[float]
    as_of: _dt.datetime = AS_OF
    meta: dict = field(default_factory=dict)

    @property
    def size(self) -> int:
        return self.subject.size + self.snippet.size + self.domains.size + len(SCALED_COLS)


def fit_features(train: DataFrame, as_of: _dt.datetime = AS_OF, max_features: int = MODEL_FEATURES) -> FeatureModel:
    """Fit all blocks on the training rows (already passed through ``build_features``)."""
    n = train.count()
    subj = fit_vocabulary(train, subject_terms(), min_df=2, max_df=0.9, max_features=max_features, n_docs=n)
    snip = fit_vocabulary(train, snippet_terms(), min_df=3, max_df=0.9, max_features=max_features, n_docs=n)
    return FeatureModel(subj, snip, fit_domains(train), fit_scaler(train), as_of)


def assemble(df: DataFrame, fm: FeatureModel, out: str = "features", id_col: str = "id", keep: tuple[str, ...] | None = None) -> DataFrame:
    """M8: blocks [subject TF-IDF | snippet TF-IDF | domain one-hot | 16 scaled numbers] as
    one sparse vector per row of ``df`` (rows of ``build_features``), beside its columns (``keep``: only these).

    The two text blocks come from ``tfidf_arrays`` (the texts are shuffled by id once, their terms not)
    and are joined back on the id; all arithmetic is JVM-side. The finished
    (index, value) arrays are written in the storage form of Spark ML's vector
    type and read back as vectors, so no Python touches a row.
    """
    off_n = fm.subject.size
    off_d = off_n + fm.snippet.size
    off_x = off_d + fm.domains.size
    arrays = tfidf_arrays(df, {"_s": (subject_terms(), fm.subject, 0), "_n": (snippet_terms(), fm.snippet, off_n)}, id_col)
    keep = list(df.columns if keep is None else keep)
    d = domain_index(df, fm.domains).select(*keep, *[c for c in ("domain_idx",) if c not in keep],
                                            F.array(*scaled(SCALED_COLS, fm.stds)).alias("_x")).join(arrays, id_col, "left")
    x_idx = F.array(*[F.lit(i) for i in range(off_x, off_x + len(SCALED_COLS))])
    nz = F.filter(F.arrays_zip(x_idx.alias("i"), F.col("_x").alias("v")), lambda e: e["v"] != 0)
    empty_i, empty_v = F.array().cast("array<int>"), F.array().cast("array<double>")
    dom_i = F.when(F.col("domain_idx").isNotNull(), F.array(F.col("domain_idx") + off_d)).otherwise(empty_i)
    dom_v = F.when(F.col("domain_idx").isNotNull(), F.array(F.lit(1.0))).otherwise(empty_v)
    idx = F.concat(F.coalesce("_s_idx", empty_i), F.coalesce("_n_idx", empty_i), dom_i, F.transform(nz, lambda e: e["i"]))
    val = F.concat(F.coalesce("_s_w", empty_v), F.coalesce("_n_w", empty_v), dom_v, F.transform(nz, lambda e: e["v"]))
    vec = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(fm.size).alias("size"), idx.alias("indices"), val.alias("values"))
    return as_vectors(d.select(*keep, *[c for c in ("domain_idx",) if c not in keep], vec.alias(out)), out)


def as_vectors(df: DataFrame, col: str) -> DataFrame:
    """``df`` written once, with the struct ``col`` (type 0, size, indices, values) read back as a sparse vector."""
    from pyspark.ml.linalg import VectorUDT
    schema = T.StructType([T.StructField(x.name, VectorUDT() if x.name == col else x.dataType) for x in df.schema.fields])
    return cut(df, "vectors", schema)


# M9 --------------------------------------------------------------------------
def split_key(id_col: str = "id", seed: int = SPLIT_SEED) -> Column:
    return F.substring(F.md5(F.concat(F.col(id_col), F.lit(f":{seed}"))), 1, 8)


def stratified_split(df: DataFrame, id_col: str = "id", seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """M9: ~80/20 within each class by a hash of the id: deterministic, no shuffle, no global
    rank, and each class is cut at the same point of the hash order (stratified)."""
    is_test = split_key(id_col, seed) < TEST_FRACTION_HEX
    return df.filter(~is_test), df.filter(is_test)


def split_column(id_col: str = "id", seed: int = SPLIT_SEED) -> Column:
    return F.when(split_key(id_col, seed) < TEST_FRACTION_HEX, F.lit("test")).otherwise(F.lit("train"))
