"""Line-first quality rules.

Every line with a word is judged by itself: it must end like a sentence and not be mostly punctuation, must not be a
navigation bar, and must not be boilerplate. Failing lines are removed; a document that loses too large a share of
its characters is rejected. All in DataFrame functions, one narrow pass without a shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .text import SPACE, free_name, read, refuse, words

# Patterns read alike by Java and RE2.
#: A line ends in a sentence mark, optionally followed by closing quotes or brackets.
SENTENCE_END = r"[.!?…。！？؟।:;][\"'”’»)\]]*[\x20\x09-\x0D]*$"
NOT_PUNCTUATION = r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+"
NAVIGATION = r"^(?:[^|»›·>]*[|»›·>]){3}"
BOILERPLATE = (r"(?i)\b(?:all rights reserved|cookies? policy|accept (?:all )?cookies|privacy policy|terms of (?:use|service)|"
               r"enable javascript|javascript is (?:disabled|required)|click here|skip to (?:main )?content|"
               r"sign up (?:now|for our)|subscribe to our|share (?:this|on)|lorem ipsum|powered by|back to top)\b")
#: Largest share of a line's characters, white space aside, that may be punctuation, and of a document's that may be lost.
MAX_PUNCTUATION, MAX_LOSS = 0.25, 0.30


def line_passes(line: Column) -> Column:
    solid = F.length(F.regexp_replace(line, SPACE, ""))
    marks = F.length(F.regexp_replace(line, NOT_PUNCTUATION, ""))
    return (line.rlike(SENTENCE_END) & (marks <= F.lit(MAX_PUNCTUATION) * solid)
            & ~line.rlike(NAVIGATION) & ~line.rlike(BOILERPLATE))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``clean_text``, ``n_lines``, ``n_removed``, ``lost`` and ``passes``.

    Lines are split at \\n. Lines without a word are kept but count for nothing. ``lost`` is the share of the
    characters of lines with a word that stood in removed lines (0 if there are none); ``passes`` is
    ``lost <= MAX_LOSS``. A null text has a null clean_text, no lines, and passes; whole texts are read, and
    repeated rows are judged alike.
    """
    n = free_name(docs.columns, "__judged")
    refuse(docs.columns, ["clean_text", "n_lines", "n_removed", "lost", "passes"])
    judged = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
                         lambda s: F.struct(s.alias("s"), has_word(s).alias("w"), line_passes(s).alias("ok")))
    out = docs.withColumn(n, judged)
    chars = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["s"]))
    real, bad = F.filter(F.col(n), lambda x: x["w"]), F.filter(F.col(n), lambda x: x["w"] & ~x["ok"])
    out = out.withColumn(f"{n}r", real).withColumn(f"{n}b", bad)
    total, gone = chars(F.col(f"{n}r")), chars(F.col(f"{n}b"))
    lost = F.when(F.size(f"{n}b") == 0, F.lit(0.0)).otherwise(gone / total)
    clean = F.array_join(F.transform(F.filter(F.col(n), lambda x: ~x["w"] | x["ok"]), lambda x: x["s"]), "\n")
    return out.select(*[F.col(c) for c in docs.columns], F.when(F.col(text).isNotNull(), clean).alias("clean_text"),
                      F.size(f"{n}r").cast("bigint").alias("n_lines"), F.size(f"{n}b").cast("bigint").alias("n_removed"),
                      lost.alias("lost"), (lost <= MAX_LOSS).alias("passes"))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. Null texts count as empty. Columns of these names are refused.

    Windows are compared by a 64-bit hash within one document; repeats are found by sorting the hashes with their
    places, so a long text costs n log n.
    """
    refuse(docs.columns, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
    p = free_name(docs.columns, "__base")
    t = F.coalesce(F.col(text), F.lit(""))
    w, h, o, q, lines = (f"{p}{x}" for x in "whoql")
    d = docs.withColumn(w, words(t))
    hashes = F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(
        *[F.get(F.col(w), i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn(h, hashes)
    d = d.withColumn(o, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(
        F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, i: F.coalesce(F.get(F.col(o), i)["h"] == x["h"], F.lit(False))
    d = d.withColumn(q, F.sort_array(F.transform(F.filter(F.col(o), lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])))
    covered = F.aggregate(F.transform(F.col(q), lambda x, i: F.least(F.lit(5), F.coalesce(F.get(F.col(q), i + 1) - x, F.lit(5)))),
                          F.lit(0), lambda a, x: a + x)
    d = d.withColumn(lines, F.filter(F.split(t, "\n"), has_word))
    return d.select(*[F.col(c) for c in docs.columns], F.size(w).cast("bigint").alias("n_words"),
                    F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                    (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
                    (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
                    F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: base counts, the base verdict and the line rules' verdict for every document."""
    d = clean_lines(base_counts(read(spark, sf_dir, "documents").select("doc_id", "text")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                    (~failed & F.col("passes")).alias("kept"), "n_lines", "n_removed",
                    F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"))


_q = lambda s: s.replace("'", "''")
ORACLE = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
win as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 4)) as i from w where len(w) >= 5)),
rep as (select doc_id, i, count(*) over (partition by doc_id, g) as n from win),
cov as (select doc_id, sum(least(5, coalesce(nx - i, 5))) as n_repeat_words
        from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nx from rep where n > 1) group by doc_id),
judged as (select doc_id, list_transform(string_split(t, chr(10)), lambda s: {{'s': s, 'w': regexp_matches(s, '[^\x20\x09-\x0D]'),
        'ok': regexp_matches(s, '{_q(SENTENCE_END)}')
          and length(regexp_replace(s, '{NOT_PUNCTUATION}', '', 'g')) <= {MAX_PUNCTUATION}::double * length(regexp_replace(s, '{SPACE}', '', 'g'))
          and not regexp_matches(s, '{NAVIGATION}') and not regexp_matches(s, '{BOILERPLATE}')}}) as j from d),
v as (select doc_id, len(list_filter(j, lambda x: x.w))::bigint as n_lines, len(list_filter(j, lambda x: x.w and not x.ok))::bigint as n_removed,
        coalesce(list_sum(list_transform(list_filter(j, lambda x: x.w), lambda x: length(x.s))), 0) as total,
        coalesce(list_sum(list_transform(list_filter(j, lambda x: x.w and not x.ok), lambda x: length(x.s))), 0) as gone,
        sha256(array_to_string(list_transform(list_filter(j, lambda x: not x.w or x.ok), lambda x: x.s), chr(10))) as clean_sha256 from judged),
b as (select w.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::bigint as n_symbols,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from w left join cov on w.doc_id = cov.doc_id)
select b.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and case when n_removed = 0 then 0.0 else gone / total end <= {MAX_LOSS}::double as kept,
  n_lines, n_removed, clean_sha256
from b join v on b.doc_id = v.doc_id
"""
