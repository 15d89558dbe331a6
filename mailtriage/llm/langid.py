"""Language identification by compression.

For every language a raw-content zstandard dictionary is filled from a bounded sample of labelled documents.
A text is cut into pieces of ``PIECE`` bytes (all of them, so long texts are judged whole and no piece
learns from another), every piece is compressed with each dictionary, and the language with the smallest total wins.
Case says little about a language and costs matches, so texts and dictionaries are lower-cased. A narrow margin to the
runner-up is a rejection.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .text import refuse, tidy

#: The fit's bound: documents per language, and characters taken of each for the dictionary.
SAMPLE_DOCS, SAMPLE_CHARS = 200, 1200
#: Parts of a language that are ranked apart, so that the last rank sees SAMPLE_DOCS of each part at most.
SALTS = 32
#: Languages a fit may hold (a fit with more is refused, not cut).
MAX_LANGS = 500
PIECE, LEVEL, MIN_MATCH = 2048, 6, 4
#: Saved bits per byte between best and second, below which a text is rejected.
MARGIN = 0.02


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Language -> dictionary content, from rows with a text and a language.

    The sample is a fixed, documented bound of the fit: per language the ``SAMPLE_DOCS`` different texts of smallest
    hash, ``SAMPLE_CHARS`` characters of each. Equal texts count once. Only that sample reaches the driver.
    """
    h = F.xxhash64(F.col(text))
    rows = (labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0))
            .select(F.col(lang).alias("lang"), h.alias("h"), F.substring(F.col(text), 1, SAMPLE_CHARS).alias("t")))
    distinct = rows.groupBy("lang", "h").agg(F.min("t").alias("t"))  # copies go before they can take a place
    distinct = distinct.withColumn("salt", F.pmod("h", F.lit(SALTS)))  # the smallest of the smallest of each part
    for keys in (["lang", "salt"], ["lang"]):
        distinct = distinct.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("r") <= SAMPLE_DOCS)
    picked = distinct.select("lang", "h", "t").limit(SAMPLE_DOCS * MAX_LANGS + 1).collect()
    langs: dict[str, list] = {}
    for r in picked:
        langs.setdefault(r["lang"], []).append((r["h"], r["t"]))
    if len(langs) > MAX_LANGS or len(picked) > SAMPLE_DOCS * MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    return {k: "\n".join(t for _, t in sorted(v)).lower().encode() for k, v in sorted(langs.items())}


def predictions(dictionaries: dict[str, bytes], margin: float):
    """Arrow batches (.., text) -> (.., lang_pred, score, margin, rejected)."""

    def run(batches: Iterator) -> Iterator:
        import math

        import pyarrow as pa
        import regex
        import zstandard as z

        letter = regex.compile(r"\p{L}")
        coders = []
        for name, content in dictionaries.items():
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            p = z.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, window_log=19, write_content_size=0,
                                                       write_checksum=0, write_dict_id=0)
            d.precompute_compress(compression_params=p)
            coders.append((name, z.ZstdCompressor(compression_params=p, dict_data=d).compress))

        def judge(text: str | None) -> tuple:
            if not coders or text is None or not letter.search(text):
                return "und", 0.0, 0.0, True
            raw = text.lower().encode()
            pieces = [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]
            sizes = sorted((sum(len(code(p)) for p in pieces), name) for name, code in coders)
            if len(sizes) == 1:
                return sizes[0][1], 1.0, math.inf, False
            gain = 8 * (sizes[1][0] - sizes[0][0]) / len(raw)
            share = [math.exp(-20 * 8 * (s - sizes[0][0]) / len(raw)) for s, _ in sizes]
            return sizes[0][1], 1 / sum(share), gain, gain < margin

        for b in batches:
            got = [judge(t.as_py()) for t in b.column(b.num_columns - 1)]
            cols = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols],
                                             names=[*b.schema.names[:-1], "lang_pred", "score", "margin", "rejected"])

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keys: list[str], text: str = "text",
             margin: float = MARGIN) -> DataFrame:
    """``keys`` plus ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``rejected`` for every row, whole texts.

    A null text or one without a letter is ``und`` with score 0 and rejected, and so is every text if nothing
    was learned. Ties go to the first language by code point, with margin 0 (rejected). With one learned
    language the score is 1. Repeated rows are judged alike; other columns are not read. Keys named like a result
    column are refused.
    """
    refuse(keys, ["lang_pred", "score", "margin", "rejected"])
    part = docs.select(*keys, F.col(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1]]
                       + ["lang_pred string", "score double", "margin double", "rejected boolean"])
    return part.mapInArrow(tidy(predictions(dictionaries, margin)), schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2 (a null id: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame) -> dict[str, bytes]:
    return fit(docs.where(~held_out(F.col("doc_id"))))


def accepted(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Pipeline form: the rows of ``docs`` whose language is recognised, all columns, one pass over the text."""
    from pyspark.sql.types import BooleanType

    dictionaries = learn(docs)
    return docs.where(_verdict(dictionaries, margin, BooleanType())(F.col("text")))


def _verdict(dictionaries: dict[str, bytes], margin: float, kind):
    """The texts that are not rejected. The texts stay Arrow arrays, and a task makes its compressors once."""
    import pyarrow as pa

    def ok(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow as pa
        import pyarrow.compute as pc
        batches = (pa.RecordBatch.from_arrays([t], names=["t"]) for t in texts)
        for out in tidy(predictions(dictionaries, margin))(batches):
            yield pc.invert(out.column("rejected"))

    ok.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(ok, kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document's language, learned from documents outside the held-out quarter."""
    from .text import read
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, learn(docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")
