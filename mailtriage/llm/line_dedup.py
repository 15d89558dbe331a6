"""Fuzzy line deduplication by MinHash.

A line's shingles are all runs of ``WIDTH`` characters (lower case, white space as one blank), in any script; a shorter
line is its own shingle. Each shingle has one 64-bit hash. The hashes' range is cut into ``BANDS`` equal parts; a band's
key is made of the ``ROWS`` smallest hashes of its part (fewer, if the line has no more there; no key, if it has none).
Lines that agree in a band share a bucket.

In a bucket, every line is first compared with the bucket's most frequent line (a star, linear in the bucket).
The exact Jaccard index of the shingle sets decides. Union-find joins the links. Where lines of one bucket are
still in different components, those outside its largest component are compared, again exactly, with all others of the
bucket: pair by pair in small buckets, by the lines' rarest shingles in larger ones, so no link inside a bucket is lost.
Of each component one line stays: the first by doc_id and place.

The smallest hashes of the union of two large sets lie in both of them about as often as the minima of that many
independent hashes agree: with similarity 0.8 two lines share one of 8 bands of 4 with probability of about 0.985, with
0.9 0.9999 (``test_native_bands`` asks for 0.97 on lines of 60 to 180 characters). All of it is DataFrame functions. Copies of a line are collapsed by partial
aggregation. Most lines have no partner; a bit filter of fixed size lets the later passes skip nearly all of them (it
only ever lets too much through).
"""
from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from mailtriage.session import cut

from .text import SPACE, SPACE_CHARS, free_name, hex16, read
from .union_find import components

SIMILARITY, WIDTH, BANDS, ROWS = 0.8, 12, 8, 4
#: Longs of the bit filter: 1 MB, whatever the input.
FILTER_LONGS = 1 << 17
#: Lines of the largest bucket whose lines meet pair by pair; larger ones meet by their rarest shingles.
CHUNK = 32


def normal(line: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    other = [F.contains(line, F.lit(x)) for x in ("  ", *SPACE_CHARS[1:])]  # few lines have any; searching is cheaper than replacing
    return F.lower(F.btrim(F.when(reduce(or_, other), F.regexp_replace(line, SPACE, " ")).otherwise(line), F.lit(" ")))


def shingles(line: Column) -> Column:
    """Array of the 64-bit hashes of all shingles of a normal line, repeats included."""
    # four bytes a character: every shingle is cut out by its place
    each = lambda u: F.transform(F.sequence(F.lit(1), F.greatest(F.length(u) - 4 * WIDTH + 1, F.lit(1)), F.lit(4)),
                                 lambda i: F.xxhash64(F.substring(u, i, F.lit(4 * WIDTH))))
    return F.get(F.transform(F.array(F.encode(line, "UTF-32")), each), F.lit(0))


#: The first hashes of the bands' parts, but for the first band's.
STARTS = [(b << 64) // BANDS - (1 << 63) for b in range(1, BANDS)]


def parts(s: str) -> Column:
    """The first ``2 * ROWS`` hashes of each band's part, from column ``s`` of sorted hashes with a mark at each part's start."""
    marks = [F.lit(0), *[F.array_position(s, F.lit(x)).cast("int") for x in STARTS], F.size(s) + 1]
    return F.array(*[F.slice(s, before + 1, F.least(after - before - 1, F.lit(2 * ROWS))) for before, after in zip(marks, marks[1:])])


def with_bands(lines: DataFrame) -> DataFrame:
    """``lines(.., line)`` of normal lines with the keys of its bands, b0, b1, .., instead; null where a part has no hash."""
    rest = [c for c in lines.columns if c != "line"]
    marked = F.concat(shingles(F.col("line")), F.array(*[F.lit(x) for x in STARTS]))
    cut_up = lines.select(*rest, F.sort_array(marked).alias("s")).select(*rest, "s", parts("s").alias("parts"))
    rising = lambda p: reduce(and_, [F.get(p, F.lit(k)) < F.get(p, F.lit(k + 1)) for k in range(ROWS - 1)])
    different = F.transform("parts", lambda p: F.when(rising(p), p).otherwise(F.array_distinct(p)))
    each = cut_up.select(*rest, "s", "parts", different.alias("few"))
    # a line that repeats itself may have too few different hashes among a part's first: all its repeats go
    same = F.exists(F.zip_with("parts", "few", lambda p, d: (F.size(p) == 2 * ROWS) & (F.size(d) < ROWS)), lambda x: x)
    once = each.select(*rest, "few", F.when(same, F.array_distinct("s")).alias("d"))
    full = F.when(F.col("d").isNull(), F.col("few")).otherwise(parts("d"))
    keys = F.transform(full, lambda p, b: F.when(F.size(p) > 0, F.xxhash64(b, F.slice(p, 1, ROWS))))
    return once.select(*rest, keys.alias("keys")).select(*rest, *[F.get("keys", F.lit(b)).alias(f"b{b}") for b in range(BANDS)])


# The same for a few lines in numpy, with independent hashes instead of parts of one hash's range.

def shingle_hashes(lines: list[str]) -> tuple["np.ndarray", "np.ndarray"]:
    """64-bit hashes of all shingles of normal lines, and where each line's begin."""
    import numpy as np
    lines = [x if len(x) >= WIDTH else x.ljust(WIDTH, "\0") for x in lines]
    sizes = np.array([len(x) for x in lines])
    c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    base = 0x9E3779B97F4A7C15
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    two = c[:-1] * power(1) + c[1:]
    four = two[:-2] * power(2) + two[2:]
    eight = four[:-4] * power(4) + four[4:]
    h = eight[:-4] * power(4) + four[8:]
    ends = np.cumsum(sizes)
    inside = np.ones(len(h), bool)
    gaps = ends[:-1, None] - np.arange(WIDTH - 1, 0, -1)  # windows that reach into the next line
    inside[gaps.ravel()] = False
    h = h[inside]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h, np.concatenate([[0], np.cumsum(sizes - WIDTH + 1)[:-1]])


def band_keys(h: "np.ndarray", starts: "np.ndarray") -> "np.ndarray":
    """The buckets of each line (a row each): hashes of ``ROWS`` minima of independent hashes of its shingle hashes."""
    import numpy as np
    r = np.random.default_rng(1)
    words = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(starts), b + 1, np.uint64)
        for k in range(ROWS):
            mul, add, mul2 = (np.uint32(x) for x in r.integers(1, 1 << 32, 3, dtype=np.uint64))
            v = words[k % 2] * (mul | np.uint32(1)) + add
            v ^= v >> np.uint32(15)
            v *= mul2 | np.uint32(1)
            least = np.minimum.reduceat(v, starts).astype(np.uint64)
            key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, b] = key
    return out.view(np.int64)


def shingle_set(normal_line: str) -> "np.ndarray":
    """The distinct shingles of a line, as sorted hashes."""
    import numpy as np
    return np.unique(shingle_hashes([normal_line])[0])


def occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, th, pos, line, h1, h2) of every line with a word; th is the text's hash, h1 and h2 the line's identity."""
    lines = docs.select("doc_id", F.xxhash64(text).alias("th"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    lines = lines.where(F.length(F.btrim("line", F.lit(SPACE_CHARS))) > 0)
    return lines.select("doc_id", "th", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h1, h2, copies, b0, b1, ..) of each distinct line with a word; h1 and h2 as in ``occurrences``."""
    lines = with_bands(occurrences(docs, text).select("h1", "h2", normal(F.col("line")).alias("line")))
    return lines.groupBy("h1", "h2").agg(F.count("*").alias("copies"), *[F.first(f"b{b}").alias(f"b{b}") for b in range(BANDS)])


def bit_filter(keys: DataFrame) -> Column:
    """``keys(h1)`` -> a test of column h1: true for every key, false for most others. FILTER_LONGS rows at most are
    gathered, into one array that goes to the tasks as a scalar."""
    word = F.shiftrightunsigned("h1", 8).bitwiseAND(F.lit(FILTER_LONGS - 1)).cast("int")
    bit = F.col("h1").bitwiseAND(F.lit(63)).cast("int")
    words = keys.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("v"))
    every = keys.sparkSession.range(FILTER_LONGS).select(F.col("id").cast("int").alias("w"))
    one = cut(every.join(words, "w", "left").agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("v", F.lit(0)).alias("v")))).alias("a"))
              .select(F.transform("a", lambda x: x["v"]).alias("a")), "filter")
    return F.getbit(F.get(one.scalar(), word), bit) == 1


def similar(a: Column, n: Column, b: Column, n2: Column, similarity: float) -> Column:
    """Whether the Jaccard index of two normal lines, which have n and n2 different shingles, is ``similarity`` or more."""
    both = F.size(F.array_intersect(shingles(a), shingles(b)))
    return both * F.lit(1 + similarity) >= F.lit(similarity) * (n + n2) - F.lit(1e-9)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(id, id2)`` whose lines in ``texts(id, line, n)`` are similar; each is compared once."""
    mine = texts.select("id", F.col("line").alias("a"), "n")
    other = texts.select(F.col("id").alias("id2"), F.col("line").alias("b"), F.col("n").alias("n2"))
    both = pairs.distinct().join(mine, "id").join(other, "id2")
    return both.where(similar(F.col("a"), F.col("n"), F.col("b"), F.col("n2"), similarity)).select("id", "id2")


def near_sizes(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of these sizes can be as similar: their overlap is at most the smaller one."""
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, th, removed): places of the lines to remove, for each document that has any.

    The first line of a component is that of the smallest doc_id (null last), text hash and place.
    """
    lines = occurrences(docs)
    members = cut(signatures(docs), "bands")
    # a bucket's rows meet once; lines that share a bucket with another line stay
    bucket = Window.partitionBy("key")
    keys = F.array_compact(F.array(*[F.col(f"b{b}") for b in range(BANDS)]))
    inside = (members.select("h1", F.explode(keys).alias("key"))
              .select("key", "h1", F.count("*").over(bucket).alias("n")).where("n > 1").drop("n"))
    inside = cut(inside, "buckets")  # by h1 alone: lines that share it come along, and are compared as the others are
    ids = inside.select("h1").distinct()
    ids = cut(ids.join(members.select("h1", "h2", "copies"), "h1"), "ids")
    repeated = members.where("copies > 1").select("h1", "h2")
    passes = bit_filter(ids.select("h1").unionAll(repeated.select("h1")))
    compared = bit_filter(ids.select("h1"))  # of the others, only the places are asked for
    relevant = cut(lines.where(passes).withColumn("line", F.when(compared, F.col("line"))), "relevant")
    same = line_components(relevant, ids, inside, similarity)
    groups = repeated.join(same, ["h1", "h2"], "left_anti").select("h1", "h2", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    occ = relevant.drop("line").join(cut(groups.unionByName(same), "groups"), ["h1", "h2"]).select("doc_id", "th", "pos", "g1", "g2")
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th", "pos")
    first = occ.groupBy("g1", "g2").agg(F.min(place).alias("first"))
    gone = occ.join(first, ["g1", "g2"]).where(place != F.col("first"))
    return gone.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("removed"))


def rare_prefixes(lines: DataFrame, similarity: float) -> DataFrame:
    """``lines(id, n, set)`` -> (id, n, t, at): the rarest elements of each set, as many as a similar set can't all miss.

    Two sets as similar as ``similarity`` share one of the first ``n - ceil(similarity * n) + 1`` elements in any common
    order (n: a set's size, at: an element's place from 1). Rarest first, elements of a frequent passage come last. An
    element that only one set has takes a place but gives no row.
    """
    each = lines.select("id", "n", F.explode("set").alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    ranked = each.join(often, "t").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("s"))
    placed = ranked.select("id", "n", (F.col("n") - F.size("s") + 1).alias("before"), F.posexplode(F.col("s")["t"]).alias("at", "t"))
    placed = placed.select("id", "n", "t", (F.col("at") + F.col("before")).alias("at"))
    return placed.where(F.col("at") <= F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-9)) + 1)


def room(n: Column, at: Column, n2: Column, at2: Column, similarity: float) -> Column:
    """Whether two sets can be as similar if their first common element has these places: the overlap is at most that
    element and what follows it in either set."""
    return 1 + F.least(n - at, n2 - at2) >= F.lit(similarity / (1 + similarity)) * (n + n2) - F.lit(1e-9)


def touching(rows: DataFrame, similarity: float, chunk: int = CHUNK) -> DataFrame:
    """``rows(key, id, root, line, probe)`` -> (a, b): roots that have similar lines in one bucket (key).

    Lines marked ``probe`` are compared with all lines of their bucket that have another root. In buckets of ``chunk``
    lines at most, all of them meet. In a larger one, lines meet that share one of their rarest shingles, which similar
    lines do. Each pair of roots is returned once.
    """
    texts = rows.groupBy("id").agg(F.first("root").alias("root"), F.first("line").alias("line"))
    texts = texts.select("*", F.array_distinct(shingles(F.col("line"))).alias("set"))
    texts = cut(texts.select("id", "root", "line", F.size("set").alias("n")), "mixed")
    sizes = rows.groupBy("key").agg(F.count("*").alias("m"), F.count_if("probe").alias("p")).where("p > 0").drop("p")
    met = cut(rows.select("key", "id", "probe").join(sizes, "key").join(texts.drop("line"), "id"), "met")
    apart = (F.col("root") != F.col("root2")) & near_sizes(F.col("n"), F.col("n2"), similarity)
    ordered = [F.least("id", "id2").alias("id"), F.greatest("id", "id2").alias("id2")]

    few = met.where(F.col("m") <= chunk)
    others = few.select("key", F.col("id").alias("id2"), F.col("root").alias("root2"), F.col("n").alias("n2"))
    pairs = few.where("probe").join(others, "key").where(apart).select(*ordered)

    many = met.where(F.col("m") > chunk).groupBy("id", "root").agg(
        F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("probe"), F.col("key"))).alias("probed"))
    sets = texts.join(many.select("id"), "id").select("id", "n", F.array_distinct(shingles(F.col("line"))).alias("set"))
    prefixes = cut(rare_prefixes(sets, similarity).join(many, "id"), "prefixes")
    again = prefixes.select("t", *[F.col(c).alias(f"{c}2") for c in ("id", "root", "n", "at", "keys")])
    enough = room(F.col("n"), F.col("at"), F.col("n2"), F.col("at2"), similarity)
    rare = (prefixes.where(F.size("probed") > 0).join(again, "t").where(apart).where(enough)
            .where(F.arrays_overlap("probed", "keys2")).select(*ordered))

    links = verified(cut(pairs.unionByName(rare).distinct(), "pairs"), texts, similarity)
    a, b = (texts.select(F.col("id").alias(i), F.col("root").alias(r)) for i, r in (("id", "ra"), ("id2", "rb")))
    return links.join(a, "id").join(b, "id2").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def line_components(relevant: DataFrame, ids: DataFrame, inside: DataFrame, similarity: float) -> DataFrame:
    """(h1, h2, g1, g2): the representative of every line of a component of two or more.

    ``relevant`` holds the lines' texts, ``ids(h1, h2, copies)`` the lines in buckets, ``inside(key, h1)`` the buckets.
    """
    # copies collapse before the shuffle: a line that is very frequent is one row per task
    text = relevant.where("line is not null").groupBy("h1", "h2").agg(F.first("line").alias("line")).join(ids, ["h1", "h2"])
    texts = text.select("h1", "h2", "copies", F.concat(hex16(F.col("h1")), hex16(F.col("h2"))).alias("id"), normal(F.col("line")).alias("line"))
    texts = texts.select("*", F.array_distinct(shingles(F.col("line"))).alias("set"))
    texts = cut(texts.withColumn("n", F.size("set")).drop("set"), "texts")
    names = texts.select("h1", "h2", "id", "copies", "n")
    named = cut(inside.join(names, "h1").select("key", "id", "copies", "n"), "named")
    rank = F.struct("copies", "id")
    heads = named.groupBy("key").agg(F.max_by(F.struct("id", "n"), rank).alias("head")).select(
        "key", F.col("head.id").alias("id2"), F.col("head.n").alias("n2"))
    sized = near_sizes(F.col("n"), F.col("n2"), similarity)
    pairs = named.join(heads, "key").where("id <> id2").where(sized).select("id", "id2")
    star = verified(pairs, texts, similarity)
    first = components(star.select(F.col("id").alias("a"), F.col("id2").alias("b")))
    rooted = cut(names.select("h1", "h2", "id").join(first, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    placed = named.select("key", "id").join(rooted.select("id", "root"), "id")
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("r")).where("r > 1")
    split = placed.join(mixed.select("key", "main"), "key").select("key", "id", "root", (F.col("root") != F.col("main")).alias("probe"))
    top = components(touching(split.join(texts.select("id", "line"), "id"), similarity))
    final = rooted.join(top.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select(
        "h1", "h2", "id", F.coalesce("top", "root").alias("root"))
    shared = final.where("id <> root").select("root").distinct()
    top_names = names.select(F.col("id").alias("root"), F.col("h1").alias("g1"), F.col("h2").alias("g2")).join(shared, "root")
    return cut(final.join(top_names, "root").select("h1", "h2", "g1", "g2"), "lines")


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """``docs`` with deduplicated texts, plus ``n_removed``.

    Lines without a word are left alone. Null and empty texts stay as they are. Rows equal in doc_id and text are
    one document and keep the same lines; rows with one doc_id and different texts are different documents. An
    empty table gives an empty result. A column of ``docs`` named n_removed is refused.
    """
    if "n_removed" in {c.lower() for c in docs.columns}:
        raise ValueError("a column n_removed is in the way")
    cols = docs.columns
    gone = removed_lines(docs.select("doc_id", F.col(text).alias("text")), similarity)
    h, r, d, t = (free_name(cols, c) for c in ("th", "removed", "__d", "__t"))
    gone = cut(gone.select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("removed").alias(r)), "removed")
    out = docs.withColumn(h, F.xxhash64(text)).join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t)), "left")
    lines = F.split(F.col(text), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(r))
    # the lines are an outer lambda's variable, so that a text is split once and not for each of its lines
    rest = F.get(F.transform(F.array(lines), lambda x: F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n")), F.lit(0))
    new = F.when(F.col(r).isNull(), F.col(text)).otherwise(rest)
    return out.select(*[new.alias(c) if c == text else F.col(c) for c in cols], F.coalesce(F.size(r), F.lit(0)).alias("n_removed"))


def stage(docs: DataFrame) -> DataFrame:
    """Pipeline form: the columns of ``docs`` with deduplicated texts; documents of which no word is left are gone."""
    out = dedup_lines(docs)
    return out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document's remaining text after line deduplication, as counts and digest."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.col("n_removed").cast("bigint").alias("n_removed"),
                      F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"),
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
