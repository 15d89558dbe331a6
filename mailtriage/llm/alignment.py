"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the same bytes. A document's tokens are two ascending arrays of byte offsets at which tokens
end; offsets in both arrays cut the tokens into groups. Most groups are one token against one, so the arrays run in
parallel at a fixed index shift: from the current place, windows of doubling length are compared at that shift
(exponential probing, then halving to the exact end), and the whole stretch is taken at once. Where the stretch
stops, a two-pointer walk finds the end of the irregular group, which gives the new shift.

The two tokens that end a group together are a link. How often a pair of ids is linked in the whole corpus is
counted by blocks of documents: a task numbers the different pairs of a block of ``BLOCK_LINKS`` links, the corpus
counts are one aggregation over the blocks' pairs (not over the documents' links), and each block gets its own
pairs' counts back. No vocabulary-sized table is broadcast and no document's links are exploded into rows.

Tokenizing: both tokenizers end a token before every space that follows another character than white space
(no token of either holds a space after such a character; ``Pair`` checks that when it reads the files), so each
different piece of text between such places is encoded once and remembered.
"""
from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, functions as F

from mailtriage.session import cut

#: A block of documents ends when it holds so many links; it bounds what a task keeps.
BLOCK_LINKS = 2_000_000
#: Remembered pieces of text, and their longest length.
WORDS, LONGEST = 600_000, 100
PROBE = 4


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def runs(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups of two ascending end arrays with the same last value, as ``(i, j, n, m)``.

    ``m`` = 0: a stretch of ``n`` one-to-one groups that starts at tokens i and j.
    Otherwise one group of ``n`` tokens against ``m``.
    """
    out, i, j = [], 0, 0
    la, lb = len(a), len(b)
    while i < la:
        n, w = 0, PROBE
        while i + n + w <= la and j + n + w <= lb and a[i + n:i + n + w] == b[j + n:j + n + w]:
            n += w
            w *= 2
        while w > 1:
            w //= 2
            if i + n + w <= la and j + n + w <= lb and a[i + n:i + n + w] == b[j + n:j + n + w]:
                n += w
        if n:
            out.append((i, j, n, 0))
            i += n
            j += n
            if i == la:
                break
        x, y = i, j
        while a[x] != b[y]:
            if a[x] < b[y]:
                x += 1
            else:
                y += 1
        out.append((i, j, x - i + 1, y - j + 1))
        i, j = x + 1, y + 1
    return out


def byte_values() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others as characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(other)}}


def byte_engine(model: dict, table: list[bytes]):
    """A byte-level BPE model in a faster engine, if its ids follow the order of its merges; else None."""
    import public_tokenizers
    import tiktoken
    vocab = model["vocab"]
    ranks = {table[k]: k for w, k in vocab.items() if not w.startswith("<|")}
    order = [vocab.get(m.replace(" ", "") if isinstance(m, str) else m[0] + m[1]) for m in model["merges"]]
    if None in order or order != sorted(order) or len(ranks) < 256 + len(order):
        return None
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def whole_engine(path: str):
    """The same by the file's own library; special tokens' strings in a text are plain text."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


class Pair:
    """Both tokenizers in one worker, with the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import sentencepiece
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        to_byte = byte_values()
        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)
        vocab = {**model["model"]["vocab"], **{t["content"]: t["id"] for t in model["added_tokens"]}}
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for word, k in vocab.items():
            self.bytes_a[k] = bytes(map(to_byte.__getitem__, word)) if all(c in to_byte for c in word) else word.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
                        for k, p in enumerate(pieces)]
        fast = byte_engine(model["model"], self.bytes_a)
        self.ids_a = fast.encode_ordinary if fast else whole_engine(path_a)
        # a token with a space behind other text could cross a cut: then texts are encoded whole
        self.cuts = not any(re.search(r"\S ", x.decode(errors="replace")) for x in (*self.bytes_a, *self.bytes_b))
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        #: ids of remembered pieces, as the bytes of int arrays; pieces whose tokens' bytes differ from them are in neither
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """The text cut at spaces behind other than white space; each piece stands for itself with a space before."""
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        if text[0] != " " and not SPACED.search(text):
            return parts
        out, held = [], None
        for p in parts:
            held = p if held is None else f"{held} {p}"
            if p and not p[-1].isspace():
                out.append(held)
                held = None
        return out if held is None else [*out, held]

    def learn(self, new: list[str]) -> tuple[dict, dict]:
        """The ids of new pieces. They are encoded in one go: the cuts between them are cuts of either tokenizer."""
        import numpy as np
        odd = [p for p in new if not p or p[0].isspace() or p[-1].isspace()]
        out_a, out_b = {}, {}
        for some in ([p for p in new if p and not (p[0].isspace() or p[-1].isspace())] if self.cuts else [], *([p] for p in (odd if self.cuts else new))):
            if not some:
                continue
            text = " ".join(some)
            whole = [(" " + p).encode() for p in some]
            ends = np.cumsum([len(w) for w in whole])
            ids = self.ids_a(" " + text), self.b.encode(text) if text else [self.b.piece_to_id("▁")]
            same = all(b"".join([t[k] for k in x]) == b"".join(whole) for t, x in zip((self.bytes_a, self.bytes_b), ids))
            at = [np.concatenate([[0], n[np.array(x, np.int64)].cumsum()]) for n, x in zip((self.len_a, self.len_b), ids)]
            cut_at = [np.searchsorted(x, ends) for x in at]
            if not same or not all((x[np.minimum(k, len(x) - 1)] == ends).all() for x, k in zip(at, cut_at)):
                if len(some) > 1:  # find the pieces whose bytes differ
                    for half in (some[:len(some) // 2], some[len(some) // 2:]):
                        a, b = self.learn(half)
                        out_a.update(a)
                        out_b.update(b)
                continue
            for out, x, k in zip((out_a, out_b), ids, cut_at):
                raw, k = np.array(x, np.int32).tobytes(), [0, *(4 * k).tolist()]
                out.update(zip(some, [raw[i:j] for i, j in zip(k, k[1:])]))
        return out_a, out_b

    def encode(self, texts: list[str | None]) -> Iterator[tuple | None]:
        """Id arrays (A, B) of each text; None without tokens (null, empty, or bytes that differ)."""
        import numpy as np
        cut_up = [self.pieces(t) if t else [] for t in texts]
        if len(self.known_a) > WORDS:
            self.known_a.clear()
            self.known_b.clear()
        new = [p for p in set().union(*cut_up) if p not in self.known_a]
        now_a, now_b = self.learn(new)
        long = [p for p in now_a if len(p) > LONGEST]
        self.known_a.update(now_a)
        self.known_b.update(now_b)
        for parts in cut_up:
            try:
                a, b = (b"".join(map(known.__getitem__, parts)) for known in (self.known_a, self.known_b))
            except KeyError:
                yield None
                continue
            yield (np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)) if parts else None
        for p in long:
            del self.known_a[p], self.known_b[p]


SPACED = re.compile(r"\s ")


class Text:
    """The alignment of one document."""

    def __init__(self, pair: Pair, ids: tuple):
        import numpy as np
        self.a, self.b = ids
        self.runs = runs(pair.len_a[self.a].cumsum().tolist(), pair.len_b[self.b].cumsum().tolist())
        inner_a, inner_b = [], []
        for i, j, n, m in self.runs:
            if n > 1 and m:
                inner_a.extend(range(i, i + n - 1))
            if m > 1:
                inner_b.extend(range(j, j + m - 1))
        #: does a token end its group
        self.ends_a, self.ends_b = np.ones(len(self.a), bool), np.ones(len(self.b), bool)
        self.ends_a[inner_a] = False
        self.ends_b[inner_b] = False
        #: a pair of ids as one long
        self.links = (self.a[self.ends_a].astype(np.int64) << 32) | self.b[self.ends_b]

    def sizes(self) -> tuple["np.ndarray", "np.ndarray"]:
        """Tokens of A and of B in each group."""
        import numpy as np
        return tuple(np.diff(np.flatnonzero(e), prepend=-1) for e in (self.ends_a, self.ends_b))

    def digest(self, texts: tuple) -> str:
        """SHA-256 of the groups as ``a1,a2|b1;a3|b2,b3``; ``texts`` holds each id's text with ``,``, with ``|``, with ``;``."""
        import numpy as np
        inner, left, right = texts
        na, nb = self.sizes()
        before_a, before_b = np.cumsum(na), np.cumsum(nb) - nb  # A's tokens up to a group, B's before it
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + np.repeat(before_b, na)] = np.where(self.ends_a, left[self.a], inner[self.a])
        out[np.arange(len(self.b)) + np.repeat(before_a, nb)] = np.where(self.ends_b, right[self.b], inner[self.b])
        return hashlib.sha256("".join(out.tolist())[:-1].encode()).hexdigest()


def id_texts(n: int) -> tuple:
    import numpy as np
    return tuple(np.array([f"{k}{end}" for k in range(n)], object) for end in ",|;")


def _slices(batches: Iterator) -> Iterator:
    """Arrow batches in stretches of 256 rows at most, fewer if their texts are long."""
    for b in batches:
        sizes = b.column(b.num_columns - 1).nbytes // max(1, b.num_rows)
        step = max(1, min(256, 8_000_000 // max(1, sizes)))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def _check_keys(docs: DataFrame, keys: list[str], own: list[str]) -> None:
    taken = {k.lower() for k in keys}
    if clash := [c for c in own if c.lower() in taken]:
        raise ValueError(f"key columns {clash} have names of result columns: rename them first")


ALIGN_FIELDS = "a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None, keys: list[str] = ["doc_id"],
          text: str = "text") -> DataFrame:
    """The groups themselves: ``keys``, both id arrays, and the tokens of A and of B in each group.

    One row per input row. Texts that are null, empty, or that a tokenizer doesn't give back byte for byte have empty
    arrays. Repeated rows and ids stay. Other columns aren't read; keys named like a result column raise ValueError.
    """
    _check_keys(docs, keys, ["a_ids", "b_ids", "a_sizes", "b_sizes"])
    paths = tokenizers or default_tokenizers()
    part = docs.select(*keys, F.col(text).alias("__text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        pair = Pair(*paths)
        ints = pa.list_(pa.int32())
        for s in _slices(batches):
            cols: list[list] = [[], [], [], []]
            for ids in pair.encode(s.column(s.num_columns - 1).to_pylist()):
                t = Text(pair, ids) if ids else None
                for c, v in zip(cols, (t.a, t.b, *t.sizes()) if t else ([], [], [], [])):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*s.columns[:-1], *(pa.array(c, ints) for c in cols)],
                                             names=[*s.schema.names[:-1], "a_ids", "b_ids", "a_sizes", "b_sizes"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1])
    return part.mapInArrow(run, f"{head}, {ALIGN_FIELDS}")


STATS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]


def block_batches(paths: tuple[str, str], block_links: int):
    """Arrow batches (keys.., text) -> (keys.., counts, digest, links, block, pairs, pairs_n).

    A block's documents are followed by one row that holds its different pairs and how many links have each;
    ``links`` (compressed) numbers a document's different pairs within the block, with the links of each.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext
        pair = Pair(*paths)
        texts = id_texts(max(len(pair.bytes_a), len(pair.bytes_b)))
        pack = zstandard.ZstdCompressor(level=1)
        block = TaskContext.get().partitionId() << 32
        held, stats, links, size = [], [], [], 0

        def close():
            every, at, n = np.unique(np.concatenate(links) if links else np.zeros(0, np.int64),
                                     return_inverse=True, return_counts=True)
            start, row = 0, 0
            for s in held:
                mine = []
                for _ in range(s.num_rows):
                    k, c = np.unique(at[start:start + len(links[row])], return_counts=True)
                    start, row = start + len(links[row]), row + 1
                    mine.append(pack.compress(np.diff(k, prepend=0).astype(np.int32).tobytes() + c.astype(np.int32).tobytes()))
                own = stats[row - s.num_rows:row]
                none = pa.array([None] * s.num_rows, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*s.columns[:-1], *(pa.array([x[k] for x in own], pa.int64()) for k in range(4)),
                     pa.array([x[4] for x in own], pa.string()), pa.array(mine, pa.binary()),
                     pa.array([block] * s.num_rows, pa.int64()), none, none],
                    names=[*s.schema.names[:-1], *STATS, "block", "pairs", "pairs_n"])
            if len(every):
                empty = [pa.nulls(1, f.type) for f in held[0].schema][:-1]
                yield pa.RecordBatch.from_arrays(
                    [*empty, *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()),
                     pa.array([block], pa.int64()), pa.array([every], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))],
                    names=[*held[0].schema.names[:-1], *STATS, "block", "pairs", "pairs_n"])

        for s in _slices(batches):
            for ids in pair.encode(s.column(s.num_columns - 1).to_pylist()):
                t = Text(pair, ids) if ids else None
                links.append(t.links if t else np.zeros(0, np.int64))
                stats.append((len(t.a), len(t.b), len(t.links), len(t.links), t.digest(texts)) if t else (0, 0, 0, 0, ""))
                size += len(links[-1])
            # only the keys of the documents are kept till the block ends
            held.append(pa.RecordBatch.from_arrays([*s.columns[:-1], pa.nulls(s.num_rows)], names=s.schema.names))
            if size >= block_links:
                yield from close()
                held, stats, links, size, block = [], [], [], 0, block + 1
        if held:
            yield from close()

    return run


def link_statistics(docs: DataFrame, tokenizers: tuple[str, str] | None = None, keys: list[str] = ["doc_id"],
                    text: str = "text", block_links: int = BLOCK_LINKS) -> DataFrame:
    """Per row: ``keys``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best``: links whose pair is its B id's most frequent in the corpus, ties included; ``count_sum``: the corpus
    counts of the row's links, summed. Rows without tokens (null or empty text, or text that a tokenizer doesn't give
    back byte for byte) have zeros and ''. Repeated rows and ids are rows of their own and count each time. Other
    columns aren't read; keys named like a result column raise ValueError. An empty table gives an empty result.
    """
    _check_keys(docs, keys, [*STATS, "n_best", "count_sum", "block", "pairs", "pairs_n", "pos", "cnt", "best"])
    part = docs.select(*keys, F.col(text).alias("__text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1])
    counts = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
    blocks = cut(part.mapInArrow(
        block_batches(tokenizers or default_tokenizers(), block_links),
        f"{head}, {counts}, groups_sha256 string, links binary, block bigint, pairs array<bigint>, pairs_n array<bigint>"), "blocks")
    pairs = (blocks.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "pairs_n")))
             .select("block", "pos", F.col("col.pairs").alias("pair"), F.col("col.pairs_n").alias("n")))
    every = cut(pairs.groupBy("pair").agg(F.sum("n").alias("cnt")), "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    top = every.groupBy(b_id.alias("b")).agg(F.max("cnt").alias("top"))
    marked = every.join(top, b_id == F.col("b")).select("pair", "cnt", (F.col("cnt") == F.col("top")).alias("best"))
    known = pairs.join(marked, "pair").select(F.col("block").alias("of"), "pos", "cnt", "best")

    def finish(left, right):
        import numpy as np
        import pyarrow as pa
        import zstandard
        unpack = zstandard.ZstdDecompressor()
        cnt, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        at = right["pos"].to_numpy()
        cnt[at], best[at] = right["cnt"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        n_best, total = [], []
        for x in left["links"].to_pylist():
            k, n = np.frombuffer(unpack.decompress(x), np.int32).reshape(2, -1)
            k, n = np.cumsum(k), n.astype(np.int64)
            n_best.append(int(n[best[k]].sum()))
            total.append(int((n * cnt[k]).sum()))
        out = left.drop(["links", "block"])
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))

    rows = blocks.where("pairs is null").drop("pairs", "pairs_n")
    out = rows.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(
        finish, f"{head}, {counts}, groups_sha256 string, n_best bigint, count_sum bigint")
    return out.select(*keys, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: both tokenizers aligned over all documents."""
    from .text import read
    return link_statistics(read(spark, sf_dir, "documents"))
