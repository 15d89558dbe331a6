"""Harmonic packing of tokenized documents into fixed-length sequences.

A document's whole sequences go out first; the rest of n tokens belongs to class ``capacity // n``. A bin of class k
takes exactly k whole documents of its class, which always fit. What is then free in the bin (less than a
``k+1``-th of it) is filled by cutting: from the rests of documents that are cut anyway, else from the next document that comes,
whose remainder fills the next gaps. Every bin so ends exactly full, and one document a bin at most is cut for it.

Each worker fills its own bins and never waits for another; it holds one open bin a class (about
``2 * sqrt(capacity)`` classes) and less than two sequences beside them. What is left at its end (bins with fewer than k documents)
is laid end to end into full sequences, and the last tokens into sequences whose lengths are powers of two: no token
of padding anywhere.

No shuffle: a worker is the task of one input partition. Sequence ids are partition << 40 | counter.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

CAPACITY, END_ID = 2048, 1
#: Runs of letters or signs whose ids a worker remembers at most, those met last; and bytes of text it encodes at once.
REMEMBERED, AT_ONCE = 200_000, 1 << 23
#: Letters of Latin-1: composed, lower-cased one to one, so a word of them and visible ASCII needs no normalizer.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: The settings of a tokenizer file whose words can be encoded one by one, as ``encoder`` does it.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class Recent(dict):
    """Remembers ``compute(key)`` of the keys met last: a full half becomes the old one, and the one before that goes."""

    def __init__(self, compute, size: int):
        super().__init__()
        self.compute, self.half, self.old = compute, max(1, size // 2), {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 64:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def whole_texts(tok):
    """Like ``encoder``, for any tokenizer: text by text."""
    import numpy as np

    def encode(texts) -> tuple:
        ids = [np.asarray(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts.to_pylist()]
        return b"".join(ids), np.cumsum([0, *map(len, ids)])

    return encode


def encoder(path: str, remembered: int = REMEMBERED):
    """String array -> (buffer of little-endian unsigned 32-bit ids, byte offsets of the texts in it).

    Ids are those of the tokenizer file on the whole text (null: none). A file with other settings than ``BY_WORD``, or
    special tokens that don't start with ``<|``, encodes each text whole. With these settings white space separates pre-tokens, so
    each different word of the array is encoded once. Words of visible ASCII and Latin-1 letters go through the file's
    own split rule and BPE model directly; others, and those that may hold a special token, through the whole tokenizer.
    """
    import json
    import re

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    settings = json.loads(tok.to_str())
    if any(settings[k] != v for k, v in BY_WORD.items()) or settings["model"]["type"] != "BPE" or not all(
            t["content"].startswith("<|") for t in settings["added_tokens"]):
        return whole_texts(tok)
    model = tok.model
    coded = [i.to_bytes(4, "little") for i in range(tok.get_vocab_size())]
    # the file's split rule, read for lower-case ASCII and Latin-1, and the end of a word
    split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\sa-z{LATIN}0-9]+|\n").findall
    plain = rf"^[\x21-\x7e{LATIN}]+$"
    # byte-level BPE writes a byte without a visible character as the next free one from 256 on
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    byte_signs = {x: 256 + n for n, x in enumerate(x for x in range(256) if x not in shown)}

    def run_ids(run: str) -> bytes:
        if run == "\n":
            return b""
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(byte_signs)
        return b"".join([coded[t.id] for t in model.tokenize(run)])

    def odd_ids(word: str) -> bytes:
        return b"".join([coded[i] for i in tok.encode(word, add_special_tokens=False).ids])

    run, odd = Recent(run_ids, remembered).__getitem__, Recent(odd_ids, remembered // 4).__getitem__

    def strings(array) -> list:
        return array.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist

    def view(array) -> tuple:
        """(offsets, data) of a fresh large binary array."""
        return np.frombuffer(array.buffers()[1], np.int64)[:len(array) + 1], array.buffers()[2] or pa.py_buffer(b"")

    def word_ids(words):
        is_plain = pc.and_(pc.match_substring_regex(words, plain), pc.invert(pc.match_substring(words, "<|")))
        others = strings(words.filter(pc.invert(is_plain)))
        # every word ends in a run "\n" without ids
        runs = pa.array(split("".join([w + "\n" for w in strings(words.filter(is_plain))]).lower()), pa.string()).dictionary_encode()
        at, data = view(pa.array([run(r) for r in strings(runs.dictionary)], pa.large_binary()).take(runs.indices))
        ends = at[np.flatnonzero(pc.equal(runs, "\n").to_numpy(zero_copy_only=False))]
        plain_ids = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends])), data])
        ids = pa.concat_arrays([plain_ids, pa.array([odd(w) for w in others], pa.large_binary())])
        here = is_plain.to_numpy(zero_copy_only=False)
        return ids.take(pa.array(np.where(here, np.cumsum(here) - 1, len(ends) + np.cumsum(~here) - 1)))

    def encode(texts) -> tuple:
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.values.dictionary_encode()
        at, data = view(word_ids(words.dictionary).take(words.indices))
        return data, at[lists.offsets.to_numpy()]

    return encode


def slices(texts, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of stretches of rows, each of about ``size`` bytes of text, or one longer text."""
    import numpy as np
    import pyarrow.compute as pc

    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64) + 1)
    start = 0
    while start < len(total):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + size, "right")))
        yield start, end - start
        start = end


class Piece(NamedTuple):
    """A stretch of a document's ids: the document's id and length, where the stretch starts, its ids as bytes."""
    key: object
    doc_tokens: int
    start: int
    ids: bytes

    @property
    def size(self) -> int:
        return len(self.ids) // 4

    def cut(self, tokens: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:4 * tokens]), self._replace(start=self.start + tokens, ids=self.ids[4 * tokens:])


class Bins:
    """Open bins of one worker, one a class. ``add`` and ``close`` return the pieces that are now placed:
    (piece, sequence number, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.next = capacity, 0
        self.open: dict[int, list[Piece]] = {}  # class -> fewer documents than its number
        self.gap: list[Piece] = []  # a bin with all its documents that still has room, or none
        self.room = 0  # tokens free in it
        self.loose: deque[Piece] = deque()  # remainders of cut documents, for the next gaps; empty while a bin has room
        self.loose_tokens = 0

    def _place(self, pieces: list[Piece]) -> list:
        out, at = [], 0
        for p in pieces:
            out.append((p, self.next, at))
            at += p.size
        self.next += 1
        return out

    def _loosen(self, piece: Piece) -> None:
        self.loose.append(piece)
        self.loose_tokens += piece.size

    def _fill(self) -> list:
        """Loose tokens go into the bin that has room; it is placed once it is full."""
        while self.room and self.loose:
            piece = self.loose.popleft()
            self.loose_tokens -= piece.size
            if piece.size > self.room:
                piece, more = piece.cut(self.room)
                self.loose.appendleft(more)
                self.loose_tokens += more.size
            self.gap.append(piece)
            self.room -= piece.size
        if self.room or not self.gap:
            return []
        full, self.gap = self.gap, []
        return self._place(full)

    def add(self, doc: Piece) -> list:
        out, whole = [], True
        while doc.size >= self.capacity:
            piece, doc = doc.cut(self.capacity)
            out += self._place([piece])
            whole = False
        if not doc.size:
            return out
        if self.room or not whole and self.loose_tokens < self.capacity:
            self._loosen(doc)
            return out + self._fill()
        k = self.capacity // doc.size
        held = self.open.setdefault(k, [])
        held.append(doc)
        if len(held) == k:
            self.gap = self.open.pop(k)
            self.room = self.capacity - sum(p.size for p in self.gap)
            out += self._fill()
        return out

    def close(self) -> list:
        left = deque([*self.gap, *self.loose, *(p for _, held in sorted(self.open.items()) for p in held)])
        tokens, out = sum(p.size for p in left), []
        self.open, self.gap, self.room, self.loose, self.loose_tokens = {}, [], 0, deque(), 0
        while tokens:
            length = min(self.capacity, 1 << (tokens.bit_length() - 1))
            tokens -= length
            pieces = []
            while length:
                piece = left.popleft()
                if piece.size > length:
                    piece, more = piece.cut(length)
                    left.appendleft(more)
                pieces.append(piece)
                length -= piece.size
            out += self._place(pieces)
        return out


SCHEMA = ("start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint")


def _pack(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, bins, base = encoder(path), Bins(capacity), TaskContext.get().partitionId() << 40
        end = end_id.to_bytes(4, "little")
        kind = None

        def batch(placed: list):
            pieces = [p for p, _, _ in placed]
            longs = ([p.start for p in pieces], [p.size for p in pieces], [zlib.crc32(p.ids) for p in pieces],
                     [p.doc_tokens for p in pieces], [base + seq for _, seq, _ in placed], [off for _, _, off in placed])
            arrays = [pa.array([p.key for p in pieces], kind), *(pa.array(c, pa.int64()) for c in longs)]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p.ids, "<u4").astype(np.int32) for p in pieces], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][:len(arrays)])

        placed = []
        for b in batches:
            kind = b.schema.field(0).type
            for start, count in slices(b.column(1), AT_ONCE):
                data, offsets = encode(b.column(1).slice(start, count))
                data = memoryview(data)
                for key, i, j in zip(b.column(0).slice(start, count).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    ids = bytes(data[i:j]) + end
                    placed += bins.add(Piece(key, len(ids) // 4, 0, ids))
                    if len(placed) >= 2_000:
                        yield batch(placed)
                        placed = []
                del data
                pa.default_memory_pool().release_unused()
            del b
        placed += bins.close()
        if placed:
            yield batch(placed)

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
         text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids``).

    Offsets in a sequence run from 0 without a gap; every sequence has ``capacity`` tokens, or a power of two at a
    partition's end. Null, empty and blank texts have the end id alone. Rows
    are packed one by one, so repeated rows and null ids give pieces of their own; very long texts become
    many full sequences. An empty table gives an empty result. Other columns are not read. ``capacity`` must
    be a power of two. The tokenizer file must be readable at ``tokenizer_path`` on every worker.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    part = docs.select(F.col(id_col).alias("key"), F.col(text).alias("text"))
    kind = part.schema["key"].dataType.simpleString()
    schema = f"key {kind}, {SCHEMA}" + (", ids array<int>" if with_ids else "")
    return part.mapInArrow(_pack(tokenizer_path, capacity, end_id, with_ids), schema).withColumnRenamed("key", id_col)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents packed into sequences of 2048."""
    from .text import read
    return pack(read(spark, sf_dir, "documents"), default_tokenizer())
