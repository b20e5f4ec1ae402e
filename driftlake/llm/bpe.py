"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of the last bytes meets a mask, so equal
passages are cut alike wherever they stand. Each different chunk is encoded once
while it is in a worker's store, which outlives the task; inside a chunk, words are
looked up in a second store, and only unknown words reach the tokenizer, in batches.
Both stores are bounded by bytes (besides what a slice adds), and the oldest half
gives way when one is full.

Joins. The tokenizer's pattern can join a space only to what follows it, so a
space before a non-space begins a new pre-token in every context: encodings on
both sides of such a *safe* place are independent. A chunk is therefore kept as
(head before its first safe place, encoded middle, tail after its last one).
Where two chunks meet, the left tail and the right head are joined and encoded
anew; if a chunk has no safe place, the repair goes on over the next chunk, until
both ends of the re-encoded text are safe and hence agree with their neighbours.
Decoding takes the final ids of the whole text. No text is shuffled; memory is
bounded by the stores, a slice and the longest text.

Defined cases: null is encoded as empty text (0 tokens); ties do not occur;
repeated rows give repeated results; special strings in a text become special
tokens, as the library does by default; a very long text stands alone in its
slice; an empty table gives an empty frame; the result's column takes a name that
the table doesn't have.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlake.llm.common import _BYTE, buffers, fresh_name, mix, powers, slices, table

ROLL = 16
#: Before the key of a piece that is stored with all its characters; no piece behind a safe place begins with white space.
MARK = " "
CHUNK_BITS = 9
#: Bytes that the stores of a worker process hold.
WORD_BYTES, CHUNK_BYTES = 72 << 20, 12 << 20
_ROLL_BASE = 0xA0761D6478BD642F
_ROLL_INV = pow(_ROLL_BASE, -1, 1 << 64)
_SAFE = re.compile(r" (?=\S)")
#: A space that is no safe place.
_ODD_SPACE = re.compile(r" (?:\s|$)")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def chunk_cuts(data: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Places after which to cut: the hash of the last ROLL bytes ends in zeros.

    Only places between code points count."""
    n = len(data)
    if n <= ROLL:
        return np.zeros(0, np.int64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_ROLL_BASE, n), out=total[1:])
    rolled = mix((total[ROLL:n] - total[: n - ROLL]) * powers(_ROLL_INV, n - ROLL))
    at = np.flatnonzero(rolled >> np.uint64(64 - bits) == 0) + ROLL
    return at[(data[at] & 0xC0) != 0x80]


class Encoder:
    """Encodes texts of one worker process; ``get`` keeps one for each vocabulary."""

    _kept: dict[str, Encoder] = {}

    @classmethod
    def get(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str, bits: int = CHUNK_BITS, words: int = WORD_BYTES, chunks: int = CHUNK_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bits = bits
        self.words, self.chunks = Store(words), Store(chunks)
        self.bytes_of, self.starts = token_bytes(self.tokenizer.get_vocab(with_added_tokens=True))

    def _learn(self, pieces: set[str]) -> None:
        """Encodes and stores those pieces that are not stored: their ids as 32-bit numbers.

        Pieces that begin with a safe place are encoded as one text, whose ids are parted again by
        the bytes that they stand for; the few others, which begin with MARK here, one by one."""
        held = self.words.held
        new = [p for p in pieces if p not in held]
        # a piece behind a safe place is stored without the space
        safe = [p for p in new if p[0] != MARK]
        sets: list[tuple[list[str], list[int], np.ndarray]] = []
        for lo in range(0, len(safe), 20_000):
            part = safe[lo : lo + 20_000]
            text = " " + " ".join(part)
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
            ends = np.cumsum(np.fromiter(map(len, part) if text.isascii() else (len(p.encode()) for p in part), np.int64, len(part)) + 1)
            sets.append((part, ids, ends))
        other = [p for p in new if p[0] == MARK]
        for p, e in zip(other, self.tokenizer.encode_batch_fast([p[1:] for p in other], add_special_tokens=False) if other else [], strict=True):
            sets.append(([p], e.ids, np.zeros(1, np.int64)))
        for part, ids, ends in sets:
            ids = np.array(ids, np.int32)
            stop = np.searchsorted(np.cumsum(np.diff(self.starts)[ids]), ends, side="right") if len(part) > 1 else np.array([len(ids)])
            numbers, at = ids.tobytes(), [0, *(4 * stop).tolist()]
            held.update((p, numbers[a:b]) for p, a, b in zip(part, at, at[1:], strict=False))
        self.words.added(new)

    @staticmethod
    def _split(chunk: str) -> list[str]:
        """Pieces between safe places; of each but the first the space is left out."""
        return _SAFE.split(chunk) if _ODD_SPACE.search(chunk) else chunk.split(" ")

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """The ids of each text as 32-bit numbers."""
        self.words.trim()
        self.chunks.trim()
        cuts = chunk_cuts(data, self.bits)
        raw = data.tobytes()
        texts: list[list[tuple]] = []
        split: dict[str, tuple] = {}
        need: set[str] = set()
        held, words = self.chunks.held, self.words.held
        for d in range(len(offsets) - 1):
            lo, hi = int(offsets[d]), int(offsets[d + 1])
            # a cut that depends on bytes before the text is not the text's own
            own = cuts[np.searchsorted(cuts, lo + ROLL) : np.searchsorted(cuts, hi)].tolist()
            edges = [lo, *own, hi]
            parts = [raw[a:b].decode() for a, b in zip(edges, edges[1:], strict=False)]
            known, pending = [], MARK
            for c in parts:
                chunk = held.get(c) or split.get(c)
                if chunk is None:
                    pieces = self._split(c)
                    need.update([p for p in pieces[1:-1] if p not in words])
                    # head, middle (pieces, later their ids), tail, whether there is no safe place
                    chunk = split[c] = [pieces[0], pieces[1:-1], MARK + " " + pieces[-1], len(pieces) == 1]
                known.append(chunk)
                if chunk[3]:
                    pending += chunk[0]
                else:
                    need.add(pending + chunk[0])
                    # a tail begins with its space, so a joint is kept under its whole text, marked as such
                    pending = chunk[2]
            need.add(pending)
            texts.append(known)
        need.discard(MARK)
        self._learn(need)
        for chunk in split.values():
            chunk[1] = b"".join([words[p] for p in chunk[1]])
        for known in texts:
            ids, pending = [], MARK
            for head, middle, tail, lone in known:
                if lone:
                    pending += head
                    continue
                if (joint := pending + head) != MARK:
                    ids.append(words[joint])
                ids.append(middle)
                pending = tail
            if pending != MARK:
                ids.append(words[pending])
            yield b"".join(ids)
        held.update((c, tuple(chunk)) for c, chunk in split.items())
        self.chunks.added(split)

    def decode(self, numbers: list[bytes]) -> list[bytes]:
        """The texts, in UTF-8, that lists of ids stand for: each id's bytes, one after another.

        Bytes that are no UTF-8 become replacement characters, as the library does."""
        ids = np.frombuffer(b"".join(numbers), np.int32)
        first, size = self.starts[ids], np.diff(self.starts)[ids]
        ends = np.cumsum(size)
        # the place of each byte in the table: where its id's bytes begin, and how far it is in them
        place = np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        raw = self.bytes_of[place].tobytes()
        edge = np.concatenate([[0], ends])[np.cumsum([0, *(len(n) // 4 for n in numbers)])].tolist()
        texts = [raw[a:b] for a, b in zip(edge, edge[1:], strict=False)]
        return [t if t.isascii() else t.decode("utf-8", "replace").encode() for t in texts]


def token_bytes(vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all ids, where each id's begin and one more) of a byte-level vocabulary.

    Byte-level vocabularies write each byte as a character: printable ones of Latin-1 as
    themselves, the others in order from U+0100 on. An id with other characters stands for these."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    own = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        own[i] = bytes(byte_of[c] for c in token) if byte_of.keys() >= set(token) else token.encode()
    return np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])


def joined(numbers: list[bytes]) -> list[str]:
    """32-bit numbers in decimal, joined by commas, of each list."""
    ids = np.frombuffer(b"".join(numbers), np.int32)
    table_, starts = _decimals(1 << int(ids.max(initial=0)).bit_length())
    first, size = starts[ids], np.diff(starts)[ids]
    edge = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(first - edge[:-1], size) + np.arange(int(edge[-1]))
    text = table_[place].tobytes().decode("ascii")
    at = edge[np.cumsum([0, *(len(n) // 4 for n in numbers)])].tolist()
    return [text[a + 1 : b] for a, b in zip(at, at[1:], strict=False)]


@cache
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    each = [f",{i}" for i in range(n)]
    return np.frombuffer("".join(each).encode(), np.uint8), np.cumsum([0, *map(len, each)])


class Store:
    """A dictionary bounded by its bytes, besides what was added since the last ``trim``.

    ``trim`` drops entries of more than a hundredth of the bound and, while there is too
    much, the oldest half."""

    #: What Python needs for an entry besides its characters, about.
    ENTRY = 200

    def __init__(self, most: int):
        self.most, self.size, self.held = most, 0, {}
        self._long: list[str] = []

    def _size(self, key: str) -> int:
        value = self.held[key]
        return self.ENTRY + len(key) + (len(value) if isinstance(value, bytes) else sum(map(len, value[:3])))

    def added(self, keys) -> None:
        for key in keys:
            size = self._size(key)
            self.size += size
            if size > self.most // 100:
                self._long.append(key)

    def trim(self) -> None:
        gone, self._long = self._long, []
        while True:
            for key in gone:
                self.size -= self._size(key)
                del self.held[key]
            if self.size <= self.most or not self.held:
                return
            gone = list(islice(self.held, len(self.held) // 2 + 1))


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, keep_ids: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct whose name is returned too:
    ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids``."""
    name = fresh_name(docs, "bpe")
    path = path or vocabulary_path()
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(path)
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            # results leave slice by slice, so a batch's ids are never held together
            for lo, hi in slices(offsets):
                count, ids_hash, text_hash, lists = [], [], [], []
                own = offsets[lo : hi + 1] - offsets[lo]
                part = data[offsets[lo] : offsets[hi]]
                coded = list(encoder.encode(part, own))
                for numbers, ids, back in zip(coded, joined(coded), encoder.decode(coded), strict=True):
                    count.append(len(numbers) // 4)
                    ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(back).hexdigest())
                    if keep_ids:
                        lists.append(np.frombuffer(numbers, np.int32))
                arrays = [pa.array(count, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                if keep_ids:
                    arrays.append(pa.array(lists, pa.list_(pa.int32())))
                found = pa.StructArray.from_arrays(arrays, [f.name for f in fields])
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, found], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StructType(fields))])), name


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> tuple[DataFrame, str]:
    """``rows`` with the decoded text of their ids (null for null) as one more column."""
    name = fresh_name(rows, "decoded")
    path = path or vocabulary_path()
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Encoder.get(path).tokenizer
        for batch in batches:
            back = [None if ids is None else tokenizer.decode(ids, skip_special_tokens=False) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])), name


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, encoded and decoded whole."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, c = encode(docs)
    return found.select("doc_id", *[F.col(f"{c}.{x}").alias(x) for x in ("n_tokens", "ids_sha256", "decoded_sha256")])


def brute_force(docs: list[tuple], path: str | None = None) -> list[tuple]:
    """Plain reference for tests: each whole text through the library."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or vocabulary_path())
    out = []
    for doc, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        out.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return out
