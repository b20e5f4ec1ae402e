"""Alignment of two tokenizers over the same bytes: an event sweep.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (SentencePiece) the
text, to which it adds that space. Each token is an *event* at the byte offset where it ends.

1. Events. Both tokenizers' ids of a document are cut at windows of ``WINDOW_BYTES`` of its
   bytes; a row holds the events of one side in one window, as ids in order from an offset on
   (an id's length is its tokenizer's, so ids tell all ends). Each distinct word is encoded
   once while a worker's table holds it (``WordTable``). The rows of A and those of B are
   one table. One event a row would be 40 times the input.
2. Sweep. The rows are repartitioned by document, sorted by (document, window, side) within
   partitions and streamed through a state machine that holds the group which is open, at most
   one window's events of A, and a running hash. Where both sides end, a group closes and a link
   is emitted.
3. Counts. Two tokens that end together are suffixes of one another, so the vocabularies alone
   bound the id pairs: about 0.3 million here (``Pairs``), whatever the corpus. Each task adds
   up its links by pair, Spark sums the tasks', and the counts are broadcast.
4. Each document's links are looked up in the counts.

Defined cases: null or empty text, and text that a tokenizer doesn't give back byte for byte
(U+2581 in it, for B), has no tokens: zeros and an empty digest. Ties for the highest count
are all best. Rows are told apart by their place in the table, so rows that share an id and
repeated rows each have their result and count for links once each; a null id stays null. A
very long text is several windows; an empty table gives an empty frame. Other columns than
id and text are not carried on, so their names don't matter.
"""

from __future__ import annotations

import hashlib
import os
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.bpe import Store, token_bytes, vocabulary_path
from driftlake.llm.common import buffers, materialize, slices, table
from driftlake.llm.sentence_pieces import MARKER, SLICE_BYTES, PieceTable, piece_bytes, piece_model_path

WINDOW_BYTES = 1 << 15
#: Bytes of a worker's table of words, and characters of new words that are encoded at once.
STORED_BYTES, LEARNED_CHARS = 180 << 20, 200_000
#: Marks a word that a tokenizer doesn't give back.
BAD = 0xFFFFFFFF
#: Bytes that can begin a word behind its space: none of white space, and none that begins a wider white-space character.
OPENS = np.ones(256, bool)
OPENS[[*range(0x09, 0x0E), 0x20, 0xC2, 0xE1, 0xE2, 0xE3]] = False
#: Links that a task adds up at once.
COUNTED = 1 << 20
EVENTS = "key long, doc long, win int, side int, start long, n int, ids binary"
SWEPT = "doc long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


class TokenTable:
    """Tokenizer A in one worker process; special tokens' strings in a text are plain text."""

    _kept: dict[str, TokenTable] = {}

    @classmethod
    def get(cls, path: str) -> TokenTable:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.bytes_of, self.starts = token_bytes(self.tokenizer.get_vocab(with_added_tokens=True))
        self.sizes = np.diff(self.starts)


class WordTable:
    """Both tokenizers' ids of the distinct words of one worker process.

    A word begins with its space. Words are cut where a space stands behind a character that is
    no space and before one that is no white space: A's pattern joins a space only to what
    follows it, and none of B's pieces holds a marker behind another character, so neither
    tokenizer's tokens cross such a place or depend on what is beyond it.

    A stored word is its number of A ids, these and its B ids; BAD alone marks one that a
    tokenizer doesn't give back. The table is bounded by bytes."""

    _kept: dict[tuple, WordTable] = {}

    @classmethod
    def get(cls, path_a: str, path_b: str) -> WordTable:
        if (path_a, path_b) not in cls._kept:
            cls._kept[path_a, path_b] = cls(path_a, path_b)
        return cls._kept[path_a, path_b]

    def __init__(self, path_a: str, path_b: str, words: int = STORED_BYTES):
        self.a, self.b, self.words = TokenTable.get(path_a), PieceTable.get(path_b), Store(words)
        self._lead = len(self.b.model.encode("x"))

    def _learn(self, words: list[str]) -> None:
        plain, odd, held = [], [], self.words.held
        for w in words:
            (odd if len(w) < 2 or w[1].isspace() or w[-1] == " " or MARKER in w else plain).append(w)
        at = np.cumsum([0, *map(len, plain)]) // LEARNED_CHARS
        for lo, hi in zip(edge := [*np.unique(at[:-1], return_index=True)[1].tolist(), len(plain)], edge[1:], strict=False):
            part = plain[lo:hi]
            text = "".join(part)
            ids = np.array(self.a.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32), np.array(self.b.model.encode(text[1:]), np.uint32)
            raw = text.encode()
            ends = np.cumsum(list(map(len, part)) if text.isascii() else [len(w.encode()) for w in part])
            cuts = [self._cuts(t, i, raw, ends) for t, i in zip((self.a, self.b), ids, strict=True)]
            if any(c is None for c in cuts):
                odd += part
                continue
            first, second = cuts[0], cuts[1]
            numbers = [i.tobytes() for i in ids]
            counts = np.diff(first).astype(np.uint32).tobytes()
            for k, (w, i, j, p, q) in enumerate(zip(part, 4 * first[:-1], 4 * first[1:], 4 * second[:-1], 4 * second[1:], strict=True)):
                held[w] = counts[4 * k : 4 * k + 4] + numbers[0][i:j] + numbers[1][p:q]
        for w in odd:
            ids = np.array(self.a.tokenizer.encode_batch_fast([w], add_special_tokens=False)[0].ids, np.uint32), np.array(self.b.model.encode("x" + w)[self._lead :], np.uint32)
            good = all(token_text(t, i) == w.encode() for t, i in zip((self.a, self.b), ids, strict=True))
            held[w] = b"".join(x.tobytes() for x in (np.array([len(ids[0])], np.uint32), *ids)) if good else np.array([BAD], np.uint32).tobytes()
        self.words.added(words)

    @staticmethod
    def _cuts(table_: TokenTable | PieceTable, ids: np.ndarray, raw: bytes, ends: np.ndarray) -> np.ndarray | None:
        """How many ids lie before each word and behind the last; null if the ids don't give the words back."""
        stops = np.append(0, np.cumsum(table_.sizes[ids]))
        at = np.searchsorted(stops, np.append(0, ends))
        right = at[-1] == len(ids) and (stops[at] == np.append(0, ends)).all() and token_text(table_, ids) == raw
        return at if right else None

    def encode(self, texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """(ids of all texts and where each text's begin, for A and B; for each text whether both give it back).

        A space is put in front of each text that isn't empty."""
        self.words.trim()
        data, offsets = buffers(pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise("", texts, " ")))
        if not len(data):
            none = np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
            return [none, none], np.ones(len(texts), bool)
        begins, space = np.zeros(len(data), bool), data == 32
        begins[1:-1] = space[1:-1] & ~space[:-2] & OPENS[data[2:]]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.flatnonzero(begins)
        coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        words, word, held = coded.dictionary.to_pylist(), coded.indices.to_numpy(), self.words.held
        self._learn([w for w in words if w not in held])
        own = [held[w] for w in words]
        flat = np.frombuffer(b"".join(own), np.uint32)
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        start = np.cumsum(size) - size
        bad = flat[start] == BAD
        n_a = np.where(bad, 0, flat[start]).astype(np.int64)
        of = np.searchsorted(at, offsets)
        sides = []
        for first, count in ((start + 1, n_a), (start + 1 + n_a, size - 1 - n_a)):
            each = count[word]
            ends = np.cumsum(each)
            place = np.repeat(first[word] - (ends - each), each) + np.arange(ends[-1])
            sides.append((flat[place], np.append(0, ends)[of]))
        lost = np.append(0, np.cumsum(bad[word]))[of]
        return sides, lost[1:] == lost[:-1]


def token_text(table_: TokenTable | PieceTable, ids: np.ndarray) -> bytes:
    """The bytes that ids stand for."""
    size = table_.sizes[ids]
    ends = np.cumsum(size)
    return table_.bytes_of[np.repeat(table_.starts[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()


def number_type(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def zstd() -> pa.Codec:
    return pa.Codec("zstd", 3)


def event_rows(keyed: DataFrame, path_a: str, path_b: str, window: int = WINDOW_BYTES) -> DataFrame:
    """Rows of EVENTS for rows (key, doc, text); each key has one row at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, codec = WordTable.get(path_a, path_b), zstd()
        for batch in batches:
            column = pc.fill_null(batch.column(2).cast(pa.string()), "")
            keys, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            _, offsets = buffers(column)
            for lo, hi in slices(offsets, SLICE_BYTES):
                coded, good = words.encode(column.slice(lo, hi - lo))
                rows: list[tuple] = []
                for side, (table_, (ids, edges)) in enumerate(zip((words.a, words.b), coded, strict=True)):
                    stored = ids.astype(number_type(len(table_.sizes)))
                    ends = np.cumsum(table_.sizes[ids])
                    for d in range(hi - lo):
                        i, j = int(edges[d]), int(edges[d + 1])
                        own_row = keys[lo + d], docs[lo + d]
                        if i == j or not good[d]:
                            if side == 0:
                                rows.append((*own_row, 0, 0, 0, 0, b""))
                            continue
                        base = int(ends[i - 1]) if i else 0
                        last = (int(ends[j - 1]) - base - 1) // window
                        cuts = [i, *(i + np.searchsorted(ends[i:j], base + window * np.arange(1, last + 1), side="right")).tolist(), j] if last else [i, j]
                        for w, (p, q) in enumerate(zip(cuts, cuts[1:], strict=False)):
                            if p < q or side == 0:
                                rows.append((*own_row, w, side, int(ends[p - 1]) - base if p > i else 0, q - p, codec.compress(stored[p:q].tobytes(), asbytes=True)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _schema(), strict=True)], schema=_schema())

    return keyed.mapInArrow(run, EVENTS)


def _schema() -> pa.Schema:
    return pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("win", pa.int32()), ("side", pa.int32()), ("start", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())])


@dataclass
class Groups:
    """Groups that close in one window: ids of both sides and, by group, its last tokens' places and its end."""

    a: np.ndarray
    b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray
    ends: np.ndarray


class Sweep:
    """The state of one document: ids of both sides since both last ended together."""

    def __init__(self):
        self.a = self.b = np.zeros(0, np.uint32)

    def window(self, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> Groups:
        """Takes the events of the next window; returns the groups that close in it."""
        place = np.searchsorted(ends_b, ends_a)
        both = np.flatnonzero(ends_b[np.minimum(place, len(ends_b) - 1)] == ends_a) if len(ends_b) else np.zeros(0, np.int64)
        at_a, at_b = both + len(self.a), place[both] + len(self.b)
        a, b = np.concatenate([self.a, a]), np.concatenate([self.b, b])
        stop_a, stop_b = (int(at_a[-1]) + 1, int(at_b[-1]) + 1) if len(both) else (0, 0)
        self.a, self.b = a[stop_a:], b[stop_b:]
        return Groups(a[:stop_a], b[:stop_b], at_a, at_b, ends_a[both])


@cache
def _numbers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of ;0 ;1 … ,0 ,1 … |0 |1 …, where each begins, and their sizes."""
    each = [f"{mark}{i}".encode() for mark in ";,|" for i in range(n)]
    size = np.array(list(map(len, each)), np.int64)
    return np.frombuffer(b"".join(each), np.uint8), np.cumsum(size) - size, size


def group_text(g: Groups, n: int) -> bytes:
    """The groups as ;a1,a2|b1;a3|b2,b3 for ids under n."""
    if not len(g.ends):
        return b""
    stop_a, stop_b = g.last_a + 1, g.last_b + 1
    first_a, first_b = np.append(0, stop_a[:-1]), np.append(0, stop_b[:-1])
    sep_a, sep_b = np.full(len(g.a), n), np.full(len(g.b), n)
    sep_a[first_a], sep_b[first_b] = 0, 2 * n
    code = np.empty(len(g.a) + len(g.b), np.int64)
    # before a token stand the other side's of earlier groups and, for one of B, of its own group
    code[np.arange(len(g.a)) + np.repeat(first_b, stop_a - first_a)] = sep_a + g.a
    code[np.arange(len(g.b)) + np.repeat(stop_a, stop_b - first_b)] = sep_b + g.b
    data, starts, sizes = _numbers(n)
    size = sizes[code]
    ends = np.cumsum(size)
    return data[np.repeat(starts[code] - (ends - size), size) + np.arange(int(ends[-1]))].tobytes()


def windows(batches: Iterator[pa.RecordBatch], sizes: list[np.ndarray]) -> Iterator[tuple]:
    """(key, doc, ids of A, their ends, ids of B, their ends) of each window, from sorted rows of EVENTS."""
    codec = zstd()
    none = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    at, held = None, [none, none]
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for row, ids in zip(zip(*columns, strict=True), batch.column(6), strict=True):
            key, doc, win, side, start, n = row
            if at is not None and at != (key, doc, win):
                yield *at[:2], *held[0], *held[1]
                held = [none, none]
            at = key, doc, win
            if n:
                kind = number_type(len(sizes[side]))
                own = np.frombuffer(codec.decompress(ids.as_buffer(), n * np.dtype(kind).itemsize), kind).astype(np.uint32)
                held[side] = own, start + np.cumsum(sizes[side][own])
    if at is not None:
        yield *at[:2], *held[0], *held[1]


class Pairs:
    """The id pairs that can end together, sorted: of each, one id's bytes end in the other's."""

    _kept: dict[tuple, Pairs] = {}

    @classmethod
    def get(cls, path_a: str, path_b: str) -> Pairs:
        if (path_a, path_b) not in cls._kept:
            cls._kept[path_a, path_b] = cls(TokenTable.get(path_a), PieceTable.get(path_b))
        return cls._kept[path_a, path_b]

    def __init__(self, a: TokenTable, b: PieceTable):
        ids: list[dict[bytes, list[int]]] = []
        for t in (a, b):
            by: dict[bytes, list[int]] = defaultdict(list)
            raw, at = t.bytes_of.tobytes(), t.starts.tolist()
            for i, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
                if lo < hi:
                    by[raw[lo:hi]].append(i)
            ids.append(by)
        of_a, of_b = ids
        found = {(i, j) for x, own in of_a.items() for k in range(len(x)) for j in of_b.get(x[k:], ()) for i in own}
        found |= {(i, j) for x, own in of_b.items() for k in range(1, len(x)) for i in of_a.get(x[k:], ()) for j in own}
        self.codes = np.array(sorted((i << 32) | j for i, j in found), np.int64)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a.astype(np.int64) << 32 | b.astype(np.int64)
        found = np.searchsorted(self.codes, code)
        if (self.codes[np.minimum(found, len(self.codes) - 1)] != code).any():
            raise ValueError("tokens that end together must end in the same bytes")
        return found.astype(np.uint32)

    def best(self, counts: np.ndarray) -> np.ndarray:
        """Whether a pair's count is the highest of its B id."""
        b = self.codes & 0xFFFFFFFF
        most = np.zeros(int(b.max(initial=-1)) + 1, np.int64)
        np.maximum.at(most, b, counts)
        return counts == most[b]



def swept_documents(events: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Streams sorted rows of EVENTS through the sweep: one row of SWEPT for each key.

    ``links`` holds the numbers of the linked pairs, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, pairs, codec = TokenTable.get(path_a), PieceTable.get(path_b), Pairs.get(path_a, path_b), zstd()
        n = max(len(a.sizes), len(b.sizes))
        key, rows = None, []

        def closed() -> tuple:
            numbers = np.concatenate([np.zeros(0, np.uint32), *links])
            return doc, count[0], count[1], len(numbers), len(numbers), digest.hexdigest() if count[0] else "", codec.compress(numbers.tobytes(), asbytes=True)

        for own, of, ids_a, ends_a, ids_b, ends_b in windows(batches, [a.sizes, b.sizes]):
            if own != key:
                if key is not None:
                    rows.append(closed())
                if len(rows) >= 2000:
                    yield _swept(rows)
                    rows = []
                key, doc, sweep, digest, links, count = own, of, Sweep(), hashlib.sha256(), [], [0, 0]
            g = sweep.window(ids_a, ends_a, ids_b, ends_b)
            digest.update(group_text(g, n)[0 if links else 1 :])
            if len(g.ends):
                links.append(pairs.number(g.a[g.last_a], g.b[g.last_b]))
            count[0] += len(ids_a)
            count[1] += len(ids_b)
        if key is not None:
            rows.append(closed())
        yield _swept(rows)

    return events.mapInArrow(run, SWEPT)


def _swept(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
    names = [x.split()[0] for x in SWEPT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _links(batches: Iterator[pa.RecordBatch], codec: pa.Codec) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches with the decompressed links of each row; columns are (…, n_links, links)."""
    for batch in batches:
        n = batch.column(batch.num_columns - 2).to_pylist()
        yield batch, [np.frombuffer(codec.decompress(x.as_buffer(), 4 * k), np.uint32) if k else np.zeros(0, np.uint32) for k, x in zip(n, batch.column(batch.num_columns - 1), strict=True)]


def pair_counts(swept: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, n): how many links of the whole table hold each pair of ``Pairs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(len(Pairs.get(path_a, path_b).codes), np.int64), [], 0
        for _, lists in _links(batches, zstd()):
            for x in lists:
                held.append(x)
                n += len(x)
                if n >= COUNTED:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, n = [], 0
        if n:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["pair", "n"])

    return swept.select("n_links", "links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def scored_documents(swept: DataFrame, counts: np.ndarray, best: np.ndarray) -> DataFrame:
    """``swept`` with ``n_best`` and ``count_sum`` in place of ``links``; ``counts`` and ``best`` go by pair."""
    shared = swept.sparkSession.sparkContext.broadcast((counts, best))
    kept = [x for x in SWEPT.split(", ") if not x.startswith(("links", "n_links"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch, lists in _links(batches, zstd()):
            found = [pa.array([int(best[x].sum()) for x in lists], pa.int64()), pa.array([int(counts[x].sum()) for x in lists], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*batch.schema.names[:-1], "n_best", "count_sum"])

    names = [x.split()[0] for x in kept]
    return swept.select(*names, "n_links", "links").mapInArrow(run, ", ".join([*kept, "n_links long", "n_best long", "count_sum long"]))


def events_of(docs: DataFrame, id_col: str, text_col: str, path_a: str, path_b: str, window: int) -> DataFrame:
    """The events of all documents, dealt out by document and sorted for the sweep."""
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return event_rows(keyed, path_a, path_b, window).repartition("key").sortWithinPartitions("key", "win", "side")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, window: int = WINDOW_BYTES) -> DataFrame:
    """One row a document: doc, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    path_a, path_b = path_a or vocabulary_path(), path_b or piece_model_path()
    swept = materialize(swept_documents(events_of(docs, id_col, text_col, path_a, path_b, window), path_a, path_b), "swept-documents")
    pairs = Pairs.get(path_a, path_b)
    counts = np.zeros(len(pairs.codes), np.int64)
    # as many rows as the vocabularies have pairs, at most
    for r in pair_counts(swept, path_a, path_b).toLocalIterator():
        counts[r.pair] = r.n
    return scored_documents(swept, counts, pairs.best(counts))


def aligned_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, window: int = WINDOW_BYTES) -> DataFrame:
    """The groups themselves: (doc, stop, a, b), ``stop`` being the byte offset where a group ends in space + text.

    The last ids of ``a`` and ``b`` are the group's link."""
    path_a, path_b = path_a or vocabulary_path(), path_b or piece_model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sizes = None, [TokenTable.get(path_a).sizes, PieceTable.get(path_b).sizes]
        for own, doc, *sides in windows(batches, sizes):
            if own != key:
                key, sweep = own, Sweep()
            g = sweep.window(*sides)
            cuts = [np.append(0, x + 1).astype(np.int32) for x in (g.last_a, g.last_b)]
            lists = [pa.ListArray.from_arrays(pa.array(c), pa.array(x.astype(np.int32))) for c, x in zip(cuts, (g.a, g.b), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([doc] * len(g.ends), pa.int64()), pa.array(g.ends), *lists], ["doc", "stop", "a", "b"])

    return events_of(docs, id_col, text_col, path_a, path_b, window).mapInArrow(run, "doc long, stop long, a array<int>, b array<int>")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by the byte-level vocabulary (A) and the piece model (B)."""
    return align(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def brute_force(docs: list[tuple]) -> list[tuple]:
    """Plain reference for tests: (doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum)."""
    from collections import Counter

    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(vocabulary_path()), SentencePieceProcessor(model_file=piece_model_path())
    a.encode_special_tokens = True
    raw, at = token_bytes(a.get_vocab(with_added_tokens=True))
    bytes_a = [raw[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)]
    raw, at = piece_bytes(b)
    bytes_b = [raw[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)]
    links, out = Counter(), []
    for doc, text in docs:
        whole = b" " + (text or "").encode()
        both = [(a.encode(" " + text, add_special_tokens=False).ids, bytes_a), (b.encode(text), bytes_b)] if text else []
        if not text or any(b"".join(own[i] for i in ids) != whole for ids, own in both):
            out.append((doc, 0, 0, [], ""))
            continue
        ends = []
        for ids, own in both:
            n, here = 0, {}
            for i in ids:
                n += len(own[i])
                here[n] = i
            ends.append(here)
        common = sorted(ends[0].keys() & ends[1].keys())
        groups, before = [], 0
        for stop in common:
            groups.append("|".join(",".join(str(i) for n, i in e.items() if before < n <= stop) for e in ends))
            before = stop
        own = [(ends[0][c], ends[1][c]) for c in common]
        links.update(own)
        out.append((doc, len(both[0][0]), len(both[1][0]), own, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most: dict[int, int] = {}
    for (_, j), n in links.items():
        most[j] = max(n, most.get(j, 0))
    return [(d, na, nb, len(own), len(own), h, sum(links[x] == most[x[1]] for x in own), sum(links[x] for x in own)) for d, na, nb, own, h in out]
