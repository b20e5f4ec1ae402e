"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words, not bytes. All windows of test items of one length m are
searched together: the last two words of a search position (a block) index a
table of shifts, which says how far ahead the next position that can end a
window lies; where the shift is 0, a bucket chosen by a hash of the window's
last words names the windows that may end there, and their bytes are compared
directly.

Items of at least ``window`` words give all their windows of that many words;
shorter ones, if not empty, are one window of their own length. So there are at
most ``window`` table sets. Items are taken in blocks of at most ``block_bytes``
of text, and each block is broadcast on its own and applied in a pass of its
own inside the same stage; documents are neither shuffled nor cut.

Defined cases: null or empty text has no words, no hits and is clean; an item
with null id marks words but is not named; repeated items and rows count as
they stand (an item id is named once); an empty benchmark leaves all clean, an
empty table gives an empty frame; a very long text is searched whole, by arrays of
its words; the result's column takes a name that the table doesn't have.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlake.llm.common import LOWER, PLAIN_WORDS, buffers, fresh_name, gram_hashes, materialize, mix, slices, table, word_hashes, words

WINDOW = 10
BLOCK_BYTES = 16 << 20


def _blocks(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Table index of the block that ends at each word; the first word has none (0)."""
    out = np.zeros(len(hashes), np.int64)
    if len(hashes) > 1:
        out[1:] = (mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) >> np.uint64(64 - bits)).astype(np.int64)
    return out


def _plain(raw: bytes) -> bytes:
    """Lower-cased, with a space in place of each byte that is in no word."""
    return raw.translate(_TO_SPACE)


_TO_SPACE = bytes(int(LOWER[i]) if PLAIN_WORDS[LOWER[i]] else 32 for i in range(256))


class Matcher:
    """Shift tables and buckets of one block of items; ``get`` keeps the last one in a worker process."""

    _kept: tuple[tuple[str, int], Matcher] | None = None

    @classmethod
    def get(cls, name: str, block, window: int) -> Matcher:
        key = name, window
        if cls._kept is None or cls._kept[0] != key:
            cls._kept = None
            cls._kept = key, cls(block.value, window)
        return cls._kept[1]

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        #: by window length: table bits, shifts, and for each suffix the windows as bytes with the places of their items
        self.sets: dict[int, tuple[int, np.ndarray, dict[int, dict[bytes, tuple[int, ...]]]]] = {}
        self.names = [item for item, _ in items]
        found: dict[int, list[tuple[int, list[bytes]]]] = defaultdict(list)
        for place, (_, text) in enumerate(items):
            ws = _plain((text or "").encode()).split()
            if ws:
                found[min(window, len(ws))].append((place, ws))
        for m, texts in found.items():
            n = sum(len(ws) - m + 1 for _, ws in texts)
            # so large that most pairs of words are in no window
            bits = min(24, max(12, (16 * n).bit_length()))
            shift = np.full(1 << bits, max(1, m - 1), np.uint8)
            bucket: dict[int, dict[bytes, tuple[int, ...]]] = defaultdict(dict)
            for place, ws in texts:
                data = np.frombuffer(b" ".join(ws), np.uint8)
                s, e, _ = words(data, np.array([0, len(data)]), PLAIN_WORDS)
                h = word_hashes(data, s, e)
                block, suffix = _blocks(h, bits), _suffix(h, m)
                for j in range(1, m):  # the j-th pair of words of every window
                    np.minimum.at(shift, block[j : len(ws) - m + 1 + j], m - 1 - j)
                for i in range(len(ws) - m + 1):
                    own, key = bucket[int(suffix[i + m - 1])], b" ".join(ws[i : i + m])
                    if place not in own.get(key, ()):
                        own[key] = (*own.get(key, ()), place)
            self.sets[m] = bits, shift, dict(bucket)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(number of words, number of hit words, item ids) of each text."""
        low = LOWER[data]
        starts, ends, first = words(low, offsets, PLAIN_WORDS)
        h = word_hashes(low, starts, ends)
        n = len(h)
        hit = np.zeros(n + 1, np.int32)
        ids: dict[int, set[str]] = defaultdict(set)
        for m, (bits, shift, bucket) in self.sets.items():
            step = shift[_blocks(h, bits)].tobytes() if m > 1 else bytes(n)
            suffix = _suffix(h, m)
            for d in range(len(first) - 1):
                p, end = int(first[d]) + m - 1, int(first[d + 1])
                while p < end:
                    ahead = step[p]
                    if ahead:
                        p += ahead
                        continue
                    if (windows := bucket.get(int(suffix[p]))) is not None:
                        lo = p - m + 1
                        named = windows.get(b" ".join(_plain(low[starts[lo] : ends[p]].tobytes()).split()))
                        if named is not None:
                            hit[lo] += 1
                            hit[p + 1] -= 1
                            ids[d].update(self.names[i] for i in named if self.names[i] is not None)
                    p += 1
        covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:n]) > 0)])
        self.covered = np.cumsum(hit[:n]) > 0
        for d in range(len(first) - 1):
            yield int(first[d + 1] - first[d]), int(covered[first[d + 1]] - covered[first[d]]), ids.get(d, set())


def _suffix(h: np.ndarray, m: int) -> np.ndarray:
    """Bucket of the window of m words that ends at each word: a hash of its last words."""
    k = min(m, 4)
    out = np.zeros(len(h), np.uint64)
    if len(h) >= k:
        out[k - 1 :] = gram_hashes(h, k)
    return out


def benchmark_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Items in lists of about ``block_bytes`` of text, read block by block."""
    items = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    for b in range(n):
        got = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).collect() if n > 1 else items.collect()
        yield [tuple(r) for r in got]


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct whose name is returned too:
    ``n_words``, ``n_hit`` (words inside occurrences), ``items`` (sorted ids) and
    ``spans`` (hit ranges of words, as start and end). Other columns pass through."""
    spark = docs.sparkSession
    name = fresh_name(docs, "contamination")
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.LongType()))])
    at = docs.columns.index(text_col)

    out, shared = docs, None
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    for block in benchmark_blocks(items, item_col, item_text_col, block_bytes):
        if shared is not None:
            # a pass is written before the next block is shared, so that one block is held at a time
            out = materialize(out, "decontamination-pass")
            shared.destroy()
        later, shared = shared is not None, spark.sparkContext.broadcast(block)
        out = out.mapInArrow(_pass(shared, at, window, name, later), schema)
    if shared is None:
        out = out.mapInArrow(_pass(spark.sparkContext.broadcast([]), at, window, name, False), schema)
    return out, name


def _pass(block, at: int, window: int, name: str, later: bool):
    kept_as = uuid.uuid4().hex
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher.get(kept_as, block, window)
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            before = batch.column(batch.num_columns - 1).to_pylist() if later else None
            found = []
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1] - offsets[lo]
                rows = list(matcher.scan(data[offsets[lo] : offsets[hi]], part))
                first = np.concatenate([[0], np.cumsum([r[0] for r in rows])]).astype(np.int64)
                for d, (n_words, n_hit, ids) in enumerate(rows):
                    spans: list[int] = []
                    if n_hit:
                        mask = matcher.covered[first[d] : first[d + 1]]
                        spans = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist()
                    if before is not None and (old := before[lo + d])["spans"]:
                        mask = np.zeros(n_words, bool)
                        for s in (spans, old["spans"]):
                            for a, b in zip(s[::2], s[1::2], strict=True):
                                mask[a:b] = True
                        n_hit, ids = int(mask.sum()), ids | set(old["items"])
                        spans = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist()
                    found.append({"n_words": n_words, "n_hit": n_hit, "items": sorted(ids), "spans": spans})
            columns = batch.columns[:-1] if later else batch.columns
            names = [*batch.schema.names[: len(columns)], name]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names)

    return run


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item, with windows of ten words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, c = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col(f"{c}.n_words").alias("n_words"),
        F.col(f"{c}.n_hit").alias("n_hit"),
        F.size(f"{c}.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(f"{c}.items")), 256).alias("items_sha256"),
        (F.col(f"{c}.n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), t AS (
  SELECT item, m, array_to_string(ws[i : i + m - 1], ' ') AS key
  FROM (SELECT item, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), s AS (
  SELECT doc, m, i, array_to_string(ws[i : i + m - 1], ' ') AS key
  FROM (SELECT doc, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM t) WHERE len(ws) >= m)
), h AS (
  SELECT doc, s.i, s.m, item FROM s JOIN t ON s.m = t.m AND s.key = t.key
), c AS (
  SELECT doc, count(DISTINCT p) AS n FROM (SELECT doc, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc
), n AS (
  SELECT doc, count(DISTINCT item) AS items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM h GROUP BY doc
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc = c.doc LEFT JOIN n ON d.doc = n.doc
"""


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Plain reference for tests: rows of (doc_id, text) and (item_id, text)."""
    import re

    def split(text: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    wins: dict[tuple, set] = defaultdict(set)
    for item, text in items:
        ws = split(text)
        m = min(window, len(ws))
        for i in range(len(ws) - m + 1 if ws else 0):
            wins[tuple(ws[i : i + m])].update([] if item is None else [str(item)])
    out = []
    for doc, text in docs:
        ws, hit, ids = split(text), set(), set()
        for m in {len(w) for w in wins}:
            for i in range(len(ws) - m + 1):
                if (got := wins.get(tuple(ws[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    ids |= got
        out.append((doc, len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
