"""Substring dedup: removes words inside long passages that an earlier document has.

A window is ``window`` consecutive words. A word goes if a window that covers it
also starts in a document with a smaller id.

1. Candidates. In each window the phrase of ``PHRASE`` words with the smallest hash
   is its anchor (the first of equal ones), so equal windows have equal anchors.
   Consecutive windows with one anchor form a piece: about one for 22 words.
2. Recurring phrases. Anchors are counted by hash, with partial aggregation; a
   phrase recurs if it is an anchor in two documents at least. With it go the smallest
   document that holds it and whether all its pieces are the same.
3. Automata. The recurring phrases of the whole corpus are dealt out by hash in shards of
   about ``SHARD`` phrases; each is compiled once, by a task of its own, into an
   Aho-Corasick automaton over two symbols a word, with all phrases that share a string
   there, and kept in the shared folder. Only an occurrence that is a piece's anchor tells
   that the piece may recur, and an anchor's hash names the one shard that may hold it. So
   of all documents the anchors' words are dealt to the shards and streamed through, each
   once however many shards there are; the tasks of one shard share its anchors evenly.
4. Confirmed passages. Of pieces that are the same, word for word, all go but the
   first document's. Around occurrences in differing surroundings, each window is
   confirmed by its own hash, reduced with partial aggregation to the smallest id.
5. Ranges of windows to remove are gathered by document and applied to its words.

Only hashes, positions and the anchors' symbols are shuffled, besides two shuffles of the texts by id;
hot phrases, windows and copies are one row for each map task after partial
aggregation, and the joins that follow can be split by AQE. Windows are told
apart by 128 bits (the anchor's hash and the window's); phrases that look alike to an
automaton are told apart by their hash.

Defined cases: null or empty text has no words; rows with null id keep all words
and count for no one; rows that share an id, and repeated rows, don't remove words
from each other; of equal passages the smallest id keeps its own; a very long text is
held whole, by arrays of its words; an empty table gives an empty frame; the result's
column takes a name that the table doesn't have.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlake.llm.common import _GRAM_INV, SPACE_WORDS, buffers, fresh_name, fresh_path, gram_hashes, gram_prefix, materialize, mix, open_uri, powers, slices, table, text_key, word_hashes, words

WINDOW = 50
PHRASE = 8
PACK = 1 << 20
#: Phrases of one automaton, and words that are streamed through a shard at once at most.
SHARD = 200_000
BUFFER_WORDS = 8_000_000


@dataclass
class Pieces:
    """Runs of consecutive windows with one anchor, over several texts."""

    text: np.ndarray  # which text
    start: np.ndarray  # the first window's first word, within the text
    count: np.ndarray  # number of windows
    anchor: np.ndarray  # the anchor's first word, within the text
    fp: np.ndarray  # the anchor's hash
    ph: np.ndarray  # hash of all words of the piece and of the anchor's place
    first: np.ndarray  # for each text its first word
    windows: np.ndarray  # hash of each window, by its first word over all texts
    stream: bytes = b""  # two symbols for each word over all texts


def pieces(data: np.ndarray, offsets: np.ndarray, window: int, hashes: bool = False) -> Pieces:
    starts, ends, first = words(data, offsets, SPACE_WORDS)
    h = word_hashes(data, starts, ends)
    k = min(PHRASE, window)
    none = np.zeros(0, np.int64)
    stream = np.stack([(h >> np.uint64(58)).astype(np.uint8), (h >> np.uint64(52)).astype(np.uint8) & 63 | 64], 1).tobytes()
    if len(h) < window:
        return Pieces(none, none, none, none, none, none, first, none)
    grams = gram_hashes(h, k)
    anchor = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1).argmin(1) + np.arange(len(h) - window + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(anchor)]
    at = np.flatnonzero(np.arange(len(anchor)) + window <= first[text + 1])
    if not len(at):
        return Pieces(none, none, none, none, none, none, first, none)
    own = anchor[at]
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(own) != 0)]))
    count = np.diff(np.concatenate([begin, [len(at)]]))
    lo, where = at[begin], own[begin]
    total = gram_prefix(h)
    run = (total[lo + count + window - 1] - total[lo]) * powers(_GRAM_INV, len(total))[lo]
    ph = mix(mix(run) ^ _pack(where - lo, count).astype(np.uint64))
    base = first[text[lo]]
    return Pieces(text[lo], lo - base, count, where - base, grams[where].view(np.int64), ph.view(np.int64), first, gram_hashes(h, window).view(np.int64) if hashes else none, stream)


def _pack(start, count):
    """A piece's first word and number of windows in one whole number."""
    return start * PACK + count


def phrases(p: Pieces, window: int, use: np.ndarray | slice = slice(None)) -> pa.Array:
    """The anchors of pieces in symbols."""
    wide = 2 * min(PHRASE, window)
    at = 2 * (p.anchor + p.first[p.text])[use]
    symbols = np.frombuffer(p.stream, np.uint8)[at[:, None] + np.arange(wide)]
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * wide).astype(np.int32)), pa.py_buffer(symbols.tobytes())])


def phrase_rows(ids: DataFrame, window: int) -> DataFrame:
    """(doc, fp, ph, phrase) of each piece, for rows (doc, th, text); ``phrase`` is the anchor in symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column(2))
            for lo, hi in slices(offsets):
                p = pieces(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], window)
                yield pa.RecordBatch.from_arrays([pa.array(doc[p.text + lo]), pa.array(p.fp), pa.array(p.ph), phrases(p, window)], ["doc", "fp", "ph", "phrase"])

    return ids.mapInArrow(run, "doc long, fp long, ph long, phrase binary")


class Shard:
    """An automaton of recurring phrases; by a phrase's number: its hash, its smallest document, whether all pieces are the same.

    A word has 12 bits in the automaton, so different phrases can have one string there. They lie
    behind one another, sorted by hash; the automaton gives the first one's number, ``named`` the right one's."""

    _kept: tuple[str, Shard] | None = None

    def __init__(self, phrases: list[bytes], fp: np.ndarray, lo: np.ndarray, same: np.ndarray):
        groups: dict[bytes, int] = {}
        group = np.array([groups.setdefault(p, len(groups)) for p in phrases], np.int64)
        order = np.lexsort((fp, group))
        self.fp, self.lo, self.same = fp[order], lo[order], same[order]
        first = np.searchsorted(group[order], np.arange(len(groups) + 1))
        self.stop = np.repeat(first[1:], np.diff(first))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for phrase, i in zip(groups, first.tolist(), strict=False):
            self.automaton.add_word(phrase.decode("latin-1"), i)
        if len(self.automaton) != len(groups):
            raise RuntimeError("the automaton lost a phrase")
        self.wide = len(phrases[0]) if phrases else 0
        self.automaton.make_automaton()

    def locate(self, stream: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(first word, first phrase with that string) of each occurrence in a stream of symbols."""
        found = np.array(list(self.automaton.iter(stream.decode("latin-1"))), np.int64).reshape(-1, 2)
        return (found[:, 0] + 1 - self.wide) // 2, found[:, 1]

    def named(self, first: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Of the phrases that share a string with ``first``, the one with the given hash; -1 if there is none."""
        lo, stop = first.copy(), self.stop[first]
        hi = stop.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            less = open_ & (self.fp[np.minimum(mid, len(self.fp) - 1)] < fp)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        at = np.minimum(lo, len(self.fp) - 1)
        return np.where((lo < stop) & (self.fp[at] == fp), at, -1)

    @classmethod
    def load(cls, path: str) -> Shard:
        """Reads a shard from the shared folder; a worker process keeps the last one."""
        if cls._kept is None or cls._kept[0] != path:
            cls._kept = None
            system, at = open_uri(path)
            with system.open_input_stream(at, compression=None) as f:
                cls._kept = path, pickle.loads(f.readall())
        return cls._kept[1]


def compile_shards(known: DataFrame, most: int) -> list[str]:
    """Compiles the phrases of rows (fp, lo, same, phrase); returns the paths of the shards.

    Of n shards, number i has the phrases whose hash is i modulo n; the file names tell i and n."""
    spark = known.sparkSession
    folder = fresh_path(spark, "phrase-automata")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        table_ = pa.Table.from_batches(rows) if rows else None
        paths = []
        if table_ is not None and table_.num_rows:
            fp, lo, same = (table_.column(i).to_numpy() for i in range(3))
            system, at = open_uri(folder)
            system.create_dir(at, recursive=True)
            name = f"{fp[0] % parts}-{parts}-{uuid.uuid4().hex}.automaton"  # a task that is run again writes under a new name
            with system.open_output_stream(f"{at}/{name}", compression=None) as f:
                f.write(pickle.dumps(Shard(table_.column(3).to_pylist(), fp, lo, same)))
            paths.append(f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    parts = max(1, -(-known.count() // most))
    dealt = known.select("fp", "lo", "same", "phrase").repartitionById(parts, F.pmod("fp", F.lit(parts)).cast("int"))
    return sorted(r.path for r in materialize(dealt.mapInArrow(run, "path string"), "phrase-shards").collect())


def streamed(batches: Iterator[pa.RecordBatch], shards: dict[int, str], parts: int, most_words: int) -> Iterator[pa.RecordBatch]:
    """Streams anchors, rows (doc, th, fp, ph, at, phrase), through their shards: those that are located."""
    for batch in batches:
        of_shard = batch.column(2).to_numpy() % parts
        # a task has one shard's rows; it is read once for all of them
        for number in np.unique(of_shard).tolist():
            shard = Shard.load(shards[number])
            own = batch.filter(pa.array(of_shard == number))
            k = shard.wide // 2
            step = max(1, most_words // k)
            for lo in range(0, own.num_rows, step):
                rows = own.slice(lo, step)
                word, phrase = shard.locate(buffers(rows.column(5))[0].tobytes())
                # a phrase ends at one word at most, as all are of one length; one that lies across two anchors is none
                first = np.full(rows.num_rows, -1, np.int64)
                whole = word % k == 0
                first[word[whole] // k] = phrase[whole]
                doc, th, fp, ph, at = (rows.column(i).to_numpy() for i in range(5))
                use = np.flatnonzero(first >= 0)
                named = shard.named(first[use], fp[use])
                right = (named >= 0) & (~shard.same[named] | (doc[use] > shard.lo[named]))
                use, named = use[right], named[right]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[use], th[use], fp[use], ph[use], at[use], shard.same[named])], ["doc", "th", "fp", "ph", "at", "same"])


def located_pieces(ids: DataFrame, shards: list[str], window: int, most_words: int) -> DataFrame:
    """(doc, th, fp, ph, at, same): pieces whose anchor a shard locates, but those that are surely the first of their kind.

    ``at`` packs a piece's first word and its number of windows."""
    spark, kind = ids.sparkSession, "doc long, th long, fp long, ph long, at long, same boolean"
    if not shards:
        return spark.createDataFrame([], kind)
    numbers = [[int(x) for x in path.rpartition("/")[2].split("-")[:2]] for path in shards]
    parts, paths = numbers[0][1], {number: path for (number, _), path in zip(numbers, shards, strict=True)}
    # tasks of one shard stand side by side, so a worker that goes on to the next often has it
    tasks = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.isin(np.arange(parts), list(paths))
        for batch in batches:
            doc, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = buffers(batch.column(2))
            for lo, hi in slices(offsets):
                p = pieces(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], window)
                use = np.flatnonzero(held[p.fp % parts])
                text, fp = p.text[use] + lo, p.fp[use]
                task = fp % parts * tasks + (mix(doc[text].astype(np.uint64)) % np.uint64(tasks)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (doc[text], th[text], fp, p.ph[use], _pack(p.start[use], p.count[use]))), phrases(p, window, use), pa.array(task.astype(np.int32))], ["doc", "th", "fp", "ph", "at", "phrase", "task"])

    dealt = ids.mapInArrow(deal, "doc long, th long, fp long, ph long, at long, phrase binary, task int").repartitionById(parts * tasks, "task").drop("task")
    return dealt.mapInArrow(lambda batches: streamed(batches, paths, parts, most_words), kind)


def window_rows(held: DataFrame, window: int) -> DataFrame:
    """(fp, wh, doc, th, at) of the windows of located pieces, for rows (doc, th, text, packed pieces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = buffers(batch.column(2))
            lists = batch.column(3)
            for lo, hi in slices(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                p = pieces(data[offsets[lo] : offsets[hi]], own, window, hashes=True)
                packed, edge = _pack(p.start, p.count), np.searchsorted(p.text, np.arange(hi - lo + 1))
                wanted = lists.slice(lo, hi - lo)
                use = [edge[d] + np.flatnonzero(np.isin(packed[edge[d] : edge[d + 1]], wanted[d].values.to_numpy())) for d in range(hi - lo)]
                use = np.concatenate([np.zeros(0, np.int64), *use])
                count = p.count[use]
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = np.repeat(p.start[use], count) + step
                of = np.repeat(p.text[use], count)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(p.fp[use], count), p.windows[at + p.first[of]], doc[of + lo], th[of + lo], at)], ["fp", "wh", "doc", "th", "at"])

    return held.mapInArrow(run, "fp long, wh long, doc long, th long, at long")


def recurring_phrases(ids: DataFrame, window: int) -> DataFrame:
    """(fp, lo, same, phrase): anchors of two documents or more, of the whole corpus."""
    known = phrase_rows(ids, window).groupBy("fp", "phrase").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("ph").alias("p0"), F.max("ph").alias("p1"))
    return known.where("lo < hi").select("fp", "lo", (F.col("p0") == F.col("p1")).alias("same"), "phrase")


def recurring_pieces(ids: DataFrame, window: int, shard: int, buffer_words: int) -> DataFrame:
    """(doc, th, at, whole): the recurring pieces; ``whole`` if an earlier document has the same piece.

    Of equal pieces only the first is not whole. What is reduced is written before it
    is joined, so that both sides of the join have a shuffle of their own, which AQE
    can split for a hot anchor."""
    shards = compile_shards(materialize(recurring_phrases(ids, window), "recurring-phrases"), shard)
    recurring = materialize(located_pieces(ids, shards, window, buffer_words), "recurring-pieces")
    mixed = recurring.where("not same").select("doc", "th", "fp", "ph", "at")
    first = materialize(mixed.groupBy("fp", "ph").agg(F.min("doc").alias("first")), "first-pieces")
    mixed = mixed.join(first, ["fp", "ph"]).select("doc", "th", "at", (F.col("doc") > F.col("first")).alias("whole"))
    return recurring.where("same").select("doc", "th", "at", F.lit(True).alias("whole")).unionByName(mixed)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard: int = SHARD, buffer_words: int = BUFFER_WORDS) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct whose name is returned too: ``n_words``,
    ``n_removed``, ``kept`` (words joined by one space) and ``spans`` (removed ranges of words)."""
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text_key(text_col).alias("th"), F.coalesce(text_col, F.lit("")).alias("text"))
    recurring = materialize(recurring_pieces(ids, window, shard, buffer_words), "repeated-pieces")

    mixed = recurring.where("not whole").groupBy("doc", "th").agg(F.collect_set("at").alias("at"))
    held = ids.join(mixed, ["doc", "th"]).select("doc", "th", "text", "at")
    around = materialize(window_rows(held, window), "passage-windows")
    first = around.groupBy("fp", "wh").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("fp", "wh", "lo")
    first = materialize(first, "first-windows")
    late = around.join(first, ["fp", "wh"]).where("doc > lo").select("doc", "th", _pack(F.col("at"), 1).alias("at"))

    whole = recurring.where("whole").select("doc", "th", "at")
    gone = whole.unionByName(late).groupBy("doc", "th").agg(F.collect_set("at").alias("at"))
    names = [fresh_name(docs, x) for x in ("repeat_doc", "repeat_hash", "repeat_at", "repeats")]
    gone = gone.select(F.col("doc").alias(names[0]), F.col("th").alias(names[1]), F.col("at").alias(names[2]))
    both = docs.join(gone, (F.col(id_col) == F.col(names[0])) & (text_key(text_col) == F.col(names[1])), "left").select(*docs.columns, names[2])
    return _apply(both, docs, text_col, names[3], window), names[3]


def _apply(both: DataFrame, docs: DataFrame, text_col: str, name: str, window: int) -> DataFrame:
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("spans", T.ArrayType(T.LongType()))])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, gone = batch.column(at), batch.column(batch.num_columns - 1)
            n_words, n_removed, kept, spans = [], [], [], []
            for i in range(batch.num_rows):
                ws = (column[i].as_py() or "").encode().split()
                ranges = gone[i].as_py()
                n_words.append(len(ws))
                cut: list[int] = []
                if ranges:
                    change = np.zeros(len(ws) + 1, np.int32)
                    packed = np.array(ranges, np.int64)
                    np.add.at(change, packed // PACK, 1)
                    np.add.at(change, packed // PACK + packed % PACK + window - 1, -1)
                    out = np.cumsum(change[:-1]) > 0
                    cut = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8))).tolist()
                    edges = [0, *cut, len(ws)]
                    ws = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in ws[a:b]]
                n_removed.append(n_words[-1] - len(ws))
                kept.append(b" ".join(ws).decode())
                spans.append(cut)
            made = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.int64()))], [f.name for f in kind])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*batch.schema.names[:-1], name])

    return both.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 words, over all documents."""
    found, c = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col(f"{c}.n_words").alias("n_words"), F.col(f"{c}.n_removed").alias("n_removed"), F.sha2(F.col(f"{c}.kept"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, doc, i, md5(array_to_string(ws[i : i + 49], ' ')) AS key
  FROM (SELECT doc_id, doc, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE doc_id IS NOT NULL AND len(ws) >= 50)
), f AS (
  SELECT key, min(doc_id) AS first FROM w GROUP BY key
), g AS (
  SELECT DISTINCT doc, unnest(range(i, i + 50)) AS i FROM w JOIN f USING (key) WHERE first < doc_id
), k AS (
  SELECT a.doc, string_agg(w, ' ' ORDER BY a.i) AS kept, count(*) AS n
  FROM (SELECT doc, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d) a LEFT JOIN g ON a.doc = g.doc AND a.i = g.i
  WHERE g.doc IS NULL GROUP BY a.doc
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc = k.doc
"""


def brute_force(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Plain reference for tests: (doc_id, n_words, n_removed, kept words)."""
    import re

    least: dict[tuple, int] = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    for d, ws in split:
        for i in range(len(ws) - window + 1 if d is not None else 0):
            key = tuple(ws[i : i + window])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, ws in split:
        gone: set[int] = set()
        for i in range(len(ws) - window + 1 if d is not None else 0):
            if least[tuple(ws[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out
