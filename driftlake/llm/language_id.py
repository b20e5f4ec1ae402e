"""Language identification with labelled spans.

Model. Letters are grouped into words; each word gives its character trigrams
and four-grams (with word borders) as hashed features. Their counts per language
come from labelled rows and give smoothed log probabilities. Each language also
has the set of scripts that its training letters are written in.

Prediction. A word's script narrows its candidate languages; its score for each
candidate is the sum over its features. A Viterbi pass over the words of the
whole text, with a penalty for each change of language, labels spans, so texts
of mixed languages are cut into spans. The text's language is the one with most
letters, its score that language's share of all letters.

Training uses a bounded sample: about ``per_lang`` different labelled texts for each
language, chosen by a hash (all where there are fewer; a text that is copied many
times counts once), and about ``most_rows`` of all languages together; the collected
model is at most 2**``BITS`` counts for each language and ``COUNTS`` of all. Every language that has a
labelled text is learned, and everything else covers all rows.

A change of language costs the same between any two, so one maximum a word is enough:
with more than ``DENSE`` languages all texts of a slice advance word by word, in time
and memory linear in languages; what is kept of a word is a bit for each. With fewer,
texts advance in segments, whose tables have a row for each pair of languages; the
labels are the same.

Defined cases: null text, or text without a letter (marks are none): ``und`` with
score 0; if no row can be learned from (an empty table), all texts are ``und``, and
an empty table to label gives an empty frame; ties go to the language that comes
first by name; repeated rows get equal results; a very long text is scored in pieces
cut at white space and labelled whole; the result's column takes a name that the
table doesn't have.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlake.llm.common import SLICE_BYTES, buffers, different_texts, fresh_name, mix, slices, table

BITS = 16
PER_LANG = 3000
SWITCH = 12.0
SEGMENT = 32
#: Labelled texts that are learned from at most, about; at least ten of each language.
MOST_ROWS = 400_000
#: Languages up to which texts advance in segments.
DENSE = 16
#: Texts of more code points are taken in pieces of about this many, fewer with many languages.
PIECE = 1 << 18
#: Counts of the model at most: features times languages; with over 1,024 languages features have fewer bits.
COUNTS = 1 << 26
#: Languages whose counts a task holds.
HELD = 128
#: Code points times languages of a slice, with many languages.
CELLS = 1 << 23
_SPACE = re.compile(r"\s")
UNKNOWN = "und"

# Unicode ranges of the scripts told apart; other letters form one more group.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "ethiopic": [(0x1200, 0x139F)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
}
N_SCRIPTS = len(SCRIPTS) + 1


#: Set in ``letter_scripts`` for marks, which belong to words but are no letters.
MARK = 128


@cache
def letter_scripts() -> np.ndarray:
    """Script of each code point, from 1 (the last: any other), plus MARK for marks; 0 if it is neither letter nor mark."""
    out = np.zeros(0x110000, np.uint8)
    mark = np.zeros(0x110000, bool)
    for c in range(0x33480):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            out[c] = N_SCRIPTS
            mark[c] = kind == "M"
    for i, ranges in enumerate(SCRIPTS.values()):
        for lo, hi in ranges:
            part = out[lo : hi + 1]
            part[part > 0] = i + 1
    out[0xE0100:0xE01F0] = N_SCRIPTS  # variation selectors
    mark[0xE0100:0xE01F0] = True
    out[mark] |= MARK
    return out


class Words:
    """Letters of several texts, the words they form and their features."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        code = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        script = letter_scripts()[code]
        real = (script > 0) & (script < MARK)
        script = script & (MARK - 1)
        inside = script > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        #: for each text the index of its first word, and one more
        ends = np.cumsum([len(t) + 1 for t in low]) if low else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.starts, ends)]).astype(np.int64)
        c = np.where(inside, code, 0)
        padded = np.concatenate([[0, 0], c, [0]]).astype(np.uint64)
        back2, back1, here, ahead = padded[:-3], padded[1:-2], padded[2:-1], padded[3:]
        back2 = np.where(back1 == 0, np.uint64(0), back2)
        three = (back1 << np.uint64(42)) ^ (here << np.uint64(21)) ^ ahead
        four = mix(three + np.uint64(0x9E3779B97F4A7C15)) ^ back2
        shift = np.uint64(64 - BITS)
        self.at = np.flatnonzero(inside)
        self.features = np.stack([(mix(x[self.at]) >> shift).astype(np.int64) for x in (three, four)])
        self.script = script[self.starts] if len(self.starts) else np.zeros(0, np.uint8)
        self.letters = self.ends - self.starts
        total = np.concatenate([[0], np.cumsum(real)])
        #: for each text whether it has a letter that isn't a mark
        self.has_letter = np.diff(total[np.minimum(np.concatenate([[0], ends]), len(real)).astype(np.int64)]) > 0

    def scores(self, table_: np.ndarray) -> np.ndarray:
        """Sum of a (features x languages) table over each word."""
        if not len(self.starts):
            return np.zeros((0, table_.shape[1]), np.float32)
        # features are the first bits of a hash, so a smaller table takes fewer of them
        fewer = BITS - (len(table_) - 1).bit_length()
        each = table_[self.features[0] >> fewer] + table_[self.features[1] >> fewer]
        return np.add.reduceat(each, np.searchsorted(self.at, self.starts), axis=0)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float, segment: int = SEGMENT) -> np.ndarray:
    """Best label of each word, where every change of label costs ``switch``.

    ``first`` bounds the words of each text. Texts are cut into segments that all
    advance together: each segment's best scores between any two labels come from
    one pass, those are chained text by text, and a second pass labels the words."""
    n_words, n = scores.shape
    lengths = np.diff(first)
    per = -(-lengths // segment)
    total = int(per.sum())
    if not total:
        return np.zeros(n_words, np.int64)
    # segments of a text stand one after another; the last may be short
    text = np.repeat(np.arange(len(per)), per)
    nth = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
    lo = first[text] + nth * segment
    size = np.minimum(segment, first[text + 1] - lo)
    index = np.minimum(lo[:, None] + np.arange(segment), n_words - 1)
    live = np.arange(segment) < size[:, None]
    own = np.where(live[..., None], scores[index], 0).astype(np.float64)

    through = np.where(np.eye(n, dtype=bool), 0.0, -np.inf)[None].repeat(total, 0)
    came = np.empty((segment, total, n), np.int8)
    # which is best before each segment
    for j in range(segment):
        on = live[:, j]
        best = through.max(-1, keepdims=True) - switch
        moved = np.maximum(through, best) + own[:, j, None, :]
        through = np.where(on[:, None, None], moved, through)
    enter = np.zeros((total, n))
    v = np.zeros(n)
    for s in range(total):
        if nth[s] == 0:
            v = np.zeros(n)
        enter[s] = v
        v = (v[:, None] + through[s]).max(0)
        v -= v.max()
    v = enter.copy()
    for j in range(segment):
        on = live[:, j]
        top = v.argmax(-1)
        best = v[np.arange(total), top] - switch
        stay = v >= best[:, None]
        came[j] = np.where(stay & on[:, None] | ~on[:, None], np.arange(n), top[:, None])
        v = np.where(on[:, None], np.maximum(v, best[:, None]) + own[:, j], v)
    # label before the segment for each label at its end
    back = np.arange(n)[None].repeat(total, 0)
    rows = np.arange(total)[:, None]
    for j in range(segment - 1, -1, -1):
        back = came[j][rows, back]
    last = v.argmax(-1)
    end = np.empty(total, np.int64)
    for s in range(total - 1, -1, -1):
        final = s == total - 1 or nth[s + 1] == 0
        end[s] = last[s] if final else back[s + 1, end[s + 1]]
    out = np.zeros(n_words, np.int64)
    label = end
    for j in range(segment - 1, -1, -1):
        on = live[:, j]
        out[index[on, j]] = label[on]
        label = came[j][np.arange(total), label]
    return out


class Trellis:
    """The best label of each word of several texts that advance together, linear in labels.

    Of each word the label is kept that a change before it would come from, and a bit for each
    label that is better reached by staying. The scores can come in parts."""

    def __init__(self, texts: int, labels: int, switch: float):
        self.v, self.switch = np.zeros((texts, labels)), switch
        self.tops: list[np.ndarray] = []
        self.stays: list[np.ndarray] = []

    def advance(self, scores: np.ndarray, first: np.ndarray) -> None:
        """Takes the next words of each text; ``first`` bounds them."""
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        begin, live = first[:-1][order], len(order) - np.searchsorted(np.sort(length), np.arange(int(length.max(initial=0))), side="right")
        v = self.v[order]
        tops, stays = np.zeros(len(scores), np.int32), np.zeros((len(scores), -(-v.shape[1] // 8)), np.uint8)
        for j, m in enumerate(live.tolist()):
            rows, own = begin[:m] + j, v[:m]
            top = own.argmax(1)
            best = (own[np.arange(m), top] - self.switch)[:, None]
            tops[rows], stays[rows] = top, np.packbits(own >= best, axis=1)
            np.maximum(own, best, out=own)
            own += scores[rows]
        v -= v.max(1, keepdims=True)
        self.v[order] = v
        self.tops.append(tops)
        self.stays.append(stays)

    def labels(self, first: np.ndarray) -> np.ndarray:
        """The labels of all words of the parts behind one another; ``first`` bounds each text's."""
        tops, stays = np.concatenate(self.tops), np.concatenate(self.stays)
        wide, stays, tops = stays.shape[1], stays.tobytes(), tops.tolist()
        out = np.zeros(len(tops), np.int64)
        for d, label in enumerate(self.v.argmax(1).tolist()):
            for i in range(int(first[d + 1]) - 1, int(first[d]) - 1, -1):
                out[i] = label
                if not stays[i * wide + (label >> 3)] >> (7 - (label & 7)) & 1:
                    label = tops[i]
        return out


def _pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cuts a text after white space, into pieces of about ``size`` code points."""
    at = 0
    while len(text) - at > size:
        space = _SPACE.search(text, at + size)
        if space is None:
            break
        yield text[at : space.end()]
        at = space.end()
    yield text[at:]


class Model:
    """``langs`` in order of name; a log table of features; allowed scripts."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, switch: float = SWITCH):
        self.langs, self.switch = langs, switch
        smooth = counts + 0.5
        self.table = np.log(smooth / smooth.sum(0, keepdims=True)).astype(np.float32) if langs else np.zeros((1 << BITS, 0), np.float32)
        share = scripts / np.maximum(scripts.sum(0, keepdims=True), 1)
        allowed = share >= 0.01
        allowed[~allowed.any(1)] = True
        self.bar = np.where(allowed, 0, -1e4).astype(np.float32)

    @property
    def piece(self) -> int:
        """Code points that are scored at once."""
        return PIECE if len(self.langs) <= DENSE else min(PIECE, max(1 << 12, CELLS // len(self.langs)))

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word of each text, labels and letters of each word, whether a text has a letter).

        Very long texts are taken in pieces, so that only their words are held together, not
        the arrays by code point; with many languages, not even their words' scores."""
        n, dense = len(self.langs), len(self.langs) <= DENSE
        pieces = [list(_pieces(t, self.piece)) for t in texts]
        if all(len(p) == 1 for p in pieces):
            w = Words(texts)
            scores = w.scores(self.table) + self.bar[w.script]
            if dense:
                return w.first, viterbi(scores, w.first, self.switch), w.letters, w.has_letter
            trellis = Trellis(len(texts), n, self.switch)
            trellis.advance(scores, w.first)
            return w.first, trellis.labels(w.first), w.letters, w.has_letter
        counts, labels, letters, has_letter = [], [], [], []
        for own in pieces:
            trellis, scores, size, found = Trellis(1, n, self.switch), [], 0, False
            for p in own:
                w = Words([p])
                size, found = size + len(w.letters), found or bool(w.has_letter[0])
                scored = w.scores(self.table) + self.bar[w.script]
                if dense:
                    scores.append(scored)
                else:
                    trellis.advance(scored, w.first)
                letters.append(w.letters)
            first = np.array([0, size])
            labels.append(viterbi(np.concatenate(scores), first, self.switch) if dense else trellis.labels(first))
            counts.append(size)
            has_letter.append(found)
        return np.concatenate([[0], np.cumsum(counts)]), np.concatenate(labels), np.concatenate(letters), np.array(has_letter)

    def label(self, texts: list[str]) -> Iterator[tuple[str, float, list[tuple[str, int, int]]]]:
        """(language, score, spans) of each text; spans are (language, first word, end)."""
        if not self.langs:
            yield from ((UNKNOWN, 0.0, []) for _ in texts)
            return
        first, best, letters_, has_letter = self.best(texts)
        for d in range(len(texts)):
            lo, hi = first[d], first[d + 1]
            if not has_letter[d]:
                yield UNKNOWN, 0.0, []
                continue
            own, letters = best[lo:hi], letters_[lo:hi]
            share = np.bincount(own, letters, len(self.langs)) / letters.sum()
            edge = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [hi - lo]])
            spans = [(self.langs[own[a]], int(a), int(b)) for a, b in zip(edge, edge[1:], strict=False)]
            top = int(share.argmax())
            yield self.langs[top], float(share[top]), spans


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, most_rows: int = MOST_ROWS) -> Model:
    """Fits a model on about ``per_lang`` different texts of each language, and about ``most_rows`` of all, at least ten of each."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text", F.lit(11))).alias("n"))
    n = {r["lang"]: r["n"] for r in found.collect()}
    langs = sorted(n)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros((N_SCRIPTS + 1, 0)))
    chosen = different_texts(rows, "text", min(per_lang, max(10, most_rows // len(langs))), ["lang"], {(x,): n[x] for x in langs})
    number = {x: i for i, x in enumerate(langs)}
    bits = max(8, min(BITS, (COUNTS // len(langs)).bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # features first, scripts after them; only languages that occur are held, HELD at most
        got: dict[int, np.ndarray] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, own in got.items():
                key = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), lang), pa.int32()), pa.array(key, pa.int32()), pa.array(own[key], pa.int64())], ["lang", "key", "n"])
            got.clear()

        for batch in batches:
            text = batch.column(1)
            for i, lang in enumerate(batch.column(0).to_pylist()):
                if len(got) >= HELD:
                    yield from counted()
                own = got.setdefault(number[lang], np.zeros((1 << bits) + N_SCRIPTS + 1, np.int64))
                for piece in _pieces(text[i].as_py()):
                    w = Words([piece])
                    np.add.at(own, w.features.ravel() >> (BITS - bits), 1)
                    np.add.at(own, (1 << bits) + w.script.astype(np.int64), w.letters)
        yield from counted()

    found = chosen.mapInArrow(count, "lang int, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(((1 << bits) + N_SCRIPTS + 1, len(langs)), np.float32)
    counts[found["key"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    return Model(langs, counts[: 1 << bits], counts[1 << bits :])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct whose name is returned too: ``lang``,
    ``score`` and ``spans`` (language, first word and end word)."""
    name = fresh_name(docs, "language")
    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    arrow_span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            _, offsets = buffers(batch.column(at))
            for lo, hi in slices(offsets, min(SLICE_BYTES // 2, m.piece)):
                part = batch.slice(lo, hi - lo)
                found = list(m.label([t or "" for t in part.column(at).to_pylist()]))
                spans = [[{"lang": a, "first": b, "end": c} for a, b, c in s] for _, _, s in found]
                made = pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, arrow_span)], ["lang", "score", "spans"])
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)])), name


def held_out(id_col: str) -> Column:
    """The rows that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the rows that are not held out, then labels every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out("doc_id")))
    found, c = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col(f"{c}.lang").alias("lang_pred"), F.col(f"{c}.score").alias("score"))
