"""Phrase collocations: runs of words that stand together more often than their parts.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words
``[^\\x20\\x09]+``; all counts are by language (null: ``und``).

1. Phrases of 1 to ``max_words`` words are exploded into rows (lang, phrase, count), one
   length after another, counted inside each slice of texts first, and hash-aggregated by
   Spark. A phrase can only reach ``least`` occurrences if its two parts that are one word
   shorter do, so a phrase is exploded only where both may: the frequent phrases one word
   shorter set bits of a filter of bounded size (``FILTER_BITS``), which is broadcast. It has
   false positives, never false negatives, so no count that matters changes.
2. Each candidate (two words or more, ``least`` occurrences) is cut after each of its words;
   both parts are at least as frequent as it, hence counted, and join by phrase. The score
   floor(scale * a * n / (l * r)) is computed in decimals of 38 digits.
3. A candidate goes if a longer one holds it with ``keep_percent`` of its occurrences. Every
   phrase between the two then is a candidate with as many, so an anti-join with those of
   one word more is enough.
4. A window ranks what is left within each language; Spark limits each partition before the
   shuffle, so a hot language sends ``most`` rows a partition.

Counting in a slice goes by hash and is then verified word by word, so it is exact.

Defined cases: null and empty texts have no words; lower-casing leaves other letters alone;
ties in the score go to the smallest cut, ties in rank to the phrase's bytes; repeated rows
count again; a very long text stands alone in its slice; an empty table gives an empty
frame; only the columns of language and text are read, so other names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlake.llm.common import LOWER, buffers, gram_hashes, materialize, mix, slices, table, word_hashes, word_table, words

MAX_WORDS, LEAST, KEEP_PERCENT, MOST, SCALE = 5, 100, 100, 2000, 1000
UNKNOWN = "und"
BREAKS = ".,;:!?\n\x0b\x0c\r"
PHRASE_WORDS = word_table([(ord(c), ord(c)) for c in BREAKS + " \t"])
BREAK_BYTES = ~word_table([(ord(c), ord(c)) for c in BREAKS])
#: Bits of the filter for a frequent phrase, and of the filter at most (16 MiB).
BITS_EACH, FILTER_BITS = 16, 1 << 27
SLICE_BYTES = 1 << 22


class Words:
    """The words of several texts, by their number in a table of distinct words."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        data, offsets = buffers(texts)
        data = LOWER[data]
        starts, ends, first = words(data, offsets, PHRASE_WORDS)
        of = np.repeat(np.arange(len(texts)), np.diff(first))
        breaks = np.append(0, np.cumsum(BREAK_BYTES[data]))
        # neither goes down, so words of one piece are those with one sum
        self.piece = breaks[starts] + of
        names = sorted(set(langs))
        place = {x: i for i, x in enumerate(names)}
        self.lang = np.array([place[x] for x in langs], np.int64)[of]
        self.langs = pa.array(names, pa.string())
        size = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(size), pa.py_buffer(np.ascontiguousarray(data[PHRASE_WORDS[data]]))).dictionary_encode()
        self.table, self.word = coded.dictionary, coded.indices.to_numpy()
        own, at = buffers(self.table)
        lang_data, lang_at = buffers(self.langs)
        self.hash = word_hashes(own, at[:-1], at[1:])[self.word]
        self.lang_hash = word_hashes(lang_data, lang_at[:-1], lang_at[1:])[self.lang]

    def phrase_hashes(self, k: int) -> np.ndarray:
        """A hash of each run of k words and its language, by the first word; runs over several pieces have one too."""
        grams = gram_hashes(self.hash, k)
        return mix(grams ^ self.lang_hash[: len(grams)])

    def counted(self, k: int, frequent: np.ndarray | None) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """(lang, phrase, count) of the phrases of k words whose two shorter parts pass the filter."""
        n = len(self.word) - k + 1
        at = np.flatnonzero(self.piece[:n] == self.piece[k - 1 :]) if n > 0 else np.zeros(0, np.int64)
        if frequent is not None and len(at):
            known = holds(frequent, self.phrase_hashes(k - 1))
            at = at[known[at] & known[at + 1]]
        _, head, group = np.unique(self.phrase_hashes(k)[at], return_index=True, return_inverse=True)
        columns = [self.lang[at], *(self.word[at + j] for j in range(k))]
        if any((c != c[head][group]).any() for c in columns):
            # two phrases with one hash: told apart by their words
            _, head, group = np.unique(np.stack(columns, 1), axis=0, return_index=True, return_inverse=True)
        parts = [self.table.take(pa.array(self.word[at[head] + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
        lang, n = self.langs.take(pa.array(self.lang[at[head]])), np.bincount(group.ravel(), minlength=len(head))
        # in order, so that neighbouring rows begin alike and a shuffle's compression finds it
        order = pc.sort_indices(pa.table({"lang": lang, "phrase": phrase}), [("lang", "ascending"), ("phrase", "ascending")])
        return lang.take(order), phrase.take(order), n[order.to_numpy()]


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash."""
    out = np.ones(len(hashes), bool)
    for place in probes(hashes, 8 * len(bits)):
        out &= bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
    return out


def probes(hashes: np.ndarray, n_bits: int) -> list[np.ndarray]:
    """Two places of each hash in a filter of ``n_bits`` (a power of two)."""
    return [(hashes & np.uint64(n_bits - 1)).astype(np.int64), (hashes >> np.uint64(64 - n_bits.bit_length() + 1)).astype(np.int64)]


def phrase_rows(texts: DataFrame, k: int, frequent: Broadcast | None) -> DataFrame:
    """(lang, phrase, n) for rows (lang, text); for k = 1 also (lang, null, number of words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(frequent.value, np.uint8) if frequent is not None else None
        for batch in batches:
            langs, column = batch.column(0).to_pylist(), batch.column(1)
            _, offsets = buffers(column)
            for lo, hi in slices(offsets, SLICE_BYTES):
                w = Words(column.slice(lo, hi - lo), langs[lo:hi])
                lang, phrase, n = w.counted(k, bits)
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(n, pa.int64())], ["lang", "phrase", "n"])
                if k == 1 and len(w.langs):
                    total = np.bincount(w.lang, minlength=len(w.langs))
                    yield pa.RecordBatch.from_arrays([w.langs, pa.nulls(len(total), pa.string()), pa.array(total, pa.int64())], ["lang", "phrase", "n"])

    return texts.mapInArrow(run, "lang string, phrase string, n long")


def phrase_filter(phrases: DataFrame, k: int) -> bytes:
    """The filter of all phrases (lang, phrase) of k words; its size is bounded, whatever their number."""
    count = phrases.count()
    n_bits = min(FILTER_BITS, 1 << max(16, (BITS_EACH * count - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = Words(batch.column(1), batch.column(0).to_pylist())
                place = np.concatenate(probes(w.phrase_hashes(k)[::k], n_bits))
                yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(np.left_shift(np.int64(1), place & 63))], ["at", "bits"])

    out = np.zeros(n_bits >> 6, np.int64)
    # a row for each 64 bits at most
    for part in phrases.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return out.tobytes()


def frequent_phrases(texts: DataFrame, max_words: int, least: int) -> list[DataFrame]:
    """(lang, phrase, n) by length: phrases with ``least`` occurrences; the first one also holds (lang, null, all words)."""
    found: list[DataFrame] = []
    shared = None
    for k in range(1, max_words + 1):
        rows = phrase_rows(texts, k, shared).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("phrase").isNull())
        found.append(materialize(rows, f"phrases-{k}"))
        if shared is not None:
            shared.unpersist()
        if k < max_words:
            shared = texts.sparkSession.sparkContext.broadcast(phrase_filter(found[-1].where("phrase IS NOT NULL"), k))
    return found


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS, least: int = LEAST, keep_percent: int = KEEP_PERCENT, most: int = MOST, scale: int = SCALE) -> DataFrame:
    """Each language's first ``most`` phrases: lang, rank, phrase, a, l, r, n, score."""
    texts = docs.select(F.coalesce(lang_col, F.lit(UNKNOWN)).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    levels = frequent_phrases(texts, max_words, least)
    totals = levels[0].where("phrase IS NULL").select("lang", F.col("n").alias("total"))
    counts = reduce(DataFrame.unionByName, levels).where("phrase IS NOT NULL")
    candidates = reduce(DataFrame.unionByName, levels[1:]).select("lang", "phrase", F.col("n").alias("a"))

    words_ = F.split("phrase", " ")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size(words_) - 1)))
    first, rest = F.array_join(F.slice(words_, 1, F.col("cut")), " "), F.array_join(F.slice(words_, F.col("cut") + 1, F.size(words_)), " ")
    cuts = cuts.select("*", first.alias("first"), rest.alias("rest"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    whole = "decimal(38,0)"
    score = F.expr(f"(cast({scale} AS {whole}) * cast(a AS {whole}) * cast(total AS {whole})) div (cast(l AS {whole}) * cast(r AS {whole}))")
    scored = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "cut", "l", "r", "total").alias("cut"))
    scored = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))

    longer = candidates.where(F.size(words_) > 2)
    sides = F.array(F.array_join(F.slice(words_, 1, F.size(words_) - 1), " "), F.array_join(F.slice(words_, 2, F.size(words_)), " "))
    longer = longer.select("lang", F.explode(sides).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    within = (scored.lang == longer.lang) & (scored.phrase == longer.phrase) & (F.lit(100) * longer.longer >= F.lit(keep_percent) * scored.a)
    left = scored.join(longer, within, "left_anti")

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.total").alias("n"), "cut.score")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of 2 to 5 words with 100 occurrences, the first 2,000 of each language, over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), k AS (
  SELECT lang, ws, unnest(range(1, 6)) AS k FROM w
), g AS (
  SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM k WHERE len(ws) >= k
), f AS (
  SELECT lang, ws[i : i + k - 1] AS ws, k, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT * FROM f WHERE k > 1 AND f >= 100
), s AS (
  SELECT c.lang, c.ws, c.f AS a, j, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f x ON x.lang = c.lang AND x.ws = c.ws[: j] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[j + 1 :] JOIN n ON n.lang = c.lang
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) = 1
), o AS (
  SELECT lang, list_slice(ws, i, i + m - 1) AS ws, max(f) AS f
  FROM (SELECT lang, ws, f, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)) GROUP BY ALL
), t AS (
  SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, a, l, r, n, score FROM b LEFT JOIN o ON o.lang = b.lang AND o.ws = b.ws WHERE o.f IS NULL OR 100 * o.f < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM t QUALIFY rank <= 2000
"""


def brute_force(docs: list[tuple], max_words: int = MAX_WORDS, least: int = LEAST, keep_percent: int = KEEP_PERCENT, most: int = MOST, scale: int = SCALE) -> list[tuple]:
    """Plain reference for tests, for rows (lang, text)."""
    import re
    from collections import Counter, defaultdict

    count: dict[str, Counter] = defaultdict(Counter)
    for lang, text in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, max_words + 1):
                count[lang or UNKNOWN if lang is None else lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in count.items():
        n = sum(x for p, x in f.items() if len(p) == 1)
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in held.items():
            score, cut = min((scale * a * n // (f[p[:j]] * f[p[j:]]), j) for j in range(1, len(p)))
            inside = (q for q in held if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not any(100 * held[q] >= keep_percent * a for q in inside):
                rows.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -score) for i, (score, a, p, x, y) in enumerate(sorted(rows)[:most])]
    return out
