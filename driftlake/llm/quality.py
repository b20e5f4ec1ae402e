"""Quality classifier from weak labels.

1. Overlapping heuristic labellers vote on every whole text: good, bad or abstain.
2. The votes of all documents are counted by pattern (at most 3**n patterns, so what
   is collected doesn't depend on the corpus but in its counts), and expectation-
   maximisation estimates each labeller's rates in good and bad documents and the
   share of good ones, without any true label.
3. The posterior of a document's pattern is its label; a linear scorer over hashed
   features (word shapes and their repetition) is trained with it on a bounded
   sample of about ``SAMPLE`` different texts, chosen by a hash (a text that is
   copied many times counts once), then scores every document.

Where a table of human labels is given, a second scorer of the same kind (hashed
words and word beginnings) learns ``toxic`` from at most about ``SAMPLE`` labelled
rows. A document is kept if its quality score is at least 0.5 and, where known,
its toxicity below 0.5.

Defined cases: null or empty text, or one with no word, has score 0 and isn't kept;
with no documents to learn from (an empty table) every score is 0.5, and an empty
table to classify gives an empty frame; repeated rows count as they stand in vote
counts, once in samples, and get equal results; a score of exactly 0.5 is kept, a
toxicity of exactly 0.5 is not; a very long text is scored whole, by arrays of its
words; labels other than 0 and 1 or whose document is missing are not used; the result's
column takes a name that the table doesn't have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlake.llm.common import LOWER, PLAIN_WORDS, SPACE_WORDS, buffers, different_texts, fresh_name, mix, slices, table, word_hashes, words
from driftlake.llm.html_text import STOP_WORDS

#: Hash bits of shape features and of word features.
SHAPE_BITS, WORD_BITS = 16, 22
SAMPLE = 5000
#: Least log-likelihood ratio of a word feature of toxic documents.
SIGNIFICANT = 16.0
GOOD, BAD, ABSTAIN = 1, 0, 2
#: Weight of the starting rates, in documents.
PSEUDO = 10.0
LABELLERS = ("symbols", "capitals", "repeats", "pipes", "stop_words", "word_length", "variety", "trailing_marks")

# byte classes of word shapes: capitals, small letters and all beyond ASCII, digits; marks keep their own code
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*+<=>@\\^_`{|}~!", np.uint8))


def _hash_words(ws: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(ws).encode(), np.uint8)
    s, e, _ = words(data, np.array([0, len(data)]), SPACE_WORDS)
    return word_hashes(data, s, e)


_STOP = np.sort(_hash_words(sorted(STOP_WORDS)))


class Texts:
    """Words of several texts and what labellers and features need of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.offsets = offsets
        self.data, self.low = data, LOWER[data]
        self.starts, self.ends, self.first = words(data, offsets, SPACE_WORDS)
        self.n = np.diff(self.first)
        self.of = np.repeat(np.arange(len(self.n)), self.n)
        self.hash = word_hashes(self.low, self.starts, self.ends)

    def mean(self, per_word: np.ndarray) -> np.ndarray:
        """The mean over each text's words; 0 without words."""
        return np.bincount(self.of, per_word, len(self.n)) / np.maximum(self.n, 1)

    def _count(self, mask: np.ndarray) -> np.ndarray:
        """How many marked bytes each word has."""
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[self.ends] - total[self.starts]

    def same(self) -> np.ndarray:
        out = np.zeros(len(self.hash))
        if len(out) > 1:
            out[1:] = (self.hash[1:] == self.hash[:-1]) & (self.of[1:] == self.of[:-1])
        return out

    def votes(self) -> np.ndarray:
        """(texts x labellers): GOOD, BAD or ABSTAIN."""
        size = self.ends - self.starts
        letters = self._count((self.data >= 65) & (self.data < 91)), self._count((self.low >= 97) & (self.low < 123))
        symbols = self._count(_SYMBOL[self.data])
        stop = _STOP[np.minimum(np.searchsorted(_STOP, self.hash), len(_STOP) - 1)] == self.hash
        order = np.lexsort((self.hash, self.of))
        value, text = self.hash[order], self.of[order]
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        variety = np.bincount(text[fresh], minlength=len(self.n)) / np.maximum(self.n, 1)
        marks = _SYMBOL[self.data[self.ends - 1]] & (size > 1) if len(size) else np.zeros(0, bool)
        pipe = (size == 1) & (self.data[self.starts] == 124) if len(size) else np.zeros(0, bool)
        share = lambda a, b: self.mean(a) / np.maximum(self.mean(b), 1e-9)
        capital, few = share(letters[0], letters[1]), self.n < 20
        votes = np.full((len(self.n), len(LABELLERS)), ABSTAIN, np.int8)
        rules = (
            (share(symbols, size) < 0.02, share(symbols, size) > 0.06),
            (capital < 0.2, capital > 0.5),
            (self.mean(self.same()) < 0.03, self.mean(self.same()) > 0.15),
            (self.mean(pipe) < 0.01, self.mean(pipe) > 0.1),
            (~few & (self.mean(stop) > 0.12), ~few & (self.mean(stop) < 0.04)),
            ((self.mean(size) > 3) & (self.mean(size) < 12), (self.mean(size) > 15) | (self.mean(size) < 2)),
            (~few & (variety > 0.3), ~few & (variety < 0.1 + 10 / np.maximum(self.n, 100))),
            (self.mean(marks) < 0.03, self.mean(marks) > 0.2),
        )
        for i, (good, bad) in enumerate(rules):
            votes[good, i] = GOOD
            votes[bad, i] = BAD
        votes[self.n == 0] = ABSTAIN
        return votes

    def shape_features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value): shares of word shapes and of words that repeat the one before."""
        code = _SHAPE[self.data]
        code[~SPACE_WORDS[self.data]] = 32
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        if len(self.starts):
            new[self.starts] = True
        place = np.concatenate([[0], np.cumsum(new)])
        short = code[new]
        shape = word_hashes(short, place[self.starts], np.maximum(place[self.ends], place[self.starts] + 1)) if len(short) else self.hash
        of = np.concatenate([self.of, self.of])
        feature = np.concatenate([(shape >> np.uint64(64 - SHAPE_BITS)).astype(np.int64), np.full(len(shape), 1)])
        value = np.concatenate([np.ones(len(shape)), self.same()]) / np.maximum(self.n[of], 1)
        return self._gather(of, feature, value, SHAPE_BITS)

    def word_features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value): 1 for each word, without marks, and each word beginning that occurs."""
        starts, ends, first = words(self.low, self.offsets, PLAIN_WORDS)
        of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        parts = [word_hashes(self.low, starts, np.minimum(ends, starts + k)) for k in (1 << 30, 7, 6, 5, 4)]
        feature = np.concatenate([(mix(x + np.uint64(i)) >> np.uint64(64 - WORD_BITS)).astype(np.int64) for i, x in enumerate(parts)])
        text, feature, value = self._gather(np.concatenate([of] * len(parts)), feature, np.ones(len(feature)), WORD_BITS)
        return text, feature, np.ones(len(feature))

    @staticmethod
    def _gather(text: np.ndarray, feature: np.ndarray, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, back = np.unique(text << bits | feature, return_inverse=True)
        return key >> bits, key & ((1 << bits) - 1), np.bincount(back, value, len(key))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The posterior of ``good`` for each pattern of votes (patterns x labellers).

    A labeller that abstains tells nothing. Rates start from, and are smoothed by,
    ``PSEUDO`` documents whatever the size of the data: labellers rarely vote bad on
    good documents, while each sees only some kinds of bad ones."""
    n = patterns.shape[1]
    one_hot = np.stack([patterns == v for v in (BAD, GOOD)], -1).astype(float)
    start = np.array([[0.4, 0.6], [0.01, 0.99]])  # class x (bad, good)
    rates, prior = np.repeat(start[:, None], n, 1), np.array([0.3, 0.7])
    post = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        log = np.log(prior)[:, None] + np.einsum("pnv,cnv->cp", one_hot, np.log(rates))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        weight = np.stack([(1 - new) * counts, new * counts])
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        rates = np.einsum("cp,pnv->cnv", weight, one_hot) + PSEUDO * start[:, None]
        rates /= rates.sum(-1, keepdims=True)
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post


class Scorer:
    """A logistic linear model over hashed features."""

    def __init__(self, bits: int):
        self.bits, self.weights, self.bias = bits, np.zeros(1 << bits, np.float32), 0.0

    def fit(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> Scorer:
        """AdaGrad on the whole sample; classes weigh alike."""
        n, share = len(target), float(np.clip(target.mean() if len(target) else 0.5, 1e-3, 1 - 1e-3))
        own, feature = np.unique(feature, return_inverse=True)
        weight = np.where(target >= 0.5, 0.5 / share, 0.5 / (1 - share))
        w, seen, seen_bias = np.zeros(len(own)), np.full(len(own), 1e-8), 1e-8
        for _ in range(rounds if n else 0):
            z = np.bincount(row, w[feature] * value, n) + self.bias
            error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) * weight
            slope = np.bincount(feature, error[row] * value, len(own)) / n + decay * w
            seen += slope**2
            w -= rate * slope / np.sqrt(seen)
            seen_bias += error.mean() ** 2
            self.bias -= rate * error.mean() / np.sqrt(seen_bias)
        self.weights[own] = w
        return self

    def predict(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(row, self.weights[feature] * value, n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _code(votes: np.ndarray) -> np.ndarray:
    return votes.astype(np.int64) @ (3 ** np.arange(votes.shape[1], dtype=np.int64))


def vote_counts(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """All patterns of votes and how many documents have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for lo, hi in slices(offsets):
                t = Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                code, count = np.unique(_code(t.votes())[t.n > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(count)], ["code", "n"])

    got = docs.select(text_col).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toPandas()
    codes = got["code"].to_numpy().astype(np.int64)
    return (codes[:, None] // 3 ** np.arange(len(LABELLERS))) % 3, got["n"].to_numpy().astype(float)


def significant_features(rows: DataFrame, text_col: str, target: str, least: float) -> np.ndarray:
    """Word features that are more frequent in the second class with at least that log-likelihood
    ratio, so that chance words are left out. Counts are made in Spark; few features pass."""
    rows = rows.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(target).cast("double").alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            wanted = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in slices(offsets):
                text, feature, _ = Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).word_features()
                own, back = np.unique(feature, return_inverse=True)
                yes, every = np.bincount(back, wanted[lo:hi][text], len(own)), np.bincount(back, minlength=len(own))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(yes), pa.array(every.astype(float))], ["feature", "yes", "every"])

    share = rows.agg(F.avg("target")).first()[0]
    if share is None or not 0 < share < 1:
        return np.zeros(0, np.int64)
    counts = rows.mapInArrow(run, "feature long, yes double, every double").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("every").alias("every"))
    part = F.least(F.col("yes") / F.col("every"), F.lit(1 - 1e-9))
    gain = F.col("yes") * F.log(part / share) + (F.col("every") - F.col("yes")) * F.log((1 - part) / (1 - share))
    found = counts.where((F.col("yes") > 0.8 * F.col("every")) & (gain >= least)).select("feature").toPandas()
    return np.sort(found["feature"].to_numpy().astype(np.int64))


def _sample(rows: DataFrame, text_col: str, kind: str, target: str | None, most: int, only: np.ndarray | None = None) -> tuple:
    """(row, feature, value, code or target) of about ``most`` different texts, chosen by a hash.

    With ``only``, other features are left out."""
    rows = rows.select(F.col(text_col).alias("text"), (F.col(target) if target else F.lit(0)).cast("long").alias("target"))
    n = rows.agg(F.approx_count_distinct(F.xxhash64("text", F.lit(11)))).first()[0]
    chosen = different_texts(rows, "text", most, ["target"], {(v,): n for v in ((0, 1) if target else (0,))}).select("text", "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for lo, hi in slices(offsets):
                t = Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                text, feature, value = getattr(t, f"{kind}_features")()
                if only is not None:
                    use = np.isin(feature, only)
                    text, feature, value = text[use], feature[use], value[use]
                wanted = batch.column(1).slice(lo, hi - lo).to_numpy() if target else _code(t.votes())
                edge = np.searchsorted(text, np.arange(hi - lo + 1))
                use = np.flatnonzero(t.n)
                arrays = [pa.array([x[edge[d] : edge[d + 1]].astype(kind_).tobytes() for d in use], pa.binary()) for x, kind_ in ((feature, np.int32), (value, np.float32))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(wanted[use])], ["feature", "value", "target"])

    got = chosen.mapInArrow(run, "feature binary, value binary, target long").toArrow().to_pylist()
    got.sort(key=lambda r: (r["target"], r["feature"], r["value"]))
    features = [np.frombuffer(r["feature"], np.int32) for r in got]
    values = [np.frombuffer(r["value"], np.float32) for r in got]
    row = np.repeat(np.arange(len(got)), [len(f) for f in features])
    flat = lambda xs, kind_: np.concatenate([np.zeros(0, kind_), *xs])
    return row, flat(features, np.int32), flat(values, np.float32), np.array([r["target"] for r in got], np.int64)


def train(docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None, toxic_col: str = "toxic", sample: int = SAMPLE) -> tuple[Scorer, Scorer | None]:
    """Fits the quality scorer on weak labels and, given rows with text and label, the toxicity scorer."""
    patterns, counts = vote_counts(docs, text_col)
    row, feature, value, code = _sample(docs, text_col, "shape", None, sample)
    post = dict(zip(_code(patterns).tolist(), expectation_maximisation(patterns, counts).tolist(), strict=True))
    quality = Scorer(SHAPE_BITS).fit(row, feature, value, np.array([post.get(c, 0.5) for c in code.tolist()]))
    toxic = None
    if labelled is not None:
        labelled = labelled.where(F.col(toxic_col).cast("long").isin(0, 1))
        row, feature, value, target = _sample(labelled, text_col, "word", toxic_col, sample, significant_features(labelled, text_col, toxic_col, SIGNIFICANT))
        toxic = Scorer(WORD_BITS).fit(row, feature, value, target.astype(float))
    return quality, toxic


def classify(docs: DataFrame, scorers: tuple[Scorer, Scorer | None], text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct whose name is returned too: ``score``, ``toxic`` (null
    if not learned), ``keep`` and the labellers' ``votes``."""
    name = fresh_name(docs, "quality")
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("toxic", T.DoubleType()), T.StructField("keep", T.BooleanType()), T.StructField("votes", T.ArrayType(T.IntegerType()))])
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(scorers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quality, toxic = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            score, bad, votes = [np.zeros(0)], [np.zeros(0)], []
            for lo, hi in slices(offsets):
                t = Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                score.append(np.where(t.n > 0, quality.predict(*t.shape_features(), len(t.n)), 0.0))
                bad.append(np.where(t.n > 0, toxic.predict(*t.word_features(), len(t.n)) if toxic else 0.0, 0.0))
                votes += t.votes().astype(np.int32).tolist()
            score, bad = np.concatenate(score), np.concatenate(bad)
            keep = (score >= 0.5) & (bad < 0.5)
            made = pa.StructArray.from_arrays(
                [pa.array(score), pa.array(bad) if toxic else pa.nulls(len(bad), pa.float64()), pa.array(keep), pa.array(votes, pa.list_(pa.int32()))],
                [f.name for f in kind],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)])), name


def label_sample(labels: DataFrame, id_col: str, toxic_col: str, most: int = SAMPLE) -> DataFrame:
    """About ``most`` labelled ids, chosen by a hash of the id: a frame of bounded size."""
    labels = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull()).select(id_col, toxic_col)
    n = labels.count()
    return labels.where(F.pmod(F.xxhash64(id_col, F.lit(13)), F.lit(1 << 20)) < int(min(1.0, most / max(n, 1)) * (1 << 20)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, toxicity and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the sample is bounded, so it is broadcast and no text is shuffled
    labelled = docs.join(F.broadcast(label_sample(table(spark, sf_dir, "labels"), "doc_id", "toxic")), "doc_id")
    found, c = classify(docs, train(docs, labelled=labelled))
    return found.select("doc_id", *[F.col(f"{c}.{x}").alias(x) for x in ("score", "toxic", "keep")])
