"""Phrase collocations against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftlake.llm import collocations

VOCABULARY = ["the", "The", "of", "a", "É", "x.y", "b-c", "ß", "\tq", "new york", "san francisco bay", "one two three four five six", "\n", "日本"]


def odd_docs(n=300, seed=3):
    rnd = random.Random(seed)
    docs = [(rnd.choice(["en", "en", "en", "fr", None, "und"]), rnd.choice([" ", "  ", "\t", ", ", "\r\n"]).join(rnd.choice(VOCABULARY) for _ in range(rnd.randint(0, 60)))) for _ in range(n)]
    return docs + [("en", None), ("xx", ""), ("yy", "A. B! C"), ("en", "new york " * 4000), docs[0], docs[0]]


def frame(spark, docs):
    rows = spark.createDataFrame(docs, "lang string, text string")
    for name in ("phrase", "n", "rank", "total"):
        rows = rows.withColumn(name, F.lit("x"))
    return rows


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("limits", [{"least": 5}, {"least": 3, "keep_percent": 60, "most": 40}, {"least": 2, "max_words": 3}])
def test_collocations(spark, limits):
    docs = odd_docs()
    same([tuple(r) for r in collocations.collocations(frame(spark, docs), **limits).collect()], collocations.brute_force(docs, **limits))


def test_filter_of_few_bits_changes_no_count(spark, monkeypatch):
    docs = odd_docs(80)
    monkeypatch.setattr(collocations, "FILTER_BITS", 1 << 6)
    same([tuple(r) for r in collocations.collocations(frame(spark, docs), least=3).collect()], collocations.brute_force(docs, least=3))


def test_nothing(spark):
    assert collocations.collocations(frame(spark, []).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [("en", None), (None, " \n,")])).count() == 0


def test_products_past_64_bits(spark):
    """Scores are exact where scale * a * n doesn't fit 64 bits."""
    docs = [("en", "a b. " * 300 + "b a. " * 7 + "a. " * 11)] * 3
    scale = 10**16
    same([tuple(r) for r in collocations.collocations(frame(spark, docs), least=5, scale=scale).collect()], collocations.brute_force(docs, least=5, scale=scale))


def test_hash_clash_in_a_slice_is_told_apart(monkeypatch):
    w = collocations.Words(pa.array(["a b c a b", "a c"]), ["en", "en"])
    monkeypatch.setattr(collocations.Words, "phrase_hashes", lambda self, k: np.zeros(len(self.word) - k + 1, np.uint64))
    _, phrase, n = w.counted(2, None)
    same(zip(phrase.to_pylist(), n.tolist(), strict=True), [("a b", 2), ("b c", 1), ("c a", 1), ("a c", 1)])
