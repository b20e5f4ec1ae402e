"""SentencePiece coding and token alignment against the libraries, on odd texts."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftlake.llm import sentence_pieces, token_alignment

PARTS = [" ", "  ", "a", "b", "the", "▁", "\n", "\t", "é", "ß", "日本", "語", "😀", "\0", "<s>", "</s>", "<|endoftext|>", "<unk>", "<0x0A>", "‍", "﻿", "0", "12", ".", "!!", " ́", "\r\n", "ing", "\U0010ffff", " ⁇ ", "　", "\xa0", "hello world"]


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    docs = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40)))) for i in range(n)]
    return docs + [(None, "abc def"), (7, None), (7, "abc"), (7, "abc"), (8, ""), (8, "   "), (9, "日本語" * 3000), (10, "x" * 5000), (11, "lorem ipsum dolor " * 4000)]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def with_clashes(rows):
    for name in ("pieces", "n_tokens", "key", "doc", "win", "links"):
        rows = rows.withColumn(name, F.lit("x"))
    return rows


def test_pieces_as_the_library(spark):
    docs = odd_texts(400)
    found, c = sentence_pieces.encode_pieces(with_clashes(spark.createDataFrame(docs, "doc_id long, text string")), keep_ids=True)
    assert c not in ("pieces",) and found.where("pieces = 'x'").count() == len(docs)
    same([(r[0], *r[1][:3]) for r in found.select("doc_id", c).collect()], sentence_pieces.brute_force(docs))
    back, d = sentence_pieces.decode_pieces(found.select("doc_id", "text", F.col(f"{c}.ids").alias("ids")))
    # a marker in a text is a space to the library
    assert all(r[d] == (r["text"] or "").replace("▁", " ") for r in back.collect())
    assert sentence_pieces.encode_pieces(found.select("doc_id", "text").limit(0))[0].count() == 0


def test_piece_table_gives_way(spark):
    """A table too small for its words gives the same ids, and keeps within its bound between slices."""
    docs = odd_texts(300, seed=4)
    small, large = (sentence_pieces.PieceTable(sentence_pieces.piece_model_path(), n) for n in (5_000, 1 << 30))
    for lo in range(0, len(docs), 30):
        part = pa.array([t for _, t in docs[lo : lo + 30]], pa.string())
        a, b = small.encode(part), large.encode(part)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
        small.words.trim()
        assert small.words.size <= 5_000


def test_distinct_words_are_segmented_once():
    table = sentence_pieces.PieceTable(sentence_pieces.piece_model_path())
    learned = []
    table._learn, own = lambda words: (learned.extend(words), own(words)), table._learn
    for text in ("one two  two one", "two one three", "one"):
        table.encode(pa.array([text, text]))
    same(learned, [" one", " two", "  two", " three"])


def test_models_with_pieces_across_markers_are_refused(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "MARKER", "t")
    with pytest.raises(ValueError, match="cross a marker"):
        sentence_pieces.PieceTable(sentence_pieces.piece_model_path())


COLUMNS = ["doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


@pytest.mark.parametrize("window", [1 << 15, 5])
def test_alignment(spark, window):
    docs = odd_texts(250)
    found = token_alignment.align(with_clashes(spark.createDataFrame(docs, "doc_id long, text string")), window=window)
    same([tuple(r) for r in found.select(COLUMNS).collect()], token_alignment.brute_force(docs))


def test_word_table_gives_way():
    """A table too small for its words gives the same ids of both tokenizers."""
    docs = [t or "" for _, t in odd_texts(300, seed=4)]
    paths = token_alignment.vocabulary_path(), token_alignment.piece_model_path()
    small, large = token_alignment.WordTable(*paths, 5_000), token_alignment.WordTable(*paths)
    for lo in range(0, len(docs), 30):
        part = pa.array(docs[lo : lo + 30], pa.string())
        (a, good), (b, fine) = small.encode(part), large.encode(part)
        assert good.tolist() == fine.tolist()
        for x, y in zip(a, b, strict=True):
            assert x[0].tolist() == y[0].tolist() and x[1].tolist() == y[1].tolist()
        small.words.trim()
        assert small.words.size <= 5_000


def test_aligned_groups(spark):
    """Groups of a document tile it, and end where both tokenizers end."""
    docs = [(i, t) for i, t in enumerate(t for _, t in odd_texts(60, seed=2))]
    groups = token_alignment.aligned_groups(spark.createDataFrame(docs, "doc_id long, text string"), window=64)
    sums = {r.doc: r for r in groups.groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.size("a")).alias("a"), F.sum(F.size("b")).alias("b"), F.max("stop").alias("stop")).collect()}
    for doc, n_a, n_b, n_groups, *_ in token_alignment.brute_force(docs):
        if n_a:
            r = sums[doc]
            assert (r.n, r.a, r.b, r.stop) == (n_groups, n_a, n_b, len(docs[doc][1].encode()) + 1)
        else:
            assert doc not in sums


def test_alignment_of_nothing(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align(rows).count() == 0 == token_alignment.aligned_groups(rows).count()


def test_pairs_are_bounded_by_the_vocabularies():
    pairs = token_alignment.Pairs.get(token_alignment.vocabulary_path(), token_alignment.piece_model_path())
    a, b = token_alignment.TokenTable.get(token_alignment.vocabulary_path()), sentence_pieces.PieceTable.get(token_alignment.piece_model_path())
    # each id's suffixes that are ids of the other side; a byte can be two ids of B
    assert len(pairs.codes) <= 2 * (a.sizes.sum() + b.sizes.sum())
