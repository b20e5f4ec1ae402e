"""The training-data operators against brute force, on small tables with odd rows."""

import gzip
import hashlib
import io
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftlake.llm import bpe, common, decontaminate, html_text, jaccard_join, language_id, line_dedup, quality, substring_dedup, topk, warc
from driftlake.llm.common import buffers

#: Clashing names that the operators use themselves.
EXTRA = "n_words long, n_lines long, language string, quality string, bpe string, repeats string, contamination string, main_text string, lines string, fp long, th long, doc long"


def with_extras(rows):
    out = rows
    for part in EXTRA.split(", "):
        name, kind = part.split()
        out = out.withColumn(name, F.lit(7).cast(kind))
    return out


def frame(spark, rows, schema="doc_id long, text string"):
    return with_extras(spark.createDataFrame(rows, schema))


def odd_docs(seed=3, n=60):
    """Copies, near copies, shared passages and lines, nulls, empty and very long texts, repeated ids."""
    rnd = random.Random(seed)
    voc = [f"w{i}" for i in range(40)] + ["É", "ß,", "Zz", "the", "a\tb"]
    parts = [" ".join(rnd.choice(voc) for _ in range(rnd.randint(4, 90))) for _ in range(9)]
    docs = []
    for i in range(n):
        text = rnd.choice(["\n", " ", "\n\n"]).join(rnd.choice(parts) for _ in range(rnd.randint(1, 4)))
        docs.append((i * 2, text if rnd.random() < 0.8 else text + " " + rnd.choice(voc)))
    docs += [(301, None), (302, ""), (303, " \n\t "), (None, parts[0]), (305, parts[0]), (305, parts[0]), (307, "x " * 20000), (308, "short"), (309, "short")]
    return docs


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_substring_dedup(spark):
    docs = odd_docs()
    for window, shard, buffer_words in ((90, 1 << 20, 1 << 20), (50, 1 << 20, 1 << 20), (50, 7, 300), (12, 50, 10), (4, 1 << 20, 1 << 20)):
        found, c = substring_dedup.remove_repeats(frame(spark, docs), window=window, shard=shard, buffer_words=buffer_words)
        got = [(r[0], r[1].n_words, r[1].n_removed, r[1].kept) for r in found.select("doc_id", c).collect()]
        same(got, substring_dedup.brute_force(docs, window))


def test_substring_automata_decide(spark, monkeypatch):
    """What no automaton locates stays: without a shard nothing is removed."""
    docs = odd_docs()
    monkeypatch.setattr(substring_dedup, "compile_shards", lambda known, most: [])
    found, c = substring_dedup.remove_repeats(frame(spark, docs))
    assert not found.where(f"{c}.n_removed > 0").count()


def test_substring_shards_hold_every_phrase(spark):
    words = [f"w{i}" for i in range(90)]
    docs = [(d, " ".join([f"own{d}", *words[d : d + 70]])) for d in range(12)]
    ids = spark.createDataFrame([(d, 0, t) for d, t in docs], "doc long, th long, text string")
    known = substring_dedup.recurring_phrases(ids, 50)
    shards = [substring_dedup.Shard.load(p) for p in substring_dedup.compile_shards(known, 1)]
    assert len(shards) > 1
    same(np.concatenate([s.fp for s in shards]).tolist(), [r.fp for r in known.collect()])
    data, offsets = buffers(pa.array([t for _, t in docs]))
    p = substring_dedup.pieces(data, offsets, 50)
    for s in shards:
        word, phrase = s.locate(p.stream)
        grams = substring_dedup.gram_hashes(substring_dedup.word_hashes(data, *substring_dedup.words(data, offsets, substring_dedup.SPACE_WORDS)[:2]), 8).view(np.int64)
        same(zip(word.tolist(), s.fp[phrase].tolist()), [(i, g) for i, g in enumerate(grams.tolist()) if g in set(s.fp.tolist())])


def removed(spark, docs, **limits):
    found, c = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), **limits)
    return [(r[0], r[1].n_words, r[1].n_removed, r[1].kept) for r in found.select("doc_id", c).collect()]


@pytest.mark.parametrize("shard", [1, 100, substring_dedup.SHARD])
def test_substring_phrases_that_look_alike(spark, shard):
    """Templated records that differ in one word: 4 of 5 automaton strings are shared, none is lost."""
    n = 40 if shard == 1 else 700
    frame_ = " ".join(["{0} opened the door of the {0} closed a window"] + [f"plain{j}" for j in range(44)])
    docs = [(i + k * n, frame_.format(f"user{i}")) for i in range(n) for k in range(2)]
    same(removed(spark, docs, shard=shard), substring_dedup.brute_force(docs))


def test_substring_phrases_of_one_string(spark):
    """Words chosen so that their 12 bits agree, in the middle of six frames."""
    names = [f"order{i}" for i in range(3000)]
    data, offsets = buffers(pa.array(names))
    bits = substring_dedup.word_hashes(data, offsets[:-1], offsets[1:]) >> np.uint64(52)
    by = {}
    for name, b in zip(names, bits.tolist(), strict=True):
        by.setdefault(b, []).append(name)
    alike = [x[:2] for x in by.values() if len(x) > 1][:6]
    rnd, docs = random.Random(9), []
    for pair in alike:
        ws = [f"v{rnd.randrange(10**6)}" for _ in range(60)]
        for name in pair:
            text = " ".join([*ws[:31], name, *ws[32:]])
            docs += [(len(docs), text), (len(docs) + 1, text)]
    want = substring_dedup.brute_force(docs)
    assert sum(r[2] == 60 for r in want) == 12
    same(removed(spark, docs), want)
    ids = spark.createDataFrame([(d, 0, t) for d, t in docs], "doc long, th long, text string")
    known = substring_dedup.recurring_phrases(ids, 50)
    shards = [substring_dedup.Shard.load(p) for p in substring_dedup.compile_shards(known, 1000)]
    assert sum(len(s.fp) for s in shards) == known.count()


@pytest.mark.parametrize("most", [1, 5, 1 << 20])
def test_substring_anchors_are_streamed_once(spark, monkeypatch, most):
    """However many shards there are, an anchor goes through one of them."""
    words = [f"w{i}" for i in range(400)]
    docs = [(d, " ".join([f"own{d}", *words[d * 5 : d * 5 + 200]])) for d in range(30)]
    ids = spark.createDataFrame([(d, 0, t) for d, t in docs], "doc long, th long, text string")
    paths = substring_dedup.compile_shards(substring_dedup.recurring_phrases(ids, 50), most)
    parts = int(paths[0].rpartition("/")[2].split("-")[1])
    assert (parts == 1) == (most > 30)
    data, offsets = buffers(pa.array([t for _, t in docs]))
    p = substring_dedup.pieces(data, offsets, 50)
    by_number = {int(x.rpartition("/")[2].split("-")[0]): x for x in paths}
    use = np.flatnonzero(np.isin(p.fp % parts, list(by_number)))
    columns = [p.text[use], 0 * use, p.fp[use], p.ph[use], substring_dedup._pack(p.start, p.count)[use]]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), substring_dedup.phrases(p, 50, use)], ["doc", "th", "fp", "ph", "at", "phrase"])
    sizes, locate = [], substring_dedup.Shard.locate
    monkeypatch.setattr(substring_dedup.Shard, "locate", lambda self, stream: sizes.append(len(stream)) or locate(self, stream))
    found = pa.Table.from_batches(substring_dedup.streamed(iter([batch]), by_number, parts, 100))
    assert sum(sizes) == 16 * len(use) and max(sizes) <= 200
    got = [tuple(r.values()) for r in found.to_pylist()]
    same(got, map(tuple, substring_dedup.located_pieces(ids, paths, 50, 1 << 20).collect()))
    assert len({r[2] for r in got}) > 10


def test_substring_dedup_empty_table(spark):
    found, c = substring_dedup.remove_repeats(frame(spark, []))
    assert found.count() == 0


def test_line_dedup(spark):
    docs = odd_docs(5)
    out, names = line_dedup.dedup_lines(frame(spark, docs), least_chars=20, batches=5)
    got = [tuple(r) for r in out.select("doc_id", "text", names["n_lines"], names["n_dropped"]).collect()]

    def key(line):
        return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for d, t in docs:
        if d is not None:
            for line in (t or "").split("\n"):
                holders.setdefault(key(line), set()).add(d)
    want = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and d < max(holders[key(x)]))]
        want.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    same(got, want)
    assert any(w[3] for w in want)


def test_line_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for b in range(4):
        runs.add(spark.createDataFrame([(k, 0, 1, b) for k in range(b, b + 3)], "h1 long, h2 long, n long, top long"))
    assert sum(map(len, runs.levels)) == 1 and len(runs.levels[2]) == 1
    same([tuple(r) for r in runs.totals().select("h1", "n", "top").collect()], [(0, 1, 0), (1, 2, 1), (2, 3, 2), (3, 3, 3), (4, 2, 3), (5, 1, 3)])


def test_line_runs_are_read_in_place(spark):
    """A batch is dealt out once; the runs it meets are neither shuffled nor sorted."""
    runs = line_dedup.LineRuns(spark)
    for b in range(2):
        runs.add(spark.createDataFrame([(k, 0, 1, b) for k in range(b, b + 30)], "h1 long, h2 long, n long, top long").repartition("h1", "h2"))
    spark.conf.set(runs.ORDERED, "true")
    keys = spark.createDataFrame([(k, 0, 1, 9) for k in range(9)], "h1 long, h2 long, n long, top long")
    for held in runs.runs():
        keys = keys.join(held.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
    plan = keys._jdf.queryExecution().executedPlan().toString()
    merged = runs.totals()._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(runs.ORDERED, "false")
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 2 and plan.count(" Sort ") == 1
    assert "Exchange" not in merged
    runs.close()


def test_line_anti_joins_decide(spark, monkeypatch):
    """Without the anti-joins a key of several batches stands in several runs, and its total is lost."""
    # a document in each of the four batches
    ids = [r[0] for r in spark.range(99).groupBy(F.pmod(F.xxhash64("id"), F.lit(4))).agg(F.min("id")).select("min(id)").collect()]
    rows = spark.createDataFrame([(i, f"a line that all documents hold, in every batch\nown line of document number {i}") for i in ids], "doc_id long, text string")
    dropped = lambda: (lambda out, names: out.agg(F.sum(names["n_dropped"])).first()[0])(*line_dedup.dedup_lines(rows, batches=4))
    tables = spark.catalog.listTables()
    assert dropped() == 3 and spark.catalog.listTables() == tables
    monkeypatch.setattr(line_dedup.LineRuns, "runs", lambda self: [])
    assert dropped() == 0


def test_line_runs_are_forgotten_after_a_failure(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "a line that all documents hold, in every batch") for i in range(9)], "doc_id long, text string")

    def fails(self):
        raise RuntimeError("lost")

    tables = spark.catalog.listTables()
    monkeypatch.setattr(line_dedup.LineRuns, "totals", fails)
    with pytest.raises(RuntimeError, match="lost"):
        line_dedup.dedup_lines(rows)
    assert spark.catalog.listTables() == tables


def test_line_dedup_odd_tables(spark):
    line = "the same long line in every document"
    clash = spark.createDataFrame([(i, f"{line}\nown line number {i} of this text", 1, "x") for i in range(4)], "doc_id long, text string, line_hash_ long, line_text string")
    out, names = line_dedup.dedup_lines(clash)
    assert {r.doc_id: r[names["n_dropped"]] for r in out.collect()} == {0: 1, 1: 1, 2: 1, 3: 0}
    out, names = line_dedup.dedup_lines(frame(spark, []))
    assert out.count() == 0
    out, names = line_dedup.dedup_lines(frame(spark, [(1, (line + "\n") * 50000), (2, line), (3, line)]))
    assert {r.doc_id: (r[names["n_lines"]], r[names["n_dropped"]]) for r in out.collect()} == {1: (50001, 50000), 2: (1, 1), 3: (1, 0)}


def test_jaccard_join(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 5)
    rnd = random.Random(4)
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(1, 120))] for _ in range(12)]
    docs = []
    for i in range(120):
        ws = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            ws[rnd.randrange(len(ws))] = f"x{rnd.randint(0, 5)}"
        docs.append((i * 3, " ".join(ws)))
    docs += [(400, ""), (401, None), (402, " ")]
    found = {r.doc: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(frame(spark, [*docs, (None, docs[0][1])])).collect()}
    for doc, class_id, links in jaccard_join.brute_force(docs):
        assert found.get(doc, (doc, 0)) == (class_id, links)


def test_jaccard_large_bucket(spark):
    words = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join(words[:k] + [f"x{i}"] + words[k + 1 :])) for i, k in enumerate(random.Random(1).choices(range(100), k=30))]
    found = jaccard_join.jaccard_classes(frame(spark, docs), part=4).collect()
    assert {r.class_id for r in found} == {0} and len(found) == 30
    same([(r.doc, r.class_id, r.n_links) for r in found], jaccard_join.brute_force(docs))


def test_jaccard_recall_in_large_buckets(spark):
    """Families of more than PART near copies, whose pairs lie on both sides of the threshold, with production constants."""
    rnd = random.Random(11)
    docs, sets = [], []
    for f, n in enumerate((2600, 500)):
        base = [f"f{f}w{i}" for i in range(160)]
        for _ in range(n):
            ws = list(base)
            for k in rnd.sample(range(160), rnd.randint(1, 4)):
                ws[k] = f"x{rnd.randint(0, 10**9)}"
            docs.append((len(docs), " ".join(ws)))
            sets.append({tuple(ws[i : i + 5]) for i in range(156)})
    number = {g: i for i, g in enumerate({g for s in sets for g in s})}
    m = np.zeros((len(docs), len(number)), np.float32)
    for i, s in enumerate(sets):
        m[i, [number[g] for g in s]] = 1
    both = (m @ m.T).astype(int)
    links = 9 * both >= 4 * (156 + 156)
    np.fill_diagonal(links, False)
    share = links.sum() / sum(n * (n - 1) for n in (2600, 500))
    assert 0.2 < share < 0.8
    found = {r.doc: r.n_links for r in jaccard_join.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()}
    want = links.sum(1)
    assert sum(found[i] for i in range(len(docs))) >= 0.999 * want.sum()
    assert all(found[i] <= want[i] for i in range(len(docs)))


def test_jaccard_shortens_as_far_as_the_links_need(spark):
    """Close copies are found by whole prefixes; pairs near the threshold need shorter ones; nothing matched, the shortest."""
    def matched(rows):
        return spark.createDataFrame(rows, "a long, b long, depth int, alike double")

    least = jaccard_join.prefix_depth(0.8, 0.999)
    assert least < jaccard_join.DEPTH
    assert jaccard_join.reached_depth(matched([(2, 1, 6, 0.89)] * 5), 0.8, 0.999, least) == 6
    assert jaccard_join.reached_depth(matched([(2, 1, 6, 0.83)] * 5), 0.8, 0.999, least) == 5
    assert jaccard_join.reached_depth(matched([(2, 1, 6, 0.80)] * 5), 0.8, 0.999, least) == least
    assert jaccard_join.reached_depth(matched([(2, 1, 6, 0.99)] * 5), 0.8, 0.999, least) == least
    assert jaccard_join.reached_depth(matched([]), 0.8, 0.999, least) == least


def test_jaccard_repeated_ids_and_long_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    long = " ".join(f"w{i}" for i in range(40000))
    docs = [(9, a), (9, b), (10, c), (9, a), (11, a + " z"), (12, long), (13, long + " z"), (14, "x " * 20000), (15, "x x x x x")]
    found = jaccard_join.jaccard_classes(frame(spark, docs)).collect()
    same([(r.doc, r.class_id, r.n_links) for r in found], [(9, 9, 2), (9, 9, 2), (9, 9, 0), (10, 10, 0), (11, 9, 2), (12, 12, 1), (13, 12, 1), (14, 14, 1), (15, 14, 1)])
    keys = {(r.doc, r.th): r.class_key for r in found}
    assert len({k for (d, _), k in keys.items() if d == 9}) == 2 and sum(r.is_first for r in found) == 6


def test_jaccard_empty_table(spark):
    assert jaccard_join.jaccard_classes(frame(spark, [])).count() == 0


def test_components(spark):
    edges = [(i + 1, i) for i in range(20)] + [(40, 30), (41, 30), (41, 40), (50, 49)]
    got = {r.node: r.root for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, 40: 30, 41: 30, 50: 49}


def test_bpe(spark):
    rnd = random.Random(2)
    alphabet = [*" \n\t  aébc'sdt1234.,!é ü世界　\x1c\x85😀", "<|endoftext|>", " the", "'ll", " \n"]
    docs = odd_docs(6, 20) + [(900 + i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 200)))) for i in range(150)]
    found, c = bpe.encode(frame(spark, docs), keep_ids=True)
    rows = found.select("doc_id", f"{c}.*").collect()
    same([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows], bpe.brute_force(docs))
    back, d = bpe.decode(found.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), f"{c}.ids"))
    assert back.where(F.col("text") != F.col(d)).count() == 0


def test_bpe_joins_at_any_cut():
    docs = [(0, "a  b\n\n c <|endoftext|> 's x" * 40), (1, "世界" * 500), (2, "  \n " * 99), (3, "no_space" * 300)]
    data, offsets = buffers(pa.array([t for _, t in docs]))
    for bits in (1, 2, 5):
        got = bpe.joined(list(bpe.Encoder(bpe.vocabulary_path(), bits=bits).encode(data, offsets)))
        assert [hashlib.sha256(i.encode()).hexdigest() for i in got] == [r[2] for r in bpe.brute_force(docs)]


def test_bpe_store_is_bounded_by_bytes():
    store = bpe.Store(100_000)
    for i in range(5000):
        store.held[f"k{i}"] = b"1234"
        store.added([f"k{i}"])
        store.trim()
        assert store.size <= 100_000
    assert "k4999" in store.held and "k0" not in store.held
    store.held["long"] = "v" * 50_000, b"", "v", True
    store.added(["long"])
    store.trim()
    assert "long" not in store.held and store.size == sum(map(store._size, store.held))
    # texts without spaces, through an encoder whose stores hold next to nothing
    rnd = random.Random(0)
    docs = [(i, "".join(rnd.choice("世界你好abc019+/") for _ in range(3000))) for i in range(20)] * 2
    data, offsets = buffers(pa.array([t for _, t in docs]))
    coder = bpe.Encoder(bpe.vocabulary_path(), words=60_000, chunks=60_000)
    got = list(coder.encode(data, offsets))
    assert [hashlib.sha256(i.encode()).hexdigest() for i in bpe.joined(got)] == [r[2] for r in bpe.brute_force(docs)]
    coder.words.trim()
    coder.chunks.trim()
    assert coder.words.size <= 60_000 and coder.chunks.size <= 60_000
    assert coder.decode(got) == [t.encode() for _, t in docs]


def test_bpe_decodes_any_ids_as_the_library():
    """Ids in any order, which need not be UTF-8 when put together."""
    coder = bpe.Encoder(bpe.vocabulary_path())
    rng = np.random.default_rng(4)
    size = coder.tokenizer.get_vocab_size(with_added_tokens=True)
    lists = [[i] for i in range(size)] + [rng.integers(0, size, n).tolist() for n in (0, 1, 50, 3000)] + [rng.integers(0, 400, 200).tolist() for _ in range(300)]
    want = coder.tokenizer.decode_batch(lists, skip_special_tokens=False)
    assert coder.decode([np.array(x, np.int32).tobytes() for x in lists]) == [w.encode() for w in want]


def test_bpe_empty_table(spark):
    found, c = bpe.encode(frame(spark, []))
    assert found.count() == 0


def test_decontaminate(spark):
    rnd = random.Random(8)
    words = [f"Q{i}" for i in range(30)] + ["é", "Mixed-Case"]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 25)))) for i in range(30)] + [(90, None), (91, ""), (92, "!?"), (None, "null item id only has this one text of more than ten words"), (5, "repeated id")]
    texts = [t for _, t in items if t]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) + " " + rnd.choice(texts).lower()) for i in range(60)] + [(70, None), (71, ""), (None, texts[0]), (70, texts[1])]
    for block in (1 << 20, 200):
        found, c = decontaminate.decontaminate(frame(spark, docs), with_extras(spark.createDataFrame(items, "item_id long, text string")), block_bytes=block)
        got = [(r[0], r[1].n_words, r[1].n_hit, len(r[1]["items"]), hashlib.sha256(",".join(r[1]["items"]).encode()).hexdigest(), r[1].n_hit > 0) for r in found.select("doc_id", c).collect()]
        same(got, decontaminate.brute_force(docs, items))


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    found, c = decontaminate.decontaminate(frame(spark, [(1, "a b")]), none)
    assert found.first()[c].n_hit == 0
    assert decontaminate.decontaminate(frame(spark, []), none)[0].count() == 0


def test_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6) / 3]) for i in range(160)]
    rows += [(200, None), (201, []), (202, [None] * 6), (203, [float("nan")] * 6), (204, [0.1] * 5), (205, [0.1] * 5), (50, rows[3][1]), (None, rows[0][1])] + [(300 + i, rows[7][1]) for i in range(9)]
    found = topk.top_k(with_extras(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), F.col("vec_id") % 50 == 0, query_block=3)
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    for q in {i for i, _ in good if i % 50 == 0 and i != 50}:
        own = next(v for i, v in good if i == q)
        best = sorted((-int(own @ v), i) for i, v in good if i != q and len(v) == len(own))[:5]
        assert [(-r.score, r.vec_id) for r in found.where(f"query_id = {q}").orderBy("rank").collect()] == best


def test_topk_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], kind), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(50, None), (1, [1.0])], kind), F.col("vec_id") % 50 == 0).count() == 0
    with pytest.raises(OverflowError):
        topk.top_k(spark.createDataFrame([(50, [1e9] * 4), (1, [2e9] * 4)], kind), F.col("vec_id") % 50 == 0)
    large = topk.top_k(spark.createDataFrame([(50, [1e5, -3e5]), (1, [2e5, 1e5]), (2, [2e5, 1e5])], kind), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in large] == [(i, 256 * 256 * (2 * 10**10 - 3 * 10**10)) for i in (1, 2)]


def test_topk_blocks():
    rng = np.random.default_rng(1)
    for n, d, high in ((300, 16, 130), (50, 3, 5), (7, 2, 1), (64, 4, 256)):
        v, ids = rng.integers(-high, high + 1, (n, d)), rng.permutation(n)
        q, r, s = topk.Block(ids, v).top(ids[:10], v[:10], 5)
        for i in range(min(10, n)):
            got = sorted((-a, ids[b]) for a, b in zip(s[q == i], r[q == i]))[:5]
            assert got == sorted((-int(v[i] @ v[j]), ids[j]) for j in range(n) if j != i)[:5]


def test_warc(spark):
    big = "<p>" + "é" * 200
    pages = [(5, "http://a/\r\nX: y", big), (3, "u", big), (9, None, big), (3, "u2", big), (4, "v", "small"), (6, "w", "small"), (7, "x", None), (8, "y", ""), (None, "z", "null id" * 40)]
    manifest = warc.write_archives(with_extras(spark.createDataFrame(pages, "page_id long, url string, html string")), archive_bytes=500)
    got = [tuple(r) for r in warc.read_archives(manifest, payloads=True).collect()]
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(None if p is None else str(p), "revisit" if p in (5, 9) else "response", sha(h), len((h or "").encode()), "3" if p in (5, 9) else None) for p, _, h in pages]
    same([(r[0], r[2], r[3], r[4], r[5]) for r in got], want)
    assert {bytes(r[6]) for r in got if r[6] is not None} == {big.encode(), b"small", b"", b"null id" * 40}
    empty = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_archives(empty).count() == 0


def test_warc_payload_longer_than_a_read(spark):
    rnd = random.Random(1)
    big = "".join(rnd.choice("abcdefgh <>") for _ in range(3 * warc.READ_BYTES))
    pages = spark.createDataFrame([(1, "u", big), (2, "v", big), (3, "w", "x" * 200)], "page_id long, url string, html string")
    got = {r.id: (r.record_type, r.payload_bytes, r.refers_to, r.payload) for r in warc.read_archives(warc.write_archives(pages), payloads=True).collect()}
    assert got["1"] == ("response", len(big), None, bytearray(big.encode())) and got["2"] == ("revisit", len(big), "1", None) and got["3"][0] == "response"


def test_decontaminate_long_text(spark):
    item = " ".join(f"q{i}" for i in range(14))
    found, c = decontaminate.decontaminate(spark.createDataFrame([(1, "word " * 300_000 + item + " word" * 10)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    row = found.first()[c]
    assert (row.n_words, row.n_hit, row["items"], row.spans) == (300_024, 14, ["1"], [300_000, 300_014])


def test_open_uri_understands_hadoop_names(tmp_path):
    assert common.open_uri(f"file://{tmp_path}/x")[1] == f"{tmp_path}/x"
    assert common.open_uri("dbfs:/a/b")[1] == "/dbfs/a/b" and common.STORES["s3a"] == "s3"


def test_release_removes_what_was_written(spark):
    df = common.materialize(spark.range(3), "some-rows")
    path = common._WRITTEN[-1]
    system, at = common.open_uri(path)
    assert df.count() == 3 and system.get_file_info(at).type.name == "Directory"
    kept, common._WRITTEN[:] = common._WRITTEN[:-1], [path]
    assert common.release(spark) == 1 and system.get_file_info(at).type.name == "NotFound"
    common._WRITTEN[:] = kept


def test_warc_frames_and_digests():
    member = warc.record_bytes("response", "1", "u", b"payload", hashlib.sha256(b"payload").hexdigest())
    both = list(warc.read_archive(io.BytesIO(member * 2)))
    assert [r.payload for r in both] == [b"payload"] * 2
    with pytest.raises(warc.CorruptRecord):
        list(warc.read_archive(io.BytesIO(member[:-9])))
    with pytest.raises(warc.CorruptRecord):
        list(warc.read_archive(io.BytesIO(gzip.compress(gzip.decompress(member).replace(b"payload", b"paymoad")))))


PAGE = """<html><head><title>T</title></head><body><div class="top nav"><a href=x>Home</a></div><h2>Heading</h2>
<div><p>This is the first paragraph of the article, and it has a number of words that are in the list.</p><p>Short&nbsp;one &amp; more.</p>
<p title="a > b">Another paragraph that is long enough to be taken as text by the rules of the first pass, x &lt; y.</p></div>
<section id="comments"><p>I like this article and it is the best of all that I have read in the year.</p></section>
<form><p>Name</p></form><script>if (a<b) "</p>"</script><footer>Copyright</footer></body>"""


def test_html(spark):
    text = html_text.main_text(PAGE)
    assert text.startswith("Heading This is the first") and "Short one & more. Another" in text and text.endswith("x < y.")
    marked = "<nav>Menu</nav><article><header><h1>Head</h1></header><p>One.<aside>No</aside><p>T<b>w</b>o<br>three<div class='ad'>Buy</div><p>caf&#233; &lt;b&gt;</article><footer>f</footer>"
    assert html_text.main_text(marked) == "Head One. Two three café <b>"
    for broken in (None, "", "<", "<p", "<!--", "<p title='", "<script>", "</div></div>x", "<a " * 2000):
        html_text.main_text(broken)
    found, c = html_text.extract(with_extras(spark.createDataFrame([(1, None), (2, marked)], "page_id long, html string")))
    assert {r.page_id: r[c] for r in found.collect()} == {1: "", 2: "Head One. Two three café <b>"}


PROSE = "This is a paragraph of the article that is long enough to be judged by the words that it has in it, and it was written for the test."


def test_html_rules_decide_inside_and_outside():
    links = "<ul>" + "".join(f"<li><a href=x>Another page {i} to read</a></li>" for i in range(4)) + "</ul>"
    # inside a marked article a block of links goes by its density
    assert html_text.main_text(f"<article><h2>Head</h2><p>{PROSE}</p>{links}<p>{PROSE}</p></article>") == f"Head {PROSE} {PROSE}"
    # without a mark: heading and short block by their neighbours, links and foreign list out
    page = f"<div>{links}</div><h2>Head</h2><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p><div>{links}</div>"
    assert html_text.main_text(page) == f"Head {PROSE} Short one. {PROSE}"
    # class words count by their head
    for name in ("post entry ad-free", "social-history", "has-sidebar", "no-comments"):
        assert html_text.main_text(f"<div class='{name}'><p>{PROSE}</p></div>") == PROSE
    for name in ("site-header", "mainNav", "comment-list", "ad", "user_comments", "cookie-banner-wrapper"):
        assert html_text.main_text(f"<div class='{name}'><p>{PROSE}</p></div><div><p>{PROSE} Here.</p></div>") == PROSE + " Here."
    # hints are not believed where nothing would be left
    assert html_text.main_text(f"<div class='notice'><p>{PROSE}</p></div>") == PROSE
    # scripts without spaces and languages whose stop words are not known
    chinese = "这是一个足够长的段落因为它有很多汉字所以应该被当作正文的一部分而不是菜单或者页脚的文字"
    assert html_text.main_text(f"<div><p>{chinese}</p></div>") == chinese
    other = "lorusta mekin dola satuvi perkele honta misku veta lomari jutta keko silma ranta talvo merka sunto vesila kotima joki lampi metsa kivi saari tuuli ilma"
    assert html_text.main_text(f"<nav><a href=x>a</a></nav><p>{other}</p>") == other


def test_html_evidence_of_classes():
    """Every word of a class counts, for containers and paragraphs; words that name the article speak for it."""
    other = "We had not seen the river that was behind the house, and it is as wide as they said to us."
    for name in "comment-body comment-text cookie-message sidebar-left ad-slot ad-unit footer-bottom newsletter-form promo-text relatedPosts share_bar".split():
        assert html_text.main_text(f"<div><p>{PROSE}</p></div><div class='{name}'><p>{other}</p></div>") == PROSE, name
        assert html_text.main_text(f"<article><p>{PROSE}</p><p class='{name}'>{other}</p><p>{PROSE}</p></article>") == f"{PROSE} {PROSE}", name
        # nothing else is left: the class isn't believed
        assert html_text.main_text(f"<div class='{name}'><p>{PROSE}</p></div>") == PROSE, name
    assert html_text.main_text(f"<article><p class='advert'>{other}</p><p>{PROSE}</p></article>") == PROSE
    for name in "article-header entry-header postHeader has-sidebar content-with-sidebar".split():
        assert html_text.main_text(f"<div class='{name}'><h1>The title</h1></div><p>{PROSE}</p>") == f"The title {PROSE}", name
    assert html_text.main_text(f"<div class='post comments-open'><p>{PROSE}</p></div><p>{other}</p>") == f"{PROSE} {other}"
    assert html_text.main_text(f"<p>{PROSE}</p><p><a href=x>{other}</a></p><p>{PROSE}</p>") == f"{PROSE} {other} {PROSE}"
    assert html_text.main_text(f"<p>{PROSE}</p><ul><li><a href=x>{PROSE}</a> <a href=y>{other}</a></li></ul>") == PROSE


def test_html_distances_and_ties():
    """An undecided block takes the closer decided neighbour's label; on a tie the one before."""
    decide = lambda *rows: [b.label for b in rows]

    def labelled(*kinds):
        rows = [html_text.Block(t, len(t) if kind == "links" else 0, False, False) for kind, t in kinds]
        html_text._passes(rows, [False] * len(rows))
        return decide(*rows)

    prose, links, short = ("prose", PROSE), ("links", "Home About Us Contact"), ("short", "Short one")
    assert labelled(prose, short, links) == [1, 1, -1] and labelled(links, short, prose) == [-1, -1, 1]
    assert labelled(prose, ("short", "Of four short words"), short, links) == [1, 1, -1, -1]
    assert labelled(short, prose) == [1, 1] and labelled(links, short) == [-1, -1]


def plain_html(blocks):
    return "".join(f"<{k} class='{c}'>{t}</{k}>" if c else f"<{k}>{t}</{k}>" for k, c, t in blocks)


def test_html_against_generated_pages(spark):
    """Pages put together from parts whose label is known; the whole result against the parts that are text."""
    rnd = random.Random(9)
    pages, want = [], {}
    for i in range(60):
        main = [("h2", "", f"Head {i}")] + [("p", "", f"{PROSE} Number {i} {j} of it.") for j in range(rnd.randint(1, 6))]
        around = [("nav", "", "<a href=x>Home</a> <a href=y>More</a>"), ("div", "ad", PROSE), ("footer", "", f"Copyright {PROSE}"), ("div", "sidebar", PROSE), ("script", "", "var a = '<p>no</p>';"), ("div", "comments", f"I like it. {PROSE}")]
        before = rnd.sample(around, rnd.randint(0, 6))
        body = f"<article>{plain_html(main)}</article>" if rnd.random() < 0.5 else plain_html(main)
        pages.append((i, plain_html(before) + body + plain_html([x for x in around if x not in before])))
        want[i] = " ".join(t for _, _, t in main)
    pages += [(7, pages[7][1]), (100, None), (101, ""), (102, f"<p>{PROSE}</p>" * 3000)]
    want |= {100: "", 101: "", 102: " ".join([PROSE] * 3000)}
    found, c = html_text.extract(with_extras(spark.createDataFrame(pages, "page_id long, html string")))
    rows = found.select("page_id", c).collect()
    assert len(rows) == 64 and all(r[c] == want[r.page_id] for r in rows)
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string"))[0].count() == 0


def slow_viterbi(scores, first, switch):
    out = np.zeros(len(scores), int)
    for a, b in zip(first, first[1:]):
        v, back = np.zeros(scores.shape[1]), []
        for i in range(a, b):
            top = v.argmax()
            back.append(np.where(v >= v[top] - switch, np.arange(len(v)), top))
            v = np.maximum(v, v[top] - switch) + scores[i]
        label = v.argmax()
        for i in range(b - 1, a - 1, -1):
            out[i], label = label, back[i - a][label]
    return out


def test_trellis_as_viterbi():
    rng = np.random.default_rng(8)
    for n in (1, 2, 9, 40):
        lengths = rng.integers(0, 40, 7)
        first = np.concatenate([[0], np.cumsum(lengths)])
        scores = np.round(rng.normal(size=(first[-1], n)) * 6)  # with ties
        want = slow_viterbi(scores, first, 9.0)
        trellis = language_id.Trellis(7, n, 9.0)
        trellis.advance(scores, first)
        assert (trellis.labels(first) == want).all() and (language_id.viterbi(scores, first, 9.0) == want).all()
        # one long text, in parts
        parts, whole = language_id.Trellis(1, n, 9.0), np.array([0, first[-1]])
        for lo in range(0, first[-1], 11):
            part = scores[lo : lo + 11]
            parts.advance(part, np.array([0, len(part)]))
        assert (parts.labels(whole) == slow_viterbi(scores, whole, 9.0)).all()


def test_many_languages(spark):
    """All of 500 languages are learned; repeated rows get equal results."""
    word = lambda k, j: "".join(chr(97 + (k * 31 + j * 17 + i * i * (k % 7 + 1)) % 26) for i in range(3 + (k + j) % 5))
    text = lambda k, s: " ".join(word(k, (s + j * 3) % 11) + chr(97 + k % 26) + chr(97 + k // 26) for j in range(30))
    rows = [(k * 4 + s, text(k, s), f"l{k:03}") for k in range(500) for s in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.where("doc_id % 4 < 3"))
    assert len(model.langs) == 500
    found, c = language_id.identify(docs.where("doc_id % 4 = 3").union(docs.where("doc_id = 7")), model)
    got = found.select("lang", f"{c}.lang", f"{c}.score").collect()
    assert {r[1] for r in got} == set(model.langs) and all(r[0] == r[1] for r in got)
    assert len({tuple(r) for r in got if r[0] == "l001"}) == 1


def test_long_text_of_many_languages_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    model = language_id.Model([f"l{i:03}" for i in range(128)], rng.integers(0, 50, (1 << language_id.BITS, 128)).astype(np.float32), np.ones((language_id.N_SCRIPTS + 1, 128)))
    text = " ".join(f"{'abcdefgh'[i % 8]}{'klmnopq'[i % 7]}" for i in range(100_000))
    tracemalloc.start()
    lang, score, spans = next(model.label([text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lang in model.langs and spans[-1][2] == 100_000 and peak < 250e6


def test_viterbi():
    rng = np.random.default_rng(0)
    for _ in range(10):
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 150, 8))])
        scores = rng.normal(size=(first[-1], 4)) * 5
        assert (language_id.viterbi(scores, first, 9.0) == slow_viterbi(scores, first, 9.0)).all()


def test_language_id(spark):
    english, german = "the cat and the dog were in the house with that other thing", "der hund und die katze waren nicht in dem haus mit den anderen"
    russian = "кошка и собака были в доме"
    rows = [(i, t, lang) for i in range(30) for t, lang in ((english, "en"), (german, "de"), (russian, "ru"))] + [(99, "no label", None), (98, None, "en")]
    model = language_id.train(frame(spark, rows, "doc_id long, text string, lang string"))
    tests = [(1, "the other dog"), (2, "die andere katze"), (3, None), (4, ""), (5, "12 34 !"), (6, "собака"), (7, f"{english} {english} {german}"), (8, "the dog " * 30000)]
    found, c = language_id.identify(frame(spark, tests), model)
    got = {r.doc_id: r[c] for r in found.select("doc_id", c).collect()}
    assert [got[i].lang for i in range(1, 9)] == ["en", "de", "und", "und", "und", "ru", "en", "en"]
    assert got[3].score == 0 and 0.5 < got[7].score < 1 and [s.lang for s in got[7].spans] == ["en", "de"]
    marks, c = language_id.identify(frame(spark, [(1, "\u0301 \u0308"), (2, "e\u0301 the dog"), (2, "e\u0301 the dog")]), model)
    assert [(r[c].lang, r[c].score > 0) for r in marks.orderBy("doc_id").collect()] == [("und", False), ("en", True), ("en", True)]
    assert language_id.identify(frame(spark, []), model)[0].count() == 0
    nothing = language_id.train(frame(spark, [], "doc_id long, text string, lang string"))
    found, c = language_id.identify(frame(spark, tests), nothing)
    assert {r[c].lang for r in found.collect()} == {"und"}


def test_language_id_against_brute_force(spark):
    """Labels and scores of whole texts from plain dictionaries and a plain Viterbi pass over words."""
    import math
    import re
    import unicodedata

    rnd = random.Random(5)
    words = {"xa": "lo ra mi ta bela sorin kadu".split(), "xb": "zug wert kamp lo drin holz fex".split(), "xc": "лом рас кот да нет".split()}
    rows = [(i, " ".join(rnd.choice(words[x]) for _ in range(rnd.randint(2, 30))), x) for i, x in enumerate(rnd.choices(list(words), k=60))]
    tests = [(i, " ".join(rnd.choice(words[x]) for x in rnd.choices(list(words), k=2) for _ in range(rnd.randint(1, 12)))) for i in range(40)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    split = lambda t: re.findall(r"[^\W\d_]+", t.lower())

    def grams(w):
        p = ["", "", *w, ""]
        return [g for i in range(2, len(p) - 1) for g in (("3", p[i - 1], p[i], p[i + 1]), ("4", p[i - 2] if p[i - 1] else "", p[i - 1], p[i], p[i + 1]))]

    counts = {x: {} for x in words}
    scripts = {x: {} for x in words}
    script = lambda w: unicodedata.name(w[0]).split()[0]
    for _, t, x in dict.fromkeys((0, t, x) for _, t, x in rows):
        for w in split(t):
            scripts[x][script(w)] = scripts[x].get(script(w), 0) + len(w)
            for g in grams(w):
                counts[x][g] = counts[x].get(g, 0) + 1
    langs = sorted(words)
    size = 1 << language_id.BITS
    score = lambda w, x: sum(math.log((counts[x].get(g, 0) + 0.5) / (sum(counts[x].values()) + 0.5 * size)) for g in grams(w)) + (0 if script(w) in scripts[x] else -1e4)
    found, c = language_id.identify(spark.createDataFrame(tests, "doc_id long, text string"), model)
    got = {r.doc_id: r[c] for r in found.collect()}
    alike = 0
    for i, t in tests:
        ws = split(t)
        table = np.array([[score(w, x) for x in langs] for w in ws])
        label = slow_viterbi(table, [0, len(ws)], language_id.SWITCH)
        share = [sum(len(w) for w, b in zip(ws, label) if b == k) / sum(map(len, ws)) for k in range(3)]
        top = max(range(3), key=lambda k: (share[k], -k))
        alike += got[i].lang == langs[top] and abs(got[i].score - share[top]) < 1e-9
    # features are hashed into 2**BITS places, so a few may share one
    assert alike >= len(tests) - 1


def test_language_id_pieces_and_labels(spark):
    text = "the cat and the dog were in the house with that other thing " * 60
    rows = [(i, text[: 50 + i], "en") for i in range(9)] + [(i, "der hund und die katze waren nicht da", "de") for i in range(9)]
    rows += [(i, "stray words", f"x{i}") for i in range(2000)] + [(i, text, "en") for i in range(100)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=50)
    assert len(model.langs) == 2002 and len(model.table) == 1 << 15
    assert "".join(language_id._pieces(text, 100)) == text and len(list(language_id._pieces(text, 100))) > 10
    whole = list(model.label([text, "x"]))
    old, cells = language_id.PIECE, language_id.CELLS
    language_id.PIECE = language_id.CELLS = 100
    language_id._pieces.__defaults__ = (100,)
    assert list(model.label([text, "x"])) == whole
    language_id.PIECE, language_id.CELLS = old, cells
    language_id._pieces.__defaults__ = (old,)


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = language_id.op1_language_id(spark, sf_dir).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)


def test_quality(spark):
    good = "This is the kind of text that was written by a person for others to read, and it has the words of the language in it. "
    docs = [(i, good + f"It was the part {i} of all that there is to say on this, or so they said to us at the time.") for i in range(80)]
    docs += [(100 + i, " ".join(f"{w}%%%" for w in f"noise{i} a b c d e f g h i j k l m n o p q r s t".split()) + " ###") for i in range(20)]
    docs += [(200, None), (201, ""), (202, " \n"), (203, "x " * 30000)]
    labelled = frame(spark, [(d, t + (" awfulword" if d % 4 == 0 else "")) for d, t in docs[:80]]).withColumn("toxic", (F.col("doc_id") % 4 == 0).cast("int"))
    scorers = quality.train(frame(spark, docs), labelled=labelled)
    found, c = quality.classify(frame(spark, [*docs, (300, docs[1][1] + " awfulword")]), scorers)
    got = {r.doc_id: r[c] for r in found.select("doc_id", c).collect()}
    assert all(got[i].keep for i in range(80)) and not any(got[100 + i].keep for i in range(20))
    assert [got[i].score for i in (200, 201, 202)] == [0, 0, 0] and not got[300].keep
    found, c = quality.classify(frame(spark, docs[:2]), quality.train(frame(spark, [])))
    assert [r[c].score for r in found.collect()] == [0.5, 0.5]


def test_expectation_maximisation_moves_far_from_its_start():
    """Planted rates far from the starting ones are found again, at any size: the start weighs PSEUDO documents."""
    rng = np.random.default_rng(3)
    n, labellers = 40000, 8
    truth = rng.random(n) < 0.6
    yes = np.where(truth[:, None], 0.95 - 0.02 * np.arange(labellers), 0.1 + 0.02 * np.arange(labellers))
    votes = np.where(rng.random((n, labellers)) < yes, quality.GOOD, quality.BAD)
    votes[rng.random((n, labellers)) < 0.2] = quality.ABSTAIN
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = quality.expectation_maximisation(patterns, counts.astype(float))
    # the exact posterior under the planted rates
    log = np.where(patterns == quality.GOOD, 1, 0), np.where(patterns == quality.BAD, 1, 0)
    good, bad = 0.95 - 0.02 * np.arange(labellers), 0.1 + 0.02 * np.arange(labellers)
    odds = np.log(0.6 / 0.4) + (log[0] * np.log(good / bad) + log[1] * np.log((1 - good) / (1 - bad))).sum(1)
    assert np.average(np.abs(post - 1 / (1 + np.exp(-odds))), weights=counts) < 0.01
    assert ((post[which.ravel()] >= 0.5) == truth).mean() > 0.97


def test_quality_scores_against_brute_force(spark):
    """The hashed linear scorer's result from its weights, by plain loops over words."""
    import re

    texts = ["Some Words here, and some 12 words", "### |", "aa aa bb", "x" * 50]
    rng = np.random.default_rng(0)
    scorer = quality.Scorer(quality.SHAPE_BITS)
    scorer.weights[:] = rng.normal(size=len(scorer.weights))
    scorer.bias = 0.3
    data, offsets = buffers(pa.array(texts))
    row, feature, value = quality.Texts(data, offsets).shape_features()
    got = scorer.predict(row, feature, value, len(texts))
    hashes = lambda w: quality.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
    for i, t in enumerate(texts):
        ws, z = t.split(), 0.3
        for j, w in enumerate(ws):
            kinds = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c for c in w))
            z += scorer.weights[int(hashes(kinds.encode())) >> 64 - quality.SHAPE_BITS] / len(ws)
            z += scorer.weights[1] * (j > 0 and w.lower() == ws[j - 1].lower()) / len(ws)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_quality_hot_text_counts_once(spark):
    good = "This is the kind of text that was written by a person for others to read, and it has the words of the language in it. "
    docs = [(i, good + f"part {i}") for i in range(30)] + [(100 + i, good) for i in range(20000)]
    row, feature, value, code = quality._sample(spark.createDataFrame(docs, "doc_id long, text string"), "text", "shape", None, 5000)
    assert len(code) == 31
    found, c = quality.classify(frame(spark, []), quality.train(frame(spark, docs[:3])))
    assert found.count() == 0


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "truth")
    rows = quality.op7_quality(spark, sf).join(labels.select("doc_id", "truth"), "doc_id").collect()
    assert sum((r.score >= 0.5) == (r.truth == 1) for r in rows) >= 0.95 * len(rows)
