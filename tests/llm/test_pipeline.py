"""The pipeline against its stages by brute force, and its planted cases."""

import hashlib
import random

import corpus_pipeline
from driftlake.llm import bpe, common, decontaminate, jaccard_join, language_id, registry


def build(spark, tmp_path):
    rnd = random.Random(1)
    en = [f"{a}{b}" for a in ("the", "and", "was", "ing", "tion", "er") for b in ("", "th", "ou", "nd", "re", "st")]
    de = [f"{a}{b}" for a in ("der", "und", "nicht", "sch", "keit", "ung") for b in ("", "ein", "ge", "tz", "ver", "äu")]
    text = lambda ws, n: " ".join(rnd.choice(ws) for _ in range(n))
    docs = [(i, text(en if i % 3 else de, rnd.randint(20, 80)), "en" if i % 3 else "de") for i in range(60)]
    line = text(en, 12)
    docs = [(i, f"{t}\n{line}\n{text(en if l == 'en' else de, 6)}" if i % 7 == 0 else t, l) for i, t, l in docs]
    bench = [(1, text(en, 15)), (2, text(de, 12))]
    near = docs[4][1].split()
    near[3] = "changed"
    docs += [(100, docs[5][1], "en"), (101, " ".join([*near, *near, *near]), "en"), (102, " ".join([*docs[4][1].split()] * 3), "en"), (103, f"{docs[8][1]} {bench[0][1]} {text(en, 5)}", "en")]
    docs += [(104, None, None), (105, "", "en"), (106, "12 34 !", None), (107, "short text", "en")]
    rows = [(d, t, lang, "src", len(t or "")) for d, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return docs, bench


def brute(spark, folder, docs, bench):
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    model = language_id.train(frame.where(~language_id.held_out("doc_id")))
    kept = [(d, t) for (d, t, _), (lang, score, _) in zip(docs, model.label([t or "" for _, t, _ in docs])) if lang != "und" and score >= 0.5]
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in kept:
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).add(d)
    kept = [(d, "\n".join(x for x in t.split("\n") if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and d < max(holders[key(x)])))) for d, t in kept]
    first = {d: c for d, c, _ in jaccard_join.brute_force(kept)}
    kept = [(d, t) for d, t in kept if first[d] == d]
    hit = {r[0] for r in decontaminate.brute_force(kept, bench) if r[5]}
    return bpe.brute_force([(d, t) for d, t in kept if d not in hit])


def test_pipeline(spark, tmp_path):
    docs, bench = build(spark, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
    assert got == sorted(brute(spark, tmp_path, docs, bench))
    ids = {g[0] for g in got}
    assert not ids & {100, 102, 103, 104, 105, 106} and 107 in ids
    row = out.where("doc_id = 107").first()
    assert len(row.ids) == row.n_tokens and row.decoded_sha256 == hashlib.sha256(b"short text").hexdigest()


def test_stages_keep_the_columns(spark, tmp_path):
    build(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_duplicates_with_odd_rows(spark, tmp_path):
    """Repeated and null ids, repeated rows and clashing names: every unrelated row stays, of a group one."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(9, a), (9, b), (10, c), (11, a + " z"), (9, a), (None, a), (None, a), (12, None), (12, ""), (12, ""), (13, b + " y"), (10, c)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, class_doc long, class_text string")
    got = sorted(map(repr, ((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())))
    assert got == sorted(map(repr, [(9, a), (9, b), (10, c), (None, a), (None, a), (12, None), (12, ""), (12, "")]))
    assert corpus_pipeline.near_duplicates(spark, docs, "").columns == docs.columns


def test_last_stage_on_an_empty_table(spark, tmp_path):
    build(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.bpe(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_registry():
    assert list(registry.QUERIES) == [*(f"op{n}_{x}" for n, x in enumerate("language_id substring_dedup jaccard_join line_dedup bpe html_text quality warc decontaminate topk collocations token_alignment sentencepiece".split(), 1)), "pipeline"]
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_run_leaves_only_the_result(spark, sf_dir):
    before = common.written()
    out = corpus_pipeline.run(spark, sf_dir)
    left = [x for x in common.written() if x not in before]
    assert len(left) == 1 and "pipeline-bpe" in left[0] and out.count() > 0
