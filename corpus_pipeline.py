"""The corpus pipeline: five stages over ``documents``, each by one operator.

A stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes each one's
rows as Parquet to the shared folder and reads them back as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.bpe import encode
from driftlake.llm.common import fresh_name, materialize, release, table, text_key, written
from driftlake.llm.decontaminate import decontaminate
from driftlake.llm.jaccard_join import jaccard_classes
from driftlake.llm.language_id import UNKNOWN, held_out, identify, train
from driftlake.llm.line_dedup import dedup_lines

#: A text goes if no language holds at least this share of its letters.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those where no language prevails."""
    found, c = identify(docs, train(docs.where(~held_out("doc_id"))))
    return found.where((F.col(f"{c}.lang") != UNKNOWN) & (F.col(f"{c}.score") >= LEAST_SHARE)).drop(c)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops common lines; texts and their lengths change, no document goes."""
    out, _ = dedup_lines(docs)
    return out.select(*[F.char_length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of similar documents the one with the smallest id.

    Rows without an id or without words have no group and stay. Rows that share an id are told
    apart by their text; of rows that share both, one stays."""
    classes = materialize(jaccard_classes(docs).select("doc", "th", "is_first"), "near-duplicates")
    doc, key, mark = (fresh_name(docs, x) for x in ("class_doc", "class_text", "class_mark"))
    # a row of the table below is either gone or, being a class's first, there more than once
    marks = classes.groupBy("doc", "th").agg(F.count("*").alias("n"), F.max("is_first").alias("stays")).where("n > 1 or not stays")
    marks = materialize(marks.select(F.col("doc").alias(doc), F.col("th").alias(key), F.col("stays").alias(mark)), "near-duplicate-marks")
    same = (F.col("doc_id") == F.col(doc)) & (text_key("text") == F.col(key))
    left = docs.join(marks, same, "left_anti")
    twice = marks.where(mark)
    if twice.limit(1).count():
        left = left.unionByName(docs.join(twice, same).dropDuplicates([doc, key]).select(*docs.columns))
    return left


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item."""
    found, c = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.col(f"{c}.n_hit") == 0).drop(c)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded text."""
    found, c = encode(docs.select("doc_id", "text"), keep_ids=True)
    return found.select("doc_id", *[F.col(f"{c}.{x}").alias(x) for x in ("n_tokens", "ids", "ids_sha256", "decoded_sha256")])


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: SQL can express neither the language model nor the tokenizer; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what stages have written is removed as soon as the next one's rows are stored."""
    docs, others = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, [*others, written()[-1]])
    return docs
