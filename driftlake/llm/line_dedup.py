"""Line dedup over levelled sorted runs of line hashes, with DataFrame functions only.

Texts are split once: the hashes of all lines whose keys are long enough are written
with the document and the place of the line.

A run is a table in the shared directory with one row per line key: two 64-bit
hashes, the number of documents that hold the key and the largest id among them;
rows are bucketed by the hashes and sorted by them in each bucket, so that a run is
read in place and in order. A new batch of documents is reduced to such rows, dealt
out in the same buckets, and merge-anti-joined with the live runs one after another.
Keys that none of them has are fresh and become a run of level 0; the others are
*updates* of a key that some run has. When a level holds ``fanout`` runs, they are
merged bucket by bucket into one run of the next level, so a row is rewritten once a
level at most. As no key is in two runs, a key's total is its one row and the sum of
its updates.

A line's key is the line with white space ``[\\x20\\x09-\\x0D]`` stripped at both
ends and A-Z lower-cased. The key of a hot line is one row per map task after partial
aggregation. Keys with a ``HOT``-th of all lines or more, of which there can be
``HOT`` at most, are broadcast to their lines; the others meet theirs in a shuffle, in
which no key holds more than a ``HOT``-th.

Defined cases: null or empty text is one empty line; a row with null id takes no
part and keeps its lines; rows that share an id, and repeated rows, count as one
document; on a tie of the largest id all its rows keep the line; a key repeated in the
document that keeps it stays as often as it stands there; a very long text is one
array of lines; an empty table gives an empty frame; added columns take names that
the table doesn't have.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import fresh_name, fresh_path, materialize, table, text_key

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
BATCHES = 4
FANOUT = 3
HOT = 10_000


def split_lines(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    key = F.trim(line, F.lit(SPACE))
    plain = F.octet_length(key) == F.char_length(key)
    return F.when(plain, F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def line_rows(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(h1, h2, doc, text hash, pos) of each line whose key is long enough."""
    at = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), text_key(text_col).alias("th"), F.posexplode(split_lines(text_col)).alias("pos", "line"))
    keyed = at.select("doc", "th", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"), "doc", "th", "pos")


class LineRuns:
    """The levelled runs: ``levels[i]`` lists the tables of level i, in which each key stands once.

    Tables are written and read in a session of their own, so that no setting of the caller's changes."""

    #: Lets a bucketed scan say that its buckets are sorted, so that merge joins don't sort them again.
    ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.updates = spark.newSession(), fanout, [[]], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            self.spark.conf.set(key, spark.conf.get(key))
        self.spark.conf.set(self.ORDERED, "true")
        self._tables: set[str] = set()

    def runs(self) -> list[DataFrame]:
        return [self._rows(name) for level in self.levels for name in level]

    def _rows(self, name: str) -> DataFrame:
        # the filter keeps all rows; a union of plain scans hands on batches of columns, and such a union doesn't put the
        # same bucket of several tables into one partition, though it says so (Spark 4.1.2)
        return self.spark.table(name).where("n > 0")

    def add(self, keys: DataFrame) -> str:
        """Adds a batch of key rows (h1, h2, n, top), each key once; ids of batches must not overlap.

        What no run has becomes a run of level 0, whose name is returned; the other keys are updates."""
        batch = self._write(keys.select(*KEY, "n", "top"), "batch")
        fresh = self._rows(batch)
        for run in self.runs():
            fresh = fresh.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        name = batch
        if any(self.levels):
            name = self._write(fresh, "run")
            self.updates.append(self._write(self._rows(batch).join(self._rows(name).select(*KEY).hint("merge"), KEY, "left_anti"), "updates"))
            self._forget([batch])
            if len(self.updates) >= self.fanout:
                old, self.updates = self.updates, []
                self.updates = [self._write(_summed(self._union(old)), "updates")]
                self._forget(old)
        self._place(name, 0)
        return name

    def _place(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            # no key is in two runs, so a bucket's runs are only put together and sorted
            old, self.levels[level] = self.levels[level], []
            self._place(self._write(self._union(old), "run"), level + 1)
            self._forget(old)

    def _union(self, names: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._rows(x) for x in names])

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"line_{kind}_{uuid.uuid4().hex}"
        self._tables.add(name)
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", fresh_path(self.spark, name)).saveAsTable(name)
        return name

    def totals(self) -> DataFrame:
        """(h1, h2, n, top) of every key: the row of the run that has it, and what later batches added to it."""
        held = self._union([name for level in self.levels for name in level])
        if not self.updates:
            return held
        more = _summed(self._union(self.updates)).select(*KEY, F.col("n").alias("more"), F.col("top").alias("later"))
        both = held.join(more.hint("merge"), KEY, "left")
        return both.select(*KEY, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("top", "later").alias("top"))

    def _forget(self, names: list[str]) -> None:
        """Takes tables out of the catalogue; their files stay in the shared folder."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self._tables.discard(name)

    def close(self) -> None:
        self._forget(list(self._tables))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 3, least_chars: int = 20, batches: int = BATCHES) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the kept text in place of the text, and two more columns: the
    number of lines before and of those dropped. Returns their names too."""
    spark = docs.sparkSession
    runs = LineRuns(spark)
    held = materialize(line_rows(docs, id_col, text_col, least_chars), "line-hashes")
    try:
        for b in range(batches):
            keys = held.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == b)
            runs.add(keys.groupBy(*KEY).agg(F.countDistinct("doc").alias("n"), F.max("doc").alias("top")))
        path = fresh_path(spark, "common-lines")
        runs.totals().where(F.col("n") >= least_docs).write.parquet(path)
    finally:
        runs.close()
    common = spark.read.schema("h1 long, h2 long, n long, top long").parquet(path)
    # at most HOT keys have a HOT-th of all lines: the size of what is broadcast is bounded
    is_hot = F.col("n") * HOT >= held.count()
    hot, rest = common.where(is_hot).select(*KEY, "top"), common.where(~is_hot).select(*KEY, "top")
    of_hot = held.join(F.broadcast(hot), KEY)
    of_rest = held.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti").join(rest, KEY)
    drops = of_hot.unionByName(of_rest).where(F.col("doc") < F.col("top"))
    drops = drops.groupBy("doc", "th").agg(F.collect_set("pos").alias("gone"))

    names = {x: fresh_name(docs, x) for x in ("n_lines", "n_dropped", "lines", "line_doc", "line_hash", "line_gone", "line_text")}
    lines, doc, th, gone, own = (names[x] for x in ("lines", "line_doc", "line_hash", "line_gone", "line_text"))
    drops = drops.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("gone").alias(gone))
    others = [c for c in docs.columns if c != text_col]
    # lines travel as an array, so that the kept ones are picked in linear time
    left = docs.select(*others, split_lines(text_col).alias(lines), text_key(text_col).alias(own))
    both = left.join(drops, (F.col(id_col) == F.col(doc)) & (F.col(own) == F.col(th)), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(F.col(gone), F.array().cast("array<int>")))
    kept = F.when(F.col(gone).isNull(), F.col(lines)).otherwise(F.transform(stay, lambda i: F.get(F.col(lines), i)))
    out = both.select(
        *[F.array_join(kept, "\n").alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.size(lines).cast("long").alias(names["n_lines"]),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(names["n_dropped"]),
    )
    return out, names


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 20 code points found in at least 3 documents, over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, names = dedup_lines(docs)
    return out.select("doc_id", F.col(names["n_lines"]).alias("n_lines"), F.col(names["n_dropped"]).alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.line, k.i, coalesce(k.doc_id < c.top, false) AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
