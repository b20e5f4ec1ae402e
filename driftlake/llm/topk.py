"""Exact top-k by inner product over a bit-sliced index.

Rows are taken in blocks. In a block every quantised attribute is stored as bit
slices: bitmap b of attribute d has a bit for each row, set where bit b of the
row's coarse value is set. For a group of queries together, the slices that a
query's coarse weight selects are added with bitmap arithmetic: carry-save adders
take three bitmaps of a place to one of that place and one of the next, until a
single bitmap is left at each place, which are the slices of the coarse scores.
The k-th best coarse score is found from the most significant slice downward.

Coarse values drop the lowest bits of the attributes; the error this can make is
bounded for each query, so all rows within the bound of the k-th (the
boundary rows, also found by comparing slices from the top) are resolved with
exact integer arithmetic. Results are exact, ties included.

Queries are a stated set; they are taken in blocks of at most ``query_block``,
and each block, of bounded size, is broadcast and applied to all rows in one
pass, whose results are written before the next block is read. The best of each
row block are merged by a partially limited window.

Defined cases: a vector that is null or empty, holds a null or a non-finite
component, or differs in length from the query's, takes no part; a row with
null id neither; rows that share a query's id are all its own; ties go to the
smaller id; of rows with one id, each is a candidate (listed again if it scores);
components so large that length x (256 x)^2 reaches 2^62 raise an OverflowError, as
their scores may not fit a long; very long vectors are exact within that bound; an
empty table gives an empty frame; other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlake.llm.common import materialize, table

QUERY_BLOCK = 4096
ROW_BLOCK = 16384
GROUP = 64
SCALE = 256
#: Bits dropped from attributes for the coarse pass.
DROP = 2


def to_bitmap(mask: np.ndarray) -> np.ndarray:
    """Rows (last axis) as bits of 64-bit words."""
    packed = np.packbits(mask, axis=-1, bitorder="little")
    short = -packed.shape[-1] % 8
    if short:
        packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], short), np.uint8)], axis=-1)
    return np.ascontiguousarray(packed).view(np.uint64)


def from_bitmap(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


class Places:
    """Bitmaps waiting at each binary place; adding keeps at most two at a place."""

    def __init__(self):
        self.at: list[list[np.ndarray]] = []

    def add(self, place: int, bits: np.ndarray) -> None:
        while True:
            while len(self.at) <= place:
                self.at.append([])
            own = self.at[place]
            own.append(bits)
            if len(own) < 3:
                return
            a, b, c = own
            half = a ^ b
            self.at[place] = [half ^ c]
            bits, place = (a & b) | (half & c), place + 1

    def slices(self) -> list[np.ndarray]:
        """One bitmap at each place, lowest first: the last carries ripple through."""
        place = 0
        while place < len(self.at):
            own = self.at[place]
            if len(own) == 2:
                a, b = own
                self.at[place] = [a ^ b]
                self.add(place + 1, a & b)
                continue
            place += 1
        shape = next(own[0].shape for own in self.at if own)
        return [own[0] if own else np.zeros(shape, np.uint64) for own in self.at]


class Block:
    """The bit-sliced index of a block of rows (rows x attributes, integers)."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, drop: int = DROP):
        self.ids, self.values, self.drop = ids, values, drop
        self.low = values.min(0)
        coarse = (values - self.low) >> drop
        self.bits = [int(m).bit_length() for m in coarse.max(0)]
        #: slices[d][b]
        self.slices = [[to_bitmap((coarse[:, d] >> b) & 1 == 1) for b in range(n)] for d, n in enumerate(self.bits)]
        self.real = to_bitmap(np.ones(len(ids), bool))

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, row position, score) of each query's best rows, at least k if there are so many."""
        n_q, n = len(queries), len(self.ids)
        own = np.stack([to_bitmap(self.ids == q) for q in query_ids]) if n_q else np.zeros((0, 0), np.uint64)
        live = self.real & ~own
        weight = np.abs(queries)
        minus = queries < 0
        # a weight below zero takes the complement of the attribute, so that only sums remain
        places = Places()
        for d, bits in enumerate(self.bits):
            flip = np.where(minus[:, d], ~np.uint64(0), np.uint64(0))[:, None]
            for a in range(int(weight[:, d].max(initial=0)).bit_length()):
                use = np.where((weight[:, d] >> a) & 1 == 1, ~np.uint64(0), np.uint64(0))[:, None]
                for b in range(bits):
                    places.add(a + b, (self.slices[d][b] ^ flip) & use)
        if not places.at:
            q, r = np.nonzero(from_bitmap(live, n))
        else:
            q, r = np.nonzero(from_bitmap(self._near_top(places.slices(), live, weight, k), n))
        score = np.empty(len(q), np.int64)
        for lo in range(0, len(q), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            score[s] = np.einsum("ij,ij->i", queries[q[s]], self.values[r[s]])
        return q, r, score

    def _near_top(self, slices: list[np.ndarray], live: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
        """Bitmaps of the rows that may be among the k best of each query."""
        sure, tied = np.zeros_like(live), live.copy()
        level = np.zeros(len(live), np.int64)
        for place in range(len(slices) - 1, -1, -1):
            with_bit = tied & slices[place]
            many = np.bitwise_count(sure | with_bit).sum(-1) >= k
            level |= many.astype(np.int64) << place
            # k rows or more: the k-th has the bit; else those with the bit are in, and the rest compete on
            sure = np.where(many[:, None], sure, sure | with_bit)
            tied = np.where(many[:, None], with_bit, tied & ~slices[place])
        # the exact score is 2**drop coarse + a rest between 0 and ``slack``, plus a constant of the query
        slack = weight.sum(1) * ((1 << self.drop) - 1)
        least = np.maximum(level - (-(-slack // (1 << self.drop))), 0)
        above, equal = np.zeros_like(live), live.copy()
        for place in range(len(slices) - 1, -1, -1):
            want = ((least >> place) & 1 == 1)[:, None]
            above = np.where(want, above, above | (equal & slices[place]))
            equal = np.where(want, equal & slices[place], equal & ~slices[place])
        return above | equal


def quantise(vector: str | Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: str) -> Column:
    """Not null or empty, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def top_k(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = SCALE, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """For each row that ``is_query`` holds for, its k best other rows: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    rows = rows.where(F.col(id_col).isNotNull() & usable(vector_col))
    check_range(rows, vector_col, scale)
    index = rows.select(F.col(id_col).cast("long").alias("id"), quantise(vector_col, scale).alias("v"))
    stated = rows.where(is_query).select(F.col(id_col).cast("long").alias("id"), quantise(vector_col, scale).alias("v"))
    n = stated.count()
    blocks = max(1, -(-n // query_block))
    found = []
    for b in range(blocks):
        got = (stated.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else stated).toArrow()
        ids = got.column("id").to_numpy()
        vectors = [np.asarray(v, np.int64) for v in got.column("v").to_pylist()]
        shared = spark.sparkContext.broadcast((ids, vectors))
        # a block's results are written before the next one's queries are read, so the plan doesn't grow with the queries
        part = index.mapInArrow(_search(shared, k, row_block), "query_id long, vec_id long, score long")
        found.append(materialize(_best(part, k), "top-of-queries"))
        shared.destroy()
    return reduce(DataFrame.unionByName, found).select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def check_range(rows: DataFrame, vector_col: str, scale: int) -> None:
    """Scores must fit a long: raises if length times the largest product could not."""
    size = F.aggregate(vector_col, F.lit(0.0), lambda top, x: F.greatest(top, F.abs(x.cast("double"))))
    row = rows.agg(F.max(F.size(vector_col)).alias("n"), F.max(size).alias("top")).first()
    if row["n"] and row["n"] * (scale * row["top"] + 1) ** 2 >= 2.0**62:
        raise OverflowError(f"components up to {row['top']:.4g} in vectors of {row['n']}: inner products of {scale} times these may not fit 64 bits")


def _search(shared, k: int, row_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        # the best so far of each query: at most k rows
        best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(queries):
            by_size.setdefault(len(v), []).append(i)

        def take(ids: np.ndarray, values: np.ndarray) -> None:
            of = by_size.get(values.shape[1], [])
            if not of or not len(ids):
                return
            block = Block(ids, values)
            for lo in range(0, len(of), GROUP):
                part = of[lo : lo + GROUP]
                q, r, score = block.top(np.array([query_ids[i] for i in part]), np.stack([queries[i] for i in part]), k)
                order = np.lexsort((block.ids[r], -score, q))
                q, r, score = q[order], r[order], score[order]
                begin = np.searchsorted(q, np.arange(len(part) + 1))
                for j, i in enumerate(part):
                    s = slice(begin[j], min(begin[j] + k, begin[j + 1]))
                    new = list(zip((-score[s]).tolist(), block.ids[r[s]].tolist(), strict=True))
                    best[i] = sorted(best[i] + new)[:k]

        waiting: dict[int, list] = {}
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat, start = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                values = flat[start[at][:, None] + np.arange(size)].astype(np.int64)
                held = waiting.setdefault(size, [])
                held.append((ids[at], values))
                if sum(len(x) for x, _ in held) >= row_block:
                    take(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                    waiting[size] = []
        for held in waiting.values():
            if held:
                take(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        out = [(int(query_ids[i]), v, -s) for i, rows in enumerate(best) for s, v in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    return run


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 50; all other rows are candidates."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
