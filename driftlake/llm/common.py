"""Helpers shared by the training-data operators.

* a folder that driver and executors share (``spark.checkpoint.dir``),
* materialising a frame there, which cuts lineage and survives lost executors,
* reading Arrow string columns as byte buffers in slices of bounded size,
* vectorised hashing of words and of runs of words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hadoop's names of stores and pyarrow's.
STORES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "abfs": "abfss"}
#: Texts of one Arrow batch are processed in slices of about this many bytes.
SLICE_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, as a URI.

    One is set only where none is and all runs on this machine; on a cluster a local
    folder would lose rows, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="driftlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: What this process wrote to the shared folder and has not removed.
_WRITTEN: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def written() -> list[str]:
    """The folders that are still there."""
    return list(_WRITTEN)


def release(spark: SparkSession, keep: list[str] | None = None) -> int:
    """Removes what was written to the shared folder so far, but the folders to ``keep``; call it when results are stored elsewhere.

    Returns the number of folders that were there."""
    jvm, n, kept = spark._jvm, 0, set(keep or [])
    for name in [x for x in _WRITTEN if x not in kept]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
        _WRITTEN.remove(name)
    return n


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    """The pyarrow file system and path of a URI; names that Hadoop gives to stores are understood."""
    scheme, colon, rest = uri.partition(":")
    if not colon:
        return fs.FileSystem.from_uri(f"file://{uri}")
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(STORES.get(scheme, scheme) + ":" + rest)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def different_texts(rows: DataFrame, text_col: str, most: int, by: list[str], counts: dict[tuple, int] | None = None) -> DataFrame:
    """About ``most`` different texts for each value of ``by``, one row each: (*by, text).

    Texts are chosen by their hash, and a text that stands in many rows counts once, so the
    size is bounded whatever is copied. ``counts`` gives the number of different texts by value."""
    hashed = rows.where(F.col(text_col).isNotNull()).select(*by, F.col(text_col).alias("text"), F.xxhash64(text_col, F.lit(11)).alias("hash"))
    if counts is None:
        counts = {tuple(r[:-1]): r[-1] for r in hashed.groupBy(*by).agg(F.approx_count_distinct("hash")).collect()}
    if not counts:
        return hashed.select(*by, "text").limit(0)
    share = {value: int(min(1.0, most / max(n, 1)) * (1 << 20)) for value, n in counts.items()}
    rate = F.lit(0)
    if len(by) == 1 and len(share) > 16 and (None,) not in share:
        rates = rows.sparkSession.createDataFrame([(*value, r) for value, r in share.items()], T.StructType([hashed.schema[by[0]], T.StructField("rate", T.IntegerType())]))
        hashed, rate, share = hashed.join(rates, by), F.col("rate"), {}
    for value, r in share.items():
        here = F.lit(True)
        for c, v in zip(by, value, strict=True):
            here = here & (F.col(c) == F.lit(v))
        rate = F.when(here, F.lit(r)).otherwise(rate)
    chosen = hashed.where(F.pmod("hash", F.lit(1 << 20)) < rate)
    return chosen.groupBy(*by, "hash").agg(F.first("text").alias("text")).select(*by, "text")


def text_key(text: str | Column) -> Column:
    """Hash that, beside the id, tells rows apart which share an id."""
    return F.xxhash64(text)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null reads as empty."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if column.null_count:
        # a null's range may hold bytes; lengths are rebuilt without them
        column = column.fill_null(b"")
        return buffers(column)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes; a longer text stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Cuts rows that are sorted by their first ``keys`` columns (whole numbers) where one of these changes."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        if held and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(keys)):
            yield joined()
            held = []
        change = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield joined()
                held = []
    if held:
        yield joined()


_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GRAM = 0xD1342543DE82EF95
_GRAM_INV = pow(_GRAM, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = 1 << max(12, (n - 1).bit_length())
        got = np.ones(size, np.uint64)
        step, width = base, 1
        while width < size:
            got[width : 2 * width] = got[:width] * np.uint64(step)
            step, width = step * step & _MASK, 2 * width
        _POWERS[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits (a xor-shift-multiply finaliser)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts that lie behind one another in ``data``.

    ``is_word`` says for each byte value whether it belongs to words. Returns
    (starts, ends, first): byte ranges, and for each text its first word's index
    (one more at the end).
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = inside[0], inside[n - 1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    # a text's border ends a word even if both sides are word bytes
    border = np.unique(offsets[1:-1])
    border = border[(border > 0) & (border < n)]
    both = border[inside[border] & inside[border - 1]]
    at = np.flatnonzero(edge)
    if len(both):
        at = np.sort(np.concatenate([at, both, both]))
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_BASE_INV, n)[starts] + (ends - starts).astype(np.uint64))


def gram_prefix(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_GRAM, len(hashes)), out=total[1:])
    return total


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words; entry i is of words i .. i+k-1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = gram_prefix(hashes)
    return mix((total[k:] - total[:-k]) * powers(_GRAM_INV, n))


def word_table(pattern_excluded: list[tuple[int, int]]) -> np.ndarray:
    """Byte table for a class of word bytes given the ranges outside it."""
    out = np.ones(256, bool)
    for lo, hi in pattern_excluded:
        out[lo : hi + 1] = False
    return out


#: Words of `[^\x20\x09-\x0D]+`.
SPACE_WORDS = word_table([(0x20, 0x20), (0x09, 0x0D)])
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased.
PLAIN_WORDS = word_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Byte table that lower-cases A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
