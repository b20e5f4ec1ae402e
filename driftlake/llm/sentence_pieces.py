"""SentencePiece encoding and decoding by a table of distinct marked words.

The library writes each space as the marker U+2581, with one more in front of a text that
isn't empty, and merges characters into pieces. If no piece of the model holds a marker
behind another character (``PieceTable`` checks this, and that the text isn't otherwise
normalised), no merge crosses the place where a marker follows another character. A
*marked word* is what lies between two such places: markers and then characters without
one. Its pieces don't depend on what is around it, so each distinct marked word is
segmented once and a text's ids are those of its words, joined by position.

The table of words belongs to a Python worker, outlives its tasks and is bounded by bytes;
the oldest half gives way when it is full. Words that are new to it are segmented many at
once. One table for the whole corpus would mean shuffling every word with its position
there and back, several times the input; no text is shuffled here, and a lost executor
costs its tasks alone. Decoding takes the final ids of the whole text.

Defined cases: null is encoded as empty text, which has the begin and end ids only; ties
don't occur; repeated rows give repeated results; U+2581 in a text is a space to the
library, hence here; control pieces' strings in a text are plain characters; a text
without spaces is one word, however long, and is not kept in the table when it takes more
than a hundredth of it; an empty table gives an empty frame; the result's column takes a
name that the table doesn't have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlake.llm.bpe import Store
from driftlake.llm.common import buffers, fresh_name, slices, table

MARKER = "▁"
#: Bytes of a worker's table of words, and words that are segmented at once.
WORD_BYTES, LEARNED = 120 << 20, 20_000
#: Texts are taken in slices of about this many bytes, over which words are told apart.
SLICE_BYTES = 1 << 21


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceTable:
    """The distinct marked words of one worker process; ``get`` keeps a table for each model."""

    _kept: dict[str, PieceTable] = {}

    @classmethod
    def get(cls, path: str, words: int = WORD_BYTES) -> PieceTable:
        if path not in cls._kept:
            cls._kept[path] = cls(path, words)
        return cls._kept[path]

    def __init__(self, path: str, words: int = WORD_BYTES):
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        pieces = model.id_to_piece(list(range(len(model))))
        inner = [p for p in pieces if MARKER in p.lstrip(MARKER)]
        if inner or model.normalize("a  Åﬁ ") != f"{MARKER}a{MARKER}{MARKER}Åﬁ{MARKER}":
            raise ValueError(f"pieces of {path} can cross a marker or its texts are normalised; words can't be segmented apart")
        self.marked = np.array([p.startswith(MARKER) for p in pieces])
        self.bytes_of, self.starts = piece_bytes(model)
        self.sizes = np.diff(self.starts)
        self.words = Store(words)
        self._lead = model.encode("x")

    def _learn(self, words: list[str]) -> None:
        """Segments words, each with its markers as spaces, and stores their ids."""
        held, marked = self.words.held, self.marked
        # a word's one marker is at its beginning, and the library writes the first one itself
        plain = [w for w in words if len(w) > 1 and w[1] != " "]
        odd = [w for w in words if len(w) < 2 or w[1] == " "]
        for lo in range(0, len(plain), LEARNED):
            part = plain[lo : lo + LEARNED]
            ids = np.array(self.model.encode("".join(part)[1:]), np.uint32)
            at = [*(4 * np.flatnonzero(marked[ids])).tolist(), 4 * len(ids)]
            numbers = ids.tobytes()
            held.update((w, numbers[a:b]) for w, a, b in zip(part, at[:-1], at[1:], strict=True))
        for w, ids in zip(odd, self.model.encode([f"x{w}" for w in odd], num_threads=1) if odd else [], strict=True):
            held[w] = np.array(ids[len(self._lead) :], np.uint32).tobytes()
        self.words.added(words)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and one more), without begin and end ids.

        The texts' distinct words are looked up or segmented; each word's ids go to all its places."""
        self.words.trim()
        text = pc.fill_null(pc.replace_substring(texts.cast(pa.string()), MARKER, " "), "")
        text = pc.if_else(pc.equal(pc.binary_length(text), 0), "", pc.binary_join_element_wise("", text, " "))
        data, offsets = buffers(text)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.flatnonzero(begins)
        edges = np.append(at, len(data)).astype(np.int32)
        table_ = pa.StringArray.from_buffers(len(at), pa.py_buffer(edges), pa.py_buffer(data)).dictionary_encode()
        words = table_.dictionary.to_pylist()
        held = self.words.held
        self._learn([w for w in words if w not in held])
        own = [held[w] for w in words]
        ids = np.frombuffer(b"".join(own), np.uint32)
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        word = table_.indices.to_numpy()
        count = size[word]
        ends = np.cumsum(count)
        # the place of each id in the table: where its word's ids begin, and how far it is in them
        place = np.repeat((np.cumsum(size) - size)[word] - (ends - count), count) + np.arange(ends[-1])
        return ids[place], np.append(0, ends)[np.searchsorted(at, offsets)]

    def with_ends(self, ids: np.ndarray, edges: np.ndarray) -> tuple[list[np.ndarray], list[bytes]]:
        """(ids of each text between begin and end ids, their decoded text)."""
        n = len(edges) - 1
        out = np.insert(ids, np.repeat(edges, 2)[1:-1], np.tile(np.array([self.model.bos_id(), self.model.eos_id()], np.uint32), n))
        edges = edges + 2 * np.arange(n + 1)
        at = edges.tolist()
        return [out[a:b] for a, b in zip(at, at[1:], strict=False)], self.decode(out, edges)

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """The texts, in UTF-8, that the ids of each text stand for: their bytes, less the space before the first word."""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        place = np.repeat(self.starts[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        raw = self.bytes_of[place].tobytes()
        at = np.append(0, ends)[edges].tolist()
        return [raw[a:b].removeprefix(b" ") for a, b in zip(at, at[1:], strict=False)]


def piece_bytes(model) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all pieces, where each id's begin and one more); control pieces have none."""
    own = []
    for i in range(len(model)):
        piece = model.id_to_piece(i)
        own.append(b"" if model.is_control(i) else bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(MARKER, " ").encode())
    return np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])


def encode_pieces(docs: DataFrame, text_col: str = "text", path: str | None = None, keep_ids: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct whose name is returned too: ``n_tokens``, ``ids_sha256``
    (of little-endian 32-bit ids, begin and end among them), ``decoded_sha256`` and, if asked for, ``ids``."""
    name = fresh_name(docs, "pieces")
    path = path or piece_model_path()
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceTable.get(path)
        for batch in batches:
            _, offsets = buffers(batch.column(at))
            # results leave slice by slice, so a batch's ids are never held together
            for lo, hi in slices(offsets, SLICE_BYTES):
                coded, back = pieces.with_ends(*pieces.encode(batch.column(at).slice(lo, hi - lo)))
                arrays = [pa.array([len(x) for x in coded], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
                if keep_ids:
                    arrays.append(pa.array([x.view(np.int32) for x in coded], pa.list_(pa.int32())))
                found = pa.StructArray.from_arrays(arrays, [f.name for f in fields])
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, found], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StructType(fields))])), name


def decode_pieces(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> tuple[DataFrame, str]:
    """``rows`` with the decoded text of their ids (null for null) as one more column."""
    name = fresh_name(rows, "decoded")
    path = path or piece_model_path()
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceTable.get(path).model
        for batch in batches:
            back = [None if ids is None else model.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])), name


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, encoded and decoded whole, with begin and end ids."""
    found, c = encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.col(f"{c}.{x}").alias(x) for x in ("n_tokens", "ids_sha256", "decoded_sha256")])


def brute_force(docs: list[tuple], path: str | None = None) -> list[tuple]:
    """Plain reference for tests: each whole text through the library."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path or piece_model_path())
    out = []
    for doc, text in docs:
        ids = model.encode(text or "", add_bos=True, add_eos=True)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        out.append((doc, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    return out
