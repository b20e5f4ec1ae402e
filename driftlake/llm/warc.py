"""WARC archives: a writer with revisit records and a sequential reader.

Every record is one gzip member of its own. The reader decompresses member after
member incrementally from a stream, frames each record by its Content-Length and
verifies its digests, so its memory is bounded by the read size and the longest
record, not by the archive.

Writing. Payload digests are counted with partial aggregation; only digests that
several rows share are joined back, by digest, in a join that AQE can split. Each
task then writes one archive for every ``archive_bytes`` of payload into the
folder that all machines share. The manifest (path and number of records) is
itself materialised; a task that is run again writes under new names, and only
the names its successful run returned are read, so lost executors leave at worst
unused files.

Defined cases: null html is an empty payload; payloads under ``least_bytes`` are
always responses; of equal payloads, all rows with the smallest id are responses;
a row with null id is a response and is never referred to unless alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import fresh_path, materialize, open_uri, table

LEAST_BYTES = 100
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: HTTP header before each payload.
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class CorruptRecord(ValueError):
    """A record whose frame or digest doesn't hold."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes = b""
    payload: bytes = field(default=b"", repr=False)


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() and c not in "\r\n" else "%" + c.encode("utf-8", "surrogatepass").hex() for c in value)


def record_bytes(kind: str, record_id: str, url: str, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One record as a gzip member. A revisit's block has the HTTP header alone."""
    block = HTTP if kind == "revisit" else HTTP + payload
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{record_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        lines += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    lines.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def members(stream, read_bytes: int = READ_BYTES) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one after another."""
    rest = b""
    while True:
        if not rest and not (rest := stream.read(read_bytes)):
            return
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest and not (rest := stream.read(read_bytes)):
                raise CorruptRecord("the archive ends inside a member")
            parts.append(unpacker.decompress(rest))
            rest = b"" if not unpacker.eof else unpacker.unused_data
        yield b"".join(parts)


def parse(member: bytes) -> Record:
    """Frames a member by its Content-Length and verifies its digests."""
    end = member.find(b"\r\n\r\n")
    lines = member[: max(end, 0)].decode().split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise CorruptRecord("no WARC header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise CorruptRecord(f"bad header line {line[:60]!r}")
        headers[name.strip().lower()] = value.strip()
    size = int(headers["content-length"])
    block = member[end + 4 : end + 4 + size]
    if len(block) != size or member[end + 4 + size :] != b"\r\n\r\n":
        raise CorruptRecord("the block isn't as long as its Content-Length")
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise CorruptRecord("block digest")
    record = Record(headers, block)
    if headers.get("warc-type") == "response":
        record.payload = block[block.find(b"\r\n\r\n") + 4 :]
        if headers.get("warc-payload-digest") != f"sha256:{hashlib.sha256(record.payload).hexdigest()}":
            raise CorruptRecord("payload digest")
    return record


def read_archive(stream) -> Iterator[Record]:
    for member in members(stream):
        yield parse(member)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes one record for each row; returns the manifest (path, records)."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.select("*", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").alias("size"))
    shared = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    shared = shared.where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")
    marked = rows.join(shared, "digest", "left").select(
        F.col("id").cast("string").alias("id"), F.coalesce("url", F.lit("")).alias("url"), "html", "digest",
        F.when(F.col("id") > F.col("first"), F.col("first").cast("string")).alias("refers_to"),
    )
    folder = fresh_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = open_uri(folder)
        system.create_dir(at, recursive=True)
        done: list[tuple[str, int]] = []
        out, name, n, size = None, "", 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, digest, refers = (batch.column(c)[i].as_py() for c in range(5))
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{at}/{name}", compression=None)
                payload = html.encode()
                page = "" if page is None else page
                out.write(record_bytes("response" if refers is None else "revisit", page, url, payload, digest, refers))
                n, size = n + 1, size + len(payload)
                if size >= archive_bytes:
                    out.close()
                    done, out = [*done, (f"{folder}/{name}", n)], None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["path", "records"])

    return materialize(marked.mapInArrow(write, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, path_col: str = "path", payloads: bool = False) -> DataFrame:
    """The verified records of the archives: id, url, type, digest, size and what they refer to.

    With ``payloads``, also the payload of responses (null for revisits)."""
    schema = "id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string" + ", payload binary" * payloads
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string()] + [pa.binary()] * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = open_uri(path)
                with system.open_input_stream(at, compression=None) as stream:
                    rows, size = [], 0
                    for r in read_archive(stream):
                        h = r.headers
                        refers = h.get("warc-refers-to")
                        page = _urn(h["warc-record-id"])
                        row = (page, h["warc-target-uri"], h["warc-type"], h["warc-payload-digest"].removeprefix("sha256:"), int(h["x-payload-length"]), _urn(refers) if refers else None)
                        if h["warc-type"] == "response" and row[4] != len(r.payload):
                            raise CorruptRecord("payload length")
                        rows.append((*row, r.payload if h["warc-type"] == "response" else None) if payloads else row)
                        size += len(r.payload) * payloads + 200
                        if size > 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                    yield batch_of(rows)

    return manifest.select(path_col).repartition(F.col(path_col)).mapInArrow(read, schema)


def _urn(value: str) -> str | None:
    return value.removeprefix("<urn:page:").removesuffix(">") or None


def digest_base32(digest: str) -> str:
    """A hex digest in the base-32 form that other tools use."""
    return base64.b32encode(bytes.fromhex(digest)).decode()


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back from them."""
    read = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return read.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
