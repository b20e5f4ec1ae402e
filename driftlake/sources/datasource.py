"""The format ``drift``: drifting datasets as a Spark data source.

Without a path, ``spark.read.format("drift")`` generates the dataset that its options describe
(clients, steps, samples, rho, alpha, delta, kind, seed, features), a range of clients a
partition; a lost partition is made again alike. With a path it reads a dataset that
``df.write.format("drift")`` has stored there, a file a partition.

A write puts each task's rows into a file of its own in a pending folder. Only the commit makes
them a dataset: it moves the files and writes one manifest with their names and rows, the options
and the concepts, which replaces an older one ("overwrite") or adds to it ("append"). A failed
write's folder is removed, and a reader never sees it, as it goes by the manifest. Call ``register(spark)`` once a session."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from driftlake.sources.generators import GeneratorConfig, draw, markov

SCHEMA = "client long, t long, gt long, row_id long, x array<double>, y double"
ARROW = pa.schema([("client", pa.int64()), ("t", pa.int64()), ("gt", pa.int64()), ("row_id", pa.int64()), ("x", pa.list_(pa.float64())), ("y", pa.float64())])
MANIFEST = "manifest.json"
#: Clients of one partition.
CLIENTS_A_PART = 64
OPTIONS = {"clients": int, "steps": int, "samples": int, "rho": float, "alpha": float, "delta": float, "kind": str, "seed": int, "features": int}
_NAMES = {"samples": "n_samples", "features": "n_features"}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def config_of(options: dict) -> GeneratorConfig:
    return GeneratorConfig(**{_NAMES.get(k, k): kind(options[k]) for k, kind in OPTIONS.items() if k in options})


def schedule(c: GeneratorConfig, client: int) -> np.ndarray:
    """A client's concepts, as ``generators.concept_grid`` makes them."""
    shared = markov(c.steps, c.concepts, np.random.default_rng([c.seed, 0]))
    rng = np.random.default_rng([c.seed, 1, client])
    own = markov(c.steps, c.concepts, rng)
    use = rng.random(c.steps) < c.alpha if 0 < c.alpha < 1 else np.full(c.steps, c.alpha == 1)
    return np.where(use, own, shared)


@dataclass
class Clients(InputPartition):
    first: int
    end: int


@dataclass
class StoredFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    concepts: list[int]


class GeneratedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.config = config_of(options)

    def partitions(self) -> list[InputPartition]:
        return [Clients(i, min(i + CLIENTS_A_PART, self.config.clients)) for i in range(0, self.config.clients, CLIENTS_A_PART)]

    def read(self, partition: Clients) -> Iterator[pa.RecordBatch]:
        c = self.config
        for client in range(partition.first, partition.end):
            for t, gt in enumerate(schedule(c, client).tolist()):
                x, y = draw(c.kind, gt, c.n_samples, c.delta, [c.seed, 2, client, t], c.n_features)
                n = len(y)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v, np.int64)) for v in (client, t, gt)] + [pa.array(np.arange(n)), pa.array(list(x), ARROW.field("x").type), pa.array(y.astype(float))], schema=ARROW)


class StoredReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files = read_manifest(self.path)["files"]
        return [StoredFile(f"{self.path}/{f['name']}") for f in files] or [StoredFile("")]

    def read(self, partition: StoredFile) -> Iterator[pa.RecordBatch]:
        if partition.path:
            system, at = file_system(partition.path)
            with system.open_input_file(at) as f:
                yield from pq.ParquetFile(f).iter_batches(batch_size=4096)


class DriftWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.options = {k: v for k, v in options.items() if k in OPTIONS}
        # made on the driver only, so that a task that outlives an aborted write finds no folder
        self.pending = f".pending-{uuid.uuid4().hex}"
        system, at = file_system(self.path)
        system.create_dir(f"{at}/{self.pending}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = file_system(self.path)
        name, rows, concepts = f"part-{uuid.uuid4().hex}.parquet", 0, set()
        with system.open_output_stream(f"{at}/{self.pending}/{name}") as out, pq.ParquetWriter(out, ARROW) as w:
            for batch in iterator:
                rows += batch.num_rows
                concepts.update(batch.column(batch.schema.get_field_index("gt")).unique().to_pylist())
                w.write_batch(pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in ARROW], schema=ARROW))
        return Written(name, rows, sorted(c for c in concepts if c is not None))

    def commit(self, messages: list[Written | None]) -> None:
        system, at = file_system(self.path)
        old = {"files": [], "concepts": []} if self.overwrite or not has_manifest(self.path) else read_manifest(self.path)
        gone = read_manifest(self.path)["files"] if self.overwrite and has_manifest(self.path) else []
        done = [m for m in messages if m is not None and m.rows]
        for m in done:
            system.move(f"{at}/{self.pending}/{m.name}", f"{at}/{m.name}")
        kept = old["files"] + [{"name": m.name, "rows": m.rows} for m in done]
        concepts = sorted({*old["concepts"], *(c for m in done for c in m.concepts)})
        made = json.dumps({"options": self.options or old.get("options", {}), "concepts": concepts, "files": kept}).encode()
        new = f"{at}/{self.pending}/{MANIFEST}"
        with system.open_output_stream(new) as out:
            out.write(made)
        system.move(new, f"{at}/{MANIFEST}")  # which makes the write visible
        for f in gone:
            system.delete_file(f"{at}/{f['name']}")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        system, at = file_system(self.path)
        system.delete_dir(f"{at}/{self.pending}")


def has_manifest(path: str) -> bool:
    system, at = file_system(path)
    return system.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.File


def read_manifest(path: str) -> dict:
    """What a stored dataset holds: options, concepts and files with their rows."""
    system, at = file_system(path)
    with system.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.readall())


class DriftSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "drift"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return StoredReader(self.options["path"].rstrip("/")) if "path" in self.options else GeneratedReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if "path" not in self.options:
            raise ValueError("a drift dataset is written to a path")
        missing = {f.name for f in ARROW} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"a drift dataset needs the columns {sorted(missing)}")
        return DriftWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DriftSource)
