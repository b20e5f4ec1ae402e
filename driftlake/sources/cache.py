"""Stored results that are found again by what they were made from.

The key of a result is a hash of its analysed plan (with normalised column ids), of its input
files with sizes and times, and of a version that the caller can add, which plans with Python
functions need. A result counts only if its manifest is there and names exactly the files, with
their sizes, that the folder holds; a torn or altered one is refused and made again."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


class TornResult(RuntimeError):
    """A stored result whose files aren't those of its manifest."""


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _files(spark: SparkSession, path: str) -> dict[str, int]:
    system, at = _store(spark, path)
    return {f.getPath().getName(): f.getLen() for f in system.listStatus(at) if f.isFile() and f.getPath().getName().startswith("part-")}


def cache_key(df: DataFrame, version: str = "") -> str:
    """Hex digest of plan, inputs and version; lists input files, but runs no job."""
    spark = df.sparkSession
    # ids that analysis gives to columns and relations differ from run to run
    whole = df._jdf.queryExecution().analyzed().canonicalized().treeString(True, False, 1 << 30, False, False)
    plan = re.sub(r"#\d+L?|@[0-9a-f]+", "#", whole)
    inputs = []
    for path in sorted(df.inputFiles()):
        system, at = _store(spark, path)
        status = system.getFileStatus(at)
        inputs.append((path, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(json.dumps([plan, inputs, df.schema.json(), version]).encode()).hexdigest()


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """The result under ``path``; TornResult if it isn't complete."""
    system, at = _store(spark, f"{path}/{MANIFEST}")
    if not system.exists(at):
        raise TornResult(f"{path} has no manifest")
    stream = system.open(at)
    try:
        made = json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()
    data = f"{path}/{made['data']}"
    if not system.exists(_store(spark, data)[1]) or _files(spark, data) != made["files"]:
        raise TornResult(f"files of {data} aren't those of its manifest")
    return spark.read.schema(made["schema"]).parquet(data)


def cached(df: DataFrame, folder: str, version: str = "") -> DataFrame:
    """``df`` from ``folder`` if it is stored there completely, else computed, stored and read back."""
    spark, path = df.sparkSession, f"{folder.rstrip('/')}/{cache_key(df, version)}"
    try:
        return read_result(spark, path)
    except TornResult:
        pass
    data = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{data}")
    made = {"data": data, "files": _files(spark, f"{path}/{data}"), "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}
    system, at = _store(spark, f"{path}/{MANIFEST}")
    new = _store(spark, f"{path}/{data}.json")[1]
    out = system.create(new, True)
    out.write(json.dumps(made).encode())
    out.close()
    system.delete(at, False)
    system.rename(new, at)  # which makes the result count
    return read_result(spark, path)
