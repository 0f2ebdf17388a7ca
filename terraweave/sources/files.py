"""Small files in whatever store a path names, through the file systems that Spark reads."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_stream(spark: SparkSession, path: str, parts: Iterable[str], overwrite: bool = False) -> None:
    """A file from pieces of text, none kept longer than it takes to write; an existing one raises unless overwrite."""
    store, target = _at(spark, path)
    out = store.create(target, overwrite)
    try:
        for part in parts:
            out.write(bytearray(part.encode()))
    finally:
        out.close()


def write_bytes(spark: SparkSession, path: str, parts: Iterable[bytes]) -> None:
    """A new file from pieces of bytes; one that fails midway is taken away again."""
    store, target = _at(spark, path)
    out = store.create(target, False)
    try:
        for part in parts:
            out.write(bytearray(part))
    except BaseException:
        out.close()
        store.delete(target, False)
        raise
    out.close()


def write_json(spark: SparkSession, path: str, payload: dict, overwrite: bool = False) -> str:
    """A small JSON file with sorted keys; returns its checksum."""
    text = json.dumps(payload, sort_keys=True, indent=1)
    write_stream(spark, path, [text], overwrite)
    return hashlib.sha256(text.encode()).hexdigest()


def json_checksum(payload) -> str:
    """SHA-256 of a JSON structure, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    store, target = _at(spark, path)
    return bool(store.exists(target))


def remove(spark: SparkSession, path: str) -> None:
    store, target = _at(spark, path)
    store.delete(target, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """File names in a folder of few files, sorted; none where it is absent."""
    store, target = _at(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(target)) if store.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    """The whole text of a small file."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes, computed where it is read."""
    from pyspark.sql import functions as F

    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
