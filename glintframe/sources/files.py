"""Files and folders: trees with digests, SQLite tags, ONNX side files, memory gauges."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import file_sha256

MAX_ENTRIES = 100_000
MAX_BYTES = 16 << 30


def safe_relative(path: str) -> bool:
    """Whether a path stays inside the folder that it is relative to."""
    p = PurePosixPath(path)
    return bool(path) and not p.is_absolute() and ".." not in p.parts and "\\" not in path and "\0" not in path


def scan_tree(root: str | Path, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES) -> list[dict]:
    """(path, bytes, sha256) of all files below ``root``, by path; links and too many or too large files are errors."""
    root, out, total, entries = Path(root), [], 0, 0
    for folder, folders, names in os.walk(root):
        for name in [*folders, *names]:
            entries += 1
            if entries > max_entries:
                raise ValueError("too many entries")
            if (Path(folder) / name).is_symlink():
                raise ValueError(f"{name} is a link")
        for name in names:
            f = Path(folder) / name
            if not f.is_file():
                raise ValueError(f"{name} is no plain file")
            total += f.stat().st_size
            if total > max_bytes:
                raise ValueError("too many bytes")
            out.append({"path": f.relative_to(root).as_posix(), "bytes": f.stat().st_size, "sha256": file_sha256(str(f))})
    return sorted(out, key=lambda r: r["path"])


def file_table(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files below a folder, hashed by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_tags(database: str | Path) -> Iterator[tuple[str, str]]:
    """(key, generated_tags) of a SQLite table ``meta``, without null tags; opened for reading only."""
    link = sqlite3.connect(f"file:{Path(database).resolve()}?mode=ro", uri=True)
    try:
        yield from link.execute("SELECT key, generated_tags FROM meta WHERE generated_tags IS NOT NULL")
    finally:
        link.close()


def tag_table(spark: SparkSession, database: str | Path) -> DataFrame:
    return spark.createDataFrame(list(read_tags(database)), "key string, generated_tags string")


def _varint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(b) or shift > 63:
            raise ValueError("a number is cut off")
        value |= (b[at] & 127) << shift
        at += 1
        if b[at - 1] < 128:
            return value, at
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    at = 0
    while at < len(b):
        tag, at = _varint(b, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(b, at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = b[at : at + n], at + n
        elif kind == 2:
            n, at = _varint(b, at)
            value, at = b[at : at + n], at + n
            if len(value) != n:
                raise ValueError("a field is cut off")
        else:
            raise ValueError("unknown kind of field")
        yield tag >> 3, kind, value


# Field numbers of the ONNX messages on the way to a tensor's external data.
_MODEL_GRAPH, _GRAPH_NODE, _GRAPH_TENSOR, _GRAPH_SPARSE = 7, 1, 5, 15
_NODE_ATTRIBUTE, _TENSOR_EXTERNAL = 5, 13
_ATTRIBUTE_TENSORS, _ATTRIBUTE_GRAPHS, _ATTRIBUTE_SPARSE = (5, 10), (6, 11), (22, 23)
MAX_DEPTH = 64


def external_files(model: bytes) -> list[str]:
    """The side files that the tensors of an ONNX model name, each once, in order; unsafe paths and too deep graphs are errors."""
    found: dict[str, None] = {}

    def tensor(b: bytes) -> None:
        for n, kind, v in _fields(b):
            if n == _TENSOR_EXTERNAL and kind == 2:
                pair = {k: x for k, _, x in _fields(v)}
                if pair.get(1) == b"location":
                    path = bytes(pair.get(2, b"")).decode("utf-8")
                    if not safe_relative(path):
                        raise ValueError(f"{path!r} isn't a safe path")
                    found[path] = None

    def sparse(b: bytes) -> None:
        for n, kind, v in _fields(b):
            if n in (1, 2) and kind == 2:
                tensor(v)

    def graph(b: bytes, depth: int) -> None:
        if depth >= MAX_DEPTH:
            raise ValueError("the graphs are nested too deeply")
        for n, kind, v in _fields(b):
            if kind != 2:
                continue
            if n == _GRAPH_TENSOR:
                tensor(v)
            elif n == _GRAPH_SPARSE:
                sparse(v)
            elif n == _GRAPH_NODE:
                for m, k, a in _fields(v):
                    if m == _NODE_ATTRIBUTE and k == 2:
                        for i, j, x in _fields(a):
                            if j != 2:
                                continue
                            if i in _ATTRIBUTE_TENSORS:
                                tensor(x)
                            elif i in _ATTRIBUTE_SPARSE:
                                sparse(x)
                            elif i in _ATTRIBUTE_GRAPHS:
                                graph(x, depth + 1)

    for n, kind, v in _fields(model):
        if n == _MODEL_GRAPH and kind == 2:
            graph(v, 0)
    return list(found)


def memory_mib(pid: int | str = "self", gauge: str = "Rss") -> float:
    """``Rss`` or ``Pss`` of a process in MiB, as the kernel tells; 0 where it doesn't."""
    try:
        lines = Path(f"/proc/{pid}/smaps_rollup").read_text().splitlines()
    except OSError:
        return 0.0
    return sum(int(x.split()[1]) for x in lines if x.startswith(f"{gauge}:")) / 1024


def total_bytes(files: DataFrame) -> DataFrame:
    """(files, bytes) of a file table."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
