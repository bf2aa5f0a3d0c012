"""The binary index file (``.sidx``): codec, Spark data source, atomic writer.

Layout, little endian: magic, width u32 (> 0), model length u32 (1 to 2^20)
and model, fingerprint u64, count u64; then for each entry key length u32 (to
2^20) and key, fingerprint u64, width x f32.  Nothing follows the last entry.
"""

from __future__ import annotations

import io
import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format.
MAGIC = b"SKWDSEM3"
TEXT_LIMIT = 1 << 20
SIDECAR = ".fingerprint"

#: Rows of a file of a folder of parts.
PART_ROWS = 65_536
ENTRY_SCHEMA = "position long, key string, fingerprint decimal(20,0), embedding array<float>"
HEADER_SCHEMA = "dimensions long, model string, fingerprint decimal(20,0), count decimal(20,0)"
BATCH_ROWS = 4_096


class IndexFileError(ValueError):
    """The bytes aren't a valid index."""


@dataclass(frozen=True)
class Header:
    dimensions: int
    model: str
    fingerprint: int
    count: int


@dataclass(frozen=True)
class Entry:
    key: str
    fingerprint: int
    embedding: np.ndarray | None


class Reader:
    """Reads a header and then the entries in turn; ``finish`` insists that all were read."""

    def __init__(self, stream: BinaryIO):
        self._in = stream
        if self._take(8) != MAGIC:
            raise IndexFileError("not an index file")
        (dimensions,) = struct.unpack("<I", self._take(4))
        if not dimensions:
            raise IndexFileError("the width is zero")
        model = self._text(1)
        fingerprint, count = struct.unpack("<QQ", self._take(16))
        self.header = Header(dimensions, model, fingerprint, count)
        self.left = count

    def _take(self, n: int) -> bytes:
        b = self._in.read(n)
        if len(b) != n:
            raise EOFError("the index ends early")
        return b

    def _text(self, least: int) -> str:
        (n,) = struct.unpack("<I", self._take(4))
        if not least <= n <= TEXT_LIMIT:
            raise IndexFileError("a text's length is out of bounds")
        try:
            return self._take(n).decode("utf-8")
        except UnicodeDecodeError as e:
            raise IndexFileError("a text isn't UTF-8") from e

    def _next(self, vector: bool) -> Entry:
        if not self.left:
            raise IndexFileError("no entry is left")
        key = self._text(0)
        (fingerprint,) = struct.unpack("<Q", self._take(8))
        raw = self._take(4 * self.header.dimensions)
        self.left -= 1
        return Entry(key, fingerprint, np.frombuffer(raw, "<f4") if vector else None)

    def entry(self) -> Entry:
        return self._next(True)

    def skip(self) -> Entry:
        """The next entry without its vector."""
        return self._next(False)

    def finish(self) -> Header:
        if self.left:
            raise IndexFileError("entries are unread")
        if self._in.read(1):
            raise IndexFileError("bytes follow the last entry")
        return self.header


def read_header(path: str | Path) -> Header:
    with open(path, "rb") as f:
        return Reader(f).header


def entries(path: str | Path, vectors: bool = True) -> Iterator[Entry]:
    """All entries of a file; a file that is too short or too long is an error at its end."""
    with open(path, "rb") as f:
        r = Reader(f)
        while r.left:
            yield r.entry() if vectors else r.skip()
        r.finish()


def validate(path: str | Path) -> Header:
    """Reads the whole file without decoding vectors; an index without entries isn't valid here."""
    with open(path, "rb") as f:
        r = Reader(f)
        if not r.header.count:
            raise IndexFileError("the index is empty")
        while r.left:
            r.skip()
        return r.finish()


def fingerprints(path: str | Path) -> tuple[Header, dict[str, int]]:
    """The header and each key's fingerprint; of several entries of a key the last counts."""
    with open(path, "rb") as f:
        r = Reader(f)
        smallest = 12 + 4 * r.header.dimensions
        if r.header.count * smallest > os.path.getsize(path):
            raise IndexFileError("the count can't be true")
        out = {}
        while r.left:
            e = r.skip()
            out[e.key] = e.fingerprint
        return r.finish(), out


def point_lookup(path: str | Path, key: str) -> np.ndarray:
    """The vector of the key's first entry; reads no further."""
    with open(path, "rb") as f:
        r = Reader(f)
        while r.left:
            e = r.entry()
            if e.key == key:
                return e.embedding
    raise KeyError(key)


def load_matrix(path: str | Path) -> tuple[str, list[str], np.ndarray]:
    """Model, keys and the matrix of vectors."""
    header = read_header(path)
    rows = list(entries(path))
    return header.model, [e.key for e in rows], np.stack([e.embedding for e in rows]) if rows else np.zeros((0, header.dimensions), np.float32)


def write_index(path: str | Path, model: str, fingerprint: int, rows: Iterable[tuple[str, int, Iterable[float]]], dimensions: int) -> None:
    """Writes an index whole or not at all: every row is checked before a file is made, which then replaces the old one."""
    path = Path(path)
    name = model.encode("utf-8")
    if not dimensions > 0 or not 1 <= len(name) <= TEXT_LIMIT or not 0 <= fingerprint < 2**64:
        raise IndexFileError("the header's values are out of bounds")
    body, count = io.BytesIO(), 0
    for key, fp, vector in rows:
        k, v = key.encode("utf-8"), np.asarray(list(vector), "<f4")
        if len(k) > TEXT_LIMIT or len(v) != dimensions or not 0 <= fp < 2**64:
            raise IndexFileError(f"entry {count} is out of bounds")
        body.write(struct.pack("<I", len(k)) + k + struct.pack("<Q", fp) + v.tobytes())
        count += 1
    head = MAGIC + struct.pack("<II", dimensions, len(name)) + name + struct.pack("<QQ", fingerprint, count)
    replace_file(path, head + body.getvalue())
    replace_file(path.with_name(path.name + SIDECAR), str(fingerprint).encode())


def replace_file(path: Path, content: bytes) -> None:
    """Puts ``content`` at ``path`` by writing a new file beside it, syncing it and renaming it over."""
    fresh = path.with_name(f"{path.name}.{os.getpid()}.tmp")
    try:
        with open(fresh, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(fresh, path)
    except BaseException:
        fresh.unlink(missing_ok=True)
        raise
    folder = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def export_index(df: DataFrame, path: str | Path, model: str, fingerprint: int, dimensions: int) -> None:
    """A table (position, key, fingerprint, embedding) as one file, in the order of position, streamed partition by partition."""
    ordered = df.select("position", "key", "fingerprint", "embedding").orderBy("position")
    write_index(path, model, fingerprint, ((r["key"], int(r["fingerprint"]), r["embedding"]) for r in ordered.toLocalIterator()), dimensions)


def export_parts(df: DataFrame, folder: str | Path, model: str, fingerprint: int, dimensions: int) -> list[tuple[str, int]]:
    """A table (position, key, fingerprint, embedding) as a folder of index files, each written whole by the task that holds its rows; (file, rows) of each.

    ``folder`` is one that all executors share.  Files have at most
    ``PART_ROWS`` rows; within a partition they keep the order of position.
    A task that runs again replaces its files.  :func:`read_index` reads the
    folder with one task a file.
    """
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, part = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            held += zip(batch["key"].to_pylist(), map(int, batch["fingerprint"].to_pylist()), batch["embedding"].to_pylist(), strict=True)
            while len(held) >= PART_ROWS:
                yield put(number, part, held[:PART_ROWS])
                held, part = held[PART_ROWS:], part + 1
        if held:
            yield put(number, part, held)

    def put(number: int, part: int, rows: list) -> pa.RecordBatch:
        path = folder / f"part-{number:06d}-{part:04d}.sidx"
        write_index(path, model, fingerprint, rows, dimensions)
        return pa.record_batch([pa.array([str(path)]), pa.array([len(rows)], pa.int64())], names=["path", "rows"])

    ordered = df.select("position", "key", "fingerprint", "embedding").sortWithinPartitions("position")
    return [(r["path"], r["rows"]) for r in ordered.mapInArrow(write, "path string, rows long").collect()]


def _batches(path: str, vectors: bool) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, Entry]] = []

    def flush() -> pa.RecordBatch:
        fp = pa.array([e.fingerprint for _, e in held], pa.decimal128(20, 0))
        cols = [pa.array([i for i, _ in held], pa.int64()), pa.array([e.key for _, e in held], pa.string()), fp]
        names = ["position", "key", "fingerprint"]
        if vectors:
            width = len(held[0][1].embedding)
            offsets = np.arange(0, (len(held) + 1) * width, width, dtype=np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([e.embedding for _, e in held]))))
            names.append("embedding")
        return pa.record_batch(cols, names=names)

    for i, e in enumerate(entries(path, vectors)):
        held.append((i, e))
        if len(held) >= BATCH_ROWS:
            yield flush()
            held = []
    if held:
        yield flush()


class IndexFileSource(DataSource):
    """``spark.read.format("sidx").load(path)``: one file or the ``.sidx`` files of a folder, one task a file.

    ``option("embeddings", "false")`` leaves the vectors out and doesn't decode them.
    """

    @classmethod
    def name(cls) -> str:
        return "sidx"

    def _vectors(self) -> bool:
        return str(self.options.get("embeddings", "true")).lower() != "false"

    def schema(self) -> str:
        return ENTRY_SCHEMA if self._vectors() else ENTRY_SCHEMA.rsplit(",", 1)[0]

    def reader(self, schema) -> DataSourceReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("the source needs a path")
        return _FileReader(path, self._vectors())


class _FileReader(DataSourceReader):
    def __init__(self, path: str, vectors: bool):
        self.path, self.vectors = path, vectors

    def partitions(self) -> list[InputPartition]:
        p = Path(self.path)
        return [InputPartition(str(f)) for f in (sorted(p.glob("*.sidx")) if p.is_dir() else [p])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition.value, self.vectors)


def read_index(spark: SparkSession, path: str | Path, vectors: bool = True) -> DataFrame:
    spark.dataSource.register(IndexFileSource)
    return spark.read.format("sidx").option("embeddings", str(vectors).lower()).load(str(path))


def load_searchable(spark: SparkSession, path: str | Path, model: str | None = None, dimensions: int | None = None) -> tuple[Header, DataFrame]:
    """Header and entries of an index that may be searched: it has entries, and the model and width asked for."""
    header = read_header(path)
    if not header.count:
        raise IndexFileError("the index is empty")
    if model is not None and header.model != model:
        raise IndexFileError(f"the index was made by {header.model}, not {model}")
    if dimensions is not None and header.dimensions != dimensions:
        raise IndexFileError("the index has another width than the model")
    return header, read_index(spark, path)


def headers(spark: SparkSession, paths: Iterable[str | Path]) -> DataFrame:
    """One row (path, dimensions, model, fingerprint, count) a file; only headers are read."""
    rows = [(str(p), h.dimensions, h.model, h.fingerprint, h.count) for p in paths for h in [read_header(p)]]
    out = spark.createDataFrame([(p, d, m, str(f), str(c)) for p, d, m, f, c in rows], "path string, dimensions long, model string, fingerprint string, count string")
    return out.withColumns({c: F.col(c).cast("decimal(20,0)") for c in ("fingerprint", "count")})
