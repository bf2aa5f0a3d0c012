"""Which vectors are usable, and their way from Arrow lists to numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_dimensions(vectors: DataFrame, header: DataFrame, ident: str = "vec_id", side: int = 0) -> DataFrame:
    """(index_name, dims, vec_id, side, embedding) of the vectors whose index has a header and whose width is the header's.

    Null idents, index names and vectors drop out here; elements are examined
    where the vectors are parsed (:func:`usable_rows`).  Of several header
    rows of one name the largest width holds.
    """
    widths = header.filter("index_name is not null and dimensions > 0").groupBy("index_name").agg(F.max("dimensions").cast("int").alias("dims"))
    own = vectors.select(F.col(ident).cast("long").alias("vec_id"), "index_name", F.col("embedding").cast("array<float>").alias("embedding"))
    return (
        own.join(widths, "index_name")
        .filter("vec_id is not null and size(embedding) = dims")
        .select("index_name", "dims", "vec_id", F.lit(side).alias("side"), "embedding")
    )


def usable_rows(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(index name, rows of the batch, raw float32 matrix) by index.

    Usable: no element null, NaN or infinite, and not all zero.
    """
    col = batch["embedding"]
    names = batch["index_name"].dictionary_encode()
    code = names.indices.to_numpy(zero_copy_only=False)
    dims = batch["dims"].to_numpy()
    offsets = col.offsets.to_numpy()
    values = col.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    for k, name in enumerate(names.dictionary.to_pylist()):
        rows = np.flatnonzero(code == k)
        if not len(rows):
            continue
        d = int(dims[rows[0]])
        m = values[offsets[rows][:, None] + np.arange(d)]
        ok = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
        if ok.any():
            yield name, rows[ok], m[ok]


def only_usable(vectors: DataFrame) -> DataFrame:
    """The rows of ``vectors`` whose vector is usable."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for _, r, _ in usable_rows(batch)]
            if rows:
                yield batch.take(pa.array(np.sort(np.concatenate(rows))))

    return vectors.mapInArrow(keep, vectors.schema)


def as_binary(m: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix as a binary column."""
    m = np.ascontiguousarray(m, dtype=np.float32)
    width = m.shape[1] * 4
    offsets = (np.arange(len(m) + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m)])


def from_binary(col: pa.Array, dims: int) -> np.ndarray:
    """The matrix of a binary column of equally wide rows."""
    if not len(col):
        return np.zeros((0, dims), np.float32)
    start = np.frombuffer(col.buffers()[1], np.int32, 1, col.offset * 4)[0]
    return np.frombuffer(col.buffers()[2], np.float32, len(col) * dims, int(start)).reshape(len(col), dims)
