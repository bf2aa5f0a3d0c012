"""Model side files: quantised token tables, dense projections, NPZ matrices."""

from __future__ import annotations

import struct
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .index_file import replace_file

# Fixed values of the two formats.
TOKEN_MAGIC = b"SKWDTOK1"
PROJECTION_MAGIC = b"SKWDPRJ1"
_TOKEN_HEAD = "<8sIIfB3x"
_PROJECTION_HEAD = "<8sII"


class TokenTable:
    """Rows of u8 codes, mapped into memory; a row's values are (code - zero point) * scale."""

    def __init__(self, path: str | Path, rows: int | None = None, dimensions: int | None = None):
        size = Path(path).stat().st_size
        with open(path, "rb") as f:
            head = f.read(struct.calcsize(_TOKEN_HEAD))
        if len(head) < struct.calcsize(_TOKEN_HEAD):
            raise ValueError("the token table ends early")
        magic, self.rows, self.dimensions, self.scale, self.zero_point = struct.unpack(_TOKEN_HEAD, head)
        if magic != TOKEN_MAGIC:
            raise ValueError("not a token table")
        if not self.rows or not self.dimensions:
            raise ValueError("the token table is empty")
        if not np.isfinite(self.scale) or self.scale <= 0:
            raise ValueError("the token table's scale isn't positive")
        if rows not in (None, self.rows) or dimensions not in (None, self.dimensions):
            raise ValueError("the token table has another shape than the model")
        if size != len(head) + self.rows * self.dimensions:
            raise ValueError("the token table has another size than its shape")
        self.codes = np.memmap(path, np.uint8, "r", len(head), (self.rows, self.dimensions))

    def lookup(self, tokens) -> np.ndarray:
        """The values of the tokens' rows, float32; an id that is negative or too large is an error."""
        ids = np.asarray(tokens, np.int64)
        if ((ids < 0) | (ids >= self.rows)).any():
            raise IndexError("token id out of range")
        return (self.codes[ids].astype(np.int32) - self.zero_point).astype(np.float32) * np.float32(self.scale)


def write_token_table(path: str | Path, codes: np.ndarray, scale: float, zero_point: int) -> None:
    codes = np.ascontiguousarray(codes, np.uint8)
    replace_file(Path(path), struct.pack(_TOKEN_HEAD, TOKEN_MAGIC, *codes.shape, scale, zero_point) + codes.tobytes())


class Projection:
    """A matrix of float32 that maps vectors of ``rows`` elements to ``columns``."""

    def __init__(self, path: str | Path, rows: int | None = None, columns: int | None = None):
        size = Path(path).stat().st_size
        with open(path, "rb") as f:
            head = f.read(struct.calcsize(_PROJECTION_HEAD))
        if len(head) < struct.calcsize(_PROJECTION_HEAD):
            raise ValueError("the projection ends early")
        magic, self.rows, self.columns = struct.unpack(_PROJECTION_HEAD, head)
        if magic != PROJECTION_MAGIC or not self.rows or not self.columns:
            raise ValueError("not a projection")
        if rows not in (None, self.rows) or columns not in (None, self.columns):
            raise ValueError("the projection has another shape than the model")
        if size != len(head) + 4 * self.rows * self.columns:
            raise ValueError("the projection has another size than its shape")
        self.weights = np.memmap(path, "<f4", "r", len(head), (self.rows, self.columns))

    def apply(self, vector) -> np.ndarray:
        """``vector`` times the matrix, added row by row in float32."""
        v = np.asarray(vector, np.float32)
        if v.shape != (self.rows,):
            raise ValueError("the vector has another width than the projection")
        out = np.zeros(self.columns, np.float32)
        for x, row in zip(v, self.weights, strict=True):
            out += x * row
        return out


def write_projection(path: str | Path, weights: np.ndarray) -> None:
    w = np.ascontiguousarray(weights, "<f4")
    replace_file(Path(path), struct.pack(_PROJECTION_HEAD, PROJECTION_MAGIC, *w.shape) + w.tobytes())


def load_npz(spark: SparkSession, path: str | Path, key: str = "keys", vector: str = "embeddings") -> DataFrame:
    """(position, key, embedding) of an NPZ file of keys and a matrix; pickled content is refused."""
    with np.load(path, allow_pickle=False) as z:
        keys, m = [str(k) for k in z[key]], np.asarray(z[vector], np.float32)
    if len(keys) != len(m):
        raise ValueError("keys and vectors differ in number")
    return spark.createDataFrame([(i, k, v.tolist()) for i, (k, v) in enumerate(zip(keys, m, strict=True))], "position long, key string, embedding array<float>")


def save_pairs(df: DataFrame, path: str) -> None:
    """Training pairs (prompt, source, target) as Parquet."""
    df.select("prompt", "source", "target").write.mode("overwrite").parquet(path)
