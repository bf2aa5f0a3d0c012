"""Fitting a linear map between two embedding spaces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of the sums that a fit keeps: (source + target) * source.
MAX_ELEMENTS = 64_000_000
CHUNK = 1_024


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.values.to_numpy(zero_copy_only=False)[col.offsets.to_numpy()[0] : col.offsets.to_numpy()[-1]].astype(np.float64).reshape(-1, width)


def ridge(pairs: DataFrame, penalty: float, source: str = "source", target: str = "target") -> np.ndarray:
    """The matrix W (source x target, float32) that minimises |X W - Y|^2 + penalty |W|^2.

    Every partition adds up its own X'X and X'Y, the sums are added by rows
    of the matrices across the cluster, and only the finished sums, whose
    size is that of the model and not of the data, reach the driver.  Pairs
    with nulls or with other widths than the first pair's are left out; no
    pair is an error.
    """
    sound = pairs.select(F.col(source).cast("array<double>").alias("x"), F.col(target).cast("array<double>").alias("y")).filter(
        "x is not null and y is not null and size(x) > 0 and size(y) > 0 and forall(x, v -> v is not null) and forall(y, v -> v is not null)"
    )
    first = sound.select(F.size("x"), F.size("y")).first()
    if first is None:
        raise ValueError("there are no pairs to fit")
    n, m = first
    if n * (n + m) > MAX_ELEMENTS:
        raise ValueError("the map is too large for one driver")

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n + m))
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                x, y = _matrix(part["x"], n), _matrix(part["y"], m)
                total += x.T @ np.hstack([x, y])
        yield pa.record_batch([pa.array(np.arange(n, dtype=np.int32)), pa.array([row.tobytes() for row in total], pa.binary())], names=["row", "sums"])

    def add(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + m)
        for batch in rows:
            for b in batch["sums"].to_pylist():
                total += np.frombuffer(b)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["row", "sums"])

    parts = sound.filter((F.size("x") == n) & (F.size("y") == m)).mapInArrow(gram, "row int, sums binary")
    rows = {r["row"]: np.frombuffer(r["sums"]) for r in parts.groupBy("row").applyInArrow(add, "row int, sums binary").collect()}
    whole = np.stack([rows[i] for i in range(n)])
    return np.linalg.solve(whole[:, :n] + penalty * np.eye(n), whole[:, n:]).astype(np.float32)


def predict(pairs: DataFrame, weights: np.ndarray, source: str = "source", out: str = "predicted") -> DataFrame:
    """Adds the mapped source vectors; null where the width doesn't fit."""
    from pyspark.sql.types import ArrayType, FloatType, StructType

    n = weights.shape[0]
    schema = StructType([*pairs.schema.fields]).add(out, ArrayType(FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch[source]
            sizes = np.diff(col.offsets.to_numpy())
            good = np.flatnonzero((sizes == n) & col.is_valid().to_numpy(zero_copy_only=False))
            values = col.values.to_numpy(zero_copy_only=False)[col.offsets.to_numpy()[:-1][good][:, None] + np.arange(n)].astype(np.float32)
            mapped: list = [None] * batch.num_rows
            for i, row in zip(good, values @ weights, strict=True):
                mapped[i] = row
            yield pa.record_batch([*batch.columns, pa.array(mapped, pa.list_(pa.float32()))], names=[*batch.schema.names, out])

    return pairs.mapInArrow(run, schema)


def check_no_leak(training: DataFrame, held_out: DataFrame, text: str = "prompt") -> None:
    """Raises if a held-out text is among the training texts."""
    shared = [r[0] for r in training.select(text).intersect(held_out.select(text)).limit(3).collect()]
    if shared:
        raise ValueError(f"held-out texts are in the training set: {shared}")
