"""Encoders from text or images to vectors, run in Arrow batches.

An encoder is made once in every Python worker, at the first row that needs
it, by a factory without arguments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.binaries import Projection, TokenTable
from ..sources.manifest import Manifest
from .images import crop_view, decode, fit, patch_input, tensor
from .text import encode_ids, frame

TextEncoder = Callable[[str], np.ndarray]
ImageEncoder = Callable[[bytes, str], np.ndarray]


class HashingEncoder:
    """A vector from the hashes of a text's words: no model, the same everywhere; for tests and as a stand-in."""

    def __init__(self, dimensions: int = 64, seed: int = 0):
        self.dimensions, self.seed = dimensions, seed

    def __call__(self, text: str) -> np.ndarray:
        v = np.zeros(self.dimensions, np.float32)
        for word in text.lower().split():
            h = hashlib.blake2b(word.encode(), digest_size=8, salt=self.seed.to_bytes(8, "little")).digest()
            v += np.random.default_rng(int.from_bytes(h, "little")).standard_normal(self.dimensions).astype(np.float32)
        return v


class LookupEncoder:
    """Vectors of known texts; an unknown one is an error."""

    def __init__(self, vectors: dict[str, np.ndarray]):
        self.vectors = vectors

    def __call__(self, text: str) -> np.ndarray:
        if text not in self.vectors:
            raise KeyError(f"no vector for {text!r}")
        return np.asarray(self.vectors[text], np.float32)


def session(path: str, threads: int = 1):
    """An ONNX session on the CPU: ``threads`` within an operator (the task's cores), operators one by one."""
    import onnxruntime as ort

    o = ort.SessionOptions()
    o.intra_op_num_threads, o.inter_op_num_threads = threads, 1
    o.execution_mode = ort.ExecutionMode.ORT_SEQUENTIAL
    return ort.InferenceSession(path, sess_options=o, providers=["CPUExecutionProvider"])


class OnnxTextEncoder:
    """A pack's text tower: lower case, ids, mask, token table, model, projection, check of the width."""

    def __init__(self, manifest: Manifest, threads: int = 1):
        t, root = manifest.text, manifest.root
        self.manifest, self.session = manifest, session(str(root / t.model), threads)
        self.table = TokenTable(root / t.token_embeddings["table"], t.token_embeddings["rows"], t.token_embeddings["dimensions"]) if t.token_embeddings else None
        self.projection = Projection(root / t.projection["path"], t.projection["inputDimensions"], t.projection["outputDimensions"]) if t.projection else None

    def __call__(self, text: str) -> np.ndarray:
        m, t = self.manifest, self.manifest.text
        ids, mask = encode_ids(str(m.root / t.tokenizer), text.lower() if t.lowercase else text)
        ids, mask = frame(ids, mask, m.context_length, t.eos_token, t.pad_token)
        feed = {t.input: np.array([ids], np.int64)}
        if t.attention_mask:
            feed[t.attention_mask] = np.array([mask if t.mask_padding else [1] * len(mask)], np.int64)
        if self.table:
            feed[t.token_embeddings["input"]] = self.table.lookup(ids)[None]
        v = np.asarray(self.session.run([t.output], feed)[0], np.float32).ravel()
        v = self.projection.apply(v) if self.projection else v
        if len(v) != m.dimensions:
            raise ValueError("the text model gives another width than its manifest")
        return v


class OnnxImageEncoder:
    """A pack's image tower, for fixed sizes or patches."""

    def __init__(self, manifest: Manifest, threads: int = 1):
        self.manifest, self.session = manifest, session(str(manifest.root / manifest.image.model), threads)

    def __call__(self, content: bytes, view: str = "full") -> np.ndarray:
        i = self.manifest.image
        pixels = crop_view(decode(content), view)
        if i.patch_size:
            values, mask, grid = patch_input(pixels, i.mean, i.std, i.patch_size, i.max_num_patches, list(i.supported_shapes))
            feed = {i.input: values[None], i.pixel_attention_mask: mask[None], i.spatial_shapes: np.array([grid], np.int64)}
        else:
            feed = {i.input: tensor(fit(pixels, i.width, i.height, i.resize_mode, i.resize_filter), i.mean, i.std)[None]}
        v = np.asarray(self.session.run([i.output], feed)[0], np.float32).ravel()
        if len(v) != self.manifest.dimensions:
            raise ValueError("the image model gives another width than its manifest")
        return v


def _apply(df: DataFrame, inputs: list[str], call, factory, vector: str, error: str) -> DataFrame:
    from pyspark.sql.types import ArrayType, FloatType, StringType, StructType

    out = StructType([*df.schema.fields]).add(vector, ArrayType(FloatType())).add(error, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            vectors, errors = [], []
            for row in zip(*(batch[c].to_pylist() for c in inputs), strict=True):
                if row[0] is None:
                    vectors.append(None)
                    errors.append(None)
                    continue
                try:
                    encoder = encoder or factory()
                    vectors.append(np.asarray(call(encoder, *row), np.float32))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 a row that can't be encoded is told, not fatal
                    vectors.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.record_batch([*batch.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[*batch.schema.names, vector, error])

    return df.mapInArrow(run, out)


def encode_texts(df: DataFrame, text: str, factory: Callable[[], TextEncoder], vector: str = "vector", error: str = "encode_error") -> DataFrame:
    """Adds the vector of every text and why there is none; null texts have neither."""
    return _apply(df, [text], lambda e, t: e(t), factory, vector, error)


def encode_images(df: DataFrame, content: str, view: str, factory: Callable[[], ImageEncoder], vector: str = "embedding", error: str = "error") -> DataFrame:
    """Adds the vector of every image file's content in the view, and why there is none."""
    return _apply(df, [content, view], lambda e, c, v: e(c, v or "full"), factory, vector, error)


def hashing_factory(dimensions: int = 64, seed: int = 0) -> Callable[[], TextEncoder]:
    return partial(HashingEncoder, dimensions, seed)


def with_contents(df: DataFrame, path: str = "path") -> DataFrame:
    """Entries with their file's content, read by the executors; a missing file has null content."""
    files = df.select(F.col(path)).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = []
            for p in batch[path].to_pylist():
                try:
                    with open(p.removeprefix("file:"), "rb") as f:
                        body.append(f.read())
                except (OSError, AttributeError):
                    body.append(None)
            yield pa.record_batch([batch[path], pa.array(body, pa.binary())], names=[path, "content"])

    return df.join(files.mapInArrow(read, f"{path} string, content binary"), path, "left")
