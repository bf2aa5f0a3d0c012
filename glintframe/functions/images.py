"""Pixels: decoding, views, resampling, tensors and patches, in numpy."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import patch_grid, view_rectangle

PIXELS = "path string, width int, height int, rgb binary, error string"
#: Formats that this module decodes; the JVM's readers do jpeg, gif and tiff.
OWN = "*.{png,bmp,ppm,pgm,pbm,pnm,PNG,BMP,PPM,PGM,PBM,PNM}"
JVM = "*.{jpg,jpeg,gif,tif,tiff,JPG,JPEG,GIF,TIF,TIFF}"


def _pnm(b: bytes) -> np.ndarray:
    kind = b[1] - 48
    at, fields = 2, []
    while len(fields) < (2 if kind in (1, 4) else 3):
        while at < len(b) and (b[at : at + 1].isspace() or b[at : at + 1] == b"#"):
            at = b.index(b"\n", at) + 1 if b[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(b) and not b[end : end + 1].isspace():
            end += 1
        fields.append(int(b[at:end]))
        at = end
    w, h, most = fields[0], fields[1], fields[2] if len(fields) > 2 else 1
    channels = 3 if kind in (3, 6) else 1
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(b, np.uint8, (w + 7) // 8 * h, at + 1).reshape(h, -1), axis=1)[:, :w]
        v, most = (1 - bits)[:, :, None].astype(np.float64), 1
    elif kind in (5, 6):
        v = np.frombuffer(b, ">u2" if most > 255 else np.uint8, w * h * channels, at + 1).reshape(h, w, channels).astype(np.float64)
    else:
        text = b"".join(line.split(b"#")[0] + b" " for line in b[at:].splitlines())
        numbers = list(text.replace(b" ", b"").strip()) if kind == 1 else text.split()
        v = np.array([int(x) - 48 if kind == 1 else int(x) for x in numbers[: w * h * channels]], np.float64).reshape(h, w, channels)
        v = 1 - v if kind == 1 else v
    return np.repeat(np.round(v * (255 / most)), 3 // channels, axis=2).astype(np.uint8)


def _bmp(b: bytes) -> np.ndarray:
    start, size, w, h, _, bits, packing = struct.unpack_from("<10xIIiiHHI", b)
    if size < 40 or packing not in (0, 3) or bits not in (24, 32):
        raise ValueError("this kind of bmp isn't supported")
    row = (w * bits + 31) // 32 * 4
    m = np.frombuffer(b, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return np.ascontiguousarray((m[::-1] if h > 0 else m)[:, :, 2::-1])


def _png(b: bytes) -> np.ndarray:
    at, data, palette, head = 8, [], None, None
    while at < len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        body = b[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    w, h, depth, color, _, _, laced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    if laced or depth not in (8, 16):
        raise ValueError("this kind of png isn't supported")
    step = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        up = out[y - 1] if y else np.zeros(w * step, np.uint8)
        if kind == 2:
            line += up
        elif kind == 1:
            line = np.cumsum(line.reshape(w, step), axis=0, dtype=np.uint8).ravel()
        elif kind in (3, 4):
            for x in range(w * step):
                left = int(line[x - step]) if x >= step else 0
                above, corner = int(up[x]), int(up[x - step]) if x >= step else 0
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2]
                line[x] = (int(line[x]) + guess) & 255
        out[y] = line
    v = out.reshape(h, w, channels, depth // 8)[:, :, :, 0]
    if color == 3:
        return palette[v[:, :, 0]]
    return np.repeat(v[:, :, :1], 3, axis=2) if channels < 3 else np.ascontiguousarray(v[:, :, :3])


def decode(b: bytes) -> np.ndarray:
    """RGB pixels (height, width, 3) of a PNG, BMP or PNM file; anything else is an error."""
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(b)
    if b[:2] == b"BM":
        return _bmp(b)
    if b[:1] == b"P" and b[1:2] in b"123456" and len(b) > 2:
        return _pnm(b)
    raise ValueError("unknown image format")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, rgb, error) of the images below ``path``; files that can't be decoded have an error and no pixels."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary()), ("error", pa.string())])
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    m = decode(content)
                    rows.append((p, m.shape[1], m.shape[0], m.tobytes(), None))
                except Exception as e:  # noqa: BLE001 a broken file is a row, not the end of the job
                    rows.append((p, None, None, None, str(e) or type(e).__name__))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rgb = []
            for d, w, h, n in zip(*(batch[c].to_pylist() for c in ("data", "width", "height", "channels")), strict=True):
                m = np.frombuffer(d, np.uint8).reshape(h, w, n) if d is not None and w > 0 else None
                rgb.append(None if m is None else np.ascontiguousarray(np.repeat(m, 3, axis=2) if n == 1 else m[:, :, 2::-1]).tobytes())
            error = pa.array([None if x is not None else "can't be decoded" for x in rgb], pa.string())
            yield pa.record_batch([batch["path"], batch["width"], batch["height"], pa.array(rgb, pa.binary()), error], names=["path", "width", "height", "rgb", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    own = files.option("pathGlobFilter", OWN).load(path).select("path", "content").mapInArrow(read, PIXELS)
    jvm = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", JVM).load(path)
    i = F.col("image")
    return own.unionByName(jvm.select(i["origin"].alias("path"), i["data"].alias("data"), i["width"].alias("width"), i["height"].alias("height"), i["nChannels"].alias("channels")).mapInArrow(turned, PIXELS))


def crop_view(m: np.ndarray, view: str) -> np.ndarray:
    x, y, w, h = view_rectangle(m.shape[1], m.shape[0], view)
    return m[y : y + h, x : x + w]


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


def _cubic(a: float):
    def kernel(x: np.ndarray) -> np.ndarray:
        x = np.abs(x)
        near = (a + 2) * x**3 - (a + 3) * x**2 + 1
        far = a * (x**3 - 5 * x**2 + 8 * x - 4)
        return np.where(x < 1, near, np.where(x < 2, far, 0.0))

    return kernel


#: Kernels and their radius.  Catmull-Rom is the cubic of -0.5, which "bicubic" means here as well.
FILTERS = {"bilinear": (_triangle, 1.0), "catmullrom": (_cubic(-0.5), 2.0), "bicubic": (_cubic(-0.5), 2.0)}


def _weights(old: int, new: int, kernel, radius: float) -> np.ndarray:
    """(new, old) weights; the kernel widens when the image shrinks."""
    ratio = old / new
    scale = max(1.0, ratio)
    centre = (np.arange(new) + 0.5) * ratio
    w = kernel((np.arange(old)[None, :] + 0.5 - centre[:, None]) / scale)
    w[np.abs(np.arange(old)[None, :] + 0.5 - centre[:, None]) > radius * scale] = 0
    return w / w.sum(axis=1, keepdims=True)


def resize(m: np.ndarray, width: int, height: int, kind: str = "catmullrom") -> np.ndarray:
    """Resampled RGB pixels, rounded to bytes."""
    kernel, radius = FILTERS[kind]
    v = np.tensordot(_weights(m.shape[0], height, kernel, radius), m.astype(np.float64), (1, 0))
    h = np.tensordot(_weights(m.shape[1], width, kernel, radius), v, (1, 1)).transpose(1, 0, 2)
    return np.clip(np.floor(h + 0.5), 0, 255).astype(np.uint8)


def fit(m: np.ndarray, width: int, height: int, mode: str = "cover", kind: str = "catmullrom", rounding=math.ceil) -> np.ndarray:
    """``stretch`` to the size, or ``cover`` it and crop the centre; ``rounding`` gives the covering size in pixels."""
    if mode == "stretch":
        return resize(m, width, height, kind)
    if mode != "cover":
        raise ValueError(f"unknown resize mode {mode!r}")
    scale = max(width / m.shape[1], height / m.shape[0])
    w, h = int(rounding(m.shape[1] * scale)), int(rounding(m.shape[0] * scale))
    big = resize(m, w, h, kind)
    x, y = (w - width) // 2, (h - height) // 2
    return big[y : y + height, x : x + width]


def _scaled(m: np.ndarray, mean, std) -> np.ndarray:
    return (m.astype(np.float32) / np.float32(255) - np.asarray(mean, np.float32)) / np.asarray(std, np.float32)


def tensor(m: np.ndarray, mean, std) -> np.ndarray:
    """Planes (3, height, width) of (pixel / 255 - mean) / std, float32."""
    return np.ascontiguousarray(_scaled(m, mean, std).transpose(2, 0, 1))


def patches(m: np.ndarray, mean, std, patch_size: int, max_patches: int) -> np.ndarray:
    """(max_patches, patch_size^2 * 3): the patches row by row, zeros after the last."""
    rows, columns = m.shape[0] // patch_size, m.shape[1] // patch_size
    v = _scaled(m[: rows * patch_size, : columns * patch_size], mean, std).reshape(rows, patch_size, columns, patch_size, 3)
    out = np.zeros((max_patches, patch_size * patch_size * 3), np.float32)
    out[: rows * columns] = v.transpose(0, 2, 1, 3, 4).reshape(rows * columns, -1)
    return out


def patch_input(m: np.ndarray, mean, std, patch_size: int, max_patches: int, supported: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Patches, their mask and the grid of an image resized bilinearly to its patch grid; an unsupported grid is an error."""
    rows, columns = patch_grid(m.shape[0], m.shape[1], patch_size, max_patches)
    if (rows, columns) not in {tuple(s) for s in supported}:
        raise ValueError(f"the patch grid {rows}x{columns} isn't supported")
    mask = np.zeros(max_patches, np.int64)
    mask[: rows * columns] = 1
    return patches(resize(m, columns * patch_size, rows * patch_size, "bilinear"), mean, std, patch_size, max_patches), mask, (rows, columns)
