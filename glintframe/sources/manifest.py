"""Model-pack manifests."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from pathlib import Path

FILE_NAME = "semantic-pack.json"
FORMAT = 1


@dataclass(frozen=True)
class ImageModel:
    model: str
    width: int
    height: int
    mean: tuple[float, ...]
    std: tuple[float, ...]
    resize_mode: str = "cover"
    resize_filter: str = "catmullrom"
    input: str = "images"
    output: str = "image_embedding"
    patch_size: int | None = None
    max_num_patches: int | None = None
    pixel_attention_mask: str | None = None
    spatial_shapes: str | None = None
    supported_shapes: tuple[tuple[int, int], ...] = ()


@dataclass(frozen=True)
class TextModel:
    model: str
    tokenizer: str
    input: str = "tokens"
    attention_mask: str | None = None
    mask_padding: bool = True
    lowercase: bool = False
    output: str = "text_embedding"
    eos_token: int = 49407
    pad_token: int = 0
    token_embeddings: dict | None = None
    projection: dict | None = None


@dataclass(frozen=True)
class Manifest:
    id: str
    version: str
    dimensions: int
    context_length: int
    image: ImageModel
    text: TextModel
    root: Path = field(default=Path("."))

    @property
    def identity(self) -> str:
        return f"{self.id}@{self.version}"


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def _own(cls, value: dict):
    known = {f for f in cls.__dataclass_fields__}
    kept = {k: v for k, v in ((_snake(k), v) for k, v in value.items()) if k in known and v is not None}
    return cls(**{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in kept.items()})


def identity(path: str | Path) -> str:
    value = json.loads(Path(path).read_bytes())
    return f"{value['id']}@{value['version']}"


def load(path: str | Path) -> Manifest:
    """The manifest of a file, its defaults filled in; a manifest that can't be used raises ValueError."""
    path = Path(path)
    try:
        v = json.loads(path.read_bytes())
        if v["format"] != FORMAT:
            raise ValueError("unknown manifest format")
        m = Manifest(v["id"], v["version"], v["dimensions"], v["contextLength"], _own(ImageModel, v["image"]), _own(TextModel, v["text"]), path.parent)
    except (KeyError, TypeError, AttributeError, json.JSONDecodeError) as e:
        raise ValueError(f"the manifest {path} is incomplete: {e}") from e
    i = m.image
    rules = [
        (bool(m.id.strip()) and bool(m.version.strip()), "id and version must not be blank"),
        (m.dimensions > 0, "dimensions must be positive"),
        (m.context_length > 1, "the context needs more than one place"),
        (len(i.mean) == 3 and len(i.std) == 3 and all(math.isfinite(s) and s > 0 for s in i.std), "standard deviations must be positive"),
        ((i.patch_size is None) == (i.max_num_patches is None), "the patch settings are incomplete"),
        (i.resize_mode in ("cover", "stretch") and i.resize_filter in ("bilinear", "catmullrom"), "unknown resizing"),
    ]
    if i.patch_size is None:
        rules.append((i.width > 0 and i.height > 0, "image sizes must be positive"))
    elif i.max_num_patches is not None:
        rules += [
            (i.patch_size > 0 and i.max_num_patches > 0, "patch sizes and numbers must be positive"),
            (bool(i.pixel_attention_mask) and bool(i.spatial_shapes), "the patch inputs are incomplete"),
            (bool(i.supported_shapes) and all(h > 0 and w > 0 and h * w <= i.max_num_patches for h, w in i.supported_shapes), "patch shapes are missing or too large"),
        ]
    for holds, why in rules:
        if not holds:
            raise ValueError(f"the manifest {path}: {why}")
    return m


def require_same_pack(text: Manifest, image: Manifest) -> None:
    """Raises unless both towers' manifests have one id and version."""
    if text.identity != image.identity:
        raise ValueError(f"{text.identity} and {image.identity} are different packs")
