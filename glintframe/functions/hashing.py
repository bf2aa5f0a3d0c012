"""Stable names and fingerprints."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .views import VIEW_CODES

# The 64-bit FNV-1a constants and the personalisation of both fingerprints.
FNV_START = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
VIEW_PERSON = b"skwdview"
CATALOG_PERSON = b"skwdcatv"


def fnv1a64(data: bytes, start: int = FNV_START) -> int:
    h = start
    for b in data:
        h = (h ^ b) * FNV_PRIME % 2**64
    return h


def cache_name(model: str, profile: str) -> str:
    """The file name of the index that a model and a view profile share."""
    return f"index-{fnv1a64(model.encode() + b'\xff' + profile.encode()):016x}.sidx"


def component_name(pack_id: str, version: str) -> str:
    """The folder name of an installed pack: a readable slug of at most 72 characters and a hash of both texts."""
    slug = re.sub(r"[^0-9a-z]+", "-", re.sub(r"[A-Z]", lambda m: m.group().lower(), f"{pack_id}-{version}")).strip("-") or "model"
    return f"{slug[:72]}-{fnv1a64(pack_id.encode() + b'\xff' + version.encode() + b'\xff'):016x}"


def view_fingerprint(path: str, size: int, mtime_ns: int, view: str) -> int:
    d = hashlib.blake2b(digest_size=8, person=VIEW_PERSON)
    d.update(path.encode() + size.to_bytes(8, "little") + mtime_ns.to_bytes(8, "little") + VIEW_CODES[view].to_bytes(1, "little"))
    return int.from_bytes(d.digest(), "little")


def catalog_fingerprint(entries: Iterable[tuple[str, int]]) -> int:
    """Of (key, fingerprint) pairs in order."""
    d = hashlib.blake2b(digest_size=8, person=CATALOG_PERSON)
    for key, fingerprint in entries:
        d.update(key.encode() + int(fingerprint).to_bytes(8, "little"))
    return int.from_bytes(d.digest(), "little")


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def cache_name_column(model: Column, profile: Column) -> Column:
    @F.pandas_udf("string")
    def name(m: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else cache_name(a, b) for a, b in zip(m, p, strict=True)])

    return name(model, profile)


def view_fingerprint_column(path: Column, size: Column, mtime_ns: Column, view: Column) -> Column:
    """As DECIMAL(20,0); null where an input is null."""

    @F.pandas_udf("string")
    def fingerprint(p: pd.Series, s: pd.Series, t: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or pd.isna(c) or d is None else str(view_fingerprint(a, int(b), int(c), d)) for a, b, c, d in zip(p, s, t, v, strict=True)])

    return fingerprint(path, size, mtime_ns, view).cast("decimal(20,0)")


def catalog_fingerprints(entries: DataFrame, by: str) -> DataFrame:
    """(by, fingerprint) of every catalog's entries (by, position, key, fingerprint) in the order of position; nulls have no bytes to hash and are left out."""

    def digest(batches: pd.DataFrame) -> pd.DataFrame:
        rows = batches.sort_values("position")
        value = catalog_fingerprint(zip(rows["key"], rows["fingerprint"], strict=True))
        return pd.DataFrame({by: [rows[by].iloc[0]], "fingerprint": [str(value)]})

    # one catalog is one document and fits into a task
    kind = entries.schema[by].dataType.simpleString()
    sound = entries.filter(f"{by} is not null and key is not null and fingerprint is not null").select(by, "position", "key", "fingerprint")
    return sound.groupBy(by).applyInPandas(digest, f"{by} {kind}, fingerprint string").withColumn("fingerprint", F.col("fingerprint").cast("decimal(20,0)"))
