"""Tag lists and predicates over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_tags(raw: Column) -> Column:
    """Distinct lower-case tags of a comma-separated text, in order; null gives null."""
    parts = F.transform(F.split(raw, ","), lambda t: F.lower(F.trim(t)))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def query_text(tag: Column) -> Column:
    return F.replace(tag, F.lit("-"), F.lit(" "))


def _some(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def matches_required(tags: Column, required_all: Column, required_any: Column) -> Column:
    """All of ``required_all`` and one of each list of ``required_any``; null lists ask for nothing, null tags are none."""
    own = _some(tags, "array<string>")
    return F.forall(_some(required_all, "array<string>"), lambda t: F.array_contains(own, t)) & F.forall(
        _some(required_any, "array<array<string>>"), lambda g: F.coalesce(F.arrays_overlap(own, g), F.lit(False))
    )


def has_forbidden(tags: Column, forbidden_any: Column) -> Column:
    return F.coalesce(F.arrays_overlap(_some(tags, "array<string>"), _some(forbidden_any, "array<string>")), F.lit(False))


def is_positive(tags: Column, required_all: Column, required_any: Column, forbidden_any: Column) -> Column:
    return matches_required(tags, required_all, required_any) & ~has_forbidden(tags, forbidden_any)


def default_kind(kind: Column, forbidden_any: Column) -> Column:
    """The query's kind, or ``negation`` where it forbids tags and ``other`` where not."""
    return F.coalesce(kind, F.when(F.size(_some(forbidden_any, "array<string>")) > 0, "negation").otherwise("other"))
