"""Token ids for text encoders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_ids(ids: Column, context: int, eos: int, pad: int = 0, always_end: bool = False) -> tuple[Column, Column]:
    """Ids and mask of exactly ``context`` places: cut with ``eos`` last, or padded.

    With ``always_end`` a list of just ``context`` ids ends in ``eos`` too.
    """
    over = F.size(ids) >= context if always_end else F.size(ids) > context
    cut = F.when(over, F.concat(F.slice(ids, 1, context - 1), F.array(F.lit(eos).cast("long")))).otherwise(ids)
    n = F.least(F.size(ids), F.lit(context))
    full = F.slice(F.concat(cut, F.array_repeat(F.lit(pad).cast("long"), context)), 1, context)
    mask = F.transform(F.sequence(F.lit(1), F.lit(context)), lambda i: F.when(i <= n, 1).otherwise(0).cast("long"))
    return full, mask


def frame(ids: Sequence[int], mask: Sequence[int], context: int, eos: int, pad: int = 0) -> tuple[list[int], list[int]]:
    """:func:`frame_ids` for one list with a mask of its own."""
    ids, mask = list(ids), list(mask)
    if len(ids) > context:
        ids, mask = [*ids[: context - 1], eos], [*mask[: context - 1], 1]
    return ids + [pad] * (context - len(ids)), mask + [0] * (context - len(mask))


@lru_cache(maxsize=8)
def tokenizer(path: str):
    """A tokenizer file of the tokenizers library, or a sentencepiece model; loaded once a process."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_ids(path: str, text: str, special: bool = True) -> tuple[list[int], list[int]]:
    """Ids and attention mask of a text."""
    t = tokenizer(path)
    if path.endswith(".model"):
        ids = t.encode(text, num_threads=1)
        return ids, [1] * len(ids)
    e = t.encode(text, add_special_tokens=special)
    return e.ids, e.attention_mask
