"""Records that are equal but for white space, letter case, punctuation or field order.

Byte-identical records collapse first, so only distinct ones are
canonicalised; they are grouped again on the whole canonical text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import checkpointed

#: Records of a text that one task joins; of more common texts the records are spread over several.
TEXT_ROWS = 1_000_000
_SIGN = "[:=]"
_PARTS = "[;|,&\\n\\r\\x0B\\x0C\\x85\\u2028\\u2029]"


def _letters(c: Column) -> Column:
    """Letters and digits (Unicode categories L and N) in lower case, whatever stood between them; a final sigma is a sigma."""
    return F.translate(F.lower(F.regexp_replace(c, "[^\\p{L}\\p{N}]+", "")), "\u03c2", "\u03c3")


def canonical(text: Column) -> Column:
    """The form that equal records share, or null if there is no letter or digit.

    A text with ``:`` or ``=`` is a list of fields: pieces between ``; | , &``
    and line breaks, each parted into name and value by its first sign (a
    piece without one is a name with an empty value); pieces without letters
    or digits are dropped, the rest is sorted, repeated fields stay.
    """
    pieces = F.transform(
        F.split(text, _PARTS),
        lambda p: F.concat(_letters(F.regexp_extract(p, f"^[^:=]*", 0)), F.lit("\u0001"), _letters(F.regexp_replace(p, f"^[^:=]*{_SIGN}?", ""))),
    )
    fields = F.array_join(F.array_sort(F.filter(pieces, lambda p: p != "\u0001")), "\u0002")
    form = F.when(text.rlike(_SIGN), F.concat(F.lit("F"), fields)).otherwise(F.concat(F.lit("T"), _letters(text)))
    return F.when(F.length(form) > 1, form)


def _raw(records: DataFrame, text: str, ident: str) -> DataFrame:
    """Byte-identical records collapsed: (_text, _n, _id)."""
    kept = records.filter(F.col(text).isNotNull() & F.col(ident).isNotNull())
    return kept.groupBy(F.col(text).alias("_text")).agg(F.count(F.lit(1)).alias("_n"), F.min(ident).alias("_id"))


def _forms(records: DataFrame, text: str, ident: str) -> DataFrame:
    """(_text, _n, _id, canonical) of every distinct text that has a canonical form."""
    return _raw(records, text, ident).withColumn("canonical", canonical(F.col("_text"))).filter("canonical is not null")


def _classes(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    classes = forms.groupBy("canonical").agg(F.min("_id").alias("first"), F.sum("_n").alias("copies"))
    return classes, forms.join(classes, "canonical")


def collapse(records: DataFrame, text: str, ident: str) -> tuple[DataFrame, DataFrame]:
    """Classes of equal records and the class of every distinct raw text.

    First (canonical, first, copies): smallest ident and number of records;
    second (text, first).  Null texts and those without letter or digit, and
    rows with null ident, are no records.
    """
    classes, of_text = _classes(_forms(records, text, ident))
    return classes, of_text.select(F.col("_text").alias(text), "first")


def copies(records: DataFrame, text: str, ident: str) -> DataFrame:
    """(first, ident): one row for each record that equals one of a smaller ident.

    The records of a text that more than ``TEXT_ROWS`` have are spread over
    several tasks, by parts told from the hash of the text; such texts are at
    most one in ``TEXT_ROWS`` records.
    """
    # used three times
    forms = checkpointed(_forms(records, text, ident))
    _, of_text = _classes(forms)
    common = forms.filter(F.col("_n") > TEXT_ROWS).select(F.xxhash64("_text").alias("_hash"), F.ceil(F.col("_n") / TEXT_ROWS).alias("_parts"))
    parts = F.broadcast(common.groupBy("_hash").agg(F.max("_parts").cast("int").alias("_parts")))
    n = F.coalesce("_parts", F.lit(1))
    own = records.select(F.col(text).alias("_text"), F.col(ident).alias("_ident")).withColumn("_hash", F.xxhash64("_text")).join(parts, "_hash", "left")
    found = of_text.select("_text", "first").withColumn("_hash", F.xxhash64("_text")).join(parts, "_hash", "left")
    spread = own.withColumn("_part", F.pmod(F.xxhash64("_ident"), n).cast("int"))
    every = found.withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1)))
    joined = spread.drop("_hash", "_parts").join(every.drop("_hash", "_parts"), ["_text", "_part"])
    return joined.filter(F.col("_ident") != F.col("first")).select("first", F.col("_ident").alias(ident))
