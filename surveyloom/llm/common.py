"""Column helpers the text operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Only these 26 letters change case, whatever the language of a text.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def whole_text(column: str) -> Column:
    """A missing text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a missing id counts as empty text."""
    key = F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % modulus
