"""Word columns built from Spark functions alone, for the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of words ``[^\x20\x09-\x0D]+``.
SPACES = r"[\x20\x09-\x0D]+"
#: Separators of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else (plain ``lower`` does the same to text of ASCII only)."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def split_words(text: Column, separators: str) -> Column:
    return F.array_remove(F.split(text, separators), "")


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
