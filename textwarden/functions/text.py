"""Small text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textwarden.functions.dialect import space_class
from textwarden.functions.rules import MAX_TEXT_BYTES


def is_blank(text: Column) -> Column:
    """Empty, or nothing but white space in the JavaScript sense; null counts as blank."""
    return F.coalesce(~text.rlike(f"[^{space_class()}]"), F.lit(True))


def js_trim(text: Column) -> Column:
    space = space_class()
    return F.regexp_replace(text, rf"\A[{space}]+|[{space}]+\z", "")


def fits(text: Column, max_bytes: int | None = MAX_TEXT_BYTES) -> Column:
    """True unless the UTF-8 size is strictly greater than the limit; None is no limit."""
    if max_bytes is None:
        return F.lit(True)
    return F.coalesce(F.octet_length(text) <= max_bytes, F.lit(True))


def slashed(path: Column) -> Column:
    """Backslashes turned into slashes."""
    return F.translate(path, "\\", "/")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters above U+FFFF count twice."""
    astral = F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.length(text) + astral
