"""Scalar functions of names and texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..sinks.lines import escape, number_text, strand_text
from ..sources.lines import number_of, strand_of, unquote

__all__ = ["escape", "number_text", "strand_text", "number_of", "strand_of", "unquote", "split_name", "safe_name", "thousands", "pretty_name",
           "file_suffix", "same", "allowed_characters"]


def split_name(name: Column) -> Column:
    """Parts of a track name, separated by ``:``, ``^`` or ``|``."""
    return F.split(name, r"[:^|]")


def safe_name(name: Column) -> Column:
    """Without characters that can't stand in a file name."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_.\- ]", "_")


def thousands(number: Column) -> Column:
    """Digits in groups of three, separated by blanks."""
    return F.regexp_replace(F.format_number(number, 0), ",", " ")


def pretty_name(name: Column) -> Column:
    """Last part of a track name, with blanks for underscores."""
    return F.replace(F.element_at(split_name(name), -1), F.lit("_"), F.lit(" "))


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def same(a: Column, b: Column) -> Column:
    """Equality in which NaN equals NaN and null equals null."""
    return a.eqNullSafe(b)


def allowed_characters(text: Column) -> Column:
    """Printable ASCII and tabs only, no blank at either end."""
    return text.rlike(r"^[\t\n\r\x20-\x7E]*$") & (text == F.trim(text))
