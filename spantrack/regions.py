"""Predicates and scalar functions of half-open intervals, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (a_end >= b_end)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (a_end > b_start)


def touches(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start == b_end) | (a_end == b_start)


def elements_overlap(track_type: str, a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """By kind of track: functions never overlap, points and partitions where they are equal."""
    if track_type in ("function", "linked function", "linked base pairs"):
        return F.lit(False)
    if "points" in track_type or "partition" in track_type or "step function" in track_type:
        return (a_start == b_start) & (a_end == b_end)
    return overlaps(a_start, a_end, b_start, b_end)


def extend(start: Column, end: Column, by: int, length: Column) -> tuple[Column, Column]:
    """Grows the end (by >= 0) or the start (by < 0), kept inside the sequence."""
    if by >= 0:
        return start, F.least(end + by, length)
    return F.greatest(start + by, F.lit(0)), end


def exclude(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Array of the up to two pieces of a that b does not cover."""
    left = F.struct(a_start.alias("start"), F.least(a_end, b_start).alias("end"))
    right = F.struct(F.greatest(a_start, b_end).alias("start"), a_end.alias("end"))
    whole = F.array(F.struct(a_start.alias("start"), a_end.alias("end")))
    pieces = F.filter(F.array(left, right), lambda p: p["end"] > p["start"])
    return F.when(overlaps(a_start, a_end, b_start, b_end), pieces).otherwise(whole)


def span(start: Column, end: Column) -> Column:
    return end - start


def is_whole(start: Column, end: Column, length: Column) -> Column:
    return (start == 0) & (end == length)


def display(seqid: Column, start: Column, end: Column, strand: Column | None = None) -> Column:
    """``chr:101-1000 (Pos)``, 1-based and inclusive; an unknown strand isn't shown."""
    text = F.concat(seqid, F.lit(":"), (start + 1).cast("string"), F.lit("-"), end.cast("string"))
    if strand is None:
        return text
    return F.concat(text, F.when(strand == 1, " (Pos)").when(strand == 0, " (Neg)").otherwise(""))


def _short(position: Column) -> Column:
    return (
        F.when((position % 1_000_000 == 0) & (position != 0), F.concat((position / 1_000_000).cast("long").cast("string"), F.lit("m")))
        .when((position % 1000 == 0) & (position != 0), F.concat((position / 1000).cast("long").cast("string"), F.lit("k")))
        .otherwise(position.cast("string"))
    )


def display_short(seqid: Column, start: Column, end: Column) -> Column:
    """As ``display``, with round bounds in thousands or millions."""
    begin = F.when(start == 0, F.lit("1")).when(start % 1000 == 0, _short(start)).otherwise((start + 1).cast("string"))
    return F.concat(seqid, F.lit(":"), begin, F.lit("-"), _short(end))
