"""Fetching a region of a track: exact slice, crop, rebasing, format conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..genome import COMP_BIN_SIZE
from .windows import LAG, ordered_values


def with_bin(df: DataFrame, size: int = COMP_BIN_SIZE) -> DataFrame:
    """Adds the grid bin of the start, on which stored tracks are pruned."""
    return df.withColumn("bin", F.floor(F.col("start") / size).cast("int"))


def slice_region(
    df: DataFrame, seqid: str, start: int, end: int, max_length: int | None = None, size: int = COMP_BIN_SIZE
) -> DataFrame:
    """Elements that reach into [start, end). With a stored ``bin`` column and the longest length
    of the track the scan is pruned to the bins that can hold them."""
    if end <= start:
        return df.where(F.lit(False))
    keep = (F.col("seqid") == seqid) & (F.col("end") > start) & (F.col("start") < end)
    if max_length is not None and "bin" in df.columns:
        keep = keep & F.col("bin").between((start - max_length) // size, (end - 1) // size)
    return df.where(keep)


def crop(df: DataFrame, start: int, end: int) -> DataFrame:
    """Adds rel_start and rel_end: clipped to the region and relative to it."""
    return df.withColumns({
        "rel_start": F.greatest(F.col("start") - start, F.lit(0)),
        "rel_end": F.least(F.col("end"), F.lit(end)) - start,
    })


def sub_slice(start: int, end: int, i: int | None, j: int | None) -> tuple[int, int]:
    """Bounds of the relative window [i:j] of a region; a negative j counts from its end."""
    i = 0 if i is None else i
    stop = end if j is None else min(end, start + j) if j >= 0 else end + j
    return start + i, max(stop, start + i)


def global_coordinates(df: DataFrame, anchor: int) -> DataFrame:
    """The inverse of ``crop`` for elements inside the region."""
    return df.withColumns({"start": F.col("rel_start") + anchor, "end": F.col("rel_end") + anchor}).drop("rel_start", "rel_end")



def point_of(which: str) -> Column:
    """Point of a segment: its upstream end ('start'), middle or downstream end by strand; an
    unknown strand counts as forward."""
    forward = F.coalesce(F.col("strand"), F.lit(-1)) != 0
    return {
        "start": lambda: F.when(forward, F.col("start")).otherwise(F.col("end") - 1),
        "mid": lambda: F.floor((F.col("start") + F.col("end")) / 2).cast("int"),
        "end": lambda: F.when(forward, F.col("end") - 1).otherwise(F.col("start")),
    }[which]()


def to_points(df: DataFrame, which: str, region: tuple[int, int] | None = None) -> DataFrame:
    """Segments to points from their whole, uncropped coordinates; points outside ``region`` go."""
    if "strand" not in df.columns:
        df = df.withColumn("strand", F.lit(None).cast("tinyint"))
        return to_points(df, which, region).drop("strand")
    out = df.withColumn("__p", point_of(which)).withColumns({"start": F.col("__p"), "end": F.col("__p") + 1}).drop("__p")
    return out if region is None else out.where((F.col("start") >= region[0]) & (F.col("start") < region[1]))


def partition_starts(df: DataFrame, entity: list[str], region_start: str | None = None) -> DataFrame:
    """Start of each partition element: the end of the one before it, or of its region."""
    first = F.col(region_start) if region_start else F.lit(0)
    out = ordered_values(df.drop("start"), entity, ["end"], {"__before": (LAG, "end")})
    return out.withColumn("start", F.coalesce("__before", first)).drop("__before")


def inter_element_gaps(df: DataFrame, entity: list[str], order: list[str] = ("start", "end")) -> DataFrame:
    """Adds ``gap``: from the end of the element before to the start; null for the first one."""
    out = ordered_values(df, entity, list(order), {"__before": (LAG, "end")})
    return out.withColumn("gap", F.col("start") - F.col("__before")).drop("__before")


def fixed_length_and_gap(df: DataFrame, entity: list[str]) -> DataFrame:
    """One row: the length and the gap shared by all elements, null where they differ."""
    g = inter_element_gaps(df, entity)
    length = F.col("end") - F.col("start")
    return g.agg(
        F.when(F.min(length) == F.max(length), F.min(length)).alias("fixed_length"),
        F.when(F.min("gap") == F.max("gap"), F.min("gap")).alias("fixed_gap"),
    )


def bp_iterate(df: DataFrame, start: int, end: int) -> DataFrame:
    """One row per position of the region with the elements that start there, if any."""
    positions = df.sparkSession.range(start, end).select(F.col("id").cast("int").alias("pos"))
    return positions.join(df, positions["pos"] == df["start"], "left")


def sliding_windows(spark, seqid: str, start: int, end: int, width: int, step: int = 1) -> DataFrame:
    """Windows of ``width`` over a region, for an overlap join."""
    last = max(end - width, start)
    return spark.range(start, last + 1, step).select(
        F.lit(seqid).alias("seqid"), F.col("id").cast("int").alias("start"), F.least(F.col("id") + width, F.lit(end)).cast("int").alias("end"))
