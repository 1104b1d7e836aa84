"""Constraints of tracks and bounding regions as queries that return what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import InvalidFormatError
from .windows import LAG, MAX_BEFORE, ordered_values

VIOLATION = "rule string, detail string"


def _found(df: DataFrame, rule: str, *detail: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.to_json(F.struct(*detail)).alias("detail"))


def positions(df: DataFrame, sequences: DataFrame, genome: str) -> DataFrame:
    """Starts and ends outside their sequence, inverted intervals, unknown sequences."""
    known = sequences.where(F.col("genome") == genome).select(F.col("seqid").alias("__s"), F.col("length").alias("__l"))
    bad = (F.col("__l").isNull()) | (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.col("__l"))
    return _found(df.join(known, df["seqid"] == F.col("__s"), "left").where(bad), "V1-V2 position", "seqid", "start", "end")


def unsorted(df: DataFrame, entity: list[str], order: str = "row_ord") -> DataFrame:
    seen = ordered_values(df.select(*entity, "start", "end", F.struct("start", "end").alias("__p"), order), entity, [order], {"__b": (LAG, "__p")})
    return _found(seen.where(F.col("__b") > F.col("__p")), "V20 sorted", *entity, "start", "end")


def overlapping(df: DataFrame, entity: list[str]) -> DataFrame:
    """Elements that begin before the end of an earlier one."""
    seen = ordered_values(df.select(*entity, "start", "end"), entity, ["start", "end"], {"__e": (MAX_BEFORE, "end")})
    return _found(seen.where(F.col("start") < F.col("__e")), "V20 overlap", *entity, "start", "end")


def repeated_ids(df: DataFrame) -> DataFrame:
    ids = df.where(F.coalesce(F.col("id"), F.lit("")) != "").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    empty = df.where(F.coalesce(F.col("id"), F.lit("")) == "").select("id", F.lit(1).cast("long").alias("n"))
    return _found(ids.unionByName(empty), "V19 id", "id", "n")


def repeated_edges(df: DataFrame) -> DataFrame:
    return _found(df.where(F.size("edges") != F.size(F.array_distinct("edges"))), "V19 edge", "id")


def broken_edges(df: DataFrame, undirected: bool = False) -> DataFrame:
    """Edges to unknown ids and, if undirected, edges without their counterpart."""
    from .graph import asymmetric, dangling, edge_list

    edges = edge_list(df)
    out = _found(dangling(edges, df), "V19 target", "src", "dst")
    return out.unionByName(_found(asymmetric(edges), "V19 symmetry", "src", "dst")) if undirected else out


def regions(br: DataFrame, dense_counts: bool = False) -> DataFrame:
    """Bounding regions of no length, that overlap or adjoin, or (dense tracks) whose number of
    elements isn't their length."""
    seen = ordered_values(br, ["genome", "seqid"], ["start", "end"], {"__b": (MAX_BEFORE, "end")})
    bad = (F.col("end") <= F.col("start")) | (F.col("start") <= F.coalesce(F.col("__b"), F.lit(-1)))
    if dense_counts:
        bad = bad | (F.col("el_count") != F.col("end") - F.col("start"))
    return _found(seen.where(bad), "V16 region", "seqid", "start", "end")


def outside_regions(df: DataFrame, br: DataFrame) -> DataFrame:
    """Elements that aren't inside one bounding region."""
    from .overlap import region_of_position

    placed = region_of_position(df, br, ["seqid"])
    bad = F.col("region_start").isNull() | (F.col("end") > F.col("region_end"))
    return _found(placed.where(bad), "V14 outside", "seqid", "start", "end")


def split_sequences(df: DataFrame, order: str = "row_ord") -> DataFrame:
    """Dense files that come back to an earlier sequence: more than one run of a seqid per file."""
    seen = ordered_values(df.select("file", "seqid", order), ["file"], [order], {"__b": (LAG, "seqid")})
    runs = seen.withColumn("__new", ~F.coalesce(F.col("__b") == F.col("seqid"), F.lit(False)))
    return _found(runs.groupBy("file", "seqid").agg(F.count(F.when(F.col("__new"), 1)).alias("n")).where("n > 1"), "V23 return", "file", "seqid", "n")


def uneven_vectors(df: DataFrame, column: str = "val") -> DataFrame:
    row = df.agg(F.min(F.size(column)).alias("least"), F.max(F.size(column)).alias("most"))
    return _found(row.where("least <> most"), "V18 dimension", "least", "most")


def require_none(violations: DataFrame) -> None:
    """Raises with the first few violations, if there are any."""
    found = violations.limit(5).collect()
    if found:
        raise InvalidFormatError("; ".join(f"{r['rule']}: {r['detail']}" for r in found))


def contained_region(br: DataFrame, seqid: str, start: int, end: int) -> DataFrame:
    """The bounding region that holds [start, end), if any."""
    inside: Column = (F.col("seqid") == seqid) & (F.col("start") <= start) & (F.col("end") >= end)
    return br.where(inside)
