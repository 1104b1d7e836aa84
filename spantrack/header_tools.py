"""Whole-file tools of the header-described format: standardise, infer headers, sort, complement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .operators.complement import complement
from .operators.windows import LAG, MAX_BEFORE, ROW, ordered_values
from .sinks.headed import compose, header_for
from .sources.headed import Header

#: Kinds of values from the narrowest to the widest.
LADDER = ("binary", "number", "category", "character")


def standardise(track: DataFrame, order: list[str]) -> DataFrame:
    """Any track as linked valued segments with all seven columns; what is missing is filled."""
    has = track.columns
    adds = {"__n": (ROW, None)} | ({"__e": (LAG, "end")} if "end" in has and "start" not in has else {})
    d = ordered_values(track, ["seqid"], order, adds) if not {"start", "id"} <= set(has) else track
    if "start" not in has:
        d = d.withColumn("start", F.coalesce("__e", F.lit(0)) if "end" in has else (F.col("__n") - 1).cast("int"))
    if "end" not in has:
        d = d.withColumn("end", F.col("start") + 1)
    if "val" not in has:
        d = d.withColumn("val", F.lit(float("nan")))
    if "strand" not in has:
        d = d.withColumn("strand", F.lit(-1).cast("tinyint"))
    if "id" not in has:
        d = d.withColumn("id", F.concat("seqid", F.lit("-"), (F.col("__n") - 1).cast("string")))
    if "edges" not in has:
        d = d.withColumn("edges", F.array().cast("array<string>"))
    extra = [c for c in has if c not in ("genome", "seqid", "start", "end", "val", "strand", "id", "edges", "weights")]
    return d.select("seqid", "start", "end", "val", "strand", "id", "edges", *extra)


def _is_number(x: Column) -> Column:
    return (x == ".") | x.try_cast("double").isNotNull()


def infer_columns(cells: DataFrame, columns: list[str]) -> DataFrame:
    """One row per text column: column, value_type, dimension, all_missing. A column is the first
    of binary, number, category, character that all its cells allow; only missing cells make a
    number; characters are categories of one character each."""
    aggregates = []
    for c in columns:
        x = F.col(f"`{c}`")
        items = F.split(x, ",", -1)
        aggregates += [
            F.bool_and(x.rlike("^[01.]+$")).alias(f"{c}__binary"), F.bool_and(F.forall(items, _is_number)).alias(f"{c}__number"),
            F.bool_and((F.length(x) == 1)).alias(f"{c}__character"), F.bool_and(x == ".").alias(f"{c}__missing"),
            F.min(F.when(x != ".", F.size(items))).alias(f"{c}__least"), F.max(F.when(x != ".", F.size(items))).alias(f"{c}__most"),
            F.min(F.when(x != ".", F.length(x))).alias(f"{c}__short"), F.max(F.when(x != ".", F.length(x))).alias(f"{c}__long"),
        ]
    row = cells.agg(*aggregates)
    rows = []
    for c in columns:
        g = lambda k: F.col(f"{c}__{k}")  # noqa: B023, E731
        kind = F.when(g("missing"), "number").when(g("binary"), "binary").when(g("number"), "number").when(g("character"), "character").otherwise("category")
        tight = g("binary") & ~F.coalesce(g("missing"), F.lit(False))
        least, most = F.when(tight, g("short")).otherwise(g("least")), F.when(tight, g("long")).otherwise(g("most"))
        dimension = F.when(F.coalesce(most, F.lit(1)) == 1, "scalar").when(least != most, "list").when(most == 2, "pair").otherwise("vector")
        rows.append(F.struct(F.lit(c).alias("column"), kind.alias("value_type"), dimension.alias("dimension"), F.coalesce(g("missing"), F.lit(True)).alias("all_missing")))
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def infer_flags(track: DataFrame, entity: list[str], order: list[str]) -> DataFrame:
    """One row: sorted, no_overlaps, circular, undirected, weighted."""
    columns = list(dict.fromkeys([*entity, "start", "end", *order]))
    by_file = ordered_values(track.select(*columns), entity, list(order), {"__bs": (LAG, "start"), "__be": (LAG, "end")})
    by_file = by_file.agg(F.bool_and(F.coalesce(F.struct("__bs", "__be") <= F.struct("start", "end"), F.lit(True)) | F.col("__bs").isNull()).alias("sorted"))
    d = ordered_values(track.select(*entity, "start", "end"), entity, ["start", "end"], {"__e": (MAX_BEFORE, "end")})
    flags = d.agg(
        F.bool_and(F.coalesce(F.col("start") >= F.col("__e"), F.lit(True))).alias("no_overlaps"),
        F.bool_or(F.col("end") <= F.col("start")).alias("circular"))
    # One row on either side.
    return by_file.withColumn("__j", F.lit(1)).join(flags.withColumn("__j", F.lit(1)), "__j").select("sorted", "no_overlaps", "circular")


def expand_header(track: DataFrame, order: list[str]) -> Header:
    """Header with everything that can be found in the data."""
    flags = infer_flags(track, ["seqid"], order).first()
    more = {"sorted_elements": bool(flags["sorted"]), "no_overlapping_elements": bool(flags["no_overlaps"]), "circular_elements": bool(flags["circular"])}
    if "edges" in track.columns:
        from .operators.graph import asymmetric, edge_list

        more["undirected_edges"] = asymmetric(edge_list(track)).limit(1).count() == 0
    return header_for(track, **more)


def sort_track(track: DataFrame) -> DataFrame:
    """By sequence, start and end (nulls first), then by all other columns that can be ordered."""
    rest = [f.name for f in track.schema.fields if f.name not in ("genome", "seqid", "start", "end") and f.dataType.typeName() != "map"]
    keys = [c for c in ("genome", "seqid", "start", "end") if c in track.columns]
    return track.orderBy(*[F.asc_nulls_first(c) for c in [*keys, *rest]])


def complement_track(track: DataFrame, db: DataFrame, by: str, columns: list[str], order: list[str]) -> tuple[Header, DataFrame]:
    """Header and lines of the track with columns from ``db``."""
    joined = complement(track, db, by, columns)
    h = expand_header(joined, order)
    return h, compose(joined, h)
