"""Statistics of tracks and of the track catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def track_stats(df: DataFrame, entity: list[str] = ("seqid",)) -> DataFrame:
    """Per sequence: elements, longest texts, most edges, longest element."""
    out = [F.count("*").alias("n_elements")]
    if "end" in df.columns and "start" in df.columns:
        out.append(F.max(F.col("end") - F.col("start")).alias("max_length"))
    for f in df.schema.fields:
        if f.name in entity:
            continue
        if isinstance(f.dataType, T.StringType):
            out.append(F.max(F.length(f.name)).alias(f"max_len_{f.name}"))
        elif isinstance(f.dataType, T.ArrayType) and f.name == "edges":
            out.append(F.max(F.size(f.name)).alias("max_edges"))
    return df.groupBy(*entity).agg(*out)


def categories(df: DataFrame, column: str, entity: list[str] = ()) -> DataFrame:
    """Distinct categories, one per row."""
    return df.where(F.col(column).isNotNull()).select(*entity, F.col(column).alias("category")).distinct()


def n_categories(df: DataFrame, column: str, entity: list[str]) -> DataFrame:
    return categories(df, column, entity).groupBy(*entity).agg(F.count("*").alias("n_categories"))


def weight_categories(df: DataFrame) -> DataFrame:
    return categories(df.select(F.explode("weights").alias("w")), "w")


def roll_up_names(tracks: DataFrame, name: str, count: str, separator: str = ":") -> DataFrame:
    """Counts of each name and of all names below it in the hierarchy."""
    parts = F.split(name, separator)
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator)))
    return tracks.select(prefix.alias("name"), F.col(count).alias("n")).groupBy("name").agg(F.sum("n").alias("n"))


def bottom_up(tracks: DataFrame, name: str, separator: str = ":") -> DataFrame:
    """Children before their parents."""
    return tracks.orderBy(F.size(F.split(name, separator)).desc(), name)


def all_whole(regions: DataFrame, sequences: DataFrame) -> DataFrame:
    """One row: whether every region spans its whole sequence."""
    s = sequences.select(F.col("genome").alias("__g"), F.col("seqid").alias("__s"), F.col("length").alias("__l"))
    met = regions.join(s, (F.col("genome") == F.col("__g")) & (F.col("seqid") == F.col("__s")), "left")
    return met.agg(F.bool_and(F.coalesce((F.col("start") == 0) & (F.col("end") == F.col("__l")), F.lit(False))).alias("all_whole"))


def multi_file(*tracks: DataFrame) -> DataFrame:
    """Union of the files of one track; their columns must agree."""
    from ..errors import InvalidFormatError

    first = tracks[0]
    for t in tracks[1:]:
        if {f.name: f.dataType for f in t.schema} != {f.name: f.dataType for f in first.schema}:
            raise InvalidFormatError("the files of a track must have the same columns")
        first = first.unionByName(t)
    return first


def cumulative_offsets(regions: DataFrame) -> DataFrame:
    """Bounding regions with the element range [start_idx, end_idx) of each, per sequence order."""
    from .windows import SUM, ordered_values

    out = ordered_values(regions, ["genome"], ["seqid", "start"], {"end_idx": (SUM, "el_count")})
    return out.withColumn("start_idx", F.col("end_idx") - F.col("el_count")).select(*regions.columns, "start_idx", "end_idx")
