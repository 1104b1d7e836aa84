"""Analysis regions: from specifications, files or tracks; filters of elements; functions of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import InvalidFormatError
from ..genome import Genome, auto_bin, parse_regions, parse_size, regions_frame
from .intervals import covered_and_gaps
from .overlap import contained_in, intersect_regions, overlap_join
from .stats import all_whole


def category_filter(df: DataFrame, wanted: list[str], strict: bool = True) -> DataFrame:
    """Elements whose category is one of ``wanted`` or, if not strict, has one of them inside."""
    if strict:
        return df.where(F.col("val").isin(wanted))
    keep = F.lit(False)
    for w in wanted:
        keep = keep | F.col("val").contains(w)
    return df.where(keep)


def strip_values(df: DataFrame) -> DataFrame:
    """Without values: a valued track as a plain one."""
    return df.drop("val")


def segments_only(df: DataFrame) -> DataFrame:
    if not {"start", "end"} <= set(df.columns):
        raise InvalidFormatError("the filter needs elements with start and end")
    return df


def envelope(track: DataFrame, sequences: DataFrame | None = None, clustered: bool = True, bounded: bool = True) -> DataFrame:
    """Regions of a track: its elements clustered (overlapping ones joined) and kept inside their
    sequences; both steps can be left out. Touching elements stay apart."""
    t = track.select("genome", "seqid", "start", "end")
    if clustered:
        t = covered_and_gaps(t, ["genome", "seqid"], "start", "end", touch=False).where("kind = 'period'").drop("kind")
    if bounded and sequences is not None:
        whole = sequences.select("genome", "seqid", F.lit(0).alias("start"), F.col("length").alias("end"))
        t = contained_in(t, whole, ["genome", "seqid"], 1_000_000)
    return t


def user_bins(spark, region_spec: str, bin_spec: str, sequences: DataFrame, genome: str) -> DataFrame:
    """Bins of regions: ``*`` leaves each region whole, a size (10k) tiles it."""
    g = Genome.load(sequences, genome)
    return auto_bin(regions_frame(spark, parse_regions(region_spec, g)), None if bin_spec == "*" else parse_size(bin_spec))


def bin_source(spark, source: str, bins: str, sequences: DataFrame, genome: str, catalog=None) -> DataFrame:
    """Regions by what ``source`` is: a specification (``chr1:1-10m``, ``*``), a file, whose
    elements become the regions, or ``track:<name>`` of the catalogue; tiled by ``bins``."""
    if source.startswith("track:"):
        if catalog is None:
            raise InvalidFormatError("a stored track needs the catalogue")
        regions = envelope(catalog.track(genome, source.removeprefix("track:")).withColumn("genome", F.lit(genome)), sequences)
    elif "/" in source or source.lower().removesuffix(".gz").rpartition(".")[2] in ("bed", "gff", "gff3", "wig", "bedgraph"):
        from ..sources.formats import parser_for
        from ..sources.lines import keep_valid, read_lines

        parser = parser_for(source)
        if parser is None:
            raise InvalidFormatError(f"no reader for {source}")
        regions = envelope(keep_valid(parser(read_lines(spark, source)), "FAILFAST").withColumn("genome", F.lit(genome)), sequences)
    else:
        return user_bins(spark, source, bins, sequences, genome)
    return auto_bin(regions, None if bins == "*" else parse_size(bins))


def global_bins(sequences: DataFrame, genome: str) -> DataFrame:
    return sequences.where(F.col("genome") == genome).select("genome", "seqid", F.lit(0).alias("start"), F.col("length").alias("end"))


def minimal_bin(sequences: DataFrame, genome: str) -> DataFrame:
    """First position of the first sequence."""
    return sequences.where(F.col("genome") == genome).orderBy("ord").limit(1).select("genome", "seqid", F.lit(0).alias("start"), F.lit(1).alias("end"))


def shared_regions(a: DataFrame, b: DataFrame, sequences: DataFrame) -> DataFrame:
    """Regions in which two tracks are both defined: where the regions of one are whole sequences
    those of the other, where both are the sequences they share, else the intersections."""
    whole_a, whole_b = (bool(all_whole(x, sequences).first()["all_whole"]) for x in (a, b))
    keys = ["genome", "seqid"]
    if whole_a and whole_b:
        return a.join(b.select(*keys).distinct(), keys, "left_semi").select(*keys, "start", "end")
    if whole_a or whole_b:
        inner, outer = (b, a) if whole_a else (a, b)
        return inner.join(outer.select(*keys).distinct(), keys, "left_semi").select(*keys, "start", "end")
    return intersect_regions(a, b, keys, 1_000_000)


def window_function(track: DataFrame, windows: DataFrame, keys: list[str], function, result: str = "double", size: int = 10_000) -> DataFrame:
    """``function`` (a pandas data frame of the elements of one window -> a number) for every window
    that holds an element: keys, start, end, val. One window is one call, so it should be small."""
    met = overlap_join(track, windows.select(*keys, "start", "end"), keys, size, suffix="_w")
    kinds = {f.name: f.dataType.simpleString() for f in windows.schema.fields}

    def one(key, frame):
        import pandas as pd

        return pd.DataFrame([[*key, function(frame)]], columns=[*keys, "start", "end", "val"])

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"start {kinds['start']}", f"end {kinds['end']}", f"val {result}"])
    return met.groupBy(*keys, "start_w", "end_w").applyInPandas(one, schema)
