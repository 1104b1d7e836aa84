"""Track views: a region of a track in the format that is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..errors import IncompatibleTracksError
from ..operators.slicing import crop, slice_region, to_points
from ..types import TrackFormat, TrackFormatReq

#: Conversions in the order in which they are tried.
CONVERTERS = ("trivial", "start", "mid", "end")


def converters(fmt: TrackFormat, req: TrackFormatReq) -> list[str]:
    """Conversions that bring a track of ``fmt`` to meet ``req``."""
    found = ["trivial"] if req.is_met_by(fmt) and req.converter in (None, "trivial") else []
    if fmt.interval and not fmt.dense:
        points = TrackFormat(**{**fmt.__dict__, "interval": False})
        if req.interval is False and req.is_met_by(points):
            found += [c for c in CONVERTERS[1:] if req.converter in (None, c)]
    return found


def track_view(track: DataFrame, seqid: str, start: int, end: int, req: TrackFormatReq | None = None, max_length: int | None = None) -> DataFrame:
    """Elements of [start, end) with rel_start and rel_end, converted by the first way that meets
    the requirement."""
    req = req or TrackFormatReq()
    if req.borders not in (None, "crop"):
        raise IncompatibleTracksError(f"borders can't be {req.borders}")
    fmt = TrackFormat.of_schema(track.schema)
    ways = converters(fmt, req)
    if not ways:
        raise IncompatibleTracksError(f"{fmt.name} can't meet {req}")
    if "end" not in track.columns:
        track = track.withColumn("end", F.col("start") + 1)
    inside = slice_region(track, seqid, start, end, max_length)
    if ways[0] != "trivial":
        inside = to_points(inside, ways[0], (start, end))
    return crop(inside, start, end)


def scan_views(views: list[DataFrame]) -> DataFrame:
    """Several views as one relation; columns that a view lacks are null."""
    out = views[0]
    for v in views[1:]:
        out = out.unionByName(v, allowMissingColumns=True)
    return out


def empty_view(spark, fmt: TrackFormat, value: T.DataType | None = None) -> DataFrame:
    """A view without rows with the columns of a format, to plan with."""
    kinds = [("seqid", T.StringType())]
    kinds += [("start", T.IntegerType())] if not fmt.dense else []
    kinds += [("end", T.IntegerType())] if fmt.interval else []
    kinds += [("val", value or T.DoubleType())] if fmt.valued else []
    kinds += [("strand", T.ByteType())] if fmt.has_strand else []
    kinds += [("id", T.StringType())] if fmt.has_id or fmt.linked else []
    kinds += [("edges", T.ArrayType(T.StringType()))] if fmt.linked else []
    kinds += [("weights", T.ArrayType(T.DoubleType()))] if fmt.weighted else []
    kinds += [(c, T.StringType()) for c in fmt.extra]
    return spark.createDataFrame([], T.StructType([T.StructField(c, k) for c, k in kinds]))


def by_sequence(df: DataFrame):
    """(seqid, elements) one sequence after the other; the names, a dimension, are read first and
    each part is a plan of its own."""
    for r in df.select("seqid").distinct().orderBy("seqid").toLocalIterator():
        yield r["seqid"], df.where(F.col("seqid").eqNullSafe(F.lit(r["seqid"])))


def then(*steps):
    """Composition of conversions."""
    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run
