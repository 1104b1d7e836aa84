"""Streams of elements: windowed counts with watermarks, and incremental coverage (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.windows import LEAD, SUM, ordered_values


def windowed_counts(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum per key and (sliding) window; rows later than the watermark are left out. Works
    on streams and, without effect of the watermark, on tables."""
    d = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return d.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    d = events.withWatermark(time, late) if events.isStreaming else events
    return d.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def coverage_events(elements: DataFrame, entity: list[str]) -> DataFrame:
    """Depth changes per position: associative, so the sums of micro-batches can be added up and
    read as coverage by a running sum over positions."""
    at = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d"))))
    return elements.where(F.col("end") > F.col("start")).select(*entity, at.alias("e")).groupBy(*entity, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))


def append_coverage(elements: DataFrame, entity: list[str], path: str):
    """Writer of a stream that adds the depth changes of each micro-batch to ``path``, one folder
    per batch, so a batch that runs again replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        coverage_events(batch, entity).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return elements.writeStream.foreachBatch(one)


def read_coverage(spark, entity: list[str], path: str) -> DataFrame:
    """Runs of constant depth from all micro-batches written so far."""
    events = spark.read.parquet(path).groupBy(*entity, "pos").agg(F.sum("d").alias("d"))
    runs = ordered_values(events, entity, ["pos"], {"end": (LEAD, "pos"), "depth": (SUM, "d")})
    return runs.where(F.col("end").isNotNull()).select(*entity, F.col("pos").alias("start"), "end", "depth")
