"""Coverage and value profiles as runs of equal depth, without a row per position."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .windows import LEAD, SUM, ordered_values


def coverage_runs(df: DataFrame, entity: list[str], value: str | None = None, void: float | None = 0.0) -> DataFrame:
    """Runs [start, end) of constant depth between the first and last event of each entity.

    Events are summed per position first (with map-side combining), so the ordered pass sees each
    distinct position once. With ``value`` the sum of the values is given too, ``void`` where the
    depth is 0. Null and NaN values count as depth but not as value. Rows with a null or inverted
    position take no part.
    """
    good = df.where(F.col("end") > F.col("start"))
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")) if value else F.lit(None).cast("double")
    v = F.coalesce(v, F.lit(0.0))
    at = F.explode(F.array(
        F.struct(F.col("start").alias("pos"), F.lit(1).alias("d"), v.alias("v")),
        F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d"), (-v).alias("v"))))
    events = good.select(*entity, at.alias("e")).groupBy(*entity, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"), F.sum("e.v").alias("v"))
    runs = ordered_values(events, entity, ["pos"], {"end": (LEAD, "pos"), "depth": (SUM, "d"), "value": (SUM, "v")})
    runs = runs.where(F.col("end").isNotNull()).select(*entity, F.col("pos").alias("start"), "end", "depth", "value")
    if value is None:
        return runs.drop("value")
    return runs.withColumn("value", F.when(F.col("depth") > 0, F.col("value")).otherwise(F.lit(void)))


def binary_span(runs: DataFrame, entity: list[str]) -> DataFrame:
    """Covered positions per entity."""
    return runs.where("depth > 0").groupBy(*entity).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def per_position(runs: DataFrame, start: int, end: int) -> DataFrame:
    """A row per position of [start, end): only for regions whose length is known to be small."""
    inside = runs.where((F.col("end") > start) & (F.col("start") < end))
    return inside.withColumn("pos", F.explode(F.sequence(F.greatest("start", F.lit(start)), F.least("end", F.lit(end)) - 1))).drop("start", "end")
