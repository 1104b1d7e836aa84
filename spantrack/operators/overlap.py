"""Overlap joins by bins, region algebra and per-region counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Clamp of the join bin, in positions.
LEAST_BIN, MOST_BIN = 1_000, 1_000_000


def join_bin(df: DataFrame, start: str, end: str) -> int:
    """Bin near the typical length of the intervals (from one aggregate), within the clamp."""
    row = df.select((F.col(end) - F.col(start)).alias("n")).where("n > 0").agg(F.percentile_approx("n", 0.9, 1000)).first()
    return int(min(max(row[0] or LEAST_BIN, LEAST_BIN), MOST_BIN))


def _bins(start: Column, end: Column, size: int) -> Column:
    return F.sequence(F.floor(start / size), F.floor(F.greatest(end - 1, start) / size))


#: Each level has bins so many times as wide as the one below.
LEVEL_FACTOR = 16


def _level(start: Column, end: Column, size: int) -> Column:
    """The least level whose bins are at least as wide as the interval."""
    ratio = F.greatest((end - start).cast("double") / size, F.lit(1.0))
    # A power that is met exactly needs no wider level; rounding may only give one too wide.
    return F.ceil(F.log2(ratio) / math.log2(LEVEL_FACTOR) - 1e-12).cast("int")


def overlap_join(
    left: DataFrame, right: DataFrame, keys: list[str], size: int = 10_000, l: tuple[str, str] = ("start", "end"),
    r: tuple[str, str] = ("start", "end"), suffix: str = "_r", how: str = "inner", how_contained: bool = False,
) -> DataFrame:
    """Pairs of intervals that overlap (or, with ``how_contained``, where right contains left).

    Intervals are put on levels of bins by their length, so that each covers at most two bins of
    its own level or of any above. Both sides stand in the bins of their own level and of those
    levels above that the other side uses, and meet on the level of the longer one: an interval of
    any length is copied at most twice a level, and the number of levels grows with the logarithm
    of the longest. A pair is kept only in the bin where its overlap begins. No nested loop and no
    broadcast is forced; AQE splits skewed (key, level, bin) groups.

    Empty intervals count as one position wide for the bins and never overlap. Columns of ``right``
    (but the keys) get ``suffix``. ``how`` is inner or left_semi.
    """
    if how == "left_semi":
        # A row may meet others on several levels: its interval is looked up and each row kept once.
        own = [*keys, *l]
        met = overlap_join(left.select(*own).distinct(), right.select(*keys, *r), keys, size, l, r, "__r", "inner", how_contained)
        return left.join(met.select(*own).distinct(), own, "left_semi").select(*left.columns)
    b = right.select(*[F.col(c).alias(c + suffix) for c in right.columns])
    ls, le, rs, re = F.col(l[0]), F.col(l[1]), F.col(r[0] + suffix), F.col(r[1] + suffix)
    # A few levels on either side.
    used = [[x[0] for x in side.select(_level(start, end, size).alias("v")).where("v is not null").distinct().collect()] for side, start, end in ((left, ls, le), (b, rs, re))]

    def spread(df: DataFrame, start: Column, end: Column, others: list[int], mark: str) -> DataFrame:
        own = _level(start, end, size)

        def on_level(level: int) -> Column:
            bins = F.transform(_bins(start, end, size * LEVEL_FACTOR**level), lambda x: F.struct(F.lit(level).alias("level"), x.alias("bin")))
            return F.when((own == level) | ((own < level) & F.lit(level in others)), bins).otherwise(F.array().cast("array<struct<level:int,bin:bigint>>"))

        every = F.flatten(F.array(*map(on_level, sorted({*used[0], *used[1]} or {0}))))
        return df.withColumns({f"__own{mark}": own, f"__at{mark}": F.explode(F.when(start.isNotNull() & end.isNotNull(), every))}).withColumns(
            {f"__level{mark}": F.col(f"__at{mark}.level"), f"__bin{mark}": F.col(f"__at{mark}.bin")}).drop(f"__at{mark}")

    a, b = spread(left, ls, le, used[1], ""), spread(b, rs, re, used[0], "_r")
    on = (F.col("__level") == F.col("__level_r")) & (F.col("__bin") == F.col("__bin_r")) & (F.col("__level") == F.greatest("__own", "__own_r"))
    for k in keys:
        on = on & (F.col(k) == F.col(k + suffix))
    if how_contained:
        on = on & (rs <= ls) & (re >= le)
    else:
        on = on & (ls < re) & (le > rs)
    wide = F.pow(F.lit(float(LEVEL_FACTOR)), F.col("__level")).cast("long") * size
    on = on & (F.col("__bin") == F.floor(F.greatest(ls, rs) / wide))
    return a.join(b, on).drop("__own", "__level", "__bin", "__own_r", "__level_r", "__bin_r", *[k + suffix for k in keys])


def contained_in(df: DataFrame, regions: DataFrame, keys: list[str], size: int = 10_000) -> DataFrame:
    """Elements wholly inside a region; each stored row once."""
    return overlap_join(df, regions, keys, size, how="left_semi", how_contained=True)


def intersect_regions(a: DataFrame, b: DataFrame, keys: list[str], size: int = 10_000) -> DataFrame:
    """Pairwise intersections of two region lists."""
    met = overlap_join(a.select(*keys, "start", "end"), b.select(*keys, "start", "end"), keys, size)
    return met.select(*keys, F.greatest("start", "start_r").alias("start"), F.least("end", "end_r").alias("end"))


def count_per_region(df: DataFrame, regions: DataFrame, keys: list[str], size: int = 10_000) -> DataFrame:
    """Regions with the number of elements that overlap them, also where there is none.

    The elements are counted per region before the regions come back in, so the last join moves
    one row per region."""
    elements = df.select(*keys, "start", "end")
    hit = overlap_join(elements, regions.select(*keys, "start", "end"), keys, size).groupBy(
        *keys, F.col("start_r").alias("start"), F.col("end_r").alias("end")).agg(F.count("*").alias("n"))
    return regions.join(hit, [*keys, "start", "end"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def region_of_position(df: DataFrame, regions: DataFrame, keys: list[str], position: str = "start", size: int = 100_000) -> DataFrame:
    """Left join to the region (of disjoint ones) that holds the position: region_start,
    region_end are null outside all of them."""
    spread = regions.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("start").alias("region_start"), F.col("end").alias("region_end"))
    spread = spread.withColumn("__b", F.explode(_bins(F.col("region_start"), F.col("region_end"), size)))
    on = (F.floor(F.col(position) / size) == F.col("__b")) & (F.col(position) >= F.col("region_start")) & (F.col(position) < F.col("region_end"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return df.join(spread, on, "left").drop("__b", *[f"__{k}" for k in keys])


def with_region(df: DataFrame, regions: DataFrame, keys: list[str], size: int = 100_000) -> DataFrame:
    """The elements with region_start, region_end and ``inside``: whether the (disjoint) region that
    holds their start holds their end too. A grouping key for work region by region."""
    placed = region_of_position(df, regions, keys, "start", size)
    end = F.col("end") if "end" in df.columns else F.col("start") + 1
    return placed.withColumn("inside", F.coalesce(end <= F.col("region_end"), F.lit(False)))


def count_contained(df: DataFrame, regions: DataFrame, keys: list[str], size: int = 100_000) -> DataFrame:
    """Regions with the number of elements in them, also where there is none. An element that isn't
    inside one region makes the read fail."""
    placed = with_region(df, regions, keys, size)
    message = F.concat_ws(" ", F.lit("outside of all regions:"), *keys, "start")
    placed = placed.withColumn("region_start", F.when(F.col("inside"), F.col("region_start")).otherwise(F.raise_error(message).cast("int")))
    hit = placed.groupBy(*keys, F.col("region_start").alias("start")).agg(F.count("*").alias("n"))
    return regions.join(hit, [*keys, "start"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
