"""Seeded null models of tracks. The same seed gives the same result on any cluster: all random
numbers are hashes of the seed and the element.

All places and running sums come from range-sorted passes (``windows.ordered_values``), so a bin
that holds most elements is spread over as many tasks as its share. A null bin is a bin of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .windows import LAG, ROW, SUM, ordered_values


def _random(seed: int, *columns: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _uniform(seed: int, *columns: str | Column) -> Column:
    """Uniform in [0, 1)."""
    return F.shiftrightunsigned(_random(seed, *columns), 11).cast("double") / float(1 << 53)


def _beside(df: DataFrame, other: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Inner join on the keys, where null equals null, and the place."""
    renamed = other.select(*[F.col(f"`{c}`").alias(f"__b_{c}") if c in [*keys, place] else F.col(f"`{c}`") for c in other.columns])
    on = F.col(place) == F.col(f"__b_{place}")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__b_{k}"))
    return df.join(renamed, on).drop(*[f"__b_{c}" for c in [*keys, place]])


def shuffle_marks(df: DataFrame, entity: list[str], value: str, seed: int, order: list[str]) -> DataFrame:
    """Permutes the values among the elements of each entity; all else stays. ``order`` should tell
    the elements of an entity apart; ties come in any order."""
    placed = ordered_values(df, entity, order, {"__p": (ROW, None)})
    drawn = df.select(*entity, F.col(value).alias("__v"), _random(seed, *order).alias("__r"), F.struct(*order).alias("__o"))
    drawn = ordered_values(drawn, entity, ["__r", "__o"], {"__p": (ROW, None)}).select(*entity, "__p", "__v")
    return _beside(placed, drawn, entity, "__p").withColumn(value, F.col("__v")).drop("__p", "__v")


def permute_segments(df: DataFrame, bins: list[str], bin_start: str, bin_end: str, seed: int, order: list[str], sampled_gaps: bool = False) -> DataFrame:
    """Permutes the (non-overlapping) segments of each bin, with all their columns, and the gaps
    between them; with ``sampled_gaps`` the gaps are the distances of sorted uniform points
    instead. Lengths, attributes and the total gap stay the same."""
    d = df.withColumn("__len", (F.col("end") - F.col("start")).cast("long"))
    d = ordered_values(d, bins, list(dict.fromkeys(["start", "end", *order])), {"__n": (ROW, None), "__e": (LAG, "end")})
    if sampled_gaps:
        totals = d.groupBy(*bins).agg((F.max(bin_end) - F.min(bin_start) - F.sum("__len")).alias("__free")).withColumn("__j", F.lit(0))
        cut = F.floor(_uniform(seed + 1, *bins, "__n", *order) * (F.col("__free") + 1))
        cuts = _beside(d.select(*bins, "__n", *[c for c in order if c not in bins]).withColumn("__j", F.lit(0)), totals, bins, "__j").select(*bins, "__n", cut.cast("long").alias("__cut"))
        gaps = ordered_values(cuts, bins, ["__cut", "__n"], {"__rank": (ROW, None), "__before": (LAG, "__cut")})
        gaps = gaps.select(*bins, "__rank", (F.col("__cut") - F.coalesce("__before", F.lit(0))).alias("__gap"))
    else:
        last = d.groupBy(*bins).agg((F.max(bin_end) - F.max("end")).cast("long").alias("__gap"), (F.max("__n") + 1).alias("__n"))
        every = d.select(*bins, (F.col("start") - F.coalesce("__e", bin_start)).cast("long").alias("__gap"), "__n").unionByName(last)
        every = every.withColumn("__r", _random(seed + 1, *bins, "__n"))
        gaps = ordered_values(every, bins, ["__r", "__n"], {"__rank": (ROW, None)}).select(*bins, "__rank", "__gap")
    d = ordered_values(d.withColumn("__r", _random(seed, *bins, "__n")), bins, ["__r", "__n"], {"__rank": (ROW, None)})
    d = ordered_values(_beside(d, gaps, bins, "__rank"), bins, ["__rank"], {"__gaps": (SUM, "__gap"), "__lens": (SUM, "__len")})
    d = d.withColumn("__s", F.col(bin_start) + F.col("__gaps") + F.col("__lens") - F.col("__len"))
    return d.withColumns({"start": F.col("__s").cast("int"), "end": (F.col("__s") + F.col("__len")).cast("int")}).select(*df.columns)


def sample_by_intensity(intensity: DataFrame, bins: list[str], wanted: DataFrame, seed: int) -> DataFrame:
    """Points drawn by intensity, each position at most once: per bin the ``n`` positions (from
    ``wanted``: bins, n) with the least exponential waiting time -ln(u) / intensity, which is
    sampling without replacement in one pass. Positions of no intensity are never drawn."""
    return _drawn(intensity, bins, seed).join(wanted, bins).where(F.col("__rank") <= F.col("n")).drop("__rank", "n", "val")


def _drawn(intensity: DataFrame, bins: list[str], seed: int) -> DataFrame:
    wait = -F.log(F.greatest(_uniform(seed, *bins, "start"), F.lit(1e-300))) / F.col("val")
    ranked = ordered_values(intensity.where(F.col("val") > 0).withColumn("__w", wait), bins, ["__w", "start"], {"__rank": (ROW, None)})
    return ranked.drop("__w")


def place_by_intensity(df: DataFrame, intensity: DataFrame, bins: list[str], seed: int, order: list[str]) -> DataFrame:
    """The elements of ``df`` at positions drawn by intensity: each keeps its columns and (with an
    ``end``) its length, and gets another start; which element gets which position is random. Where
    a bin has fewer positions of any intensity than elements, the rest of them has no place and is
    left out."""
    own = df.withColumn("__r", _random(seed + 1, *bins, *order))
    own = ordered_values(own, bins, list(dict.fromkeys(["__r", *order])), {"__rank": (ROW, None)}).drop("__r")
    found = _beside(own, _drawn(intensity, bins, seed).select(*bins, F.col("start").alias("__s"), "__rank"), bins, "__rank")
    moved = {"start": F.col("__s").cast("int")} | ({"end": (F.col("__s") + F.col("end") - F.col("start")).cast("int")} if "end" in df.columns else {})
    return found.withColumns(moved).select(*df.columns)
