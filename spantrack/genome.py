"""Genome dimension, region and size specifications, bins."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .errors import ArgumentValueError

#: Default grid of the position index, in positions.
COMP_BIN_SIZE = 100_000
REGION_SCHEMA = "genome string, seqid string, start int, end int"


@dataclass(frozen=True)
class Region:
    genome: str
    seqid: str
    start: int
    end: int


class Genome:
    """Sequences of one genome with their lengths, read from the genome table (a dimension: one
    row per sequence)."""

    def __init__(self, name: str, lengths: dict[str, int]):
        self.name, self.lengths = name, lengths

    @classmethod
    def load(cls, sequences: DataFrame, name: str) -> Genome:
        rows = sequences.where(F.col("genome") == name).orderBy("ord").select("seqid", "length").collect()
        if not rows:
            raise ArgumentValueError(f"unknown genome {name}")
        return cls(name, {r["seqid"]: r["length"] for r in rows})

    def is_valid(self, seqid: str) -> bool:
        return seqid in self.lengths

    def length(self, seqid: str) -> int:
        if seqid not in self.lengths:
            raise ArgumentValueError(f"{seqid} is not in {self.name}")
        return self.lengths[seqid]

    def standard(self) -> list[str]:
        """Names of the sequences without the extra ones, which have a ``_`` in their names."""
        return [s for s in self.lengths if "_" not in s]

    def regions(self, include_extra: bool = True) -> list[Region]:
        names = self.lengths if include_extra else self.standard()
        return [Region(self.name, s, 0, self.lengths[s]) for s in names]


def parse_size(spec: str) -> int:
    """``100k`` -> 100000, ``1m`` -> 1000000."""
    m = re.fullmatch(r"\s*(\d+)\s*([km]?)\s*", spec, re.I)
    if not m:
        raise ArgumentValueError(f"no size: {spec}")
    return int(m[1]) * {"": 1, "k": 1000, "m": 1_000_000}[m[2].lower()]


def _bound(text: str, is_start: bool) -> int:
    """1-based bound; a shortened start means the first position of its unit."""
    m = re.fullmatch(r"(\d+)([km]?)", text.replace(",", ""), re.I)
    if not m:
        raise ArgumentValueError(f"no position: {text}")
    unit = {"": 1, "k": 1000, "m": 1_000_000}[m[2].lower()]
    return int(m[1]) * unit + (1 if is_start and unit > 1 else 0)


def parse_regions(spec: str, genome: Genome, include_extra: bool = True) -> list[Region]:
    """``*``, ``chr1``, ``chr1:10k-2m``, ``genome:chr1:1-100`` and comma lists of them. Positions
    are 1-based and inclusive; the result is 0-based and half-open. ``*`` leaves the extra sequences
    out unless ``include_extra``."""
    if spec.strip() == "*":
        return genome.regions(include_extra)
    out = []
    for part in (p.strip() for p in re.split(r",(?![0-9]{3}\b)", spec)):
        part = part.removeprefix(genome.name + ":")
        seqid, _, span = part.partition(":")
        if seqid == "*" and not span:
            out += genome.regions(include_extra)
            continue
        length = genome.length(seqid)
        if not span or span == "*":
            out.append(Region(genome.name, seqid, 0, length))
            continue
        first, dash, last = span.partition("-")
        start = _bound(first, True) - 1
        end = (_bound(last, False) if last else length) if dash else start + 1
        if not 0 <= start < end <= length:
            raise ArgumentValueError(f"{part} is outside {seqid} of length {length}")
        out.append(Region(genome.name, seqid, start, end))
    return out


def regions_frame(spark: SparkSession, regions: list[Region]) -> DataFrame:
    return spark.createDataFrame([(r.genome, r.seqid, r.start, r.end) for r in regions], REGION_SCHEMA)


def auto_bin(regions: DataFrame, bin_length: int | None) -> DataFrame:
    """Tiles each region in bins of ``bin_length``, the last one cut; None leaves it whole."""
    if bin_length is None:
        return regions.withColumn("bin_no", F.lit(0).cast("int"))
    if bin_length < 1:
        raise ArgumentValueError("the bin length must be positive")
    tiled = regions.where(F.col("end") > F.col("start")).withColumn(
        "__s", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(bin_length))))
    return tiled.withColumns({
        "bin_no": ((F.col("__s") - F.col("start")) / bin_length).cast("int"),
        "end": F.least(F.col("__s") + bin_length, F.col("end")), "start": F.col("__s"),
    }).drop("__s")


def bin_number(position: Column, size: int = COMP_BIN_SIZE) -> Column:
    return F.floor(position / size).cast("int")


def bin_start(number: Column, size: int = COMP_BIN_SIZE) -> Column:
    return number * size


def offset_in_bin(position: Column, size: int = COMP_BIN_SIZE) -> Column:
    return F.pmod(position, F.lit(size))


def is_comp_bin(start: Column, end: Column, size: int = COMP_BIN_SIZE) -> Column:
    return (F.pmod(start, F.lit(size)) == 0) & (end - start == size)


def split_user_bin(regions: DataFrame, size: int = COMP_BIN_SIZE) -> DataFrame:
    """Splits regions at the grid, so that all but the outer pieces are whole grid bins."""
    pieces = regions.where(F.col("end") > F.col("start")).withColumn(
        "__b", F.explode(F.sequence(bin_number(F.col("start"), size), bin_number(F.col("end") - 1, size))))
    return pieces.withColumns({
        "start": F.greatest(F.col("start"), F.col("__b") * size), "end": F.least(F.col("end"), (F.col("__b") + 1) * size),
    }).withColumnRenamed("__b", "bin_no")
