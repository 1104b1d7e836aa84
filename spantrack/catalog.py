"""Catalogue of stored tracks: ingest, list, rename, info, export.

A track is stored below ``root/genome=<g>/track=<name>/v=<n>/``: ``variant=raw`` as it came and
``variant=clustered`` with overlaps merged, as Parquet partitioned by seqid and sorted by position,
and ``regions``, its bounding regions with the range of elements of each. Its record is one small
JSON file beside the versions, which is switched last: readers see the old track or the new one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import Config
from .errors import (
    BoundingRegionsNotAvailableError, EmptySourceError, IncompatibleTracksError, InvalidFormatError, OutsideBoundingRegionError)
from .genome import Genome, Region, parse_regions
from .operators import validate
from .operators.cluster import cluster
from .operators.overlap import overlap_join
from .operators.slicing import slice_region, with_bin
from .operators.stats import cumulative_offsets, n_categories, roll_up_names, track_stats
from .sinks import formats as sinks
from .sinks import headed as headed_sink
from .sinks.lines import archive, save
from .sources import formats, headed
from .sources.lines import keep_valid, read_lines
from .types import TrackFormat, TrackFormatReq

RAW, CLUSTERED = "raw", "clustered"
#: Names that begin so are no tracks.
HIDDEN = (".", "_", "#")


@dataclass
class TrackInfo:
    genome: str
    name: str
    track_type: str
    value_type: str
    counts: dict[str, int] = field(default_factory=dict)
    max_length: int = 0
    fingerprint: str = ""
    source: str = ""
    version: int = 0
    n_regions: int = 0
    n_categories: int = 0

    def shown(self, keys: list[str] | None = None) -> str:
        """The record as lines of text; ``keys`` picks some, and what is empty is left out."""
        return "\n".join(f"{k}: {v}" for k, v in asdict(self).items() if (keys is None or k in keys) and v not in ("", 0, {}))


class Catalog:
    def __init__(self, spark: SparkSession, root: str, sequences: DataFrame | None = None, config: Config | None = None):
        self.spark, self.root, self.sequences, self.config = spark, root.rstrip("/"), sequences, config or Config.of(spark)
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Storage
    def _dir(self, genome: str, name: str) -> str:
        return f"{self.root}/genome={genome}/track={name.replace(':', '__').replace('/', '_')}"

    def _data(self, genome: str, name: str) -> str:
        return f"{self._dir(genome, name)}/v={self.info(genome, name).version}"

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._fs_path(path))

    def _write_info(self, info: TrackInfo) -> None:
        """Written beside and renamed, so that the record is never half there."""
        base = self._dir(info.genome, info.name)
        new, path = self._fs_path(base + "/_info.json.new"), self._fs_path(base + "/info.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(asdict(info)).encode()))
        out.close()
        self._fs.delete(path, False)
        self._fs.rename(new, path)

    def info(self, genome: str, name: str) -> TrackInfo:
        path = self._dir(genome, name) + "/info.json"
        if not self._exists(path):
            raise InvalidFormatError(f"no track {name} in {genome}")
        stream = self._fs.open(self._fs_path(path))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return TrackInfo(**json.loads(text))

    def genomes(self) -> list[str]:
        if not self._exists(self.root):
            return []
        return sorted(s.getPath().getName().removeprefix("genome=") for s in self._fs.listStatus(self._fs_path(self.root))
                      if s.isDirectory() and s.getPath().getName().startswith("genome="))

    def tracks(self, genome: str) -> list[str]:
        base = f"{self.root}/genome={genome}"
        if not self._exists(base):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._fs_path(base)) if s.isDirectory()]
        tracks = (n.removeprefix("track=").replace("__", ":") for n in names if n.startswith("track="))
        return sorted(n for n in tracks if not any(part.startswith(HIDDEN) for part in n.split(":")) and self._exists(self._dir(genome, n) + "/info.json"))

    def counts_by_name(self, genome: str) -> DataFrame:
        rows = [(n, self.info(genome, n).counts.get(RAW, 0)) for n in self.tracks(genome)]
        return roll_up_names(self.spark.createDataFrame(rows, "name string, n long"), "name", "n")

    # Ingest
    def fingerprint(self, path: str) -> str:
        files = self.spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
        return str(files.agg(F.bit_xor(F.xxhash64("path", "modificationTime", "length")).alias("x")).first()["x"])

    def is_stale(self, genome: str, name: str, path: str) -> bool:
        if not self._exists(self._dir(genome, name) + "/info.json"):
            return True
        return self.info(genome, name).fingerprint != self.fingerprint(path)

    def ingest(self, path: str, genome: str, name: str, suffix: str | None = None, mode: str = "FAILFAST", force: bool = False) -> TrackInfo:
        """Parses, checks, stores raw and clustered, and records a file (or folder of files)."""
        mark = self.fingerprint(path)
        if not force and self._exists(self._dir(genome, name) + "/info.json") and self.info(genome, name).fingerprint == mark:
            return self.info(genome, name)
        track, regions, rules = self.read_with_regions(path, genome, suffix, mode)
        return self.store(track, genome, name, mark, path, regions, **rules)

    def ingest_frame(self, track: DataFrame, genome: str, name: str, transform: Callable[[DataFrame], DataFrame] | None = None,
                     regions: DataFrame | None = None, **rules) -> TrackInfo:
        """Stores any frame of elements, changed by ``transform`` before."""
        return self.store(transform(track) if transform else track, genome, name, regions=regions, **rules)

    def ingest_track(self, genome: str, name: str, target: str, transform: Callable[[DataFrame], DataFrame] | None = None, allow_overlaps: bool = True) -> TrackInfo:
        """Stores a stored track, changed by ``transform``, under another name."""
        df = self.track(genome, name, allow_overlaps).drop("bin")
        return self.ingest_frame(df, genome, target, transform, self.regions(genome, name) if self.info(genome, name).n_regions else None)

    def read(self, path: str, genome: str, suffix: str | None = None, mode: str = "FAILFAST") -> DataFrame:
        return self.read_with_regions(path, genome, suffix, mode)[0]

    def read_with_regions(self, path: str, genome: str, suffix: str | None = None, mode: str = "FAILFAST") -> tuple[DataFrame, DataFrame | None, dict[str, bool]]:
        """Elements, bounding regions (None without any) and the rules that a header declares."""
        lines = read_lines(self.spark, path)
        kind = (suffix or path).lower().removesuffix(".gz")
        regions, rules = None, {}
        if kind.endswith(self.config.header_suffix):
            h = headed.load_header(lines, self.config.header_keyword)
            if h["circular elements"] or "list" in (h["value dimension"], h["edge weight dimension"]):
                raise InvalidFormatError("circular elements and lists of varying length can't be stored")
            parsed = headed.parse(lines, h, self.sequences)
            regions = headed.bounding_regions(lines, h, self.sequences)
            headed.check_regions(regions)
            regions = regions.where(F.col("seqid").isNotNull()).select("seqid", "start", "end")
            regions = None if regions.isEmpty() else regions
            rules = {"undirected": bool(h["undirected edges"]), "sorted_elements": bool(h["sorted elements"]), "no_overlaps": bool(h["no overlapping elements"])}
        else:
            parser = formats.parser_for(kind)
            if parser is None:
                raise InvalidFormatError(f"no reader for {path}")
            parsed = parser(lines)
            if parser is formats.wig:
                # A break between blocks is a border of a region; abutting blocks should be one.
                kinds = {r["kind"] for r in formats.wig_kind(parsed).collect()}
                if kinds <= {"function", "step function"}:
                    found = formats.wig_regions(parsed, adjacent=False)
                    bad = found.where(F.col("error").isNotNull()).limit(1).collect()
                    if bad:
                        raise InvalidFormatError(f"adjacent blocks of {bad[0]['seqid']} at {bad[0]['start']}")
                    regions = found.select("seqid", "start", "end")
        if self.sequences is not None:
            parsed = formats.unknown_sequences(parsed, self.sequences, genome)
            # Rows of unknown sequences are skipped, as a warning.
            parsed = parsed.where(~F.coalesce(F.col("error") == "seqid", F.lit(False)))
        track = keep_valid(parsed, mode)
        own = ("ord", "n_columns", "part", "br_ord", "decl", "fixed", "step", "span")
        track = track.withColumn("row_ord", F.col("ord.block") * F.lit(1 << 33) + F.col("ord.nth")).drop(*own, "file")
        return track.drop("genome"), regions, rules

    def check(self, track: DataFrame, genome: str, regions: DataFrame | None = None, undirected: bool = False, sorted_elements: bool = False,
              no_overlaps: bool = False) -> None:
        """Raises with the first few elements that break a rule: positions outside of their
        sequence or of all bounding regions, repeated ids and edges, edges to unknown ids or
        without their counterpart, vectors of different length, and what the header declares."""
        found = []
        if self.sequences is not None and "start" in track.columns:
            ended = track if "end" in track.columns else track.withColumn("end", F.col("start") + 1)
            found.append(validate.positions(ended, self.sequences, genome))
        if "edges" in track.columns and "id" in track.columns:
            found += [validate.repeated_ids(track), validate.repeated_edges(track), validate.broken_edges(track, undirected)]
        if "val" in track.columns and track.schema["val"].dataType.typeName() == "array":
            found.append(validate.uneven_vectors(track))
        if {"start", "end"} <= set(track.columns):
            if sorted_elements and "row_ord" in track.columns:
                found.append(validate.unsorted(track, ["seqid"]))
            if no_overlaps:
                found.append(validate.overlapping(track, ["seqid"]))
            if regions is not None:
                found.append(validate.outside_regions(track, regions))
        for violations in found:
            validate.require_none(violations)

    def store(self, track: DataFrame, genome: str, name: str, mark: str = "", source: str = "", regions: DataFrame | None = None, **rules) -> TrackInfo:
        fmt = TrackFormat.of_schema(track.schema)
        dense = fmt.dense or fmt.represented_dense
        if track.isEmpty():
            raise EmptySourceError(f"{source or name} has no valid row")
        self.check(track, genome, regions, **rules)
        known = self._exists(self._dir(genome, name) + "/info.json")
        info = TrackInfo(genome, name, fmt.name, fmt.value_type, fingerprint=mark, source=source, version=self.info(genome, name).version + 1 if known else 1)
        base = f"{self._dir(genome, name)}/v={info.version}"
        variants = {RAW: track} if dense else {RAW: track, CLUSTERED: None}
        for variant in variants:
            if variant == CLUSTERED:
                kept = self.spark.read.parquet(f"{base}/variant={RAW}").drop("bin")
                df = cluster(kept.withColumn("end", F.col("end") if "end" in kept.columns else F.col("start") + 1), ["seqid"],
                             "segments" if fmt.interval else "points", "row_ord" if "row_ord" in kept.columns else None).drop("n_elements")
                df = df if fmt.interval else df.drop("end")
            else:
                df = track
            keys = [c for c in ("seqid", "start", "end") if c in df.columns]
            with_bin(df).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("seqid").parquet(f"{base}/variant={variant}")
        raw = self.spark.read.parquet(f"{base}/variant={RAW}")
        stats = track_stats(raw, ["seqid"])
        row = stats.agg(F.sum("n_elements").alias("n"), *([F.max("max_length").alias("longest")] if fmt.interval else [])).first()
        info.counts[RAW] = row["n"]
        info.max_length = (row["longest"] if fmt.interval else 1) or 1
        if fmt.value_type == "category":
            info.n_categories = n_categories(raw.withColumn("__a", F.lit(0)), "val", ["__a"]).agg(F.sum("n_categories")).first()[0] or 0
        if not dense:
            clustered = self.spark.read.parquet(f"{base}/variant={CLUSTERED}")
            info.counts[CLUSTERED] = clustered.count()
            if fmt.interval:
                info.max_length = max(info.max_length, clustered.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 1)
        if regions is not None:
            counted = overlap_join(raw if "end" in raw.columns else raw.withColumn("end", F.col("start") + 1), regions.select("seqid", "start", "end"), ["seqid"], 1_000_000)
            counted = counted.groupBy("seqid", F.col("start_r").alias("start"), F.col("end_r").alias("end")).agg(F.count("*").alias("el_count"))
            whole = regions.select("seqid", "start", "end").join(counted, ["seqid", "start", "end"], "left").withColumn("el_count", F.coalesce("el_count", F.lit(0)))
            cumulative_offsets(whole.withColumn("genome", F.lit(genome))).drop("genome").write.mode("overwrite").parquet(f"{base}/regions")
            info.n_regions = self.spark.read.parquet(f"{base}/regions").count()
            if dense and fmt.interval:
                # The opening row of each region of a partition is no element.
                info.counts[RAW] -= raw.where(F.col("start") == F.col("end")).count()
        self._write_info(info)
        if known:
            self._fs.delete(self._fs_path(f"{self._dir(genome, name)}/v={info.version - 1}"), True)
        return info

    # Reading
    def track(self, genome: str, name: str, allow_overlaps: bool = True) -> DataFrame:
        """The stored variant; where there is none with overlaps, the clustered one."""
        base = self._data(genome, name)
        variant = RAW if allow_overlaps or not self._exists(f"{base}/variant={CLUSTERED}") else CLUSTERED
        return self.spark.read.parquet(f"{base}/variant={variant}")

    def regions(self, genome: str, name: str) -> DataFrame:
        """Bounding regions: seqid, start, end, el_count, start_idx, end_idx."""
        path = self._data(genome, name) + "/regions"
        if not self._exists(path):
            raise BoundingRegionsNotAvailableError(f"{name} has no bounding regions")
        return self.spark.read.parquet(path)

    def region_holding(self, genome: str, name: str, region: Region) -> DataFrame:
        """The bounding region that holds ``region``; raises where none does."""
        found = validate.contained_region(self.regions(genome, name), region.seqid, region.start, region.end)
        if found.isEmpty():
            raise OutsideBoundingRegionError(f"{region.seqid}:{region.start}-{region.end} is not inside one bounding region of {name}")
        return found

    def view(self, genome: str, name: str, region: Region, allow_overlaps: bool = True) -> DataFrame:
        """Elements that reach into a region; the scan is pruned by sequence and bin. A track with
        bounding regions only answers for what is inside one of them."""
        info = self.info(genome, name)
        if info.n_regions:
            self.region_holding(genome, name, region)
        df = self.track(genome, name, allow_overlaps)
        if "end" not in df.columns:
            df = df.withColumn("end", F.col("start") + 1)
        return slice_region(df, region.seqid, region.start, region.end, info.max_length)

    def satisfies(self, genome: str, name: str, req: TrackFormatReq) -> None:
        fmt = TrackFormat.of_schema(self.track(genome, name).schema)
        if not req.is_met_by(fmt):
            raise IncompatibleTracksError(f"{name} is {fmt.name}")

    # Changes
    def rename(self, genome: str, old: str, new: str) -> list[str]:
        """Renames a track and all below it; returns the new names."""
        done = []
        for name in self.tracks(genome):
            if name == old or name.startswith(old + ":"):
                target = new + name[len(old):]
                if self._exists(self._dir(genome, target)):
                    raise InvalidFormatError(f"{target} exists")
                info = self.info(genome, name)
                self._fs.rename(self._fs_path(self._dir(genome, name)), self._fs_path(self._dir(genome, target)))
                info.name = target
                self._write_info(info)
                done.append(target)
        return done

    def remove(self, genome: str, name: str) -> None:
        self._fs.delete(self._fs_path(self._dir(genome, name)), True)

    # Export
    def export_options(self, genome: str, name: str) -> list[str]:
        return sinks.options(TrackFormat.of_schema(self.track(genome, name).drop("bin", "row_ord").schema))

    def _cut(self, genome: str, name: str, allow_overlaps: bool, regions: list[Region]) -> DataFrame:
        """Elements cut to the regions, once for every region they reach into, with its number as
        br_idx: one scan, whatever the number of regions."""
        df = self.track(genome, name, allow_overlaps).drop("bin")
        pointlike = "end" not in df.columns
        frame = self.spark.createDataFrame(
            [(i, r.seqid, r.start, r.end) for i, r in enumerate(regions)], "br_idx int, seqid string, start int, end int")
        met = overlap_join(df.withColumn("end", F.col("start") + 1) if pointlike else df, frame, ["seqid"], 1_000_000)
        met = met.withColumns({"start": F.greatest("start", "start_r"), "end": F.least("end", "end_r"), "br_idx": F.col("br_idx_r")}).drop("start_r", "end_r", "br_idx_r")
        return met.drop("end") if pointlike else met

    def _parsed(self, genome: str, regions: str) -> list[Region]:
        if self.sequences is None:
            raise InvalidFormatError("regions need the genome table")
        return parse_regions(regions, Genome.load(self.sequences, genome))

    def _lines(self, df: DataFrame, fmt: str) -> tuple[DataFrame, list[str]]:
        if fmt == "headed":
            h = headed_sink.header_for(df.drop("row_ord", "br_idx"))
            h.keyword = self.config.header_keyword
            return headed_sink.compose(df, h), headed_sink.header_lines(h)
        return sinks.compose(df, fmt), sinks.HEADERS.get(fmt, [])

    def export(self, out: str, genome: str, name: str, fmt: str, allow_overlaps: bool = True, regions: str | None = None, single: bool = False) -> None:
        """Writes the track (within ``regions``) in a text format, in order: many part files or,
        with ``single``, one (which one task writes, for results of the size of one file)."""
        df = self._cut(genome, name, allow_overlaps, self._parsed(genome, regions)).drop("br_idx") if regions and regions != "*" else self.track(
            genome, name, allow_overlaps).drop("bin")
        lines, head = self._lines(df, fmt)
        save(lines, out, head, single)

    def export_regions(self, out: str, genome: str, name: str, fmt: str, regions: str, allow_overlaps: bool = True, zipped: bool = False) -> list[str]:
        """One folder for every region below ``out``, or one archive of them; returns their names."""
        cut = self._parsed(genome, regions)
        names = []
        for r in cut:  # a plan per region: regions are given by hand
            label = f"{r.seqid}_{r.start + 1}-{r.end}"
            df = self._cut(genome, name, allow_overlaps, [r]).drop("br_idx")
            lines, head = self._lines(df, fmt)
            save(lines, f"{out}/{label}", head)
            names.append(label)
        if zipped:
            archive(self.spark, [f"{out}/{x}" for x in names], f"{out}.zip", fmt)
        return names

    def export_tracks(self, out: str, genome: str, names: list[str], fmt: str, allow_overlaps: bool = True, regions: str | None = None) -> list[str]:
        """Many tracks, each in a folder below ``out``."""
        folders = []
        for name in names:
            folder = name.replace(":", "__").replace("/", "_")
            self.export(f"{out}/{folder}", genome, name, fmt, allow_overlaps, regions)
            folders.append(folder)
        return folders
