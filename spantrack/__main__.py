"""Command line of the catalogue: python -m spantrack COMMAND --root STORE ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .catalog import Catalog
from .errors import SpanTrackError


def main(args: list[str], spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="spantrack")
    p.add_argument("command", choices=("ingest", "genomes", "tracks", "info", "options", "export", "rename", "remove"))
    p.add_argument("--root", required=True, help="folder of the store")
    p.add_argument("--sequences", help="table of sequences (genome, seqid, length, ord)")
    p.add_argument("--genome")
    p.add_argument("--track")
    p.add_argument("--to", help="new name, or folder to write to")
    p.add_argument("--path", help="file or folder to ingest")
    p.add_argument("--suffix", help="format to read or write, where the name doesn't tell")
    p.add_argument("--regions", help="such as chr1:10k-2m,chr2")
    p.add_argument("--clustered", action="store_true", help="the variant without overlaps")
    p.add_argument("--permissive", action="store_true", help="leave faulty lines out")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    catalog = Catalog(spark, a.root, spark.read.parquet(a.sequences) if a.sequences else None)
    try:
        if a.command == "ingest":
            print(catalog.ingest(a.path, a.genome, a.track, a.suffix, "PERMISSIVE" if a.permissive else "FAILFAST").shown())
        elif a.command == "genomes":
            print("\n".join(catalog.genomes()))
        elif a.command == "tracks":
            print("\n".join(catalog.tracks(a.genome)))
        elif a.command == "info":
            print(catalog.info(a.genome, a.track).shown())
        elif a.command == "options":
            print("\n".join(catalog.export_options(a.genome, a.track)))
        elif a.command == "export":
            catalog.export(a.to, a.genome, a.track, a.suffix, not a.clustered, a.regions)
        elif a.command == "rename":
            print("\n".join(catalog.rename(a.genome, a.track, a.to)))
        else:
            catalog.remove(a.genome, a.track)
    except SpanTrackError as x:
        print(f"{type(x).__name__}: {x}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
