"""Session-level helpers: table access, shared materialisation, sizes of partitions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``; timestamps keep their zone-free type."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and the context
    has no folder yet (local tests) is a temporary one made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spantrack-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``: computed once, lineage cut, survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def range_sorted(df: DataFrame, *keys: str) -> DataFrame:
    """Global sort as range partitions with sorted content.

    Boundaries are Spark's sampled quantiles of the composite key, so one heavy leading value is
    split over many partitions by the columns that follow it. The partition number is left to
    ``spark.sql.shuffle.partitions`` and adaptive coalescing, which only joins neighbours.
    """
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
