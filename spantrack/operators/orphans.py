"""References to records that do not exist at the time of the reference.

Parents become disjoint periods of existence per key. Parents and references are range-partitioned
together on (key, time) with sampled quantiles, so that a heavy key is split by time; in each
range the parents form sorted arrays, reference batches are probed by binary search for the last
period that begins at or before them, and the last parent of the ranges before is carried in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .intervals import covered_and_gaps
from .scan import changes

FOREVER = 2**62


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp, read off its fields, hence without any time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    seconds = (F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400
               + F.hour(c) * 3600 + F.minute(c) * 60)
    return seconds * 1000000 + (F.extract(F.lit("SECOND"), c) * 1000000).cast("long")


def existence(nodes: DataFrame, key: str, since: str, until: str) -> DataFrame:
    """Disjoint periods (key, start, end) in microseconds in which a key exists."""
    rows = nodes.select(F.col(key).alias("key"), micros(since).alias("a"),
                        F.coalesce(micros(until), F.lit(FOREVER)).alias("b")).where(F.col("key").isNotNull())
    return covered_and_gaps(rows, ["key"], "a", "b").where("kind = 'period'").select("key", "start", "end")


def orphan_references(references: DataFrame, nodes: DataFrame, key: str, since: str, until: str) -> DataFrame:
    """The references (ref_table, row_id, ref_id, ref_time) whose id has no node at their time.

    A node row says that ``key`` exists from ``since`` (included) to ``until`` (excluded, null:
    never removed); rows with a null key or ``since`` say nothing. Null ref_ids name nothing and
    give no row; a reference with a null time has no node. Ids are compared exactly, also empty
    ones. Repeated references give one row.
    """
    refs = references.select("ref_table", "row_id", "ref_id", "ref_time").where(F.col("ref_id").isNotNull())
    parents = existence(nodes, key, since, until)
    both = refs.select(
        F.col("ref_id").alias("key"), F.coalesce(micros("ref_time"), F.lit(-FOREVER)).alias("at"), F.lit(1).alias("tag"),
        F.lit(None).cast("long").alias("until"), "ref_table", "row_id", "ref_time",
    ).unionByName(parents.select(
        "key", F.col("start").alias("at"), F.lit(0).alias("tag"), F.col("end").alias("until"),
    ), allowMissingColumns=True)
    ranged = both.repartitionByRange("key", "at", "tag", "row_id").sortWithinPartitions("tag", "key", "at")
    ordered = materialise(ranged).withColumn("pid", F.spark_partition_id())
    # One row per range: the last parent in it.
    last = {r["pid"]: (r["p"]["key"], r["p"]["at"], r["p"]["until"]) for r in ordered.where("tag = 0").groupBy("pid").agg(
        F.max(F.struct("key", "at", "until")).alias("p")).collect()}
    carried, carry = {}, None
    for pid in range(max(last, default=-1) + 2):
        carried[pid] = carry
        carry = last.get(pid, carry)
    final = carry

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, since_, until_, index = [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            if index is None and not keys:
                before = carried.get(batch.column("pid")[0].as_py(), final)
                if before:
                    keys.append(pa.array([before[0]], pa.string()))
                    since_.append(np.array([before[1]]))
                    until_.append(np.array([before[2]]))
            tag = batch.column("tag").to_numpy(zero_copy_only=False)
            n = int(np.count_nonzero(tag == 0))
            if n:
                own = batch.slice(0, n)
                keys.append(own.column("key"))
                since_.append(own.column("at").to_numpy(zero_copy_only=False))
                until_.append(own.column("until").to_numpy(zero_copy_only=False).astype(np.int64))
            if n == batch.num_rows:
                continue
            if index is None:
                index = _Index(keys, since_, until_)
            rest = batch.slice(n)
            missed = ~index.alive(rest.column("key"), rest.column("at").to_numpy(zero_copy_only=False))
            if missed.any():
                pick = pa.array(np.flatnonzero(missed))
                yield pa.RecordBatch.from_arrays(
                    [rest.column(c).take(pick) for c in ("ref_table", "row_id", "key", "ref_time")],
                    ["ref_table", "row_id", "ref_id", "ref_time"])

    from pyspark.sql import types as T

    schema = T.StructType([refs.schema[c] for c in ("ref_table", "row_id", "ref_id", "ref_time")])
    return ordered.mapInArrow(probe, schema).distinct()


class _Index:
    """Sorted arrays of the parents of one range: keys by code, and (code, time) as one number each,
    which references are searched for."""

    def __init__(self, keys, since, until):
        self.empty = not keys
        if self.empty:
            return
        key, since, until = pa.concat_arrays(keys), np.concatenate(since), np.concatenate(until)
        fresh = changes([key], None)
        # The code of a key is its place among the sorted ones.
        self.keys, self.until = key.take(pa.array(np.flatnonzero(fresh))), until
        self.times = np.unique(since)
        self.width = len(self.times) + 1
        self.code = (np.cumsum(fresh) - 1) * self.width + np.searchsorted(self.times, since) + 1

    def alive(self, key: pa.Array, at: np.ndarray) -> np.ndarray:
        if self.empty:
            return np.zeros(len(at), dtype=bool)
        fresh = changes([key], None)
        distinct = key.take(pa.array(np.flatnonzero(fresh)))
        coded = pc.index_in(distinct, value_set=self.keys)
        known = coded.is_valid().to_numpy(zero_copy_only=False)
        place = coded.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(fresh) - 1
        wanted = place[group] * self.width + np.searchsorted(self.times, at, side="right")
        found = np.searchsorted(self.code, wanted, side="right") - 1
        same = known[group] & (found >= 0) & (self.code[found] // self.width == place[group]) & (
            self.code[found] % self.width > 0)
        return same & (self.until[found] > at)
