"""Runs of consecutive (nearly) equal events, collapsed across partition boundaries.

Each range-sorted chunk encodes its runs locally into associative summaries (first and last value,
extent, count, length); only the first and last run of a chunk can still grow, and a prefix merge
over those boundary runs joins the compatible ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..operators.scan import changes, key_at
from ..session import materialise, range_sorted

_RUN = (
    ("pid", "int"), ("seq", "long"), ("edge", "boolean"), ("start", "long"), ("end", "long"), ("n", "long"),
    ("length", "long"), ("first_val", "double"), ("last_val", "double"),
)


def latest_version(df: DataFrame, row_id: str, version: str, keep: list[str]) -> DataFrame:
    """One row per ``row_id``: the one with the latest ``version``, ties broken by the other
    columns. Rows with a null id can't be told apart as repeats and all stay."""
    named = df.where(F.col(row_id).isNotNull()).groupBy(row_id).agg(
        F.max(F.struct(version, *keep)).alias("__v")).select(row_id, *[F.col(f"__v.`{c}`").alias(c) for c in keep])
    return named.unionByName(df.where(F.col(row_id).isNull()).select(row_id, *keep))


def collapse_runs(
    df: DataFrame, sequence: list[str], start: str, end: str, value: str, tolerance: float, tie: str
) -> DataFrame:
    """One row per run of at least two elements: sequence columns, start, end, n_elements, length.

    In the order of (start, end, tie) of one sequence an element joins the run of the element
    before it if it starts exactly where that one ends and the two values differ by at most
    ``tolerance``. Rows with a null sequence column, start or end take no part; an element with
    null or NaN value takes its place in the order but is in no run. ``length`` is the sum of the
    elements' lengths. Repeated rows are elements of their own (see ``latest_version``); extra
    columns are not read; an empty table gives no row.
    """
    k = len(sequence)
    kind = df.schema[start].dataType
    picked = df.select(
        *[F.col(f"`{c}`") for c in sequence], F.col(f"`{start}`").cast("long").alias("__s"),
        F.col(f"`{end}`").cast("long").alias("__e"), F.col(f"`{tie}`").alias("__t"),
        F.col(f"`{value}`").cast("double").alias("__v"),
    ).dropna(subset=[*sequence, "__s", "__e"])
    ordered = range_sorted(picked, *sequence, "__s", "__e", "__t").drop("__t")
    chunks = ordered.withColumn("__pid", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run, seq, pid, types = None, 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(i) for i in range(k)]
            types = [c.type for c in keys]
            s = batch.column(k).to_numpy(zero_copy_only=False)
            e = batch.column(k + 1).to_numpy(zero_copy_only=False)
            v = batch.column(k + 2).to_numpy(zero_copy_only=False).astype(float)
            pid = batch.column(k + 3)[0].as_py()
            breaks = changes(keys, open_run["key"] if open_run else None)
            breaks[1:] |= (s[1:] != e[:-1]) | ~(np.abs(v[1:] - v[:-1]) <= tolerance)
            if open_run:
                breaks[0] |= bool(s[0] != open_run["end"]) or not abs(v[0] - open_run["last_val"]) <= tolerance
            at = np.flatnonzero(breaks)
            lengths = np.concatenate(([0], np.cumsum(e - s)))
            if not len(at):
                open_run |= {"end": int(e[-1]), "last_val": float(v[-1]), "n": open_run["n"] + n,
                             "length": open_run["length"] + int(lengths[-1])}
                continue
            if open_run:
                if at[0]:
                    a = int(at[0])
                    open_run |= {"end": int(e[a - 1]), "last_val": float(v[a - 1]), "n": open_run["n"] + a,
                                 "length": open_run["length"] + int(lengths[a])}
                if seq == 0 or open_run["n"] >= 2:
                    yield _one(open_run, types, pid, seq, seq == 0)
                seq += 1
            # Runs that begin and end inside the batch; the last one stays open.
            a, b = at[:-1], at[1:]
            count = b - a
            numbers = seq + np.arange(len(a))
            keep = (count >= 2) | (numbers == 0)
            if keep.any():
                a, b, count, numbers = a[keep], b[keep], count[keep], numbers[keep]
                pick = pa.array(a)
                yield pa.RecordBatch.from_arrays(
                    [c.take(pick) for c in keys] + [
                        pa.array(np.full(len(a), pid), pa.int32()), pa.array(numbers, pa.int64()),
                        pa.array(numbers == 0), pa.array(s[a], pa.int64()), pa.array(e[b - 1], pa.int64()),
                        pa.array(count, pa.int64()), pa.array(lengths[b] - lengths[a], pa.int64()),
                        pa.array(v[a]), pa.array(v[b - 1])],
                    [*sequence, *[x for x, _ in _RUN]],
                )
            seq += len(at) - 1
            last = int(at[-1])
            open_run = {"key": key_at(keys, last), "start": int(s[last]), "end": int(e[-1]), "n": n - last,
                        "length": int(lengths[-1] - lengths[last]), "first_val": float(v[last]), "last_val": float(v[-1])}
        if open_run:
            yield _one(open_run, types, pid, seq, True)

    def _one(run, types, pid, seq, edge):
        kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        values = {"pid": pid, "seq": seq, "edge": edge} | run
        return pa.RecordBatch.from_arrays(
            [pa.array([run["key"][i]], types[i]) for i in range(k)]
            + [pa.array([values[name]], kinds[t]) for name, t in _RUN],
            [*sequence, *[x for x, _ in _RUN]],
        )

    schema = T.StructType(
        [T.StructField(c, df.schema[c].dataType) for c in sequence]
        + [T.StructField(n, {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(),
                             "boolean": T.BooleanType()}[t]) for n, t in _RUN]
    )
    runs = materialise(chunks.mapInArrow(encode, schema))
    # At most two boundary runs per partition, so one task can merge them in partition order.
    order = Window.orderBy("pid", "seq")
    same = F.lit(True)
    for c in sequence:
        same = same & (F.lag(c).over(order) == F.col(c))
    joins = same & (F.lag("end").over(order) == F.col("start")) & (
        F.abs(F.lag("last_val").over(order) - F.col("first_val")) <= tolerance)
    # NaN compares as equal to itself and above all numbers in SQL; such elements never join.
    joins = joins & ~F.isnan(F.col("first_val")) & ~F.isnan(F.lag("last_val").over(order)) & (
        (F.lag("pid").over(order) < F.col("pid")))
    boundary = runs.where("edge").withColumn("__open", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    boundary = boundary.withColumn("__run", F.sum("__open").over(order)).groupBy("__run", *sequence).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.sum("length").alias("length"))
    columns = [*sequence, "start", "end", "n", "length"]
    merged = runs.where(~F.col("edge")).select(*columns).unionByName(boundary.select(*columns))
    return merged.where("n >= 2").select(
        *sequence, F.col("start").cast(kind).alias("start"), F.col("end").cast(kind).alias("end"),
        F.col("n").alias("n_elements"), "length",
    )
