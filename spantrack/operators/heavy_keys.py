"""Per-key summaries when a few keys hold most rows.

Rows are range-partitioned on (key, position, tie) with sampled quantiles, so a heavy key spans
as many partitions as its share of the rows. Each partition reduces its stretch of a key to a
partial state of fixed size, which also keeps the first and last position; the states of one key
are then stitched in partition order, where neighbours meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .scan import changes

_STATE = (
    ("pid", "int"), ("n", "long"), ("n_pos", "long"), ("first_pos", "long"), ("last_pos", "long"),
    ("n_distinct", "long"), ("max_step", "long"), ("n_val", "long"), ("sum0", "long"), ("sum1", "long"), ("sum2", "long"),
    ("min_val", "double"), ("max_val", "double"),
)
#: Bits of the two lower limbs of a sum; the third has the rest.
LIMB = 40
_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def key_states(df: DataFrame, key: str, position: str, value: str, tie: str | None = None) -> DataFrame:
    """Partial states, one per (key, partition); the state is of fixed size."""
    picked = df.select(
        F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{position}`").cast("long").alias("pos"),
        F.col(f"`{value}`").cast("double").alias("val"),
        (F.xxhash64(F.col(f"`{tie}`")) if tie else F.lit(0).cast("long")).alias("tie"),
    )
    # Rows tied on key and position are spread by the last column too.
    ordered = picked.repartitionByRange("key", "pos", "tie").sortWithinPartitions("key", "pos").drop("tie")
    numbered = ordered.withColumn("pid", F.spark_partition_id())

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state, pid = None, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(0)]
            pid = batch.column(3)[0].as_py()
            fresh = changes(keys, open_key)
            goes_on = not fresh[0]
            at = np.flatnonzero(fresh)
            if goes_on:
                at = np.concatenate(([0], at))
            table = _reduce(batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(float), at)
            if goes_on:
                state = _merge(state, _state(table, 0))
            last = len(at) - 1
            if goes_on and last == 0:
                continue
            if state is not None:
                yield _rows(pa.array([open_key[0]], pa.string()), pid, _single(state))
            if last > int(goes_on):  # keys that begin and end in this batch
                whole = slice(int(goes_on), last)
                yield _rows(keys[0].take(pa.array(at[whole])), pid, [c[whole] for c in table])
            open_key, state = (keys[0][int(at[last])].as_py(),), _state(table, last)
        if state is not None:
            yield _rows(pa.array([open_key[0]], pa.string()), pid, _single(state))

    fields = ", ".join(f"{n} {t}" for n, t in _STATE)
    return numbered.mapInArrow(reduce, f"key string, {fields}")


def _reduce(position: pa.Array, val: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Columns of the states (but the partition) of all stretches that begin at ``at``; nulls of
    positions stand first in a stretch. NaN stands for no minimum, maximum or position."""
    n = len(val)
    here = ~position.is_null().to_numpy(zero_copy_only=False)
    pos = position.fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.append(at[1:], n)
    count = ends - at
    n_pos = np.add.reduceat(here.astype(np.int64), at)
    step = np.zeros(n, dtype=np.int64)
    step[1:] = np.where(here[:-1], pos[1:] - pos[:-1], 0)
    step[at] = 0
    known = ~np.isnan(val)
    milli = np.floor(np.where(np.isfinite(val), val, 0.0) * 1000)
    if np.abs(milli).max(initial=0) >= 10.0**37:
        raise ArithmeticError("a value of 1e34 or more is too large for the sum in thousandths")
    limbs = []
    for _ in range(2):
        above = np.floor(milli / 2.0**LIMB)
        limbs.append(np.add.reduceat((milli - above * 2.0**LIMB).astype(np.int64), at))
        milli = above
    limbs.append(np.add.reduceat(milli.astype(np.int64), at))
    return [
        count, n_pos, pos[np.minimum(ends - n_pos, n - 1)], pos[ends - 1], (n_pos > 0) + np.add.reduceat((step != 0).astype(np.int64), at),
        np.maximum.reduceat(step, at), np.add.reduceat(known.astype(np.int64), at), *limbs, np.fmin.reduceat(val, at), np.fmax.reduceat(val, at),
    ]


def _state(table: list[np.ndarray], i: int) -> tuple:
    """One state with its sum as one whole number."""
    c = [x[i].item() for x in table]
    return (*c[:7], c[7] + (c[8] << LIMB) + (c[9] << 2 * LIMB), c[10], c[11])


def _single(state: tuple) -> list[np.ndarray]:
    total, low = state[7], (1 << LIMB) - 1
    return [np.array([x]) for x in (*state[:7], total & low, (total >> LIMB) & low, total >> 2 * LIMB, *state[8:])]


def _merge(a: tuple, b: tuple) -> tuple:
    """Associative: ``b`` follows ``a`` in the order of positions."""
    both = a[1] and b[1]
    return (
        a[0] + b[0], a[1] + b[1], a[2] if a[1] else b[2], b[3] if b[1] else a[3],
        a[4] + b[4] - (1 if both and a[3] == b[2] else 0),
        max(a[5], b[5], b[2] - a[3] if both else 0), a[6] + b[6], a[7] + b[7],
        float(np.fmin(a[8], b[8])), float(np.fmax(a[9], b[9])),
    )


def _rows(keys: pa.Array, pid: int, table: list[np.ndarray]) -> pa.RecordBatch:
    n, none = len(keys), table[1] == 0
    columns = [pa.array(np.full(n, pid), pa.int32())]
    for (name, kind), values in zip(_STATE[1:], table):
        mask = none if name in ("first_pos", "last_pos") else np.isnan(values) if kind == "double" else None
        columns.append(pa.array(values, _KINDS[kind], mask=mask))
    return pa.RecordBatch.from_arrays([keys, *columns], ["key", *[name for name, _ in _STATE]])


def stitch(states: DataFrame) -> DataFrame:
    """One row per key from its partial states, joined in partition order.

    At most one state per key and partition arrives here, so even the heaviest key has no more
    rows than there are partitions.
    """
    order = Window.partitionBy("key").orderBy("pid")
    before = F.last("last_pos", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    met = states.withColumn("before", before)
    limb = lambda i: F.sum(F.col(f"sum{i}").cast("decimal(20,0)")).cast("decimal(24,0)") * F.lit(str(1 << LIMB * i)).cast("decimal(25,0)")
    return met.groupBy("key").agg(
        F.sum("n").alias("n_rows"),
        (F.sum("n_distinct") - F.sum(F.when(F.col("before") == F.col("first_pos"), 1).otherwise(0))).alias("n_starts"),
        F.greatest(F.max("max_step"), F.max(F.col("first_pos") - F.col("before"))).alias("max_step"),
        F.min("first_pos").alias("first_start"), F.max("last_pos").alias("last_start"),
        F.sum("n_val").alias("n_val"), (limb(0) + limb(1) + limb(2)).cast("decimal(38,0)").alias("sum_milli"),
        F.min("min_val").alias("min_val"), F.max("max_val").alias("max_val"),
    )


def per_key_summary(df: DataFrame, key: str, position: str, value: str, tie: str | None = None) -> DataFrame:
    """Summary of each key: rows, distinct and extreme positions, widest step between neighbouring
    positions, number, fixed-point sum (thousandths, floored), minimum and maximum of the values.

    The null key is a group of its own. Null positions count as rows only. Null and NaN values
    are not counted as values; infinite ones count but stay out of the sum. Repeated rows count as
    often as they are stored. An empty table gives no row; extra columns are not read. The sum is
    exact, as decimal(38, 0); values of 1e34 and more, or a sum beyond it, raise.
    """
    return stitch(key_states(df, key, position, value, tie))


def heavy_keys(df: DataFrame, key: str, position: str, value: str, tie: str, percent: int) -> DataFrame:
    """The non-null keys that hold at least ``percent`` of all rows, as (key, n_rows, all_rows)."""
    states = materialise(key_states(df, key, position, value, tie))
    total = states.agg(F.sum("n")).first()[0] or 0
    return (
        stitch(states).where(F.col("key").isNotNull() & (F.col("n_rows") * 100 >= F.lit(percent) * F.lit(total)))
        .select("key", "n_rows", F.lit(total).cast("long").alias("all_rows"))
    )
