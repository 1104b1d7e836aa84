"""Covered periods and gaps of intervals per entity, over a global range sort.

The rows are range-sorted by (entity, start, end), so no entity has to fit in one task. Pass one
reduces every partition to a summary of fixed size, the summaries are combined from left to right
(associatively, one row per partition), and pass two rescans the partitions, each with the state
carried in from all partitions before it, and closes the islands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialise, range_sorted
from .scan import changes, key_at, segmented_cummax

_LO, _HI, _PID = "__lo", "__hi", "__pid"


def _scan(batches, n_keys: int, carry, touch: bool):
    """Walk one sorted partition.

    ``carry`` is (key, island start, running maximum end) or None. Yields, for each batch, the
    arrays that describe the islands closed and opened by it, and at last the open state.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = [batch.column(i) for i in range(n_keys)]
        lo = batch.column(n_keys).to_numpy(zero_copy_only=False)
        hi = batch.column(n_keys + 1).to_numpy(zero_copy_only=False)
        fresh = changes(keys, carry[0] if carry else None)
        segment = np.cumsum(fresh)  # 0 goes on with the carried entity
        if segment[0] == 0:
            running = segmented_cummax(np.concatenate(([0], segment)), np.concatenate(([carry[2]], hi)))
            before, running = running[:-1], running[1:]
        else:
            running = segmented_cummax(segment - 1, hi)
            before = np.concatenate(([0 if carry is None else carry[2]], running[:-1]))
        opens = fresh | ((lo > before) if touch else (lo >= before))
        at = np.flatnonzero(opens)
        yield batch, keys, lo, fresh, before, at, carry
        if len(at):
            carry = (key_at(keys, n - 1), int(lo[at[-1]]), int(running[-1]))
        else:
            carry = (carry[0], carry[1], int(running[-1]))
    yield carry


def _carried(picked: DataFrame, entity: list[str], touch: bool):
    """The sorted, numbered rows; by partition the state carried in, and whether its last island
    goes on in the next one."""
    ordered = materialise(range_sorted(picked, *entity, _LO, _HI))
    numbered = ordered.withColumn(_PID, F.spark_partition_id())
    k, pid_at = len(entity), len(picked.columns)
    key_fields = [T.StructField(c, picked.schema[c].dataType) for c in entity]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, pid, single, island, most, schema, key = None, None, True, None, None, None, None
        for item in _scan(batches, k, None, touch):
            if isinstance(item, tuple) and len(item) == 7:
                batch, keys, lo, fresh, _, _, _ = item
                if first is None:
                    first, pid = (key_at(keys, 0), int(lo[0])), batch.column(pid_at)[0].as_py()
                    single = not fresh[1:].any()
                else:
                    single = single and not fresh.any()
                schema = batch.schema
            elif item is not None:
                key, island, most = item
        if first is not None:
            columns = [pa.array([first[0][i]], schema.field(i).type) for i in range(k)]
            columns += [pa.array([key[i]], schema.field(i).type) for i in range(k)]
            names = [f"f{i}" for i in range(k)] + [f"l{i}" for i in range(k)]
            for name, value, kind in (
                ("pid", pid, pa.int32()), ("first_lo", first[1], pa.int64()), ("single", single, pa.bool_()),
                ("island", island, pa.int64()), ("most", most, pa.int64()),
            ):
                columns.append(pa.array([value], kind))
                names.append(name)
            yield pa.RecordBatch.from_arrays(columns, names)

    summary_schema = T.StructType(
        [T.StructField(f"{p}{i}", f.dataType) for p in "fl" for i, f in enumerate(key_fields)]
        + [T.StructField("pid", T.IntegerType()), T.StructField("first_lo", T.LongType()),
           T.StructField("single", T.BooleanType()), T.StructField("island", T.LongType()),
           T.StructField("most", T.LongType())]
    )
    # One row per partition: bounded by the partition number, whatever the data.
    rows = sorted(numbered.mapInArrow(summarise, summary_schema).collect(), key=lambda r: r["pid"])
    carries, goes_on, carry = {}, {}, None
    for i, r in enumerate(rows):
        first = tuple(r[f"f{j}"] for j in range(k))
        last = tuple(r[f"l{j}"] for j in range(k))
        if carry is not None and carry[0] == first:
            joined = r["first_lo"] <= carry[2] if touch else r["first_lo"] < carry[2]
            goes_on[rows[i - 1]["pid"]] = joined
        carries[r["pid"]] = carry
        if r["single"] and carry is not None and carry[0] == first:
            reached = r["island"] <= carry[2] if touch else r["island"] < carry[2]
            carry = (last, carry[1] if reached else r["island"], max(carry[2], r["most"]))
        else:
            carry = (last, r["island"], r["most"])
    return numbered, carries, goes_on


def covered_and_gaps(
    df: DataFrame, entity: list[str], start: str, end: str, touch: bool = True
) -> DataFrame:
    """Maximal covered periods and the gaps between them, per entity.

    Returns the entity columns, ``kind`` ('period' or 'gap'), ``start`` and ``end``. Intervals are
    half-open; with ``touch`` abutting ones join, without it only those that overlap.

    Rows whose start or end is null or whose end is not above its start take no part. A null
    entity value is an entity of its own. Repeated and tied rows change nothing; extra columns are
    not read; an empty table gives no row.
    """
    kind_of = df.schema[start].dataType
    picked = df.select(
        *[F.col(f"`{c}`") for c in entity],
        F.col(f"`{start}`").cast("long").alias(_LO),
        F.col(f"`{end}`").cast("long").alias(_HI),
    ).where(F.col(_LO).isNotNull() & (F.col(_HI) > F.col(_LO)))
    numbered, carries, goes_on = _carried(picked, entity, touch)
    k = len(entity)
    key_fields = [T.StructField(c, df.schema[c].dataType) for c in entity]

    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import itertools

        batches = iter(batches)
        head = next((b for b in batches if b.num_rows), None)
        if head is None:
            return
        pid, types = head.column(k + 2)[0].as_py(), [head.schema.field(i).type for i in range(k)]
        for item in _scan(itertools.chain([head], batches), k, carries.get(pid), touch):
            if not (isinstance(item, tuple) and len(item) == 7):
                if item is not None and not goes_on.get(pid, False):
                    yield _out([pa.array([item[0][i]], types[i]) for i in range(k)], np.array(["period"]),
                               np.array([item[1]]), np.array([item[2]]))
                continue
            batch, keys, lo, fresh, before, at, carried = item
            if not len(at):
                continue
            # Every opening closes the island before it; the first one closes the carried island.
            starts = np.concatenate(([0 if carried is None else carried[1]], lo[at[:-1]]))
            ends = before[at]
            owners = [
                pa.concat_arrays([pa.array([None if carried is None else carried[0][i]], types[i]), keys[i].take(pa.array(at[:-1]))])
                for i in range(k)
            ]
            emit = np.ones(len(at), dtype=bool)
            first_of_partition = batch is head
            if carried is None or (first_of_partition and at[0] == 0):
                emit[0] = False  # nothing before it, or closed by the partition that held it
            if emit.any():
                pick = pa.array(np.flatnonzero(emit))
                yield _out([o.take(pick) for o in owners], np.full(int(emit.sum()), "period"), starts[emit], ends[emit])
            inner = at[~fresh[at]]
            if len(inner):
                pick = pa.array(inner)
                yield _out([c.take(pick) for c in keys], np.full(len(inner), "gap"), before[inner], lo[inner])

    def _out(owners, kind, lo, hi):
        return pa.RecordBatch.from_arrays(
            [*owners, pa.array(kind, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())],
            [*entity, "kind", _LO, _HI],
        )

    out_schema = T.StructType(
        key_fields + [T.StructField("kind", T.StringType()), T.StructField(_LO, T.LongType()), T.StructField(_HI, T.LongType())]
    )
    found = numbered.mapInArrow(rescan, out_schema)
    # Without touching, abutting islands have no gap between them.
    found = found.where((F.col("kind") == "period") | (F.col(_HI) > F.col(_LO)))
    return found.select(
        *[F.col(f"`{c}`") for c in entity], "kind",
        F.col(_LO).cast(kind_of).alias("start"), F.col(_HI).cast(kind_of).alias("end"),
    )


def label_islands(
    df: DataFrame, entity: list[str], start: str, end: str, label: str = "island", touch: bool = False
) -> DataFrame:
    """The rows of ``df`` with ``label``, the start of the island (the maximal group of
    overlapping intervals of one entity) that they are in.

    Rows whose start or end is null come out with a null label, as do rows whose end is not above
    their start. Repeated and tied rows keep their number; a null entity is an entity of its own.
    """
    lo, hi = F.col(f"`{start}`").cast("long"), F.col(f"`{end}`").cast("long")
    fits = F.coalesce(lo.isNotNull() & (hi > lo), F.lit(False))
    others = [c for c in df.columns if c not in entity]
    picked = df.where(fits).select(*[F.col(f"`{c}`") for c in entity], lo.alias(_LO), hi.alias(_HI), *[F.col(f"`{c}`") for c in others])
    numbered, carries, _ = _carried(picked, entity, touch)
    k, pid_at = len(entity), len(picked.columns)

    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import itertools

        batches = iter(batches)
        head = next((b for b in batches if b.num_rows), None)
        if head is None:
            return
        for item in _scan(itertools.chain([head], batches), k, carries.get(head.column(pid_at)[0].as_py()), touch):
            if isinstance(item, tuple) and len(item) == 7:
                batch, _, low, _, _, at, carried = item
                last = np.searchsorted(at, np.arange(batch.num_rows), side="right") - 1
                island = np.where(last >= 0, low[at[np.maximum(last, 0)]] if len(at) else 0, 0 if carried is None else carried[1])
                columns = [batch.column(i) for i in range(k)] + [batch.column(k + 2 + i) for i in range(len(others))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(island, pa.int64())], [*entity, *others, label])

    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in [*entity, *others]] + [T.StructField(label, T.LongType())])
    labelled = numbered.mapInArrow(rescan, schema)
    rest = df.where(~fits).select(*[F.col(f"`{c}`") for c in [*entity, *others]], F.lit(None).cast("long").alias(label))
    return labelled.unionByName(rest).select(*[F.col(f"`{c}`") for c in [*df.columns, label]])
