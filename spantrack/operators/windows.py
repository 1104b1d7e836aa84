"""Ordered window values over heavy entities: lag, lead, running sum, maximum, row number and the
last value seen.

A window partitioned by entity puts the whole of a heavy entity into one task. Here the rows are
range-sorted by (entity, order) with sampled quantiles, each partition is reduced to one summary
row, the summaries are combined from left to right, and a rescan adds the values carried in.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialise, range_sorted
from .scan import changes, key_at, segmented_cummax

LAG, LEAD, SUM, MAX_BEFORE, ROW, LAST, SUM_AT = "lag", "lead", "sum", "max before", "row", "last", "sum at"


def ordered_values(df: DataFrame, entity: list[str], order: list[str], adds: dict[str, tuple]) -> DataFrame:
    """``df`` with new columns, each given as (kind, column): the value of the row before or after
    in the entity (lag, lead), the running sum up to the row (sum), the maximum over the rows
    before it (max before), the place of the row from 1 (row), the last value up to the row that
    isn't null (last), or, given as (sum at, (column, mark)), what the running sum was at the last
    row whose ``mark`` isn't null, 0 if there is none.

    Sums and max before are for whole or (sum) floating numbers; nulls add nothing. Rows tied in
    ``order`` come in any order. A null entity is an entity of its own.
    """
    if not entity:
        # All rows are one entity.
        whole = ordered_values(df.withColumn("__all", F.lit(0)), ["__all"], order, adds)
        return whole.drop("__all")
    names = df.columns
    ordered = materialise(range_sorted(df, *entity, *order))
    numbered = ordered.withColumn("__pid", F.spark_partition_id())
    at = {c: i for i, c in enumerate(names)}
    keys_at = [at[c] for c in entity]
    floats = {n: isinstance(df.schema[c].dataType, T.FloatType | T.DoubleType) for n, (k, c) in adds.items() if k == SUM}
    fields = []
    for name, (kind, column) in adds.items():
        dtype = T.LongType() if kind in (ROW, MAX_BEFORE, SUM_AT) or kind == SUM and not floats[name] else T.DoubleType() if kind == SUM else df.schema[column].dataType
        fields.append(T.StructField(name, dtype))

    def numbers(batch, column, fill, kind=np.int64):
        a = batch.column(at[column])
        return a.cast(pa.float64() if kind is np.float64 else pa.int64()).fill_null(fill).to_numpy(zero_copy_only=False)

    least = -(2**62)

    def hold(batch, start, held):
        """Updates what LAST and SUM_AT know after the rows from ``start`` on: by name the value, or
        (sum up to the mark, sum), where no mark gives None."""
        for name, (kind, c) in adds.items():
            if kind == LAST:
                where = np.flatnonzero(batch.column(at[c]).slice(start).is_valid().to_numpy(zero_copy_only=False))
                if len(where):
                    held[name] = batch.column(at[c])[start + int(where[-1])].as_py()
            elif kind == SUM_AT:
                total = np.cumsum(numbers(batch, c[0], 0)[start:])
                marks = np.flatnonzero(batch.column(at[c[1]]).slice(start).is_valid().to_numpy(zero_copy_only=False))
                mark, before = held.get(name, (None, 0))
                held[name] = (before + int(total[marks[-1]]) if len(marks) else mark, before + int(total[-1]) if len(total) else before)

    def joined(carry, held):
        """The knowledge of ``carry`` followed by that of ``held``."""
        out = {**carry, **held}
        for name, (kind, _) in adds.items():
            if kind == SUM_AT:
                mark, before = carry.get(name, (None, 0))
                own, total = held.get(name, (None, 0))
                out[name] = (before + own if own is not None else mark, before + total)
        return out

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        first = last = None
        single, rows, sums, most, held, pid = True, 0, {}, {}, {}, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            pid = batch.column(len(names))[0].as_py()
            keys = [batch.column(i) for i in keys_at]
            fresh = changes(keys, last[0] if last else None)
            if first is None:
                first = (key_at(keys, 0), {c: batch.column(at[c])[0].as_py() for k, c in adds.values() if k == LEAD})
                fresh[0] = False
            single = single and not fresh.any()
            start = int(np.flatnonzero(fresh)[-1]) if fresh.any() else 0
            if fresh.any():
                rows, sums, most, held = 0, {}, {}, {}
            rows += n - start
            hold(batch, start, held)
            for name, (kind, c) in adds.items():
                if kind == SUM:
                    sums[name] = sums.get(name, 0) + numbers(batch, c, 0, np.float64 if floats[name] else np.int64)[start:].sum().item()
                elif kind == MAX_BEFORE:
                    most[name] = max(most.get(name, least), int(numbers(batch, c, least)[start:].max()))
            last = (key_at(keys, n - 1), {c: batch.column(at[c])[n - 1].as_py() for k, c in adds.values() if k == LAG})
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([pickle.dumps((first, last, single, rows, sums, most, held))], pa.binary())], ["pid", "s"])

    import pickle

    # One small row per partition.
    found = sorted((r["pid"], pickle.loads(r["s"])) for r in numbered.mapInArrow(summarise, "pid int, s binary").collect())
    carries, following, carry = {}, {}, None
    for i, (pid, (first, last, single, rows, sums, most, held)) in enumerate(found):
        carries[pid] = carry
        if i:
            following[found[i - 1][0]] = first
        if single and carry is not None and carry[0] == first[0]:
            carry = (last[0], last[1], carry[2] + rows, {n: carry[3][n] + x for n, x in sums.items()}, {n: max(carry[4][n], x) for n, x in most.items()}, joined(carry[5], held))
        else:
            carry = (last[0], last[1], rows, sums, most, held)

    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, waiting = None, None
        started = False
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None and not started:
                started, pid = True, batch.column(len(names))[0].as_py()
                state = carries.get(pid)
            if waiting is not None:
                ahead = following.get(pid) if batch is None else (
                    key_at([batch.column(i) for i in keys_at], 0), {c: batch.column(at[c])[0].as_py() for k, c in adds.values() if k == LEAD})
                yield add(*waiting, ahead)
                waiting = None
            if batch is None:
                continue
            n = batch.num_rows
            keys = [batch.column(i) for i in keys_at]
            fresh = changes(keys, state[0] if state else None)
            waiting = (batch, keys, fresh, state)
            start = int(np.flatnonzero(fresh)[-1]) if fresh.any() else 0
            goes_on = not fresh.any()
            sums, most = {}, {}
            for name, (kind, c) in adds.items():
                if kind == SUM:
                    sums[name] = numbers(batch, c, 0, np.float64 if floats[name] else np.int64)[start:].sum().item() + (state[3][name] if goes_on else 0)
                elif kind == MAX_BEFORE:
                    most[name] = max(int(numbers(batch, c, least)[start:].max()), state[4][name] if goes_on else least)
            held = dict(state[5]) if goes_on else {}
            hold(batch, start, held)
            state = (key_at(keys, n - 1), {c: batch.column(at[c])[n - 1].as_py() for k, c in adds.values() if k == LAG}, n - start + (state[2] if goes_on else 0), sums, most, held)

    def add(batch, keys, fresh, state, ahead):
        n = batch.num_rows
        opened = np.flatnonzero(fresh)
        segment = np.cumsum(fresh)
        base = np.concatenate(([0], opened))[segment]
        out = [batch.column(i) for i in range(len(names))]
        for name, (kind, c) in adds.items():
            if kind == ROW:
                out.append(pa.array(np.arange(n) - base + 1 + np.where(segment == 0, state[2] if state else 0, 0), pa.int64()))
            elif kind == SUM:
                x = numbers(batch, c, 0, np.float64 if floats[name] else np.int64)
                total = np.concatenate(([0], np.cumsum(x)))
                out.append(pa.array(total[1:] - total[base] + np.where(segment == 0, state[3][name] if state else 0, 0), pa.float64() if floats[name] else pa.int64()))
            elif kind == MAX_BEFORE:
                x = numbers(batch, c, least)
                before = np.concatenate(([state[4][name] if state and segment[0] == 0 else least], x[:-1]))
                before[opened] = least
                before = segmented_cummax(segment, before)
                out.append(pa.array(before, pa.int64(), mask=before == least))
            elif kind == LAST:
                a = batch.column(at[c])
                seen = np.maximum.accumulate(np.where(a.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1))
                pick = np.where(seen >= base, seen + 1, np.where(segment == 0, 0, n + 1))
                known = state[5].get(name) if state else None
                out.append(pa.concat_arrays([pa.array([known], a.type), a, pa.array([None], a.type)]).take(pa.array(pick)))
            elif kind == SUM_AT:
                mark, before = state[5].get(name, (None, 0)) if state else (None, 0)
                total = np.concatenate(([0], np.cumsum(numbers(batch, c[0], 0))))
                total = total[1:] - total[base] + np.where(segment == 0, before, 0)
                seen = np.maximum.accumulate(np.where(batch.column(at[c[1]]).is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1))
                out.append(pa.array(np.where(seen >= base, total[np.maximum(seen, 0)], np.where(segment == 0, mark or 0, 0)), pa.int64()))
            elif kind == LAG:
                a = batch.column(at[c])
                one = pa.array([state[1][c] if state else None], a.type)
                shifted = pa.concat_arrays([one, a.slice(0, n - 1)])
                out.append(_null_where(shifted, fresh))
            else:
                a = batch.column(at[c])
                same = ahead is not None and ahead[0] == key_at(keys, n - 1)
                one = pa.array([ahead[1][c] if same else None], a.type)
                shifted = pa.concat_arrays([a.slice(1), one])
                out.append(_null_where(shifted, np.append(fresh[1:], False)))
        return pa.RecordBatch.from_arrays(out, [*names, *adds])

    return numbered.mapInArrow(rescan, T.StructType([*df.schema.fields, *fields]))


def _null_where(values: pa.Array, where: np.ndarray) -> pa.Array:
    import pyarrow.compute as pc

    return pc.if_else(pa.array(where), pa.scalar(None, values.type), values)
