"""Percentiles of very large numeric columns by relative-rank compactors.

A sketch is a list of levels; an item of level h stands for 2**h values. A full level sorts its
buffer, keeps the protected tail in place and sends every second item of the rest one level up, so
ranks near the protected tail stay (almost) exact and the error of a rank r is a fraction of the
distance to that tail. Sketches of partitions, days or files merge level by level.

The compaction schedule follows the published relative-error quantile sketch: a level has
sections of ``k`` items; after its n-th compaction the trailing (ones of n + 1) sections take part.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.scan import changes, key_at

DEFAULT_K, FIRST_SECTIONS = 64, 3
#: Rows that are grouped at a time.
BUFFER_ROWS = 200_000
#: Sketches that a task holds at a time; beyond it they are handed on and merge later.
HELD = 4000
HIGH, LOW = "high", "low"


class Sketch:
    """Relative-rank sketch. ``tail`` is the protected end: 'high' keeps large values exact."""

    __slots__ = ("k", "tail", "n", "levels", "turns", "sections", "least", "most")

    def __init__(self, k: int = DEFAULT_K, tail: str = HIGH):
        if k < 4 or k % 2:
            raise ValueError("k must be even and at least 4")
        self.k, self.tail, self.n = k, tail, 0
        self.levels: list[list[np.ndarray]] = [[]]
        self.turns, self.sections = [0], [FIRST_SECTIONS]
        self.least, self.most = math.inf, -math.inf

    def capacity(self, h: int) -> int:
        return 2 * self.k * self.sections[h]

    def add(self, values: np.ndarray) -> None:
        """Adds all numbers; NaN is left out."""
        values = values[~np.isnan(values)]
        if not len(values):
            return
        self.n += len(values)
        self.least, self.most = min(self.least, float(values.min())), max(self.most, float(values.max()))
        step = self.capacity(0)
        for a in range(0, len(values), step):
            self.levels[0].append(np.asarray(values[a : a + step], dtype=np.float64))
            self._compress()

    def merge(self, other: Sketch) -> Sketch:
        """Takes in ``other``; associative up to the error bound."""
        if (self.k, self.tail) != (other.k, other.tail):
            raise ValueError("only sketches of equal k and tail can be merged")
        self.n += other.n
        self.least, self.most = min(self.least, other.least), max(self.most, other.most)
        for h, buffers in enumerate(other.levels):
            self._grow(h)
            self.levels[h] += buffers
            self.turns[h] |= other.turns[h]
            self.sections[h] = max(self.sections[h], other.sections[h])
        self._compress()
        return self

    def _grow(self, h: int) -> None:
        while len(self.levels) <= h:
            self.levels.append([])
            self.turns.append(0)
            self.sections.append(FIRST_SECTIONS)

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            while sum(map(len, self.levels[h])) >= self.capacity(h):
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        buffer = np.sort(np.concatenate(self.levels[h]))
        if self.tail == LOW:
            buffer = buffer[::-1]
        # buffer[0] is farthest from the protected tail.
        turn = self.turns[h]
        trailing = 1
        while turn >> (trailing - 1) & 1:
            trailing += 1
        half = self.capacity(h) // 2
        size = min(len(buffer) - half + (trailing - 1) * self.k if len(buffer) > self.capacity(h) else trailing * self.k,
                   len(buffer) - half)
        size -= size % 2
        self._grow(h + 1)
        # A fixed mix of level and turn takes the place of the coin, so a retry gives the same sketch.
        coin = ((turn * 0x9E3779B97F4A7C15 + h * 0xBF58476D1CE4E5B9 + self.n * 0x94D049BB133111EB) >> 33) & 1
        self.levels[h + 1].append(buffer[coin:size:2].copy())
        self.levels[h] = [buffer[size:]]
        self.turns[h] = turn + 1
        if self.turns[h] >= 1 << (self.sections[h] - 1):
            self.sections[h] += 1

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Kept values in order, with their weights."""
        parts = [(np.concatenate(b), 1 << h) for h, b in enumerate(self.levels) if b and sum(map(len, b))]
        if not parts:
            return np.empty(0), np.empty(0, dtype=np.int64)
        values = np.concatenate([p for p, _ in parts])
        weights = np.concatenate([np.full(len(p), w, dtype=np.int64) for p, w in parts])
        order = np.argsort(values, kind="stable")
        return values[order], weights[order]

    def quantiles(self, at: list[float]) -> list[float | None]:
        """For each q the least kept value whose estimated rank is at least q * n."""
        if not self.n:
            return [None] * len(at)
        if len(self.levels) == 1:
            values = np.sort(np.concatenate(self.levels[0]))
            return [float(values[min(max(math.ceil(q * self.n), 1), self.n) - 1]) for q in at]
        values, weights = self.items()
        ranks = np.cumsum(weights)
        out = []
        for q in at:
            if q <= 0 or q >= 1:
                out.append(self.least if q <= 0 else self.most)
            else:
                out.append(float(values[min(np.searchsorted(ranks, math.ceil(q * self.n)), len(values) - 1)]))
        return out

    def rank(self, x: float) -> int:
        """Estimated number of values at most ``x``."""
        values, weights = self.items()
        return int(weights[: np.searchsorted(values, x, side="right")].sum())

    def to_bytes(self) -> bytes:
        head = np.array([self.k, self.tail == HIGH, self.n, len(self.levels)], dtype=np.int64)
        kept = [np.concatenate(b) if b else np.empty(0) for b in self.levels]
        info = np.array([[len(x), t, s] for x, t, s in zip(kept, self.turns, self.sections)], dtype=np.int64)
        return b"".join([head.tobytes(), np.array([self.least, self.most]).tobytes(), info.tobytes(), *[x.tobytes() for x in kept]])

    @classmethod
    def from_bytes(cls, data: bytes) -> Sketch:
        k, high, n, levels = np.frombuffer(data, np.int64, 4)
        s = cls(int(k), HIGH if high else LOW)
        s.n = int(n)
        s.least, s.most = map(float, np.frombuffer(data, np.float64, 2, 32))
        info = np.frombuffer(data, np.int64, 3 * int(levels), 48).reshape(-1, 3)
        at, s.levels, s.turns, s.sections = 48 + 24 * int(levels), [], [], []
        for size, turn, sections in info.tolist():
            s.levels.append([np.frombuffer(data, np.float64, size, at).copy()])
            at += 8 * size
            s.turns.append(turn)
            s.sections.append(sections)
        return s


def _pack(values: np.ndarray, sizes: np.ndarray, k: int, tail: str) -> pa.Array:
    """Bytes of one-level sketches of sorted groups, as ``Sketch.to_bytes`` writes them."""
    head = 9
    begin = np.cumsum(sizes) - sizes
    at = np.cumsum(sizes + head) - sizes - head
    words = np.empty(int((sizes + head).sum()), dtype=np.int64)
    floats = words.view(np.float64)
    for i, x in enumerate((k, int(tail == HIGH), sizes, 1)):
        words[at + i] = x
    floats[at + 4], floats[at + 5] = values[begin], values[begin + sizes - 1]
    words[at + 6], words[at + 7], words[at + 8] = sizes, 0, FIRST_SECTIONS
    floats[np.arange(len(values)) + np.repeat(at + head - begin, sizes)] = values
    offsets = np.append(at, len(words)).astype(np.int32) * 8
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(words)])


def sketches(df: DataFrame, keys: list[str], value: str, k: int = DEFAULT_K, tail: str = HIGH) -> DataFrame:
    """One sketch per key combination, as (keys, n, sketch BINARY), mergeable later.

    Every partition sketches its own rows first, so only sketches of fixed size are shuffled; they
    merge in two stages, so even a key that is in every partition loads no single task. Null and
    NaN values are left out, a null key is a group of its own, keys without a value give no row.
    """
    picked = df.select(*[F.col(f"`{c}`") for c in keys], F.col(f"`{value}`").cast("double").alias("__v")).where(
        F.col("__v").isNotNull() & ~F.isnan("__v"))
    width = len(keys)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        waiting, rows, schema = [], 0, None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                waiting.append(batch)
                rows += batch.num_rows
                schema = batch.schema
            if not waiting or (batch is not None and rows < BUFFER_ROWS):
                continue
            block = pa.Table.from_batches(waiting).combine_chunks()
            waiting, rows = [], 0
            values = block.column(width).to_numpy()
            group = np.zeros(len(values), dtype=np.int64)
            for i in range(width):
                coded = block.column(i).combine_chunks().dictionary_encode("encode")
                coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
                group = np.unique(group * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            order = np.lexsort((values, group))
            values, group = values[order], group[order]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            size = np.diff(np.append(first, len(group)))
            small = size < 2 * k * FIRST_SECTIONS
            # Groups that fit into one buffer are written as they are, all at once.
            if small.any():
                at, n = first[small], size[small]
                inside = np.repeat(small, size)
                owners = [block.column(i).take(pa.array(order[at])).combine_chunks() for i in range(width)]
                yield pa.RecordBatch.from_arrays([*owners, pa.array(n, pa.int64()), _pack(values[inside], n, k, tail)], [*keys, "n", "sketch"])
            for a, n in zip(first[~small], size[~small]):
                key = tuple(block.column(i)[int(order[a])].as_py() for i in range(width))
                if key not in held:
                    held[key] = Sketch(k, tail)
                held[key].add(values[a : a + n])
            if len(held) > HELD:
                yield _batch(schema, held)
                held = {}
        if held:
            yield _batch(schema, held)

    def _batch(schema, held):
        columns = [pa.array([key[i] for key in held], schema.field(i).type) for i in range(width)]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array([s.n for s in held.values()], pa.int64()), pa.array([s.to_bytes() for s in held.values()], pa.binary())],
            [*keys, "n", "sketch"])

    from pyspark.sql import types as T

    schema = T.StructType([df.schema[c] for c in keys] + [T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])
    parts = picked.mapInArrow(sketch, schema)
    return merge_sketches(merge_sketches(parts, keys, by_partition=16), keys)


def merge_sketches(parts: DataFrame, keys: list[str], by_partition: int | None = None) -> DataFrame:
    """Merges sketches of equal keys; with ``by_partition`` each key in that many shares."""
    from pyspark.sql import types as T

    schema = T.StructType([parts.schema[c] for c in keys] + [T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])
    share = [F.pmod(F.spark_partition_id(), F.lit(by_partition)).alias("__share")] if by_partition else []
    grouped = parts.select("*", *share).repartition(*keys, *(["__share"] if by_partition else []))
    grouped = grouped.sortWithinPartitions(*keys, "n")
    width = len(keys)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple, Sketch] | None = None
        types = None

        def done():
            key, s = held
            return pa.RecordBatch.from_arrays(
                [pa.array([key[i]], types[i]) for i in range(width)] + [pa.array([s.n], pa.int64()), pa.array([s.to_bytes()], pa.binary())],
                [*keys, "n", "sketch"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(i) for i in range(width)]
            types = [c.type for c in columns]
            fresh = changes(columns, held[0] if held else None) if columns else np.arange(n) == (0 if not held else -1)
            # A key with a single sketch inside the batch passes as it is; the last one may go on.
            alone = fresh & np.append(fresh[1:], False)
            if alone.any():
                yield pa.RecordBatch.from_arrays([c.take(pa.array(np.flatnonzero(alone))) for c in batch.columns], [*keys, "n", "sketch"])
            blobs = batch.column(width + 1)
            for i in np.flatnonzero(~alone).tolist():
                s = Sketch.from_bytes(blobs[i].as_py())
                if fresh[i]:
                    if held:
                        yield done()
                    held = (key_at(columns, i), s)
                else:
                    held[1].merge(s)
        if held:
            yield done()

    return grouped.select(*keys, "n", "sketch").mapInArrow(merge, schema)


def percentiles(merged: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """The named percentiles of each sketch: keys, n, one column per name."""
    from pyspark.sql import types as T

    schema = T.StructType([merged.schema[c] for c in keys] + [T.StructField("n", T.LongType())]
                          + [T.StructField(name, T.DoubleType()) for name in at])
    width = len(keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [Sketch.from_bytes(b.as_py()).quantiles(list(at.values())) for b in batch.column(width + 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(width + 1)] + [pa.array([r[j] for r in rows], pa.float64()) for j in range(len(at))],
                [*keys, "n", *at])

    return merged.select(*keys, "n", "sketch").mapInArrow(read, schema)
