"""Filling containers of fixed capacity with items, at any number of items.

Sizes are whole numbers up to the capacity, so the packing is planned on the histogram of sizes,
whose length is bounded by the capacity and not by the data. The plan is a list of runs: the items
of one size from rank a to rank b go, q to a container, into the containers from c on. Items get
their rank within their size by a distributed count over buckets and look their container up.

Planning: items above a third of the capacity are matched greedily, each largest one with the
largest that still fits beside it, so such a container holds at most two of them; smaller items
then go, in falling size, each into the container with the least room that is enough (best fit).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .bpe import read_ranks, vocabulary_path

DEFAULT_CAPACITY = 2048
_encoders: dict = {}


def token_counts(df: DataFrame, item: str, text: str, path: str | None = None) -> DataFrame:
    """(item, n_tokens) by the byte-level vocabulary at ``path``; null and empty texts have 0."""
    path = path or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            import public_tokenizers
            import tiktoken

            _encoders[path] = tiktoken.Encoding(
                "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
        encode = _encoders[path].encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())],
                ["item", "n_tokens"])

    kind = df.schema[item].dataType.simpleString()
    return df.select(item, text).mapInArrow(count, f"item {kind}, n_tokens long").withColumnRenamed("item", item)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (size, first rank, end rank, first container, items per container)."""
    left = {s: n for s, n in histogram.items() if n}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []
    bins = 0

    def give(size: int, count: int, first_bin: int, per_bin: int) -> None:
        runs.append((size, used[size], used[size] + count, first_bin, per_bin))
        used[size] += count
        left[size] -= count

    def free(room: int, first: int, end: int) -> None:
        if room and end > first:
            if not gaps.get(room):
                gaps[room] = []
                insort(open_gaps, room)
            gaps[room].append((first, end))

    large = sorted(s for s in left if 3 * s > capacity)  # sizes with items left
    while large:
        x = large.pop()
        at = bisect_right(large, capacity - x) - 1  # the largest other size that fits beside x
        if 2 * x <= capacity and left[x] > 1:
            pairs = left[x] // 2
            give(x, 2 * pairs, bins, 2)
            free(capacity - 2 * x, bins, bins + pairs)
            bins += pairs
        while left[x] and at >= 0:
            y = large[at]
            pairs = min(left[x], left[y])
            give(x, pairs, bins, 1)
            give(y, pairs, bins, 1)
            free(capacity - x - y, bins, bins + pairs)
            bins += pairs
            if not left[y]:
                large.pop(at)
                at -= 1
        if left[x]:
            n = left[x]
            give(x, n, bins, 1)
            free(capacity - x, bins, bins + n)
            bins += n
    for s in sorted((s for s in left if 3 * s <= capacity and left[s]), reverse=True):
        while left[s]:
            at = bisect_left(open_gaps, s)
            if at == len(open_gaps):
                per, n = capacity // s, left[s]
                whole = n // per
                if whole:
                    give(s, whole * per, bins, per)
                    free(capacity - per * s, bins, bins + whole)
                    bins += whole
                if n % per:
                    give(s, n % per, bins, per)
                    free(capacity - (n % per) * s, bins, bins + 1)
                    bins += 1
                continue
            room = open_gaps[at]
            first, end = gaps[room].pop()
            if not gaps[room]:
                del gaps[room], open_gaps[at]
            per, n = room // s, left[s]
            whole = min(end - first, n // per)
            if whole:
                give(s, whole * per, first, per)
                free(room - per * s, first, first + whole)
                free(room, first + whole, end)
            else:
                give(s, n, first, per)
                free(room - n * s, first, first + 1)
                free(room, first + 1, end)
    return runs


def fill_containers(sizes: DataFrame, item: str, size: str, capacity: int = DEFAULT_CAPACITY) -> DataFrame:
    """Pieces with their containers: item, piece, first (offset in the item), size, container_id.

    Only an item above the capacity is split: into full pieces and one rest. Items of size 0 (or
    null) take no room: one row with a null container. Repeated and tied items are items of their
    own; an empty table gives no row; extra columns are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = materialise(sizes.select(F.col(f"`{item}`").alias("item"), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("n")))
    pieces = items.where("n > 0").select(
        "item", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {capacity}"))).alias("piece")).select(
        "item", "piece", (F.col("piece") * capacity).alias("first"),
        F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("size"))
    buckets = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("item", "piece"), F.lit(buckets)).cast("int"))
    counts = pieces.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    # At most one row per size.
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(plan(histogram, capacity))
    run_size, run_from, _, run_bin, run_per = (np.array(c, dtype=np.int64) for c in (zip(*runs) if runs else [()] * 5))
    offsets = counts.select("size", "bucket", (F.sum("n").over(
        Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = pieces.withColumn("nth", F.row_number().over(Window.partitionBy("bucket", "size").orderBy("item", "piece")))
    ranked = ranked.join(offsets, ["size", "bucket"]).select(
        "item", "piece", "first", "size", (F.col("before") + F.col("nth") - 1).alias("rank"))
    start_of = np.searchsorted(run_size, np.arange(capacity + 2))
    total = int(sum(histogram.values())) + 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = run_size * total + run_from if len(run_size) and capacity * total < 2**62 else None
        for batch in batches:
            s = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(4).to_numpy(zero_copy_only=False)
            if keys is not None:
                at = np.searchsorted(keys, s * total + rank, side="right") - 1
            else:
                at = np.array([start_of[x] + np.searchsorted(run_from[start_of[x]:start_of[x + 1]], r, side="right") - 1
                               for x, r in zip(s, rank)], dtype=np.int64)
            container = run_bin[at] + (rank - run_from[at]) // run_per[at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(4)], pa.array(container, pa.int64())], ["item", "piece", "first", "size", "container_id"])

    kind = items.schema["item"].dataType.simpleString()
    placed = ranked.mapInArrow(assign, f"item {kind}, piece long, first long, size long, container_id long")
    empty = items.where("n <= 0").select(
        "item", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("size"),
        F.lit(None).cast("long").alias("container_id"))
    return placed.unionByName(empty).withColumnRenamed("item", item)
