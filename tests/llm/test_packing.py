import random

import pytest
from hypothesis import given, settings, strategies as st

from spantrack.llm.packing import fill_containers, plan, token_counts


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.lists(st.tuples(st.integers(1, 60), st.integers(1, 40)), max_size=25))
def test_plan(capacity, pairs):
    histogram = {}
    for s, n in pairs:
        if s <= capacity:
            histogram[s] = histogram.get(s, 0) + n
    fill, seen, large = {}, set(), {}
    for size, a, b, first, per in plan(histogram, capacity):
        for r in range(a, b):
            c = first + (r - a) // per
            fill[c] = fill.get(c, 0) + size
            large[c] = large.get(c, 0) + (3 * size > capacity)
            assert (size, r) not in seen
            seen.add((size, r))
    assert len(seen) == sum(histogram.values())
    assert max(fill.values(), default=0) <= capacity and max(large.values(), default=0) <= 2
    # Best fit decreasing never needs more than 3/2 of the least number of containers.
    least = -(-sum(s * n for s, n in histogram.items()) // capacity)
    assert len(fill) <= max(1.7 * least + 1, sum(n for s, n in histogram.items() if 2 * s > capacity) * 1.5 + 1)


def test_plan_of_a_long_context_is_quick():
    import time

    rng = random.Random(4)
    histogram = {s: rng.randrange(1, 50) for s in range(1, 65_537)}
    began = time.time()
    runs = plan(histogram, 65_536)
    assert time.time() - began < 20 and sum(b - a for _, a, b, _, _ in runs) == sum(histogram.values())


@pytest.mark.parametrize("capacity", [1, 10, 1000])
def test_frame(spark, capacity):
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 3, 3, 3, 7, 10, 15, 25]) for _ in range(200)] + [None]
    df = spark.createDataFrame([(i, s, 1, 1) for i, s in enumerate(sizes)], "doc_id int, n_tokens int, piece int, bucket int")
    got = fill_containers(df, "doc_id", "n_tokens", capacity).collect()
    fill, by = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        if r["container_id"] is not None:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["size"]
    assert max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))
    for i, s in enumerate(sizes):
        own = sorted(by[i], key=lambda r: r["piece"])
        assert sum(r["size"] for r in own) == (s or 0)
        assert len(own) == max(-(-(s or 0) // capacity), 1)
        assert [r["first"] for r in own] == [k * capacity for k in range(len(own))]


def test_hot_size_and_empty(spark):
    df = spark.createDataFrame([(i, 5) for i in range(500)], "doc_id int, n_tokens int")
    got = fill_containers(df, "doc_id", "n_tokens", 10)
    assert got.count() == 500 and got.select("container_id").distinct().count() == 250
    assert fill_containers(df.limit(0), "doc_id", "n_tokens", 10).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "x " * 50_000)], "doc_id int, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] >= 50_000
