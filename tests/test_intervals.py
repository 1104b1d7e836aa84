import random

import pytest

from spantrack.operators.intervals import covered_and_gaps, label_islands

SCHEMA = "k string, start int, end int, kind string"


def brute(rows, touch=True):
    out = []
    for k in {r[0] for r in rows}:
        segments = sorted((s, e) for kk, s, e in rows if kk == k and s is not None and e is not None and e > s)
        periods = []
        for s, e in segments:
            if periods and (s <= periods[-1][1] if touch else s < periods[-1][1]):
                periods[-1][1] = max(periods[-1][1], e)
            else:
                periods.append([s, e])
        out += [(k, "period", *p) for p in periods]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:]) if b[0] > a[1]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("touch", [True, False])
@pytest.mark.parametrize("seed", range(3))
def test_random_with_a_heavy_entity(spark, seed, touch):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        k = rng.choice(["hot"] * 6 + ["a", "b", None])
        s = rng.choice([None, *range(0, 900, 3)]) if rng.random() < 0.1 else rng.randrange(900)
        e = None if rng.random() < 0.05 else (s or 0) + rng.choice([-2, 0, 1, 2, 3, 60])
        rows.append((k, s, e))
    rows += rows[:40]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = sorted(((r["k"], r["kind"], r["start"], r["end"]) for r in covered_and_gaps(df, ["k"], "start", "end", touch).collect()), key=repr)
    assert got == brute(rows, touch)


def test_one_island_over_all_partitions(spark):
    rows = [("a", i, i + 2) for i in range(300)] + [("a", 0, 1000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert [tuple(r) for r in covered_and_gaps(df, ["k"], "start", "end").collect()] == [("a", "period", 0, 1000)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert covered_and_gaps(df, ["k"], "start", "end").count() == 0
    assert label_islands(df, ["k"], "start", "end").count() == 0


def test_labels_keep_all_rows(spark):
    rows = [("a", i % 50 * 4, i % 50 * 4 + 1 + i % 7, "x") for i in range(200)] + [("a", None, 3, "x"), ("a", 5, 5, "x"), (None, 1, 2, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = label_islands(df, ["k"], "start", "end").collect()
    assert len(got) == len(rows)
    assert sum(r["island"] is None for r in got) == 2
    islands = {(r[0], r[2], r[3]) for r in brute([r[:3] for r in rows], False) if r[1] == "period"}
    for r in got:
        if r["island"] is not None:
            assert any(k == r["k"] and a == r["island"] and a <= r["start"] and r["end"] <= b for k, a, b in islands)
