import random

import pytest
from pyspark.sql import functions as F

from spantrack.llm.runs import collapse_runs, latest_version

SCHEMA = "el_id long, k string, start int, end int, val double, pid int, seq int"


def brute(rows):
    out, by = [], {}
    for r in rows:
        if None not in (r[1], r[2], r[3]):
            by.setdefault(r[1], []).append(r)
    for k, own in by.items():
        own.sort(key=lambda r: (r[2], r[3], r[0]))
        run = [own[0]]
        for a, b in zip(own, own[1:] + [None]):
            if b is not None and a[3] == b[2] and a[4] is not None and b[4] is not None and abs(a[4] - b[4]) <= 0.05:
                run.append(b)
                continue
            if len(run) > 1:
                out.append((k, run[0][2], run[-1][3], len(run), sum(r[3] - r[2] for r in run)))
            run = [b]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    rows, at = [], {"hot": 0, "a": 0, "b": 0}
    for i in range(400):
        k = rng.choice(["hot"] * 5 + ["a", "b"])
        start = at[k] + (rng.random() < 0.1)
        at[k] = start + rng.randrange(1, 4)
        v = rng.choice([1.0, 1.0, 1.0, 1.04, 1.09, None, float("nan")])
        rows.append((i, k, start, at[k], v, 1, 1))
    rows += [(900, None, 1, 2, 1.0, 1, 1), (901, "a", None, 2, 1.0, 1, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in collapse_runs(df, ["k"], "start", "end", "val", 0.05, "el_id").collect())
    clean = [(r[0], r[1], r[2], r[3], None if r[4] is None or r[4] != r[4] else r[4]) for r in rows]
    assert got == brute(clean)


def test_one_run_over_all_partitions(spark):
    df = spark.createDataFrame([(i, "a", i, i + 1, 2.0, 1, 1) for i in range(300)], SCHEMA)
    assert [tuple(r) for r in collapse_runs(df, ["k"], "start", "end", "val", 0.05, "el_id").collect()] == [("a", 0, 300, 300, 300)]
    assert collapse_runs(df.limit(0), ["k"], "start", "end", "val", 0.05, "el_id").count() == 0


def test_latest_version(spark):
    df = spark.createDataFrame([(1, "a", 0, 1, 1.0, 1, 1), (1, "a", 0, 1, 1.0, 2, 1), (None, "a", 5, 6, 1.0, 1, 1), (None, "a", 5, 6, 1.0, 1, 1)], SCHEMA)
    got = latest_version(df, "el_id", "pid", ["k", "start", "end", "val"])
    assert got.count() == 3 and got.where(F.col("el_id") == 1).count() == 1
