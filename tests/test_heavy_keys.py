import math
import random

import pytest
from pyspark.sql import functions as F

from spantrack.operators.heavy_keys import heavy_keys, per_key_summary

SCHEMA = "chr string, start int, val double, el_id long, key string, pos int"


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(500):
        k = rng.choice(["hot"] * 5 + ["a", "b", None])
        v = rng.choice([None, float("nan"), float("inf"), 1.25, -3.5, rng.random() * 10])
        rows.append((k, rng.choice([None, *range(0, 400, 7)]), v, rng.randrange(50), "x", 1))
    got = {r["key"]: r for r in per_key_summary(spark.createDataFrame(rows, SCHEMA), "chr", "start", "val", "el_id").collect()}
    assert set(got) == {r[0] for r in rows}
    for k, r in got.items():
        own = [x for x in rows if x[0] == k]
        pos = sorted(x[1] for x in own if x[1] is not None)
        vals = [x[2] for x in own if x[2] is not None and not math.isnan(x[2])]
        assert r["n_rows"] == len(own) and r["n_starts"] == len(set(pos)) and r["n_val"] == len(vals)
        assert (r["first_start"], r["last_start"]) == (pos[0], pos[-1])
        assert r["max_step"] == max(b - a for a, b in zip(pos, pos[1:]))
        assert (r["min_val"], r["max_val"]) == (min(vals), max(vals))
        assert r["sum_milli"] == sum(math.floor(v * 1000) for v in vals if math.isfinite(v))


def test_the_sum_does_not_wrap(spark):
    rows = [("a", i, v, i, "", 0) for i, v in enumerate([1e17] * 500 + [-1e17] * 100 + [0.25, 3.0e25, -3.0e25])] + [("b", 1, -1e17, 1, "", 0)] * 3
    got = {r["key"]: r for r in per_key_summary(spark.createDataFrame(rows, SCHEMA), "chr", "start", "val", "el_id").collect()}
    assert int(got["a"]["sum_milli"]) == 400 * 10**20 + 250 and int(got["b"]["sum_milli"]) == -3 * 10**20
    with pytest.raises(Exception, match="too large"):
        per_key_summary(spark.createDataFrame([("a", 1, 1e300, 1, "", 0)], SCHEMA), "chr", "start", "val", "el_id").collect()


def test_a_million_keys(spark):
    df = spark.range(1_200_000).selectExpr("cast(id % 1000000 as string) as chr", "cast(id as int) as start", "1.5D as val", "id as el_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        row = per_key_summary(df, "chr", "start", "val", "el_id").agg(F.count("*"), F.sum("n_rows"), F.sum("sum_milli"), F.max("max_step")).first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    assert (row[0], row[1], int(row[2]), row[3]) == (1_000_000, 1_200_000, 1_800_000_000, 1_000_000)


def test_heavy(spark):
    rows = [("a", 1, 1.0, i, "", 0) for i in range(96)] + [("b", 1, 1.0, i, "", 0) for i in range(4)] + [(None, 1, 1.0, 1, "", 0)] * 10
    found = heavy_keys(spark.createDataFrame(rows, SCHEMA), "chr", "start", "val", "el_id", 4).collect()
    assert [(r["key"], r["n_rows"], r["all_rows"]) for r in found] == [("a", 96, 110)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert per_key_summary(df, "chr", "start", "val").count() == 0
    assert heavy_keys(df, "chr", "start", "val", "el_id", 4).count() == 0
