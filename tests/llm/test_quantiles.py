import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spantrack.llm.quantiles import HIGH, LOW, Sketch, merge_sketches, percentiles, sketches


@pytest.mark.parametrize("tail", [HIGH, LOW])
@pytest.mark.parametrize("shape", ["random", "sorted", "reverse", "ties"])
def test_error_bound(tail, shape):
    x = np.random.default_rng(1).lognormal(0, 3, 200_000)
    x = {"random": x, "sorted": np.sort(x), "reverse": np.sort(x)[::-1], "ties": np.floor(x)}[shape]
    whole = Sketch(tail=tail)
    for part in np.array_split(x, 17):
        s = Sketch(tail=tail)
        for piece in np.array_split(part, 7):
            s.add(piece)
        whole.merge(Sketch.from_bytes(s.to_bytes()))
    ordered = np.sort(x)
    assert whole.n == len(x) == whole.items()[1].sum()
    assert sum(len(b) for level in whole.levels for b in level) < 8000
    for q in (0.0001, 0.001, 0.01, 0.1, 0.5, 0.9, 0.99, 0.999, 0.9999):
        v = whole.quantiles([q])[0]
        low, high = np.searchsorted(ordered, v, "left") + 1, np.searchsorted(ordered, v, "right")
        error = max(low - q * len(x), q * len(x) - high, 0)
        assert error <= 0.01 * ((1 - q) if tail == HIGH else q) * len(x) + 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(allow_nan=True, allow_infinity=True, width=32), max_size=300))
def test_small_ones_are_exact(values):
    s = Sketch()
    s.add(np.array(values, dtype=float))
    clean = sorted(v for v in values if v == v)
    assert s.n == len(clean)
    if clean:
        assert s.quantiles([0, 0.5, 1]) == [clean[0], clean[max(-(-len(clean) // 2), 1) - 1], clean[-1]]
    else:
        assert s.quantiles([0.5]) == [None]


def test_frame(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "b").alias("chr"), (F.col("id") % 997).cast("double").alias("val"), F.lit(1).alias("n"))
    df = df.unionByName(spark.createDataFrame([("hot", float("nan"), 1), ("hot", None, 1), ("none", None, 1)], df.schema))
    got = {r["chr"]: r for r in percentiles(sketches(df, ["chr"], "val"), ["chr"], {"p50": 0.5, "p99": 0.99}).collect()}
    assert set(got) == {"hot", "b", None} and all(r["n"] == 2000 for r in got.values())
    assert all(abs(r["p50"] - 498) < 12 and abs(r["p99"] - 987) < 3 for r in got.values())
    days = sketches(df.withColumn("day", F.col("val") % 5), ["chr", "day"], "val")
    joined = {r["chr"]: r for r in percentiles(merge_sketches(days, ["chr"]), ["chr"], {"p99": 0.99}).collect()}
    assert joined["hot"]["n"] == 2000 and abs(joined["hot"]["p99"] - 987) < 3
    assert sketches(df.limit(0), ["chr"], "val").count() == 0
