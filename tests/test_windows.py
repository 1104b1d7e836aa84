import random

import pytest

from spantrack.operators.windows import LAG, LAST, LEAD, MAX_BEFORE, ROW, SUM, SUM_AT, ordered_values

ADDS = {"before": (LAG, "t"), "after": (LEAD, "o"), "total": (SUM, "v"), "share": (SUM, "x"), "most": (MAX_BEFORE, "v"), "place": (ROW, None), "known": (LAST, "m"), "then": (SUM_AT, ("v", "m"))}


@pytest.mark.parametrize("heavy", [1, 30])
def test_against_brute_force(spark, heavy):
    rng = random.Random(heavy)
    rows = [(rng.choice(["hot"] * heavy + ["a", None]), i, rng.choice([None, -3, 2, 9]), 0.5, f"t{i}", rng.choice([None] * 20 + [f"m{i}"])) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int, x double, t string, m string")
    got = {r["o"]: r for r in ordered_values(df, ["k"], ["o"], ADDS).collect()}
    assert len(got) == 300
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for i, r in enumerate(own):
            g = got[r[1]]
            seen = [x[2] for x in own[:i] if x[2] is not None]
            assert g["before"] == (own[i - 1][4] if i else None) and g["after"] == (own[i + 1][1] if i + 1 < len(own) else None)
            assert g["total"] == sum(x[2] or 0 for x in own[: i + 1]) and g["share"] == 0.5 * (i + 1)
            marks = [j for j in range(i + 1) if own[j][5] is not None]
            assert g["known"] == (own[marks[-1]][5] if marks else None)
            assert g["then"] == (sum(x[2] or 0 for x in own[: marks[-1] + 1]) if marks else 0)
            assert g["most"] == (max(seen) if seen else None) and g["place"] == i + 1


def test_empty(spark):
    df = spark.createDataFrame([], "k string, o int, v int, x double, t string, m string")
    assert ordered_values(df, ["k"], ["o"], ADDS).count() == 0
