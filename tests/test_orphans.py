import datetime as dt
import random

from spantrack.operators.orphans import orphan_references

T0 = dt.datetime(2023, 1, 1)
NODES = "id string, loaded_at timestamp_ntz, removed_at timestamp_ntz, key string, at int"
REFS = "ref_table string, row_id long, ref_id string, ref_time timestamp_ntz, key string"


def when(x):
    return None if x is None else T0 + dt.timedelta(minutes=x)


def check(spark, nodes, refs):
    want = {(t, i, r, at) for t, i, r, at in refs if r is not None and not any(
        n == r and a is not None and at is not None and a <= at and (b is None or b > at) for n, a, b in nodes)}
    df = orphan_references(spark.createDataFrame([(t, i, r, when(at), "x") for t, i, r, at in refs], REFS),
                           spark.createDataFrame([(n, when(a), when(b), "x", 1) for n, a, b in nodes], NODES), "id", "loaded_at", "removed_at")
    got = [(r["ref_table"], r["row_id"], r["ref_id"], r["ref_time"]) for r in df.collect()]
    assert sorted(got, key=repr) == sorted([(t, i, r, when(at)) for t, i, r, at in want], key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    ids = ["hot", "a", "b", "ä", "", "z;1", "A", "hot2", None]
    nodes = []
    for _ in range(120):
        a = rng.choice([None, *range(300)])
        nodes.append((rng.choice(ids), a, rng.choice([None, rng.randrange(320)])if rng.random() < 0.7 else (a or 0) + 5))
    refs = [(rng.choice("xy"), rng.randrange(500), rng.choice([*ids, *["hot"] * 8, "none"]), rng.choice([None, *range(320)])) for _ in range(700)]
    check(spark, nodes[::2], refs + refs[:50])
    check(spark, nodes[:9], refs)


def test_hot_id_far_from_its_node(spark):
    check(spark, [("hot", 1, None), ("b", 2, 4)], [("x", i, "hot", 5 + i) for i in range(400)] + [("x", 1, "hot", 0), ("x", 2, "b", 9)])


def test_empty(spark):
    check(spark, [], [("x", 1, "a", 1)])
    check(spark, [("a", 1, None)], [])
