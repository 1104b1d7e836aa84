import random

import numpy as np
import pytest

from spantrack.operators import packed as P
from spantrack.operators.packed import unpack_lists

CASES = {
    "a;b|c": ["a", "b", "c"],
    "a;b;": ["a", "b", None],
    ";0.156": [None, "0.156"],
    "[a, b]": ["a", "b"],
    "a  b\tc": ["a", "b", "c"],
    "'o\"x'; b; 'arm q,r'": ['o"x', "b", "arm q,r"],
    '"o""x"  b': ['o"x', "b"],
    "0.7\t.\t0.2": ["0.7", None, "0.2"],
    '"."; .': [".", None],
    '""; a': ["", "a"],
    "a、；b": ["a", None, "b"],
    "a ; ; b": ["a", None, "b"],
    " {0.04} ": ["0.04"],
    "[(<{a,b}>)]": ["a", "b"],
    "it's": ["it", "s"],
    "a\"b\"c": ["a", "b", "c"],
    '"x\x01y", "\x01"': ["x\x01y", "\x01"],
    ".": [None],
    "  ": [],
    "[]": [],
}


def unpacked(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "el_id long, edges string")
    out = [{} for _ in texts]
    for r in unpack_lists(df, "el_id", ["edges"]).collect():
        assert r["pos"] not in out[r["el_id"]]
        out[r["el_id"]][r["pos"]] = r["item"]
    return out


def test_cases(spark):
    got = unpacked(spark, list(CASES))
    for text, found, want in zip(CASES, got, CASES.values()):
        assert found == {i: x for i, x in enumerate(want) if x is not None}, text


def test_quoted_items_come_back(spark):
    rng = random.Random(2)
    texts, want = [], []
    for _ in range(400):
        q, separator = rng.choice("\"'"), rng.choice([";", ",", " | ", "/", "\t"])
        items = ["".join(rng.choices("ab0.;,| '\"x", k=rng.randrange(1, 7))) for _ in range(rng.randrange(1, 7))]
        texts.append(separator.join(q + x.replace(q, q + q) + q for x in items))
        want.append(dict(enumerate(items)))
    assert unpacked(spark, texts) == want


# A rare separator amid a common one, and lists whose mixes differ though their signature is one.
RARE = [";".join("abc%d" % i for i in range(900)) + ",end", *["a1;b2;c3"] * 30, *['"x,y";b;c'] * 30, "'p q';b|c", *["'p|q';b;c"] * 40]


def test_lists_of_one_signature_share_a_dialect_that_fits_all(spark):
    got = unpacked(spark, RARE)
    assert got[0][900] == "end" and got[61] == {0: "p q", 1: "b", 2: "c"} and got[-1] == {0: "p|q", 1: "b", 2: "c"} and got[40] == {0: "x,y", 1: "b", 2: "c"}


def test_without_the_counts_the_choice_goes_wrong(spark, monkeypatch):
    """The learned lengths decide: with all counts zero the rare separator is taken for a character of its value."""
    monkeypatch.setattr(P, "value_codes", lambda counts, fields: [P.ValueCode(np.zeros(P.N_CLASSES**2))] * fields)
    got = unpacked(spark, RARE)
    assert got[0] != unpacked_by_hand(RARE[0]) and max(got[0]) == 899


def unpacked_by_hand(text):
    return dict(enumerate(text.replace(",", ";").split(";")))


def test_code_lengths():
    counts = np.zeros((P.N_CLASSES, P.N_CLASSES))
    counts[P.EDGE, 0] = counts[0, P.EDGE] = 1000
    code = P.ValueCode(counts)
    assert code.pair_bits[P.EDGE, 0] < 5 < code.pair_bits[P.EDGE, 1] and code.foreign_bits > P.ValueCode(counts * 0).foreign_bits + 7


def test_frame(spark):
    rows = [(1, "a;b", "1,2", "x"), (1, "a;b", "1,2", "x"), (2, None, "", "x"), (3, ".", None, "x"), (None, "q", "1", "x"), (4, ";".join("v%d" % i for i in range(20000)), "", "x"),
            (5, ";".join('"v%d"' % i for i in range(20000)), "", "x")]
    df = spark.createDataFrame(rows, "el_id long, edges string, weights string, field string")
    got = unpack_lists(df.distinct(), "el_id", ["edges", "weights"]).collect()
    assert sorted((r["field"], r["pos"], r["item"]) for r in got if r["el_id"] == 1) == [("edges", 0, "a"), ("edges", 1, "b"), ("weights", 0, "1"), ("weights", 1, "2")]
    assert all(sum(r["el_id"] == i for r in got) == 20000 for i in (4, 5)) and not any(r["el_id"] in (2, 3) for r in got)
    assert sum(r["el_id"] is None for r in got) == 2
    assert unpack_lists(df.where("false"), "el_id", ["edges", "weights"]).count() == 0


def test_many_signatures_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_SIGNATURES", 3)
    test_cases(spark)
