import pytest

from spantrack.operators.faults import parse_track_lines, split_valid

SCHEMA = "line_id long, genome string, col_spec string, raw_line string, seqid string"
SPEC = "seqid,start,end,value,name"


@pytest.fixture(scope="module")
def sequences(spark):
    return spark.createDataFrame([("g", "chr1", 1000), ("h", "chr2", 5)], "genome string, seqid string, length int")


CASES = {
    'chr1\t5\t10\t1.5\tx': None,
    'chr1\t5\t10\t1.5\tx\r': None,
    '"chr1"\t"5"\t10\tNaN\t"a\tb ""c"""': None,
    'chr1\t005\t1000\t-1e3\t': None,
    'chr1\t5\t10\t1.5\t"x': "quoting",
    'chr1\t5\t1"0\t1.5\tx': "quoting",
    '"a\t"b"\t5': "quoting",
    'chr1\t5\t10\t1.5': "column_count",
    'chr1\t5\t10\t1.5\tx\ty': "column_count",
    'chr2\t1\t2\t1\tx': "seqid",
    ' chr1\t1\t2\t1\tx': "seqid",
    'chr1\t1000\t1001\t1\tx': "start",
    'chr1\t-1\t10\t1\tx': "start",
    'chr1\t５\t10\t1\tx': "start",
    'chr1\t99999999999999999999999\t10\t1\tx': "start",
    'chr1\t5\t5\t1\tx': "end",
    'chr1\t5\t1001\t1\tx': "end",
    'chr1\t5\t1e2\t1\tx': "end",
    'chr1\t5\t10\tinf\tx': "value",
    'chr1\t5\t10\t1e999\tx': "value",
    'chr1\t5\t10\t1.\tx': "value",
    'chr1\t5\t10\t\tx': "value",
    'chr1\t5\t10\tNULL\tx': "value",
}


def test_cases(spark, sequences):
    rows = [(i, "g", SPEC, x, "clash") for i, x in enumerate(CASES)]
    rows += rows + [(900, "g", SPEC, None, ""), (901, "g", SPEC, "   ", ""), (902, "g", SPEC, "# x", ""), (903, "g", SPEC, "track x", ""), (904, "g", SPEC, "", ""), (905, "g", SPEC, "\r", "")]
    valid, bad = split_valid(parse_track_lines(spark.createDataFrame(rows, SCHEMA), sequences))
    assert {r["line_id"]: r["reason"] for r in bad.collect()} == {i: x for i, x in enumerate(CASES.values()) if x}
    assert bad.count() == len({i for i, x in enumerate(CASES.values()) if x})
    good = {r["line_id"]: r for r in valid.collect()}
    assert set(good) == {i for i, x in enumerate(CASES.values()) if not x}
    assert (good[2]["start"], good[2]["end"], good[2]["value"]) == (5, 10, None)
    assert (good[3]["start"], good[3]["value"]) == (5, -1000.0)


def test_nulls_long_and_empty(spark, sequences):
    rows = [(1, None, SPEC, "chr1\t1\t2\t1\tx", ""), (2, "g", None, "chr1\t1\t2\t1\tx", ""), (3, "g", SPEC, "chr1\t5\t10\t1.5\t" + '"' + "y\t" * 200_000 + '"', ""),
            (4, "g", SPEC, "\t" * 100_000, "x"), (5, "g", SPEC, "chr1\t5\t10\t1\t" + "z" * 500_000, ""), (None, "g", SPEC, "chr1\t1\t2\t1", "")]
    valid, bad = split_valid(parse_track_lines(spark.createDataFrame(rows, SCHEMA), sequences))
    assert {r["line_id"]: r["reason"] for r in bad.collect()} == {1: "seqid", 2: "column_count", None: "column_count"}
    assert {r["line_id"] for r in valid.collect()} == {3, 5}
    assert parse_track_lines(spark.createDataFrame([], SCHEMA), sequences).count() == 0
