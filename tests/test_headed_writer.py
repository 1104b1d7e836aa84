from spantrack.sinks import headed as W
from spantrack.sources import headed as H
from spantrack.sources.lines import lines_of


def text_of(out, h):
    rows = out.orderBy("k_region", "k_kind", "k_start", "k_end", "k_row").collect()
    return [*W.header_lines(h), *[r["line"] for r in rows]]


def back(spark, text):
    lines = lines_of(spark, "f", text)
    d = H.parse(lines, H.load_header(lines))
    return [r for r in d.where("error is null").orderBy("ord", "part").collect()]


def test_fixed_length_and_gap(spark):
    br = spark.createDataFrame([(0, "c", 100, 160), (1, "c", 200, 225)], "br_idx int, seqid string, start int, end int")
    t = spark.createDataFrame([(0, "c", 100 + 15 * i, 110 + 15 * i, float(i)) for i in range(4)] + [(1, "c", 200, 210, 9.0), (1, "c", 215, 225, 8.0)],
                              "br_idx int, seqid string, start int, end int, val double")
    h = W.extended_header(t.drop("br_idx"), W.header_for(t.drop("br_idx")), br)
    h.columns.remove("seqid")
    assert h["fixed length"] == 10 and h["fixed gap size"] == 5 and h.columns == ["value"]
    got = back(spark, text_of(W.compose(t, h, br), h))
    assert [(r["start"], r["end"], r["val"]) for r in got] == [(100, 110, 0.0), (115, 125, 1.0), (130, 140, 2.0), (145, 155, 3.0), (200, 210, 9.0), (215, 225, 8.0)]
    uneven = t.where("val <> 1")
    assert "fixed length" not in W.extended_header(uneven.drop("br_idx"), W.header_for(uneven.drop("br_idx")), br).given


def test_a_subtype_is_found_and_its_order_kept(spark):
    t = spark.createDataFrame([("c", 1, 5, 1.0, "n", "x")], "seqid string, start int, end int, val double, name string, more string")
    h = W.extended_header(t, W.header_for(t))
    assert h.columns == ["seqid", "start", "end", "name", "value", "more"] and h["subtype url"] == "bed5"
    got = back(spark, text_of(W.compose(t, h), h))
    assert [(r["seqid"], r["start"], r["end"], r["val"], r["name"], r["more"]) for r in got] == [("c", 1, 5, 1.0, "n", "x")]


def test_fixed_size_lines(spark):
    br = spark.createDataFrame([(0, "c", 10, 140), (1, "d", 0, 3)], "br_idx int, seqid string, start int, end int")
    letters = "ACGT" * 40
    t = spark.createDataFrame([(0, p, letters[p]) for p in range(10, 140)] + [(1, p, "N") for p in range(3)], "br_idx int, start int, val string")
    h = H.Header()
    h.values |= {"track type": "function", "value type": "character", "fixed-size data lines": True, "data line size": 1}
    h.given, h.columns = ["track type", "value type", "fixed-size data lines", "data line size"], ["value"]
    text = text_of(W.compose_fixed_lines(t, h, br), h)
    assert [len(x) for x in text[6:9]] == [60, 60, 10]
    got = back(spark, text)
    assert [(r["seqid"], r["start"], r["val"]) for r in got] == [("c", p, letters[p]) for p in range(10, 140)] + [("d", p, "N") for p in range(3)]
