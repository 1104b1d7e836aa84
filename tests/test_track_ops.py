import math

import pytest
from pyspark.sql import functions as F

from spantrack.errors import ArgumentValueError, IncompatibleTracksError, InvalidFormatError
from spantrack.genome import Genome, auto_bin, parse_regions, parse_size, regions_frame
from spantrack.operators import graph, overlap, randomise, slicing
from spantrack.operators.cluster import cluster
from spantrack.operators.complement import complement
from spantrack.operators.coverage import coverage_runs, per_position
from spantrack.operators.validate import broken_edges, overlapping, regions, repeated_ids, require_none
from spantrack.plans import track_view
from spantrack.regions import display, display_short
from spantrack.types import TRACK_TYPES, TrackFormat, TrackFormatReq

GENOME = Genome("g", {"chr1": 5_000_000, "chrM": 16_571})


def test_track_types():
    assert len(TRACK_TYPES) == 15 and len(set(TRACK_TYPES.values())) == 15


def test_requirements():
    fmt = TrackFormat(dense=False, valued=True, interval=True, linked=False, value_type="number")
    assert fmt.name == "Valued segments"
    assert TrackFormatReq.named("valued segments").is_met_by(fmt) and not TrackFormatReq.named("points").is_met_by(fmt)
    with pytest.raises(IncompatibleTracksError):
        TrackFormatReq(dense=True).merge(TrackFormatReq(dense=False))


def test_regions():
    assert parse_size("100k") == 100_000
    r = parse_regions("chr1:1001-2k, chrM", GENOME)
    assert [(x.start, x.end) for x in r] == [(1000, 2000), (0, 16_571)]
    assert parse_regions("chr1:10k-2m", GENOME)[0].start == 10_000
    assert len(parse_regions("*", GENOME)) == 2
    with pytest.raises(ArgumentValueError):
        parse_regions("chrM:1-20k", GENOME)


def test_bins(spark):
    r = auto_bin(regions_frame(spark, parse_regions("chrM", GENOME)), 10_000).orderBy("start").collect()
    assert [(x["start"], x["end"]) for x in r] == [(0, 10_000), (10_000, 16_571)]


def test_display(spark):
    row = spark.range(1).select(display(F.lit("chr1"), F.lit(100), F.lit(1000), F.lit(1)).alias("a"), display_short(F.lit("chr1"), F.lit(10_000), F.lit(2_000_000)).alias("b")).first()
    assert (row["a"], row["b"]) == ("chr1:101-1000 (Pos)", "chr1:10k-2m")


def test_cluster_merges_values(spark):
    rows = [("c", 0, 10, 1.0, "b", "x", 1), ("c", 5, 8, 2.0, "a", "x", 1), ("c", 10, 12, 3.0, "q", "y", 0), ("c", 11, 20, 3.0, "q", "z", 1), ("c", 30, 31, float("nan"), None, None, None)]
    df = spark.createDataFrame(rows, "seqid string, start int, end int, val double, name string, id string, strand byte")
    got = cluster(df, ["seqid"]).orderBy("start").collect()
    assert [(r["start"], r["end"], r["n_elements"], r["name"], r["id"], r["strand"]) for r in got] == [
        (0, 10, 2, "b|a", "x", 1), (10, 20, 2, "q", "y|z", -1), (30, 31, 1, None, None, None)]
    assert math.isnan(got[0]["val"]) and got[1]["val"] == 3.0


def test_cluster_cuts_long_lists(spark):
    rows = [("c", i, 100 + i, "k%02d" % (i % 30)) for i in range(25)]
    df = spark.createDataFrame(rows, "seqid string, start int, end int, val string")
    assert cluster(df, ["seqid"]).first()["val"] == "k00|..."
    assert cluster(df.limit(0), ["seqid"]).count() == 0


def test_cluster_arrays(spark):
    rows = [("c", 0, 5, [1.0, 2.0]), ("c", 1, 5, [1.0, 3.0]), ("c", 9, 12, [1.0]), ("c", 10, 12, [1.0, 2.0])]
    got = cluster(spark.createDataFrame(rows, "seqid string, start int, end int, val array<double>"), ["seqid"]).orderBy("start").collect()
    assert len(got[0]["val"]) == 2 and all(math.isnan(x) for x in got[0]["val"]) and got[1]["val"] == []


def test_coverage(spark):
    rows = [("c", 1, 4, 2.0), ("c", 2, 6, 3.0), ("c", 8, 9, float("nan")), ("c", 5, 5, 1.0), ("c", None, 5, 1.0)]
    runs = coverage_runs(spark.createDataFrame(rows, "seqid string, start int, end int, val double"), ["seqid"], "val")
    got = {r["pos"]: (r["depth"], r["value"]) for r in per_position(runs, 0, 20).collect()}
    assert got == {1: (1, 2.0), 2: (2, 5.0), 3: (2, 5.0), 4: (1, 3.0), 5: (1, 3.0), 6: (0, 0.0), 7: (0, 0.0), 8: (1, 0.0)}


def test_overlap_join_has_no_nested_loop(spark):
    a = spark.createDataFrame([("c", i * 7, i * 7 + 5 + i % 40) for i in range(200)], "seqid string, start int, end int")
    b = spark.createDataFrame([("c", i * 11, i * 11 + 9) for i in range(150)], "seqid string, start int, end int")
    j = overlap.overlap_join(a, b, ["seqid"], 16)
    assert "NestedLoop" not in j._jdf.queryExecution().executedPlan().toString()
    want = sum(x["start"] < y["end"] and x["end"] > y["start"] for x in a.collect() for y in b.collect())
    assert j.count() == want
    assert overlap.contained_in(a, b, ["seqid"], 16).count() == sum(any(y["start"] <= x["start"] and x["end"] <= y["end"] for y in b.collect()) for x in a.collect())


def test_overlap_join_of_very_different_lengths(spark):
    import random

    rng = random.Random(8)

    def some(n):
        return [(rng.choice("cd"), s, s + rng.choice([0, 1, 15, 16, 17, 300, 4_096, 70_000, 900_000])) for s in (rng.randrange(1_000_000) for _ in range(n))] + [("c", None, 5), ("d", 5, None)]

    one, two = some(300), some(200)
    a, b = (spark.createDataFrame(x, "seqid string, start int, end int") for x in (one, two))
    want = sorted((x, y) for x in one for y in two if None not in x and None not in y and x[0] == y[0] and x[1] < y[2] and x[2] > y[1])
    got = overlap.overlap_join(a, b, ["seqid"], 16).collect()
    assert sorted(((r["seqid"], r["start"], r["end"]), (r["seqid"], r["start_r"], r["end_r"])) for r in got) == want
    held = overlap.contained_in(a, b, ["seqid"], 16).count()
    assert held == sum(None not in x and any(None not in y and x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2] for y in two) for x in one)
    copies = a.where("end is not null and start is not null").agg(F.max(F.col("end") - F.col("start"))).first()[0]
    assert copies == 900_000


def test_counts_of_contained_elements(spark):
    br = spark.createDataFrame([("c", 0, 10), ("c", 20, 30)], "seqid string, start int, end int")
    inside = spark.createDataFrame([("c", 1, 5), ("c", 20, 30), ("c", 9, 10)], "seqid string, start int, end int")
    assert sorted((r["start"], r["n"]) for r in overlap.count_contained(inside, br, ["seqid"]).collect()) == [(0, 2), (20, 1)]
    with pytest.raises(Exception, match="outside of all regions"):
        overlap.count_contained(inside.unionByName(spark.createDataFrame([("c", 8, 12)], inside.schema)), br, ["seqid"]).collect()


def test_elements_placed_by_intensity(spark):
    dense = spark.range(100).selectExpr("'c' as seqid", "cast(id as int) as start", "case when id % 2 = 0 then 0D else 1D + id end as val")
    t = spark.createDataFrame([("c", i, i + 3, "n%d" % i) for i in range(20)], "seqid string, start int, end int, name string")
    got = randomise.place_by_intensity(t, dense, ["seqid"], 5, ["name"]).collect()
    assert len({r["start"] for r in got}) == 20 and all(r["start"] % 2 and r["end"] - r["start"] == 3 for r in got) and {r["name"] for r in got} == {"n%d" % i for i in range(20)}


def test_views_together(spark):
    from spantrack.plans import by_sequence, empty_view, scan_views

    a = spark.createDataFrame([("c", 1)], "seqid string, start int")
    b = spark.createDataFrame([("d", 2, 1.5)], "seqid string, start int, val double")
    assert scan_views([a, b]).count() == 2 and [(s, d.count()) for s, d in by_sequence(scan_views([a, b]))] == [("c", 1), ("d", 1)]
    fmt = TrackFormat.of_schema(b.schema)
    assert empty_view(spark, fmt).columns == ["seqid", "start", "val"] and empty_view(spark, fmt).count() == 0


def test_graphs_must_agree(spark):
    g = spark.createDataFrame([("a",)], "id string")
    with pytest.raises(IncompatibleTracksError):
        graph.merge_graphs(g, g, undirected=(True, False))


def test_bin_sources(spark, tmp_path):
    from spantrack.operators.user_bins import bin_source

    sequences = spark.createDataFrame([("g", "chr1", 1000, 1)], "genome string, seqid string, length int, ord int")
    (tmp_path / "r.bed").write_text("chr1\t0\t20\nchr1\t10\t30\n")
    assert [(r["start"], r["end"]) for r in bin_source(spark, str(tmp_path / "r.bed"), "20", sequences, "g").orderBy("start").collect()] == [(0, 20), (20, 30)]
    assert bin_source(spark, "chr1:1-100", "50", sequences, "g").count() == 2


def test_views(spark):
    t = spark.createDataFrame([("c", 5, 20, 0), ("c", 15, 40, 1), ("c", 50, 60, -1)], "seqid string, start int, end int, strand byte")
    got = track_view(t, "c", 10, 30).orderBy("start").collect()
    assert [(r["rel_start"], r["rel_end"]) for r in got] == [(0, 10), (5, 20)]
    points = track_view(t, "c", 10, 30, TrackFormatReq(interval=False, converter="start")).collect()
    assert sorted(r["start"] for r in points) == [15, 19]
    with pytest.raises(IncompatibleTracksError):
        track_view(t, "c", 10, 30, TrackFormatReq(linked=True))
    assert slicing.sub_slice(10, 30, 2, -3) == (12, 27)


def test_complement(spark):
    t = spark.createDataFrame([("a",), ("b",)], "id string")
    db = spark.createDataFrame([("a", "x", 1.0)], "id string, note string, score double")
    got = {r["id"]: (r["note"], r["score"]) for r in complement(t, db, "id", ["note", "score"]).collect()}
    assert got["a"] == ("x", 1.0) and got["b"][0] == "." and math.isnan(got["b"][1])
    with pytest.raises(InvalidFormatError):
        complement(t, db.union(db), "id", ["note"])


def test_graph(spark):
    t = spark.createDataFrame([("a", ["b", "c"], [1.0, 2.0]), ("b", ["a"], [1.0]), ("c", [], [])], "id string, edges array<string>, weights array<double>")
    e = graph.edge_list(t)
    assert e.count() == 3 and graph.edge_list(t, True).count() == 2
    assert [(r["src"], r["dst"]) for r in graph.asymmetric(e).collect()] == [("a", "c")]
    assert graph.dangling(e, t).count() == 0
    assert graph.weight_matrix(e, complete=True).count() == 9
    assert broken_edges(t, True).count() == 1


def test_validation(spark):
    t = spark.createDataFrame([("c", 0, 5, "a"), ("c", 3, 6, "a"), ("c", 7, 8, "")], "seqid string, start int, end int, id string")
    assert overlapping(t, ["seqid"]).count() == 1 and repeated_ids(t).count() == 2
    br = spark.createDataFrame([("g", "c", 0, 5), ("g", "c", 5, 9)], "genome string, seqid string, start int, end int")
    with pytest.raises(InvalidFormatError):
        require_none(regions(br))


@pytest.mark.parametrize("sampled", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_permutation_keeps_lengths(spark, seed, sampled):
    rows = [("c", i * 10 + i % 3, i * 10 + 3 + i % 5, 0, 400, "n%d" % i) for i in range(30)]
    df = spark.createDataFrame(rows, "seqid string, start int, end int, b0 int, b1 int, name string")
    p = randomise.permute_segments(df, ["seqid"], "b0", "b1", seed, ["name"], sampled).orderBy("start").collect()
    assert sorted((r["end"] - r["start"], r["name"]) for r in p) == sorted((e - s, n) for _, s, e, _, _, n in rows)
    assert all(a["end"] <= b["start"] for a, b in zip(p, p[1:])) and p[0]["start"] >= 0 and p[-1]["end"] <= 400
