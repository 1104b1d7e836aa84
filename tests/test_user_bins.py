import pytest

from spantrack.errors import InvalidFormatError
from spantrack.operators import user_bins as U
from spantrack.sealed_store import SealedStore


@pytest.fixture(scope="module")
def sequences(spark):
    return spark.createDataFrame([("g", "c", 100, 0), ("g", "d", 50, 1)], "genome string, seqid string, length int, ord int")


def rows(df):
    return sorted((r["seqid"], r["start"], r["end"]) for r in df.collect())


def test_bins(spark, sequences):
    assert rows(U.user_bins(spark, "d", "30", sequences, "g")) == [("d", 0, 30), ("d", 30, 50)]
    assert rows(U.global_bins(sequences, "g")) == [("c", 0, 100), ("d", 0, 50)]
    assert rows(U.minimal_bin(sequences, "g")) == [("c", 0, 1)]


def test_envelope(spark, sequences):
    t = spark.createDataFrame([("g", "c", 5, 9), ("g", "c", 8, 12), ("g", "c", 12, 14), ("g", "d", 40, 60)], "genome string, seqid string, start int, end int")
    assert rows(U.envelope(t, sequences)) == [("c", 5, 12), ("c", 12, 14)]
    assert rows(U.envelope(t, sequences, bounded=False)) == [("c", 5, 12), ("c", 12, 14), ("d", 40, 60)]
    assert len(rows(U.envelope(t, sequences, clustered=False))) == 3


def test_shared_regions(spark, sequences):
    whole = U.global_bins(sequences, "g")
    a = spark.createDataFrame([("g", "c", 5, 20), ("g", "c", 30, 40)], "genome string, seqid string, start int, end int")
    b = spark.createDataFrame([("g", "c", 10, 35)], "genome string, seqid string, start int, end int")
    assert rows(U.shared_regions(whole, whole, sequences)) == [("c", 0, 100), ("d", 0, 50)]
    assert rows(U.shared_regions(whole, a, sequences)) == rows(a)
    assert rows(U.shared_regions(a, b, sequences)) == [("c", 10, 20), ("c", 30, 35)]


def test_filters_and_windows(spark, sequences):
    t = spark.createDataFrame([("g", "c", 5, 9, "loop"), ("g", "c", 18, 22, "stem loop")], "genome string, seqid string, start int, end int, val string")
    assert U.category_filter(t, ["loop"]).count() == 1 and U.category_filter(t, ["loop"], strict=False).count() == 2
    assert "val" not in U.strip_values(t).columns
    with pytest.raises(InvalidFormatError):
        U.segments_only(t.drop("end"))
    bins = U.user_bins(spark, "c", "20", sequences, "g")
    got = U.window_function(t, bins, ["genome", "seqid"], lambda frame: float(len(frame)))
    assert sorted((r["start"], r["val"]) for r in got.collect()) == [(0, 2.0), (20, 1.0)]


def test_sealed_store(spark, tmp_path):
    s = SealedStore(spark, str(tmp_path / "s"))
    s.add_nodes(spark.createDataFrame([(0, 24, 0, 10), (1, 24, 10, 20)], "n long, seqid int, start int, end int"))
    with pytest.raises(InvalidFormatError):
        s.nodes()
    s.add_node_values("score", spark.createDataFrame([(0, 1.5)], "n long, value double"))
    with pytest.raises(InvalidFormatError):
        s.seal()
    s.add_node_values("score", spark.createDataFrame([(1, 2.5)], "n long, value double"))
    s.seal()
    assert s.nodes().count() == 2 and s.nodes(1, 2).first()["start"] == 10 and s.node_values("score").count() == 2
    with pytest.raises(KeyError):
        s.node_values("none")
    with pytest.raises(InvalidFormatError):
        s.add_links(spark.createDataFrame([(0, 0, 1)], "n long, source long, target long"))
    s.unseal()
    s.add_links(spark.createDataFrame([(0, 0, 1)], "n long, source long, target long"))
    s.seal()
    assert s.links().count() == 1
