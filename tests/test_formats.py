import math

import pytest
from pyspark.sql import functions as F

from spantrack.catalog import Catalog
from spantrack.errors import EmptySourceError, InvalidFormatError
from spantrack.header_tools import expand_header, infer_columns, sort_track, standardise
from spantrack.sinks import formats as out
from spantrack.sinks import headed as headed_out
from spantrack.sinks.lines import number_text
from spantrack.sources import formats as P
from spantrack.sources import headed as H
from spantrack.sources.lines import keep_valid, lines_of


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("ord").collect()]


def test_bed(spark):
    d = P.bed(lines_of(spark, "f", ["track name=x", "# c", "chr1\t5\t9\tn\t500\t+", "chr1\t5\t9\tn\t2000\t+", "chr1\t9\t9", "chr1\t1\t2", "chr1\t1"]))
    assert rows(d, "start", "end", "error") == [(5, 9, None), (5, 9, "score"), (9, 9, "end"), (1, 2, None), (1, None, "column count")]
    assert P.uneven_files(d).count() == 1
    assert keep_valid(d, "PERMISSIVE").count() == 2
    with pytest.raises(Exception, match="invalid line"):
        keep_valid(d, "FAILFAST").collect()


def test_wig_kinds(spark):
    fixed = P.wig(lines_of(spark, "a", ["track type=wiggle_0", "fixedStep chrom=c start=11 step=1", "1.5", "nan", "fixedStep chrom=c start=13", "2"]))
    assert rows(fixed, "start", "end") == [(10, 11), (11, 12), (12, 13)]
    assert P.wig_kind(fixed).first()["kind"] == "function"
    assert [(r["start"], r["end"]) for r in P.wig_regions(fixed).collect()] == [(10, 13)]
    variable = P.wig(lines_of(spark, "b", ["variableStep chrom=c span=5", "11 1", "31 2"]))
    assert rows(variable, "start", "end") == [(10, 15), (30, 35)] and P.wig_kind(variable).first()["kind"] == "valued segments"
    assert rows(P.wig(lines_of(spark, "b", ["1 2"])), "error") == [("no declaration",)]


def test_gff(spark):
    d = P.gff(lines_of(spark, "f", ["##gff-version 3", "c%20d\ts\tgene\t11\t20\t.\t+\t.\tID=a;Name=b+c", "##FASTA", ">c", "ACGT"]))
    r = d.collect()
    assert len(r) == 1 and (r[0]["seqid"], r[0]["start"], r[0]["end"], r[0]["id"], r[0]["name"]) == ("c d", 10, 20, "a", "b+c")


def test_fasta(spark):
    d = P.fasta(lines_of(spark, "f", [">c x", "ACG", "T", ">d", "GG"]))
    assert [(r["seqid"], r["start"], r["val"]) for r in d.orderBy("seqid", "start").collect()] == [("c", 0, "A"), ("c", 1, "C"), ("c", 2, "G"), ("c", 3, "T"), ("d", 0, "G"), ("d", 1, "G")]
    text = [r["line"] for r in out.fasta(d).orderBy("k_region", "k_start", "k_end").collect()]
    assert text == [">c 1-4", "ACGT", ">d 1-2", "GG"]


def test_microarray(spark):
    head = 'track type="array" expScale=3.0 expStep=0.5 expNames="a,b,c,"'
    d = P.microarray(lines_of(spark, "f", [head, "c 5 9 n 500 - 5 9 0 1 4, 0, 2 0,2, 0.5,1.5,", "c 5 9 n 500 - 5 9 0 1 4, 0, 2 0,7, 0.5,1.5,"]))
    r = d.orderBy("ord").collect()
    assert r[0]["error"] is None and r[0]["val"][0] == 0.5 and math.isnan(r[0]["val"][1]) and r[1]["error"] == "experiment id"


def test_headed(spark):
    text = ["##Track type: linked step function", "##Edge weights: true", "###id\tend\tvalue\tedges", "####seqid=chr1; start=1000; end=2000",
            "1\t1250\t10\t4=0.4", "2\t1500\t7\t.", "####seqid=chr1; start=3000; end=4000", "3\t3250\t.\t1=.3;2=1"]
    lines = lines_of(spark, "f", text)
    d = H.parse(lines, H.load_header(lines))
    assert rows(d, "seqid", "start", "end", "edges", "error") == [("chr1", 1000, 1250, ["4"], None), ("chr1", 1250, 1500, [], None), ("chr1", 3000, 3250, ["1", "2"], None)]
    with pytest.raises(InvalidFormatError):
        H.parse_header(["##track type: points", "###seqid\tstart\tend"])
    with pytest.raises(InvalidFormatError):
        H.parse_header(["###seqid\tstart\tend", "##track type: segments"])


def test_fixed_gap_and_lines(spark):
    lines = lines_of(spark, "f", ["##subtype url: fasta", "####seqid=s", "ACG", "T"])
    assert rows(H.parse(lines, H.load_header(lines)), "start", "val") == [(0, "A"), (1, "C"), (2, "G"), (3, "T")]
    lines = lines_of(spark, "f", ["##track type: valued segments", "##fixed length: 50", "##fixed gap size: 50", "###value", "####seqid=s; start=200; end=400", "1", "2"])
    assert rows(H.parse(lines, H.load_header(lines)), "start", "end") == [(200, 250), (300, 350)]


def test_numbers(spark):
    values = [1.0, 1234.567, 0.00012345, float("nan"), -2.5, 0.0, 123456.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(number_text(F.col("v"))).collect()]
    assert got == ["1.0", "1235.0", "0.0001234", ".", "-2.5", "0.0", "123500.0"] or got[2] in ("0.0001234", "0.0001235")


@pytest.mark.parametrize("name", ["bed", "bedgraph", "valued.bed", "gff", "wig"])
def test_round_trip(spark, name):
    df = spark.createDataFrame([("c", 10, 20, 1.5), ("c", 30, 40, 2.5), ("d", 1, 11, 3.0)], "seqid string, start int, end int, val double")
    text = [r["line"] for r in out.compose(df, name).orderBy("k_region", "k_start", "k_row").collect()]
    back = P.parser_for("x." + name)(lines_of(spark, "f", text))
    assert {(r["seqid"], r["start"], r["end"]) for r in back.where("error is null").collect()} == {("c", 10, 20), ("c", 30, 40), ("d", 1, 11)}


def test_catalog(spark, tmp_path):
    source = tmp_path / "a.valued.bed"
    source.write_text("".join(f"chr1\t{s}\t{s + 10}\tn\t{v}\t+\n" for s, v in [(0, 1.0), (5, 2.0), (100, 3.0)]) + "chrQ\t1\t2\tn\t1\t+\n")
    sequences = spark.createDataFrame([("g", "chr1", 1000, 1)], "genome string, seqid string, length int, ord int")
    cat = Catalog(spark, str(tmp_path / "store"), sequences)
    info = cat.ingest(str(source), "g", "Genes:all")
    assert info.counts == {"raw": 3, "clustered": 2} and cat.genomes() == ["g"] and cat.tracks("g") == ["Genes:all"]
    assert not cat.is_stale("g", "Genes:all", str(source))
    assert {r["name"]: r["n"] for r in cat.counts_by_name("g").collect()} == {"Genes": 3, "Genes:all": 3}
    from spantrack.genome import Region

    assert cat.view("g", "Genes:all", Region("g", "chr1", 12, 50)).count() == 1
    cat.export(str(tmp_path / "out"), "g", "Genes:all", "bedgraph", allow_overlaps=False)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "track type=bedGraph\nchr1\t0\t15\t.\nchr1\t100\t110\t3.0\n"
    cat.export(str(tmp_path / "out2"), "g", "Genes:all", "headed", regions="chr1:1-12")
    assert cat.rename("g", "Genes", "Loci") == ["Loci:all"] and cat.tracks("g") == ["Loci:all"]
    cat.remove("g", "Loci:all")
    assert cat.tracks("g") == []
    (tmp_path / "e.bed").write_text("# nothing\n")
    with pytest.raises(EmptySourceError):
        cat.ingest(str(tmp_path / "e.bed"), "g", "none")


def test_header_tools(spark):
    t = spark.createDataFrame([("c", 5, 9), ("c", 1, 6)], "seqid string, start int, end int")
    s = standardise(t, ["start"])
    assert [r["id"] for r in s.orderBy("start").collect()] == ["c-0", "c-1"]
    h = expand_header(t.withColumn("n", F.col("start")), ["n"])
    assert h["track type"] == "segments" and h["sorted elements"] and not h["no overlapping elements"]
    assert [r["start"] for r in sort_track(t).collect()] == [1, 5]
    cells = spark.createDataFrame([("1", "1.5,2", "a", "."), (".", "3,.", "b", ".")], "a string, b string, c string, d string")
    kinds = {r["column"]: (r["value_type"], r["dimension"]) for r in infer_columns(cells, cells.columns).collect()}
    assert kinds == {"a": ("binary", "scalar"), "b": ("number", "pair"), "c": ("character", "scalar"), "d": ("number", "scalar")}
    lines = headed_out.compose(s, headed_out.header_for(s))
    assert lines.count() == 2 and headed_out.fitting_subtypes(headed_out.header_for(t)) == ["bed3"]
