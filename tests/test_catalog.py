import zipfile

import pytest

from spantrack.__main__ import main
from spantrack.catalog import Catalog
from spantrack.config import Config
from spantrack.errors import BoundingRegionsNotAvailableError, InvalidFormatError, OutsideBoundingRegionError
from spantrack.genome import Region
from spantrack.sources import headed as H
from spantrack.sources.lines import lines_of


@pytest.fixture(scope="module")
def sequences(spark):
    return spark.createDataFrame([("g", "chr1", 10_000, 1), ("g", "chr2", 5_000, 2)], "genome string, seqid string, length int, ord int")


STEP = ["##track type: step function", "###end\tvalue", "####seqid=chr1; start=1000; end=2000", "1250\t1", "2000\t2", "####seqid=chr1; start=3000; end=4000", "4000\t.", ""]


def write(path, lines):
    path.write_text("\n".join(lines))
    return str(path)


def test_regions_are_stored_and_asked(spark, tmp_path, sequences):
    cat = Catalog(spark, str(tmp_path / "s"), sequences)
    info = cat.ingest(write(tmp_path / "a.headed", STEP), "g", "steps")
    assert info.n_regions == 2 and info.counts["raw"] == 3
    got = [(r["start"], r["end"], r["el_count"], r["start_idx"], r["end_idx"]) for r in cat.regions("g", "steps").orderBy("start").collect()]
    assert got == [(1000, 2000, 2, 0, 2), (3000, 4000, 1, 2, 3)]
    assert cat.view("g", "steps", Region("g", "chr1", 1300, 1900)).count() == 1
    with pytest.raises(OutsideBoundingRegionError):
        cat.view("g", "steps", Region("g", "chr1", 1900, 3100))
    again = cat.ingest(write(tmp_path / "a.headed", STEP[:4] + [""]), "g", "steps", force=True)
    assert again.version == 2 and again.n_regions == 1 and cat.track("g", "steps").count() == 1
    cat.ingest_track("g", "steps", "copy", lambda d: d.drop("val"))
    assert cat.info("g", "copy").track_type == "Segments" and cat.info("g", "copy").n_regions == 1


@pytest.mark.parametrize("lines", [
    ["##track type: linked points", "###seqid\tstart\tid\tedges", "chr1\t5\ta\tb", "chr1\t6\ta\t."],
    ["##track type: linked points", "###seqid\tstart\tid\tedges", "chr1\t5\ta\tq", "chr1\t6\tb\t."],
    ["##track type: linked points", "##undirected edges: true", "###seqid\tstart\tid\tedges", "chr1\t5\ta\tb", "chr1\t6\tb\t."],
    ["##no overlapping elements: true", "###seqid\tstart\tend", "chr1\t5\t9", "chr1\t8\t12"],
    ["##sorted elements: true", "###seqid\tstart\tend", "chr1\t8\t12", "chr1\t5\t7"],
    ["##circular elements: true", "###seqid\tstart\tend", "chr1\t8\t2"],
    ["##track type: valued segments", "##value dimension: list", "###seqid\tstart\tend\tvalue", "chr1\t8\t12\t1,2"],
    ["##track type: valued segments", "##value dimension: vector", "###seqid\tstart\tend\tvalue", "chr1\t8\t12\t1,2", "chr1\t9\t12\t1,2,3"],
    ["###seqid\tstart\tend", "####seqid=chr1; start=0; end=10", "chr1\t5\t20"],
    ["###seqid\tstart\tend", "####genome=g", "chr1\t5\t9", "####seqid=chr1; start=0; end=10", "chr1\t5\t9"],
    ["###seqid\tstart\tend", "####seqid=chr1; start=0; end=10", "chr1\t5\t9", "####seqid=chr1; start=10; end=20", "chr1\t15\t19"],
    ["###seqid\tstart\tend", "####seqid=chr1; start=0; end=ten", "chr1\t5\t9"],
    ["chr1\t5\t9", "###seqid\tstart\tend"],
], ids=range(13))
def test_what_breaks_a_rule_is_refused(spark, tmp_path, sequences, lines):
    cat = Catalog(spark, str(tmp_path / "s"), sequences)
    with pytest.raises(Exception, match="V1|V2|circular|lists|outside region|region|header|stored"):
        cat.ingest(write(tmp_path / "a.headed", [*lines, ""]), "g", "x")
    assert cat.tracks("g") == []


def test_adjacent_wiggle_blocks_are_refused(spark, tmp_path, sequences):
    cat = Catalog(spark, str(tmp_path / "s"), sequences)
    with pytest.raises(InvalidFormatError, match="adjacent"):
        cat.ingest(write(tmp_path / "a.wig", ["fixedStep chrom=chr1 start=1", "1", "2", "fixedStep chrom=chr1 start=3", "1", ""]), "g", "w")
    info = cat.ingest(write(tmp_path / "b.wig", ["fixedStep chrom=chr1 start=1", "1", "2", "fixedStep chrom=chr1 start=9", "1", ""]), "g", "w")
    assert info.n_regions == 2


def test_header_keyword(spark):
    lines = lines_of(spark, "f", ["##own version: 1.0", "##own subtype: x", "###seqid\tstart\tend", "c\t1\t2"])
    h = H.load_header(lines, "own")
    assert h["subtype"] == "x" and not h.warnings and H.load_header(lines).warnings
    assert Config.of(spark).max_concat == 20


def test_batch_export(spark, tmp_path, sequences, capsys):
    cat = Catalog(spark, str(tmp_path / "s"), sequences)
    bed = write(tmp_path / "a.bed", ["chr1\t5\t9", "chr1\t100\t300", "chr2\t1\t2", ""])
    cat.ingest(bed, "g", "A:b")
    with pytest.raises(BoundingRegionsNotAvailableError):
        cat.regions("g", "A:b")
    names = cat.export_regions(str(tmp_path / "out"), "g", "A:b", "bed", "chr1:1-200,chr2", zipped=True)
    assert names == ["chr1_1-200", "chr2_1-5000"]
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        text = z.read("chr1_1-200.bed").decode().splitlines()
        assert [x.split("\t")[:3] for x in text] == [["chr1", "5", "9"], ["chr1", "100", "200"]] and len(z.namelist()) == 2
    assert cat.export_tracks(str(tmp_path / "all"), "g", ["A:b"], "bed") == ["A__b"]
    root = ["--root", str(tmp_path / "s"), "--genome", "g"]
    assert main(["tracks", *root], spark) == 0 and capsys.readouterr().out == "A:b\n"
    assert main(["info", *root, "--track", "A:b"], spark) == 0 and "counts: {'raw': 3, 'clustered': 3}" in capsys.readouterr().out
    assert main(["info", *root, "--track", "none"], spark) == 1
