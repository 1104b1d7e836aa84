"""Parsers of the tab-separated and stateful track formats.

Each takes ordered lines (file, ord, line) and gives one row per element: file, ord, seqid, the
columns of the format, and ``error`` (the broken rule, else null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.windows import LAST, SUM, SUM_AT, ordered_values
from .lines import first_error, number_of, sealed, strand_of, unquote

BED_EXTRAS = ("thickstart", "thickend", "itemrgb", "blockcount", "blocksizes", "blockstarts")


def _data(lines: DataFrame, header: str | None = "track") -> DataFrame:
    keep = F.col("line").isNotNull() & (F.trim("line") != "") & ~F.col("line").startswith("#")
    if header:
        keep = keep & ~F.col("line").rlike(rf"^({header}|browser)\b")
    return sealed(lines.where(keep).withColumn("c", F.split("line", "\t", -1)))


def _c(i: int) -> Column:
    return F.get("c", F.lit(i))


def _int(text: Column) -> Column:
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))


def _interval_rules(start: Column, end: Column) -> list[tuple[Column, str]]:
    return [(start < 0, "start"), (end <= start, "end")]


def bed(lines: DataFrame) -> DataFrame:
    """BED with 3 to 12 columns. The score becomes an integer val from 0 to 1000 (- and . are 0)."""
    d = _data(lines)
    n = F.size("c")
    score = F.when(_c(4).isin("-", "."), 0).otherwise(_int(_c(4)))
    d = d.select(
        "file", "ord", _c(0).alias("seqid"), _int(_c(1)).alias("start"), _int(_c(2)).alias("end"),
        F.when(n > 4, score).alias("val"), F.when(n > 5, strand_of(_c(5))).alias("strand"), _c(3).alias("name"),
        *[_c(6 + i).alias(x) for i, x in enumerate(BED_EXTRAS)], n.alias("n_columns"))
    return sealed(d).withColumn("error", first_error(
        (~F.col("n_columns").between(3, 12), "column count"), *_interval_rules(F.col("start"), F.col("end")),
        ((F.col("n_columns") > 4) & ~F.coalesce(F.col("val").between(0, 1000), F.lit(False)), "score"),
        ((F.col("n_columns") > 5) & F.col("strand").isNull(), "strand")))


def uneven_files(parsed: DataFrame) -> DataFrame:
    """Files whose lines differ in their number of columns."""
    return parsed.groupBy("file").agg(F.min("n_columns").alias("least"), F.max("n_columns").alias("most")).where("least <> most")


def point_bed(lines: DataFrame) -> DataFrame:
    """BED of points: the end must follow the start directly and is dropped."""
    d = bed(lines)
    return d.withColumn("error", F.coalesce("error", first_error((F.col("end") != F.col("start") + 1, "point length")))).drop("end")


def valued_bed(lines: DataFrame) -> DataFrame:
    """BED whose fifth column is any number."""
    d = _data(lines)
    n = F.size("c")
    d = d.select("file", "ord", _c(0).alias("seqid"), _int(_c(1)).alias("start"), _int(_c(2)).alias("end"), number_of(_c(4)).alias("val"),
                 F.when(n > 5, strand_of(_c(5))).alias("strand"), _c(3).alias("name"), n.alias("n_columns"))
    return sealed(d).withColumn("error", first_error(
        (~F.col("n_columns").between(5, 12), "column count"), *_interval_rules(F.col("start"), F.col("end")), (F.col("val").isNull(), "value"),
        ((F.col("n_columns") > 5) & F.col("strand").isNull(), "strand")))


def category_bed(lines: DataFrame) -> DataFrame:
    """BED whose fourth column is a category; the score is an extra column."""
    d = _data(lines)
    n = F.size("c")
    d = d.select("file", "ord", _c(0).alias("seqid"), _int(_c(1)).alias("start"), _int(_c(2)).alias("end"), _c(3).alias("val"),
                 F.when(n > 5, strand_of(_c(5))).alias("strand"), _c(4).alias("score"), n.alias("n_columns"))
    return sealed(d).withColumn("error", first_error(
        (~F.col("n_columns").between(4, 12), "column count"), *_interval_rules(F.col("start"), F.col("end")),
        ((F.col("n_columns") > 5) & F.col("strand").isNull(), "strand")))


def bedgraph(lines: DataFrame) -> DataFrame:
    d = _data(lines).withColumn("c", F.split(F.trim("line"), r"\s+"))
    d = d.select("file", "ord", _c(0).alias("seqid"), _int(_c(1)).alias("start"), _int(_c(2)).alias("end"), number_of(_c(3)).alias("val"), F.size("c").alias("n"))
    return sealed(d).withColumn("error", first_error((F.col("n") != 4, "column count"), *_interval_rules(F.col("start"), F.col("end")),
                                             (F.col("val").isNull(), "value"))).drop("n")


def target_control(lines: DataFrame) -> DataFrame:
    """bedGraph of cases (1), controls (0) and missing ones (-1)."""
    d = bedgraph(lines)
    val = F.when(F.col("val") == 1, 1).when(F.col("val") == 0, 0).when(F.isnan("val"), -1).cast("tinyint")
    return d.withColumn("val", val).withColumn("error", F.coalesce("error", first_error((F.col("val").isNull(), "value"))))


def gff(lines: DataFrame, category: bool = False) -> DataFrame:
    """GFF3: nine columns, URL-quoted, 1-based and inclusive; ends at ``##FASTA``. ID and Name of
    the attributes become id and name. With ``category`` the type is the value."""
    fasta = lines.where(F.col("line").startswith("##FASTA")).groupBy("file").agg(F.min("ord").alias("stop"))
    d = _data(lines, None).join(fasta, "file", "left").where(F.col("stop").isNull() | (F.col("ord") < F.col("stop")))
    attribute = lambda name: F.nullif(F.regexp_extract(_c(8), rf"(?:^|;)\s*{name}=([^;]*)", 1), F.lit(""))
    score = number_of(_c(5))
    d = d.select(
        "file", "ord", F.size("c").alias("n"), unquote(_c(0)).alias("seqid"), (_int(_c(3)) - 1).alias("start"), _int(_c(4)).alias("end"),
        (unquote(_c(2)) if category else score).alias("val"), strand_of(_c(6)).alias("strand"), unquote(attribute("ID")).alias("id"),
        unquote(_c(1)).alias("source"), *([_c(5).alias("score")] if category else [unquote(_c(2)).alias("type")]), _c(7).alias("phase"),
        unquote(_c(8)).alias("attributes"), unquote(attribute("Name")).alias("name"))
    return sealed(d).withColumn("error", first_error((F.col("n") != 9, "column count"), *_interval_rules(F.col("start"), F.col("end")),
                                             (F.col("val").isNull(), "score"), (F.col("strand").isNull(), "strand"))).drop("n")


def category_gff(lines: DataFrame) -> DataFrame:
    return gff(lines, True)


def wig(lines: DataFrame) -> DataFrame:
    """fixedStep and variableStep blocks. Adds span, step and decl (the place of the declaration),
    from which the kind of track follows (see ``wig_kind``). A file of any size is read in parts:
    the last declaration is carried over their borders."""
    d = _data(lines).where(~F.col("line").startswith("browser")).drop("c")
    is_declaration = F.col("line").rlike("^(fixed|variable)Step")
    field = lambda name: F.nullif(F.regexp_extract("line", rf"\b{name}=(\S+)", 1), F.lit(""))
    declared = F.when(is_declaration, F.struct(
        F.col("ord").alias("at"), F.col("line").startswith("fixed").alias("fixed"), field("chrom").alias("seqid"), _int(field("start")).alias("start"),
        F.coalesce(_int(field("step")), F.lit(1)).alias("step"), F.coalesce(_int(field("span")), F.lit(1)).alias("span")))
    d = ordered_values(d.withColumns({"own": declared, "one": F.lit(1)}), ["file"], ["ord"], {
        "decl": (LAST, "own"), "place": (SUM, "one"), "block": (SUM_AT, ("one", "own"))})
    d = sealed(d.where(F.col("own").isNull()).withColumn("c", F.split(F.trim("line"), r"\s+")))
    nth = F.col("place") - F.col("block") - 1
    fixed = F.col("decl.fixed")
    start = F.when(fixed, (F.col("decl.start") - 1 + nth * F.col("decl.step")).cast("int")).otherwise(_int(_c(0)) - 1)
    d = d.select("file", "ord", F.col("decl.seqid").alias("seqid"), start.alias("start"), (start + F.col("decl.span")).alias("end"),
                 number_of(F.when(fixed, _c(0)).otherwise(_c(1))).alias("val"), F.col("decl.at").alias("decl"), fixed.alias("fixed"),
                 F.col("decl.step").alias("step"), F.col("decl.span").alias("span"), F.size("c").alias("n"))
    return sealed(d).withColumn("error", first_error(
        (F.col("seqid").isNull(), "no declaration"), (F.col("n") != F.when(F.col("fixed"), 1).otherwise(2), "column count"),
        ((F.col("step") < 1) | (F.col("span") < 1), "step or span"), (F.col("start") < 0, "start"), (F.col("val").isNull(), "value"))).drop("n")


def wig_kind(parsed: DataFrame) -> DataFrame:
    """Per file: the kind of track, and whether its declarations can't go together."""
    per = parsed.groupBy("file").agg(F.min("span").alias("span"), F.max("span").alias("most_span"), F.min("step").alias("step"),
                                     F.max("step").alias("most_step"), F.bool_and("fixed").alias("fixed"), F.bool_or("fixed").alias("any_fixed"))
    even = (F.col("span") == F.col("most_span")) & (F.col("step") == F.col("most_step"))
    kind = (F.when(F.col("fixed") & even & (F.col("step") == F.col("span")), F.when(F.col("span") == 1, "function").otherwise("step function"))
            .when(F.col("most_span") == 1, "valued points").otherwise("valued segments"))
    return per.select("file", kind.alias("kind"), (F.col("fixed") != F.col("any_fixed")).alias("mixed"))


def wig_regions(parsed: DataFrame, adjacent: bool = True) -> DataFrame:
    """Bounding regions of (step) functions: abutting fixedStep blocks joined. With ``adjacent``
    off, abutting blocks are an error instead and the regions come with ``error``."""
    from ..operators.intervals import covered_and_gaps

    blocks = parsed.where("fixed").groupBy("file", "seqid", "decl").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    if adjacent:
        return covered_and_gaps(blocks, ["file", "seqid"], "start", "end").where("kind = 'period'").drop("kind")
    from ..operators.windows import MAX_BEFORE

    seen = ordered_values(blocks, ["file", "seqid"], ["start", "end"], {"before": (MAX_BEFORE, "end")})
    return seen.select("file", "seqid", "start", "end", F.when(F.col("start") <= F.col("before"), "adjacent region").alias("error"))


def fasta(lines: DataFrame) -> DataFrame:
    """One character per row and position; ``>`` lines name the sequence. A file of any size is
    read in parts: the name and the length so far are carried over their borders."""
    d = lines.where(F.col("line").isNotNull() & (F.trim("line") != ""))
    is_head = F.col("line").startswith(">")
    text = F.when(is_head, "").otherwise(F.rtrim("line"))
    d = d.select("file", "ord", text.alias("text"), F.length(text).cast("long").alias("n"), F.when(is_head, F.regexp_extract("line", r"^>\s*(\S*)", 1)).alias("head"))
    d = ordered_values(d, ["file"], ["ord"], {"seqid": (LAST, "head"), "total": (SUM, "n"), "begun": (SUM_AT, ("n", "head"))}).where(F.col("head").isNull())
    d = d.select("file", "ord", "seqid", (F.col("total") - F.col("begun") - F.col("n")).alias("before"), F.posexplode(F.split("text", "")).alias("i", "val")).where("val <> ''")
    return d.select("file", "ord", "seqid", (F.col("before") + F.col("i")).cast("int").alias("start"), "val",
                    first_error((F.col("seqid").isNull(), "no sequence name")).alias("error"))


def microarray(lines: DataFrame) -> DataFrame:
    """Arrays of one score per experiment, NaN where an element has none. The header names the
    experiments (expNames) and must have expScale and expStep."""
    header = F.when(F.col("line").startswith("track"), F.regexp_replace("line", "'", '"'))
    d = lines.where(F.col("line").isNotNull() & (F.trim("line") != "") & ~F.col("line").startswith("#")).withColumn("own", header)
    d = ordered_values(d, ["file"], ["ord"], {"head": (LAST, "own")}).where(~F.col("line").startswith("track")).withColumn("c", F.split(F.trim("line"), r"\s+"))
    names = F.filter(F.split(F.regexp_extract("head", r'expNames="([^"]*)"', 1), ","), lambda x: x != "")
    numbers = lambda i, kind: F.transform(F.filter(F.split(_c(i), ","), lambda x: x != ""), lambda x: x.try_cast(kind))
    d = d.select("file", "ord", _c(0).alias("seqid"), _int(_c(1)).alias("start"), _int(_c(2)).alias("end"), strand_of(_c(5)).alias("strand"),
                 F.size("c").alias("n"), _int(_c(12)).alias("k"), F.size(names).alias("width"), numbers(13, "int").alias("ids"), numbers(14, "double").alias("scores"),
                 F.col("head").rlike("^track type=\"array\"").alias("typed"), (F.col("head").contains("expScale=") & F.col("head").contains("expStep=")).alias("scaled"))
    at = lambda i: F.array_position("ids", i)
    val = F.transform(F.sequence(F.lit(0), F.greatest(F.col("width") - 1, F.lit(0))), lambda i: F.when(
        at(i) > 0, F.get("scores", (at(i) - 1).cast("int"))).otherwise(F.lit(float("nan"))))
    return sealed(d.withColumn("val", val)).withColumn("error", first_error(
        (~F.col("typed") | ~F.col("scaled"), "header"), (F.col("width") < 3, "experiments"), (F.col("n") != 15, "column count"),
        *_interval_rules(F.col("start"), F.col("end")), (F.col("strand").isNull(), "strand"),
        ((F.size("ids") != F.col("k")) | (F.size("scores") != F.col("k")), "score count"),
        (F.exists("ids", lambda i: F.coalesce((i < 0) | (i >= F.col("width")), F.lit(True))), "experiment id"),
        (F.exists("scores", lambda x: x.isNull()), "value"))).drop("n", "k", "width", "ids", "scores", "typed", "scaled")


def constant_function(spark, seqid: str = "chr21", value: float = 0.0) -> DataFrame:
    """A function track of one position."""
    return spark.range(1).select(F.lit(seqid).alias("seqid"), F.lit(0).alias("start"), F.lit(value).alias("val"))


def function_slice(values: DataFrame, array: str, seqid: str, start: Column | int = 0) -> DataFrame:
    """A dense array as one row per position."""
    first = F.lit(start) if isinstance(start, int) else start
    return values.select(F.col(seqid).alias("seqid"), first.alias("first"), F.posexplode(array).alias("i", "val")).select(
        "seqid", (F.col("first") + F.col("i")).cast("int").alias("start"), "val")


def tabular(lines: DataFrame, columns: dict[str, str], separator: str = "\t") -> DataFrame:
    """Any separated text: the named columns cast to their types; a cell that can't be cast is an
    error of its column."""
    d = _data(lines).withColumn("c", F.split("line", separator, -1))
    cast = {name: _c(i).try_cast(kind) for i, (name, kind) in enumerate(columns.items())}
    out = d.select("file", "ord", F.size("c").alias("n"), *[x.alias(name) for name, x in cast.items()])
    return sealed(out).withColumn("error", first_error((F.col("n") < len(columns), "column count"), *[
        (F.col(name).isNull(), name) for name in columns])).drop("n")


def unknown_sequences(parsed: DataFrame, sequences: DataFrame, genome: str) -> DataFrame:
    """Adds the genome's rules: a row of an unknown sequence gets the error ``seqid`` and one that
    ends beyond its sequence ``beyond end``."""
    known = sequences.where(F.col("genome") == genome).select(F.col("seqid").alias("__s"), F.col("length").alias("__l"))
    last = F.col("end") if "end" in parsed.columns else F.col("start") + 1
    joined = parsed.join(known, parsed["seqid"] == F.col("__s"), "left")
    return joined.withColumn("error", F.coalesce("error", F.when(F.col("__l").isNull(), "seqid").when(last > F.col("__l"), "beyond end"))).drop("__s", "__l")


# First match wins, so longer suffixes stand before shorter ones.
BY_SUFFIX = (
    ("point.bed", point_bed), ("valued.bed", valued_bed), ("marked.bed", valued_bed), ("category.bed", category_bed), ("bed", bed),
    ("targetcontrol.bedgraph", target_control), ("bedgraph", bedgraph), ("wig", wig), ("category.gff", category_gff), ("category.gff3", category_gff),
    ("gff", gff), ("gff3", gff), ("fasta", fasta), ("fas", fasta), ("fa", fasta), ("microarray", microarray),
)


def suffixes(use: str = "all") -> list[str]:
    """File suffixes that can be read: all, those for ``binning`` (elements with positions) or
    those for a ``function`` (a value at every position)."""
    dense = ("wig", "bedgraph", "targetcontrol.bedgraph", "fasta", "fas", "fa")
    known = [x for x, _ in BY_SUFFIX]
    if use == "all":
        return known
    return [x for x in known if (x in dense) == (use == "function") or use == "binning" and x in ("wig", "bedgraph", "targetcontrol.bedgraph")]


def parser_for(name: str):
    """Parser by the suffix of a file name (a .gz at its end aside), or None."""
    plain = name.lower().removesuffix(".gz")
    return next((p for suffix, p in BY_SUFFIX if plain.endswith("." + suffix) or plain == suffix), None)
