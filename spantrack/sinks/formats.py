"""Composers: tracks to lines of the tab-separated formats.

Each gives (k_region, k_kind, k_start, k_end, k_row, line); ``lines.save`` writes them in order. Headers
come from ``HEADERS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import NotSupportedError
from ..operators.windows import LAG, ROW, ordered_values
from ..session import materialise
from ..types import TrackFormat
from .lines import binary_text, number_text, strand_text

HEADERS = {"bedgraph": ["track type=bedGraph"], "targetcontrol.bedgraph": ["track type=bedGraph"], "gff": ["##gff-version 3"], "wig": ["track type=wiggle_0"]}


def _lines(df: DataFrame, *cells: Column) -> DataFrame:
    row = F.col("row_ord").cast("long") if "row_ord" in df.columns else F.lit(0).cast("long")
    end = F.col("end") if "end" in df.columns else F.col("start") + 1
    return df.select(F.col("seqid").alias("k_region"), F.lit(1).alias("k_kind"), F.col("start").cast("long").alias("k_start"),
                     end.cast("long").alias("k_end"), row.alias("k_row"), F.concat_ws("\t", *cells).alias("line"))


def _text(df: DataFrame, name: str, default: str) -> Column:
    """Text of an extra column; merged (``a|b``) and missing ones become the default."""
    if name not in df.columns:
        return F.lit(default)
    x = F.col(name).cast("string")
    return F.when(x.isNull() | (x == "") | x.contains("|"), F.lit(default)).otherwise(x)


def _end(df: DataFrame) -> Column:
    return F.col("end") if "end" in df.columns else F.col("start") + 1


def bed(df: DataFrame) -> DataFrame:
    """BED with as few columns as the track needs. The score is written only if all values are
    whole numbers from 0 to 1000 (one aggregate)."""
    score = F.lit("0")
    use_score = False
    if "val" in df.columns and isinstance(df.schema["val"].dataType, T.NumericType):
        v = F.col("val").cast("double")
        row = df.agg(F.bool_and(F.coalesce((v >= 0) & (v <= 1000) & (v == F.floor(v)), F.lit(False))).alias("fits")).first()
        use_score = bool(row["fits"])
        if use_score:
            score = v.cast("int").cast("string")
    cells = [F.col("seqid"), F.col("start").cast("string"), _end(df).cast("string")]
    extras = ("thickstart", "thickend", "itemrgb", "blockcount", "blocksizes", "blockstarts")
    wide = [x for x in extras if x in df.columns]
    need = 12 if any(x in df.columns for x in extras[3:]) else 9 if wide else 6 if "strand" in df.columns else 5 if use_score else 4 if "name" in df.columns or "id" in df.columns else 3
    name = _text(df, "name", ".") if "name" in df.columns else _text(df, "id", ".")
    tail = [name, score, strand_text(F.col("strand")) if "strand" in df.columns else F.lit(".")]
    defaults = (F.col("start").cast("string"), _end(df).cast("string"), F.lit("0"), F.lit("1"), F.concat((_end(df) - F.col("start")).cast("string"), F.lit(",")), F.lit("0,"))
    for x, default in zip(extras, defaults):
        tail.append(F.coalesce(F.nullif(_text(df, x, ""), F.lit("")), default))
    return _lines(df, *cells, *tail[: need - 3])


def category_bed(df: DataFrame) -> DataFrame:
    strand = [F.lit("0"), strand_text(F.col("strand"))] if "strand" in df.columns else []
    return _lines(df, F.col("seqid"), F.col("start").cast("string"), _end(df).cast("string"), F.col("val").cast("string"), *strand)


def valued_bed(df: DataFrame) -> DataFrame:
    strand = [strand_text(F.col("strand"))] if "strand" in df.columns else []
    return _lines(df, F.col("seqid"), F.col("start").cast("string"), _end(df).cast("string"), _text(df, "name", "."), number_text(F.col("val")), *strand)


def point_bed(df: DataFrame) -> DataFrame:
    return bed(df.withColumn("end", F.col("start") + 1))


def bedgraph(df: DataFrame) -> DataFrame:
    return _lines(df, F.col("seqid"), F.col("start").cast("string"), _end(df).cast("string"), number_text(F.col("val")))


def target_control(df: DataFrame) -> DataFrame:
    return _lines(df, F.col("seqid"), F.col("start").cast("string"), _end(df).cast("string"), binary_text(F.col("val")))


def gff(df: DataFrame) -> DataFrame:
    """Nine columns, 1-based; attributes are built of id and name where there are none."""
    quote = lambda x: F.regexp_replace(F.replace(F.replace(x, F.lit("%"), F.lit("%25")), F.lit("\t"), F.lit("%09")), ";", "%3B")
    category = "val" in df.columns and isinstance(df.schema["val"].dataType, T.StringType)
    kind = F.col("val") if category else _text(df, "type", "region")
    score = _text(df, "score", ".") if category else number_text(F.col("val")) if "val" in df.columns else F.lit(".")
    made = F.concat_ws(";", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(label + "="), quote(F.col(c)))) for c, label in (("id", "ID"), ("name", "Name")) if c in df.columns])
    attributes = F.coalesce(F.nullif(_text(df, "attributes", ""), F.lit("")), F.nullif(made, F.lit("")), F.lit("."))
    return _lines(df, F.col("seqid"), _text(df, "source", "."), kind, (F.col("start") + 1).cast("string"), _end(df).cast("string"), score,
                  strand_text(F.col("strand")) if "strand" in df.columns else F.lit("."), _text(df, "phase", "."), attributes)


def wig(df: DataFrame) -> DataFrame:
    """fixedStep where starts go on evenly, else variableStep; a declaration stands before every
    change of sequence, span or step."""
    d = df.withColumn("__span", _end(df) - F.col("start"))
    d = materialise(ordered_values(d, ["seqid"], ["start"], {"__at": (LAG, "start"), "__before": (LAG, "__span")}))
    step = F.col("start") - F.col("__at")
    # Null for the first element of a sequence.
    goes_on = (step == F.col("__before")) & (F.col("__before") == F.col("__span"))
    dense = d.agg(F.bool_and(F.coalesce(goes_on, F.col("__at").isNull())).alias("x")).first()["x"]
    if dense:
        fresh = ~F.coalesce(goes_on, F.lit(False))
        head = F.format_string("fixedStep chrom=%s start=%d step=%d span=%d", F.col("seqid"), F.col("start") + 1, F.col("__span"), F.col("__span"))
        body = number_text(F.col("val"))
    else:
        fresh = F.coalesce(F.col("__before") != F.col("__span"), F.lit(True))
        head = F.format_string("variableStep chrom=%s span=%d", F.col("seqid"), F.col("__span"))
        body = F.concat((F.col("start") + 1).cast("string"), F.lit(" "), number_text(F.col("val")))
    d = d.withColumn("__lines", F.when(fresh, F.array(head, body)).otherwise(F.array(body)))
    return d.select(F.col("seqid").alias("k_region"), F.lit(1).alias("k_kind"), F.col("start").cast("long").alias("k_start"), _end(df).cast("long").alias("k_end"),
                    F.posexplode("__lines").alias("k_row", "line")).withColumn("k_row", F.col("k_row").cast("long"))


def fasta(df: DataFrame, width: int = 60) -> DataFrame:
    """One record per stretch of neighbouring positions, ``width`` characters a line."""
    d = ordered_values(df.select("seqid", "start", F.col("val").cast("string").alias("val")), ["seqid"], ["start"], {"__n": (ROW, None)})
    # Neighbouring positions have the same distance from their place.
    d = d.withColumn("__d", F.col("start") - F.col("__n"))
    begins = d.groupBy("seqid", "__d").agg(F.min("start").alias("__s"), (F.max("start") + 1).alias("e"))
    d = d.join(begins.drop("e"), ["seqid", "__d"])
    rows = d.groupBy("seqid", "__s", F.floor((F.col("start") - F.col("__s")) / width).alias("n")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "val"))), lambda x: x["val"]), "").alias("text"))
    heads = begins.select(F.col("seqid").alias("k_region"), F.lit(1).alias("k_kind"), F.col("__s").cast("long").alias("k_start"), F.lit(-1).cast("long").alias("k_end"),
                        F.lit(0).cast("long").alias("k_row"), F.format_string(">%s %d-%d", F.col("seqid"), F.col("__s") + 1, F.col("e")).alias("line"))
    body = rows.select(F.col("seqid").alias("k_region"), F.lit(1).alias("k_kind"), F.col("__s").cast("long").alias("k_start"), F.col("n").cast("long").alias("k_end"),
                       F.lit(1).cast("long").alias("k_row"), F.col("text").alias("line"))
    return heads.unionByName(body)


COMPOSERS = {"bed": bed, "point.bed": point_bed, "category.bed": category_bed, "valued.bed": valued_bed, "bedgraph": bedgraph,
             "targetcontrol.bedgraph": target_control, "gff": gff, "wig": wig, "fasta": fasta}


def options(fmt: TrackFormat) -> list[str]:
    """Formats that can hold a track."""
    number = fmt.value_type in ("number", "number (integer)")
    found = []
    if not fmt.dense and not fmt.linked:
        found.append("bed" if fmt.interval else "point.bed")
        if fmt.value_type == "category":
            found.append("category.bed")
        if number:
            found += ["valued.bed", "bedgraph"]
        if fmt.value_type == "tc":
            found.append("targetcontrol.bedgraph")
        found.append("gff")
    if number and not fmt.linked:
        found.append("wig")
    if fmt.represented_dense and fmt.value_type in ("char", "category"):
        found.append("fasta")
    return [*found, "headed"]


def compose(df: DataFrame, name: str) -> DataFrame:
    if name not in COMPOSERS:
        raise NotSupportedError(f"no writer for {name}")
    return COMPOSERS[name](df)
