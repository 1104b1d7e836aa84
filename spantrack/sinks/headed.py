"""Writer of the header-described format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import NotSupportedError
from ..sources.headed import DEFAULTS, Header
from ..sources.subtypes import SUBTYPES
from ..types import RESERVED, TrackFormat
from .lines import binary_text, escape, number_text, strand_text


def _kind(dtype: T.DataType) -> tuple[str, str]:
    dimension = "scalar"
    if isinstance(dtype, T.ArrayType):
        dtype, dimension = dtype.elementType, "list"
    if isinstance(dtype, T.ByteType | T.BooleanType):
        return "binary", dimension
    return ("number" if isinstance(dtype, T.NumericType) else "category"), dimension


def header_for(df: DataFrame, dimension: str | None = None, **more) -> Header:
    """Header that describes ``df``; values of ``more`` (with _ for blanks) go before."""
    fmt = TrackFormat.of_schema(df.schema)
    h = Header()
    h.values["track type"] = fmt.name.lower()
    if fmt.valued:
        h.values["value type"], h.values["value dimension"] = _kind(df.schema["val"].dataType)
        h.values["value dimension"] = dimension or h["value dimension"]
    if fmt.weighted:
        h.values["edge weights"] = True
        h.values["edge weight type"], h.values["edge weight dimension"] = _kind(df.schema["weights"].dataType.elementType)
    for name, value in more.items():
        h.values[name.replace("_", " ")] = value
    names = {"val": "value"}
    h.columns = ["seqid", *[names.get(c, c) for c in RESERVED if c in df.columns and c != "weights"], *fmt.extra]
    h.given = [x for x in DEFAULTS if h[x] != DEFAULTS[x] or x in ("version", "track type")]
    return h


def header_lines(h: Header) -> list[str]:
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    return [*[f"##{Header.written(x, h.keyword)}: {text(h[x])}" for x in h.given], "###" + "\t".join(h.columns)]


def _value(x: Column, dtype: T.DataType, delimiter: str = ",") -> Column:
    if isinstance(dtype, T.ArrayType):
        kind = _kind(dtype.elementType)[0]
        return F.when(x.isNull() | (F.size(x) == 0), ".").otherwise(F.array_join(F.transform(x, lambda v: _value(v, dtype.elementType)), "" if kind == "binary" else delimiter))
    if isinstance(dtype, T.ByteType | T.BooleanType):
        return binary_text(x.cast("tinyint"))
    if isinstance(dtype, T.NumericType):
        return number_text(x)
    return F.when(x.isNull() | (x == ""), ".").otherwise(escape(x))


def compose(df: DataFrame, h: Header, regions: DataFrame | None = None) -> DataFrame:
    """Data lines (and ``####`` lines of ``regions`` before the elements inside them)."""
    shift = int(bool(h["1-indexed"]))
    last = shift - int(bool(h["end inclusive"]))
    cells = []
    for c in h.columns:
        if c == "value":
            cells.append(_value(F.col("val"), df.schema["val"].dataType))
        elif c == "start":
            cells.append((F.col("start") + shift).cast("string"))
        elif c == "end":
            cells.append((F.col("end") + last).cast("string"))
        elif c == "strand":
            cells.append(strand_text(F.col("strand")))
        elif c == "edges":
            if h["edge weights"]:
                inner = df.schema["weights"].dataType.elementType
                pairs = F.transform(F.arrays_zip("edges", "weights"), lambda e: F.concat(escape(e["edges"]), F.lit("="), _value(e["weights"], inner)))
            else:
                pairs = F.transform("edges", lambda e: escape(e))
            cells.append(F.when(F.col("edges").isNull() | (F.size("edges") == 0), ".").otherwise(F.array_join(pairs, ";")))
        else:
            x = F.col(c).cast("string")
            cells.append(F.when(x.isNull() | (x == ""), ".").otherwise(escape(x, "%#\t")))
    row = F.col("row_ord").cast("long") if "row_ord" in df.columns else F.lit(0).cast("long")
    start = F.col("start") if "start" in df.columns else F.lit(0)
    end = F.col("end") if "end" in df.columns else start + 1
    key = F.col("br_idx").cast("string") if regions is not None else F.col("seqid")
    body = df.select(key.alias("k_region"), F.lit(1).alias("k_kind"), start.cast("long").alias("k_start"), end.cast("long").alias("k_end"), row.alias("k_row"),
                     F.concat_ws("\t", *cells).alias("line"))
    if regions is None:
        return body
    heads = regions.select(F.col("br_idx").cast("string").alias("k_region"), F.lit(0).alias("k_kind"), F.col("start").cast("long").alias("k_start"), F.col("end").cast("long").alias("k_end"),
                           F.lit(0).cast("long").alias("k_row"), F.format_string("####seqid=%s; start=%d; end=%d", F.col("seqid"), F.col("start") + shift, F.col("end") + last).alias("line"))
    return heads.unionByName(body)


def fitting_subtypes(h: Header) -> list[str]:
    """Bundled subtypes whose columns and headers the track meets as they are."""
    out = []
    for key, (adherence, headers, columns) in SUBTYPES.items():
        text = {x: str(h[x]).lower() for x in headers if x != "uninterrupted data lines"}
        same = all(text[x] == headers[x] for x in text)
        names = columns.split()
        fits = h.columns == names if adherence == "strict" else h.columns[: len(names)] == names if adherence == "extensible" else set(names) <= set(h.columns)
        if same and fits:
            out.append(key)
    return out




def extended_header(df: DataFrame, h: Header, regions: DataFrame | None = None) -> Header:
    """``h`` with all that makes the file shorter or better known: a fixed length and gap instead of
    positions, where the elements of every region lie so from its start on (one aggregate), and a
    bundled subtype, for which columns are put in another order if need be."""
    out = Header(dict(h.values), list(h.given), list(h.columns), list(h.warnings), h.keyword)
    if regions is not None and "start" in df.columns:
        fixed = _fixed(df, regions)
        if fixed is not None:
            length, gap = fixed
            dropped = ["start", "end"] if "end" in df.columns and length > 1 else ["start"] if "end" not in df.columns else []
            if dropped:
                out.columns = [c for c in out.columns if c not in dropped]
                for name, value in (("fixed length", length), ("fixed gap size", gap)):
                    out.values[name] = value
                    out.given.append(name)
    for key, (adherence, headers, columns) in SUBTYPES.items():
        names = columns.split()
        own = set(out.columns)
        same = all(str(out[x]).lower() == v for x, v in headers.items() if x != "uninterrupted data lines")
        plain = regions is None or headers.get("uninterrupted data lines") != "true"
        beyond = own - set(names)
        fits = own == set(names) if adherence == "strict" else set(names) <= own and not beyond & {"start", "end", "value", "edges"}
        if same and plain and fits and "fixed length" not in out.given:
            out.columns = [*names, *[c for c in out.columns if c in beyond]]
            out.values["subtype url"], out.values["subtype adherence"] = key, adherence
            out.given += [x for x in ("subtype url", "subtype adherence") if x not in out.given]
            break
    return out


def _fixed(df: DataFrame, regions: DataFrame) -> tuple[int, int] | None:
    """(length, gap) if all elements have one length and follow each other at one distance, the
    first of each region at its start."""
    from ..operators.overlap import region_of_position
    from ..operators.windows import LAG, ordered_values

    d = df.select("seqid", "start", *(["end"] if "end" in df.columns else [])) if "end" in df.columns else df.select("seqid", "start").withColumn("end", F.col("start") + 1)
    d = region_of_position(d, regions.select("seqid", "start", "end"), ["seqid"])
    d = ordered_values(d, ["seqid", "region_start"], ["start", "end"], {"__e": (LAG, "end")})
    length, gap = F.col("end") - F.col("start"), F.col("start") - F.col("__e")
    row = d.agg(
        F.min(length).alias("a"), F.max(length).alias("b"), F.min(gap).alias("c"), F.max(gap).alias("d"),
        F.bool_and(F.coalesce(F.when(F.col("__e").isNull(), F.col("start") == F.col("region_start")), F.col("region_start").isNotNull())).alias("flush")).first()
    if row["a"] is None or not row["flush"] or row["a"] != row["b"] or row["c"] is None or row["c"] != row["d"] or row["a"] + row["c"] < 1:
        return None
    return row["a"], row["c"]


def compose_fixed_lines(df: DataFrame, h: Header, regions: DataFrame, width: int = 60) -> DataFrame:
    """A function of single characters as lines of ``width`` of them, behind its region lines
    (``regions``: br_idx, seqid, start, end; ``df``: br_idx, start, val, every position once)."""
    if h.columns != ["value"] or h["value type"] not in ("character", "binary"):
        raise NotSupportedError("fixed-size lines are for functions of one character a position")
    kind = df.schema["val"].dataType
    d = df.join(regions.select("br_idx", F.col("start").alias("__s")), "br_idx")
    n = F.floor((F.col("start") - F.col("__s")) / width)
    cell = F.when(F.col("val").isNull() | (F.col("val").cast("string") == ""), ".").otherwise(
        binary_text(F.col("val").cast("tinyint")) if isinstance(kind, T.ByteType | T.BooleanType) else F.col("val").cast("string"))
    rows = d.groupBy("br_idx", n.alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", cell.alias("v")))), lambda x: x["v"]), "").alias("line"))
    heads = regions.select(F.col("br_idx").cast("string").alias("k_region"), F.lit(0).alias("k_kind"), F.lit(0).cast("long").alias("k_start"), F.lit(0).cast("long").alias("k_end"),
                           F.lit(0).cast("long").alias("k_row"), F.format_string("####seqid=%s; start=%d; end=%d", F.col("seqid"), F.col("start"), F.col("end")).alias("line"))
    body = rows.select(F.col("br_idx").cast("string").alias("k_region"), F.lit(1).alias("k_kind"), F.col("n").cast("long").alias("k_start"), F.lit(0).cast("long").alias("k_end"),
                       F.lit(0).cast("long").alias("k_row"), "line")
    return heads.unionByName(body)
