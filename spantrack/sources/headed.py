"""Reader of the header-described format: ``##`` variables, ``###`` columns, ``####`` regions, data.

Headers and column lines are read on the driver (they are metadata: a few lines per file); regions
and data are one distributed plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import InvalidFormatError
from ..operators.windows import LAG, LAST, SUM, SUM_AT, ordered_values
from ..types import TRACK_TYPES
from . import subtypes
from .lines import first_error, sealed, strand_of, unquote

#: Suffix of such files, and the word before ``version`` and ``subtype`` in their headers, unless
#: given otherwise.
SUFFIX, KEYWORD = "headed", "format"
#: Header lines that a file may have.
MOST_HEADERS = 10_000
# Fixed values of the format: header variables with their defaults, and columns.
DEFAULTS: dict[str, str | bool | int] = {
    "version": "1.0", "track type": "segments", "value type": "number", "value dimension": "scalar", "undirected edges": False,
    "edge weights": False, "edge weight type": "number", "edge weight dimension": "scalar", "uninterrupted data lines": False,
    "sorted elements": False, "no overlapping elements": False, "circular elements": False, "1-indexed": False, "end inclusive": False,
    "value column": "value", "edges column": "edges", "fixed length": 1, "fixed gap size": 0, "fixed-size data lines": False,
    "data line size": 1, "subtype": "", "subtype version": "1.0", "subtype url": "", "subtype adherence": "free",
}
EXTENDED = ("value column", "edges column", "fixed length", "fixed gap size", "fixed-size data lines", "data line size", "subtype",
            "subtype version", "subtype url", "subtype adherence")
CORE, RESERVED = ("start", "end", "value", "edges"), ("genome", "seqid", "start", "end", "value", "strand", "id", "edges")
VALUE_TYPES, DIMENSIONS = ("number", "binary", "character", "category"), ("scalar", "pair", "vector", "list")
ADHERENCE = ("strict", "extensible", "redefinable", "reorderable", "free")
REDEFINABLE = ("value type", "value dimension", "edge weights", "edge weight type", "edge weight dimension", "value column", "edges column",
               "undirected edges", "track type")


@dataclass
class Header:
    values: dict[str, str | bool | int] = field(default_factory=lambda: dict(DEFAULTS))
    given: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    keyword: str = KEYWORD

    def __getitem__(self, name: str):
        return self.values[name]

    @property
    def extended(self) -> bool:
        return any(h in EXTENDED for h in self.given)

    @staticmethod
    def written(name: str, keyword: str) -> str:
        """Name of a variable as files have it."""
        return f"{keyword} {name}" if name in ("version", "subtype") else name

    def core(self) -> set[str]:
        renamed = {str(self["value column"]): "value", str(self["edges column"]): "edges"}
        return {renamed.get(c, c) for c in self.columns} & set(CORE)


def core_of(track_type: str) -> set[str]:
    for (dense, valued, interval, linked), name in TRACK_TYPES.items():
        if name == track_type:
            return {c for c, on in (("start", not dense), ("value", valued), ("end", interval), ("edges", linked)) if on}
    raise InvalidFormatError(f"no track type: {track_type}")


def parse_header(lines: list[str], keyword: str = KEYWORD) -> Header:
    """Header of the ``##`` and ``###`` lines, in file order, checked."""
    h, stage = Header(keyword=keyword), 0
    names = {Header.written(x, keyword): x for x in DEFAULTS}
    for line in lines:
        depth = 3 if line.startswith("###") else 2
        if depth < stage:
            raise InvalidFormatError(f"header after the column line: {line}")
        stage = depth
        if depth == 3:
            if h.columns:
                raise InvalidFormatError("more than one column line")
            h.columns = [c.strip().lower() for c in line[3:].split("\t")]
            continue
        name, colon, value = line[2:].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            raise InvalidFormatError(f"no header line: {line}")
        if name not in names:
            h.warnings.append(f"unknown header {name}")
            continue
        name = names[name]
        if name in h.given:
            raise InvalidFormatError(f"header {name} given twice")
        default = DEFAULTS[name]
        if isinstance(default, bool):
            if value.lower() not in ("true", "false"):
                raise InvalidFormatError(f"{name} must be true or false")
            h.values[name] = value.lower() == "true"
        elif isinstance(default, int):
            if not value.isdigit():
                raise InvalidFormatError(f"{name} must be a number")
            h.values[name] = int(value)
        else:
            h.values[name] = value if name in ("subtype", "subtype url") else value.lower()
        h.given.append(name)
    if h["subtype url"]:
        found = subtypes.find(str(h["subtype url"]))
        if found is None:
            h.warnings.append(f"the subtype {h['subtype url']} isn't bundled; nothing is fetched")
        else:
            adherence, headers, columns = found
            own = Header(given=["subtype adherence", *headers], columns=columns)
            own.values["subtype adherence"] = adherence
            for name, value in headers.items():
                kind = type(DEFAULTS[name])
                own.values[name] = value == "true" if kind is bool else kind(value)
            h.columns = h.columns or list(columns)
            h = apply_subtype(h, own)
    check_header(h)
    return h


def check_header(h: Header) -> None:
    def need(ok: bool, text: str) -> None:
        if not ok:
            raise InvalidFormatError(text)

    need(h["version"] == "1.0", "the version must be 1.0")
    need(h["value type"] in VALUE_TYPES and h["edge weight type"] in VALUE_TYPES, "unknown value type")
    need(h["value dimension"] in DIMENSIONS and h["edge weight dimension"] in DIMENSIONS, "unknown dimension")
    need(h["subtype adherence"] in ADHERENCE, "unknown subtype adherence")
    need(h["data line size"] >= 1, "the data line size must be positive")
    need(h["fixed length"] >= 1 and h["fixed length"] + h["fixed gap size"] > 0, "fixed length and gap must add up to more than 0")
    track_type = str(h["track type"])
    core = core_of(track_type)
    if not h.columns:
        h.columns = ["seqid", *[c for c in ("start", "end", "value") if c in core], *(["id", "edges"] if "edges" in core else [])]
    need(len(set(h.columns)) == len(h.columns), "a column is named twice")
    own = h.core()
    if h["fixed length"] > 1 and "end" in core:
        own.add("end")
    if "fixed gap size" in h.given and "start" in core:
        own.add("start")
    need(own == core, f"columns {sorted(own)} don't fit the track type {track_type}")
    need(not h["fixed-size data lines"] or (track_type == "function" and len(h.columns) == 1), "fixed-size lines are for functions of one column")


def apply_subtype(h: Header, subtype: Header) -> Header:
    """Checks the header against a subtype by its adherence and takes over what it leaves open."""
    mode = str(h["subtype adherence"]) if "subtype adherence" in h.given else str(subtype["subtype adherence"])
    changed = [x for x in h.given if x in subtype.given and h[x] != subtype[x] and not x.startswith("subtype")]
    if mode in ("strict", "extensible", "reorderable") and changed or mode == "redefinable" and set(changed) - set(REDEFINABLE):
        raise InvalidFormatError(f"headers {changed} differ from the subtype")
    a, b = h.columns, subtype.columns
    fits = {
        "strict": a == b, "extensible": a[: len(b)] == b and not set(a[len(b):]) & set(CORE),
        "redefinable": len(a) >= len(b) and all(x == y or {x, y} & {"value", "edges"} for x, y in zip(a, b)),
        "reorderable": set(b) <= set(a), "free": True,
    }[mode]
    if not fits:
        raise InvalidFormatError(f"columns {a} don't fit the subtype under {mode}")
    values = dict(h.values)
    for x in subtype.given:
        if x not in h.given:
            values[x] = subtype[x]
    return replace(h, values=values)


def load_header(lines: DataFrame, keyword: str = KEYWORD) -> Header:
    """Reads the header lines of a file, whose number is bounded by MOST_HEADERS, and checks that
    kinds of lines stand in order: variables, columns, then regions and data. Of several files with
    one header each the headers must be the same."""
    is_head = F.col("line").rlike("^##[^#]|^###[^#]")
    heads = lines.where(is_head)
    first = heads.groupBy("file").agg(F.count("*").alias("n"), F.max("ord").alias("last"))
    if first.where(F.col("n") > MOST_HEADERS).limit(1).count():
        raise InvalidFormatError(f"more than {MOST_HEADERS} header lines")
    body = lines.where(F.col("line").isNotNull() & (F.trim("line") != "") & (~F.col("line").startswith("#") | F.col("line").startswith("####")))
    began = body.groupBy("file").agg(F.min("ord").alias("first"))
    late = first.join(began, "file").where(F.col("last") > F.col("first")).limit(1).collect()
    if late:
        raise InvalidFormatError(f"header lines after regions or data in {late[0]['file']}")
    texts = heads.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]).alias("text"))
    distinct = texts.groupBy("text").agg(F.min("file").alias("file")).limit(2).collect()
    if len(distinct) > 1:
        raise InvalidFormatError("files with different headers can't be read as one track")
    return parse_header(list(distinct[0]["text"]) if distinct else [], keyword)


def _cells(text: Column, kind: str) -> Column:
    return F.split(text, ",", -1) if kind in ("number", "category") else F.filter(F.split(text, ""), lambda x: x != "")


def _one(text: Column, kind: str) -> Column:
    """One typed value; null if it isn't one."""
    if kind == "number":
        return F.when(text == ".", F.lit(float("nan"))).otherwise(unquote(text).try_cast("double"))
    if kind == "binary":
        return F.when(text == ".", -1).when(text == "1", 1).when(text == "0", 0).cast("tinyint")
    if kind == "character":
        return F.when(text == ".", "").when(F.length(text) == 1, text)
    return F.when(text == ".", "").when(text != "", unquote(text))


def typed(text: Column, kind: str, dimension: str) -> Column:
    """Value of a cell by its declared type and dimension; null where it is none."""
    if dimension == "scalar":
        return _one(text, kind)
    values = F.transform(_cells(text, kind), lambda x: _one(x, kind))
    good = ~F.exists(values, lambda x: x.isNull())
    if dimension == "pair":
        good = good & (F.size(values) == 2)
    if dimension == "list":
        return F.when(text == ".", F.array().cast({"number": "array<double>", "binary": "array<tinyint>"}.get(kind, "array<string>"))).when(good, values)
    return F.when(good, values)


def _attribute(name: str) -> Column:
    return F.nullif(unquote(F.trim(F.regexp_extract("line", rf"(?i)(?:^####|;)\s*{name}\s*=\s*([^;]*)", 1))), F.lit(""))


def bounding_regions(lines: DataFrame, h: Header, sequences: DataFrame | None = None) -> DataFrame:
    """(file, ord, genome, seqid, start, end, error) of the ``####`` lines. A missing start is 0, a
    missing end the length of the sequence, where ``sequences`` knows it. Lines of a genome only and
    lines with a seqid are two kinds, which a file can't mix (see ``check_regions``)."""
    one, inclusive = int(bool(h["1-indexed"])), int(bool(h["end inclusive"]))
    r = lines.where(F.col("line").startswith("####")).select(
        "file", "ord", _attribute("genome").alias("genome"), _attribute("seqid").alias("seqid"),
        (_attribute("start").try_cast("int") - one).alias("start"), (_attribute("end").try_cast("int") - one + inclusive).alias("end"),
        F.when(F.coalesce(_attribute("genome"), _attribute("seqid")).isNull(), "region without genome and seqid").when(
            _attribute("seqid").isNull() & F.coalesce(_attribute("start"), _attribute("end")).isNotNull(), "region bounds without seqid").when(
            _attribute("start").isNotNull() & _attribute("start").try_cast("int").isNull() | _attribute("end").isNotNull() & _attribute("end").try_cast("int").isNull(),
            "region bounds").alias("error"))
    r = r.withColumn("start", F.when(F.col("seqid").isNotNull(), F.coalesce("start", F.lit(0))))
    if sequences is not None:
        s = sequences.select(F.col("genome").alias("__g"), F.col("seqid").alias("__s"), F.col("length").alias("__l"))
        r = r.join(s, (F.col("seqid") == F.col("__s")) & F.coalesce(F.col("genome") == F.col("__g"), F.lit(True)), "left")
        r = r.withColumn("end", F.coalesce("end", "__l")).drop("__g", "__s", "__l").dropDuplicates(["file", "ord"])
    return r


def check_regions(regions: DataFrame) -> None:
    """Raises for faulty region lines, for files that mix both kinds, and for regions of a sequence
    that overlap, adjoin or have no length."""
    bad = regions.where(F.col("error").isNotNull()).limit(1).collect()
    if bad:
        raise InvalidFormatError(f"{bad[0]['error']} in {bad[0]['file']}")
    kinds = regions.groupBy("file").agg(F.min(F.col("seqid").isNull().cast("int")).alias("a"), F.max(F.col("seqid").isNull().cast("int")).alias("b"))
    mixed = kinds.where("a <> b").limit(1).collect()
    if mixed:
        raise InvalidFormatError(f"region lines with and without a seqid in {mixed[0]['file']}")
    from ..operators.validate import regions as faulty, require_none

    require_none(faulty(regions.where(F.col("seqid").isNotNull() & F.col("end").isNotNull()).select("genome", "seqid", "start", "end")))


def parse(lines: DataFrame, h: Header, sequences: DataFrame | None = None) -> DataFrame:
    """Elements with ``error``; br_ord is the place of their bounding region, null without one. A
    file of any size is read in parts: the region, the number of elements since it and the end
    before are carried over their borders."""
    regions = bounding_regions(lines, h, sequences).select(
        F.col("file").alias("__f"), F.col("ord").alias("__o"), F.struct("genome", "seqid", "start", "end").alias("__br"))
    d = lines.where(F.col("line").isNotNull() & (F.trim("line") != "") & (~F.col("line").startswith("#") | F.col("line").startswith("####")))
    d = d.join(regions, (F.col("file") == F.col("__f")) & (F.col("ord") == F.col("__o")), "left").drop("__f", "__o")
    size = int(h["data line size"]) if h["fixed-size data lines"] else 0
    here = F.col("__br").isNotNull()
    one, inclusive = int(bool(h["1-indexed"])), int(bool(h["end inclusive"]))
    d = d.withColumns({"__at": F.when(here, F.col("ord")), "__k": F.when(here, 0).otherwise(
        F.floor(F.length("line") / size) if size else 1).cast("long")})
    adds = {"br": (LAST, "__br"), "br_ord": (LAST, "__at"), "__total": (SUM, "__k"), "__base": (SUM_AT, ("__k", "__at"))}
    if "end" in h.columns:
        end_cell = F.get(F.split("line", "\t", -1), F.lit(h.columns.index("end"))).try_cast("int") - one + inclusive
        d = d.withColumn("__end", F.when(~here, end_cell))
        adds["__before"] = (LAG, "__end")
    # The places before the line's own elements.
    d = ordered_values(d, ["file"], ["ord"], adds).where(F.col("__br").isNull()).withColumn("__n", F.col("__total") - F.col("__base") - F.col("__k"))
    if h["fixed-size data lines"]:
        d = d.select(
            "*", F.posexplode(F.regexp_extract_all("line", F.lit(f".{{{size}}}"), F.lit(0))).alias("part", "piece")).drop("line").withColumnRenamed("piece", "line")
    else:
        d = d.withColumn("part", F.lit(0))
    d = sealed(d.withColumn("c", F.split("line", "\t", -1)))
    cell = {name: F.get("c", F.lit(i)) for i, name in enumerate(h.columns)}
    renamed = {str(h["value column"]): "value", str(h["edges column"]): "edges"}
    cell = {renamed.get(name, name): x for name, x in cell.items()}
    nth = F.col("__n") + F.col("part")
    track = core_of(str(h["track type"]))
    columns, rules = {}, [(F.size("c") != len(h.columns), "column count")]
    columns["genome"] = F.coalesce(cell["genome"], F.col("br.genome")) if "genome" in cell else F.col("br.genome")
    columns["seqid"] = F.coalesce(cell["seqid"], F.col("br.seqid")) if "seqid" in cell else F.col("br.seqid")
    rules.append((F.col("seqid").isNull(), "seqid"))
    if "seqid" in cell:
        rules.append((F.coalesce(F.col("seqid") != F.col("br.seqid"), F.lit(False)), "region seqid"))
    length, gap = int(h["fixed length"]), int(h["fixed gap size"])
    br_start = F.coalesce(F.col("br.start"), F.lit(0))
    if "start" in cell:
        start = cell["start"].try_cast("int") - one
    elif "start" in track:
        start = (br_start + nth * (length + gap)).cast("int")
    elif "end" in cell:
        start = None  # filled from the end before
    else:
        start = (br_start + nth * length).cast("int")
    if "end" in cell:
        end = cell["end"].try_cast("int") - one + inclusive
    elif start is not None:
        end = F.least(start + length, F.col("br.end")) if length > 1 else start + 1
    if start is None:
        start = F.coalesce("__before", br_start)
    columns["start"], columns["end"] = start.cast("int"), end.cast("int")
    rules.append((F.col("start") < 0, "start"))
    if h["circular elements"]:
        rules.append((F.col("end").isNull(), "end"))
    else:
        rules.append((F.col("end") <= F.col("start"), "end"))
    rules.append((F.coalesce((F.col("start") < F.col("br.start")) | (F.col("end") > F.col("br.end")), F.lit(False)), "outside region"))
    if "value" in cell:
        columns["val"] = typed(cell["value"], str(h["value type"]), str(h["value dimension"]))
        rules.append((F.col("val").isNull(), "value"))
    if "strand" in cell:
        columns["strand"] = strand_of(cell["strand"])
        rules.append((F.col("strand").isNull(), "strand"))
    if "id" in cell:
        columns["id"] = unquote(cell["id"])
        rules.append((F.col("id") == "", "id"))
    if "edges" in cell:
        none = cell["edges"] == "."
        pieces = F.when(none, F.array().cast("array<string>")).otherwise(F.split(cell["edges"], ";", -1))
        parts = F.transform(pieces, lambda e: F.split(e, "=", -1))
        columns["edges"] = F.transform(parts, lambda p: unquote(F.get(p, F.lit(0))))
        wanted = 2 if h["edge weights"] else 1
        rules.append((F.exists("__parts", lambda p: F.size(p) != wanted), "edge weights"))
        columns["__parts"] = parts
        if h["edge weights"]:
            columns["weights"] = F.transform(parts, lambda p: typed(F.get(p, F.lit(1)), str(h["edge weight type"]), str(h["edge weight dimension"])))
            rules.append((F.exists("weights", lambda w: w.isNull()), "weight"))
        rules.append((F.size(F.array_distinct("edges")) != F.size("edges"), "repeated edge"))
    taken = {"genome", "seqid", "start", "end", "value", "strand", "id", "edges"}
    for name, x in cell.items():
        if name not in taken:
            safe = "__" + name if name in ("extra", "val", "chr", "subtype", "file", "ord", "error", "br", "c", "line") or name.startswith("_") else name
            columns[safe] = x
    d = d.select("file", "ord", "part", "br", "br_ord", "c", *[x.alias(n) for n, x in columns.items()])
    d = sealed(d).withColumn("error", first_error(*rules))
    keep = [n for n in columns if n != "__parts"]
    return d.select("file", "ord", "part", "br_ord", *keep, "error")
