"""Lines of text in order, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Significant digits of written numbers.
PRECISION = 4
KEYS = ("k_region", "k_kind", "k_start", "k_end", "k_row")


def number_text(value: Column, precision: int = PRECISION) -> Column:
    """A number with ``precision`` significant digits; NaN and null are a point."""
    x = value.cast("double")
    size = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x))).cast("int"))
    digits = F.lit(precision - 1) - size
    scale = F.pow(F.lit(10.0), digits.cast("double"))
    rounded = F.rint(x * scale) / scale
    text = F.when(rounded == F.rint(rounded), F.concat(rounded.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(
        F.regexp_replace(rounded.cast("decimal(38,12)").cast("string"), "0+$", ""))
    wide = (size < -5) | (size >= 15)
    return F.when(x.isNull() | F.isnan(x), ".").when(wide, rounded.cast("string")).otherwise(text)


def binary_text(value: Column) -> Column:
    return F.when(value == -1, ".").when(value.isNull(), ".").otherwise(value.cast("string"))


def strand_text(value: Column) -> Column:
    return F.when(value == 1, "+").when(value == 0, "-").otherwise(".")


def escape(text: Column, reserved: str = "%;=,#\t") -> Column:
    """URL escapes of the characters that the format needs for itself."""
    for c in reserved:
        text = F.replace(text, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return text


def ordered(lines: DataFrame) -> DataFrame:
    """Global order of the lines as a range sort, so parts follow each other."""
    keys = [k for k in KEYS if k in lines.columns]
    return lines.repartitionByRange(*keys).sortWithinPartitions(*keys)


def save(lines: DataFrame, path: str, header: list[str] = (), single: bool = False, mode: str = "errorifexists") -> None:
    """Writes the lines in order below ``path``: many part files, or one with ``single`` (meant for
    results of the size of one file)."""
    if header:
        first = lines.sparkSession.createDataFrame([(i, x) for i, x in enumerate(header)], "k_row long, line string")
        lines = lines.unionByName(first.withColumn("k_kind", F.lit(-1)), allowMissingColumns=True)
    out = ordered(lines).select("line")
    (out.coalesce(1) if single else out).write.mode(mode).text(path)


def archive(spark, folders: list[str], path: str, suffix: str) -> None:
    """One zip file of the folders that ``save`` wrote, one member each. The parts are copied piece
    by piece, so the driver holds no more than one piece."""
    import zipfile

    sc = spark.sparkContext
    path_of = sc._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path_of(path), True)

    class Sink:
        """What zipfile needs of a stream that can't be read or sought."""

        def write(self, data):
            out.write(bytearray(data))
            return len(data)

        def flush(self):
            out.flush()

    with zipfile.ZipFile(Sink(), "w", zipfile.ZIP_DEFLATED) as z:
        for folder in folders:
            name = f"{folder.rstrip('/').rpartition('/')[2]}.{suffix}"
            parts = sorted(str(s.getPath()) for s in fs.listStatus(path_of(folder)) if s.getPath().getName().startswith("part-"))
            with z.open(name, "w", force_zip64=True) as member:
                for part in parts:
                    stream = fs.open(path_of(part))
                    try:
                        while piece := stream.readNBytes(1 << 20):
                            member.write(bytes(piece))
                    finally:
                        stream.close()
    out.close()
