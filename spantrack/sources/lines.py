"""Ordered lines of text files, and the split of parsed lines into valid and faulty ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import InvalidFormatError


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, ord, line) of text files, also compressed ones. ``ord`` grows in the order of the
    lines of a file (blocks of a split file by their offset) and has gaps; null bytes and carriage
    returns at line ends are taken off."""
    raw = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"),
        F.regexp_replace("value", r"\r\z", "").alias("line"))
    # The row number of a scan partition fits into 33 bits; blocks come before rows.
    return raw.select("file", F.struct("block", "nth").alias("ord"), "line")


def lines_of(spark: SparkSession, name: str, lines: list[str]) -> DataFrame:
    """The same from text in memory."""
    rows = [(name, 0, i, x) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "file string, block long, nth long, line string").select(
        "file", F.struct("block", "nth").alias("ord"), "line")


def sealed(df: DataFrame) -> DataFrame:
    """``df`` as it is, behind a generator: a later filter is evaluated on the columns made so far
    and not on copies of the expressions that make them."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def first_error(*rules: tuple[Column, str]) -> Column:
    """Name of the first rule that is broken (or can't be evaluated), null if none is."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for broken, name in rules], F.lit(None).cast("string"))


def keep_valid(parsed: DataFrame, mode: str) -> DataFrame:
    """FAILFAST: a faulty row makes the read fail when it is reached. PERMISSIVE: it is left out
    (see ``faulty``)."""
    if mode == "PERMISSIVE":
        return parsed.where(F.col("error").isNull()).drop("error")
    if mode != "FAILFAST":
        raise InvalidFormatError(f"unknown mode {mode}")
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("invalid line: "), F.col("error"))).cast("string"))
    return parsed.withColumn("error", checked).where(F.col("error").isNull()).drop("error")


def faulty(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull())


def strand_of(text: Column) -> Column:
    """+ 1, - 0, . and ? -1; null for anything else."""
    return F.when(text == "+", 1).when(text == "-", 0).when(text.isin(".", "?"), -1).cast("tinyint")


def number_of(text: Column) -> Column:
    """A float, NaN for the missing tokens, null where it is neither."""
    return F.when(F.lower(text).isin(".", "na", "nan", "n/a", "none"), F.lit(float("nan"))).otherwise(text.try_cast("double"))


def unquote(text: Column) -> Column:
    """URL decoding that keeps plus signs; text that can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
