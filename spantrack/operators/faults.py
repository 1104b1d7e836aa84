"""Rows that fail to parse: valid typed rows on one side, faulty rows with reasons on the other.

All columns are read as nullable text; rules are vectorised expressions that fill an array of
error names in order of precedence; a row is valid when its array is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.lines import sealed

# Fixed values of the line format.
QUOTED_CELL = r'(?<=^|\t)"[^"]*+(?:""[^"]*+)*+"(?=\t|$)'
ANY_CELL = r'(?<=^|\t)(?:"[^"]*+(?:""[^"]*+)*+"|[^"\t]*+)(?=\t|$)'
MISSING = (".", "na", "nan", "n/a", "none")
NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
DIGITS = r"^[0-9]+$"


def _whole(text: Column) -> Column:
    """Digits as a number; null when there are more than any position can have."""
    stripped = F.regexp_replace(text, r"^0+(?=[0-9])", "")
    return F.when(F.length(stripped) <= 18, stripped.try_cast("long"))


def parse_track_lines(lines: DataFrame, sequences: DataFrame) -> DataFrame:
    """Cells of the data lines with their errors.

    ``lines`` has line_id, genome, col_spec, raw_line (and others, which are ignored);
    ``sequences`` has genome, seqid, length. Returns line_id, genome, seqid, start, end, value
    (typed; null where missing or faulty) and ``errors``, an array of rule names in the order
    quoting, column_count, seqid, start, end, value.

    Null and blank lines and those that start with ``#`` or ``track `` are not data and give no
    row. Repeats of a line are parsed like any other (see ``split_valid``). A column that col_spec lacks (or a null col_spec)
    reads as an empty cell, hence faulty; a null genome has no sequences. Lines of any length are
    parsed whole; cells beyond the four named ones may hold anything.
    """
    line = F.regexp_replace(F.col("raw_line"), r"\r\z", "")
    data = lines.select("line_id", "genome", "col_spec", line.alias("line")).where(
        F.col("line").isNotNull()
        & F.col("line").rlike(r"[^\s]")
        & ~F.col("line").startswith("#")
        & ~F.col("line").startswith("track ")
    )
    has_quote = F.col("line").contains('"')
    spec = F.split(F.coalesce("col_spec", F.lit("")), ",", -1)
    data = data.select(
        "line_id", "genome", "line", spec.alias("spec"),
        (has_quote & F.regexp_replace("line", QUOTED_CELL, "").contains('"')).alias("bad_quotes"),
        F.when(has_quote, F.regexp_extract_all("line", F.lit(ANY_CELL), F.lit(0)))
        .otherwise(F.split("line", "\t", -1)).alias("cells"),
    )
    data = sealed(data)
    columns = ("seqid", "start", "end", "value")
    data = data.select(
        "line_id", "genome", "bad_quotes", (F.size("cells") != F.size("spec")).alias("bad_count"),
        *[F.get(F.col("cells"), (F.array_position("spec", c) - 1).cast("int")).alias(f"c_{c}") for c in columns],
    )
    data = data.select(
        "line_id", "genome", "bad_quotes", "bad_count",
        *[
            F.coalesce(
                F.when(F.col(f"c_{c}").startswith('"'),
                       F.replace(F.expr(f"substring(c_{c}, 2, length(c_{c}) - 2)"), F.lit('""'), F.lit('"')))
                .otherwise(F.col(f"c_{c}")), F.lit("")).alias(f"t_{c}")
            for c in columns
        ],
    )
    data = sealed(data)
    # Left to Catalyst: it broadcasts the sequences only where their size is below the threshold.
    known = sequences.where(F.col("genome").isNotNull() & F.col("seqid").isNotNull()).groupBy(
        F.col("genome").alias("s_genome"), F.col("seqid").alias("s_seqid")).agg(F.max("length").alias("s_length"))
    data = data.join(known, (F.col("genome") == F.col("s_genome")) & (F.col("t_seqid") == F.col("s_seqid")), "left")
    start = F.when(F.col("t_start").rlike(DIGITS), _whole(F.col("t_start")))
    end = F.when(F.col("t_end").rlike(DIGITS), _whole(F.col("t_end")))
    number = F.when(F.col("t_value").rlike(NUMBER), F.col("t_value").try_cast("double"))
    finite = number.isNotNull() & (F.abs(number) < F.lit(float("inf")))
    missing = F.lower("t_value").isin(*MISSING)
    data = sealed(data.withColumns({"p_start": start, "p_end": end, "p_value": F.when(finite, number)}))

    def rule(broken: Column, name: str) -> Column:
        return F.when(F.coalesce(broken, F.lit(True)), F.lit(name))

    cells_hold = ~(F.col("bad_quotes") | F.col("bad_count"))
    errors = F.array_compact(F.array(
        rule(F.col("bad_quotes"), "quoting"),
        rule(F.col("bad_count"), "column_count"),
        F.when(cells_hold, rule(F.col("s_length").isNull(), "seqid")),
        F.when(cells_hold, rule(F.col("p_start") >= F.col("s_length"), "start")),
        F.when(cells_hold, rule((F.col("p_end") <= F.col("p_start")) | (F.col("p_end") > F.col("s_length")), "end")),
        F.when(cells_hold, rule(~(missing | F.col("p_value").isNotNull()), "value")),
    ))
    return sealed(data.select(
        "line_id", "genome", F.col("t_seqid").alias("seqid"), F.col("p_start").try_cast("int").alias("start"),
        F.col("p_end").try_cast("int").alias("end"), F.col("p_value").alias("value"), errors.alias("errors"),
    ))


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid typed rows, faulty rows with ``reason`` = the first error and all ``errors``), each
    row once: only these narrow rows are shuffled, never the texts."""
    valid = parsed.where(F.size("errors") == 0).drop("errors")
    faulty = parsed.where(F.size("errors") > 0).select("line_id", F.get("errors", F.lit(0)).alias("reason"), "errors")
    # As text, since comparison as numbers would turn -0.0 into 0.0.
    valid = valid.withColumn("value", F.col("value").cast("string")).distinct().withColumn("value", F.col("value").cast("double"))
    return valid, faulty.distinct()
