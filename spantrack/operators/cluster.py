"""Clustering of overlapping elements with merging of their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .intervals import label_islands

#: From this many elements on a concatenated text is cut to its first item.
MAX_CONCAT = 20


def _numeric(kind: T.DataType, same: Column, first: Column) -> Column:
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.when(same, first).otherwise(F.lit(float("nan")))
    if isinstance(kind, T.ByteType):
        return F.when(same, first).otherwise(F.lit(-1).cast("tinyint"))
    if isinstance(kind, T.BooleanType):
        return F.when(same, first).otherwise(F.lit(True))
    return F.when(same, first).otherwise(F.lit(0).cast(kind))


def cluster(
    df: DataFrame, entity: list[str], kind: str = "segments", row_ord: str | None = None, category: bool = True,
) -> DataFrame:
    """One row per group of overlapping segments (or of points with one start).

    start and end span the group. ``val`` stays where all are equal and becomes NaN, 0, -1 or true
    by its type where not; category values are sorted and joined by ``|``, ids and extra columns
    are joined in row order; groups of 20 or more keep the first item and ``...``. ``strand`` becomes
    -1, arrays become missing per slot, or empty where lengths differ, edges and weights empty.
    Null values leave the others as they are. Touching segments stay apart. Texts are gathered
    only for groups below 20, so no group, however large, is collected. Extra columns are read as
    text. Rows without a valid position take no part.
    """
    order = [F.col("start"), F.col("end"), *([F.col(row_ord)] if row_ord else [])]
    if kind == "points":
        labelled = df.where(F.col("start").isNotNull()).withColumn("__island", F.col("start").cast("long"))
    else:
        labelled = label_islands(df, entity, "start", "end", "__island").where(F.col("__island").isNotNull())
    skip = {*entity, "start", "end", row_ord, "edges", "weights", "bin"}
    rest = [c for c in df.columns if c not in skip]
    rank = F.struct(*order)
    aggregates, texts, arrays = [F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_elements")], [], []
    for c in rest:
        dtype = df.schema[c].dataType
        col = F.col(f"`{c}`")
        if isinstance(dtype, T.StringType):
            texts.append(c)
            aggregates += [F.min(col).alias(f"__lo_{c}"), F.max(col).alias(f"__hi_{c}"),
                           F.min(F.when(col.isNotNull(), F.struct(rank, col.alias("v"))))["v"].alias(f"__first_{c}"), F.count(col).alias(f"__n_{c}")]
        elif isinstance(dtype, T.ArrayType):
            arrays.append(c)
            aggregates += [F.min(col).alias(f"__lo_{c}"), F.max(col).alias(f"__hi_{c}"), F.min(F.size(col)).alias(f"__least_{c}"),
                           F.max(F.size(col)).alias(f"__most_{c}")]
        else:
            same = F.min(col).eqNullSafe(F.max(col))
            aggregates.append(_numeric(dtype, same, F.min(col)).alias(c))
    keys = [*[F.col(f"`{c}`") for c in entity], F.col("__island")]
    out = labelled.groupBy(*keys).agg(*aggregates)
    if texts:
        # Only groups that can be written out in full gather their texts.
        small = out.where((F.col("n_elements") > 1) & (F.col("n_elements") < MAX_CONCAT)).select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(entity)], F.col("__island").alias("__ki"))
        on = F.col("__island") == F.col("__ki")
        for i, c in enumerate(entity):
            on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"__k{i}"))
        lists = labelled.join(small, on).groupBy(*[f"__k{i}" for i in range(len(entity))], "__ki").agg(*[
            F.transform(F.array_sort(F.collect_list(F.when(F.col(f"`{c}`").isNotNull(), F.struct(rank.alias("r"), F.col(f"`{c}`").alias("v"))))),
                        lambda x: x["v"]).alias(f"__l_{c}") for c in texts])
        out = out.join(lists, on, "left")
        for c in texts:
            value = c == "val" and category
            joined = F.array_join(F.array_sort(f"__l_{c}") if value else F.col(f"__l_{c}"), "|")
            cut = F.concat(F.col(f"__lo_{c}") if value else F.col(f"__first_{c}"), F.lit("|..."))
            out = out.withColumn(c, F.when(F.col(f"__lo_{c}").eqNullSafe(F.col(f"__hi_{c}")), F.col(f"__lo_{c}"))
                                 .when(F.col(f"__n_{c}") < MAX_CONCAT, F.coalesce(joined, cut)).otherwise(cut))
    for c in arrays:
        inner = df.schema[c].dataType.elementType
        slot = F.lit(float("nan")) if isinstance(inner, T.FloatType | T.DoubleType) else F.lit(-1) if isinstance(inner, T.ByteType) else F.lit("") if isinstance(inner, T.StringType) else F.lit(0)
        out = out.withColumn(c, F.when(F.col(f"__lo_{c}").eqNullSafe(F.col(f"__hi_{c}")), F.col(f"__lo_{c}"))
                             .when(F.col(f"__least_{c}") == F.col(f"__most_{c}"), F.array_repeat(slot.cast(inner), F.col(f"__most_{c}")))
                             .otherwise(F.array().cast(df.schema[c].dataType)))
    for c in ("edges", "weights"):
        if c in df.columns:
            out = out.withColumn(c, F.array().cast(df.schema[c].dataType))
    kept = [c for c in df.columns if c in {*entity, "start", "end", "edges", "weights", *rest}]
    return out.select(*[F.col(f"`{c}`") for c in kept], "n_elements")
