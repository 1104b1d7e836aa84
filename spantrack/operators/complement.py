"""Adding columns from a second track by id or position."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..errors import InvalidFormatError


def complement(df: DataFrame, db: DataFrame, by: str, columns: list[str], check_unique: bool = True) -> DataFrame:
    """Left join of ``columns`` of ``db``. ``by`` is id, or position (genome, seqid, start and end,
    where null equals null). Keys must be unique in ``db``; elements without a match get ``.`` in
    text columns, NaN in numbers, empty arrays."""
    if by not in ("id", "position"):
        raise InvalidFormatError("by must be id or position")
    keys = ["id"] if by == "id" else [c for c in ("genome", "seqid", "start", "end") if c in df.columns and c in db.columns]
    side = db.select(*[F.col(k).alias(f"__{k}") for k in keys], *columns, F.lit(True).alias("__hit"))
    if check_unique:
        again = side.groupBy(*[f"__{k}" for k in keys]).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
        if again:
            raise InvalidFormatError(f"repeated key {again[0]}")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = df.drop(*[c for c in columns if c in df.columns]).join(side, on, "left")
    for c in columns:
        dtype = db.schema[c].dataType
        none = F.lit(".") if isinstance(dtype, T.StringType) else F.lit(float("nan")) if isinstance(dtype, T.FloatType | T.DoubleType) else (
            F.array().cast(dtype) if isinstance(dtype, T.ArrayType) else F.lit(None).cast(dtype))
        out = out.withColumn(c, F.when(F.col("__hit"), F.col(c)).otherwise(none))
    return out.drop("__hit", *[f"__{k}" for k in keys])
