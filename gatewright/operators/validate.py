"""Batch validation: rows keep flowing, errors become a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.functions.text import slug


def reference_flag(df: DataFrame, value: Column, dim: DataFrame, dim_key: str, flag: str) -> DataFrame:
    """Add a boolean: whether `value` is a key of `dim`."""
    known = dim.select(F.col(dim_key).alias("_ref")).distinct().withColumn("_known", F.lit(True))
    joined = df.withColumn("_ref", value).join(known, "_ref", "left")
    return joined.withColumn(flag, F.coalesce("_known", F.lit(False))).drop("_ref", "_known")


def check_reference(
    df: DataFrame, column: str, dim: DataFrame, dim_key: str, label: str, *, required: bool = True,
    default: str | None = None, default_if: str = "absent_or_blank",
) -> DataFrame:
    """Resolve a reference: adds <column>_ref (slug, with default) and <column>_error.

    default_if 'absent_or_blank' replaces NULL and '', 'absent' replaces NULL only.
    """
    raw = F.col(column)
    if default is not None:
        raw = F.coalesce(F.nullif(raw, F.lit("")) if default_if == "absent_or_blank" else raw, F.lit(default))
    df = df.withColumn(f"{column}_ref", slug(raw))
    df = reference_flag(df, F.col(f"{column}_ref"), dim, dim_key, "_ok")
    ref = F.col(f"{column}_ref")
    errors = [F.when(ref == "", F.lit(f"{label} is required"))] if required else []
    errors.append(F.when((ref != "") & ~F.col("_ok"), F.lit(f"{label} is not valid")))
    return df.withColumn(f"{column}_error", F.coalesce(*errors)).drop("_ok")


def split(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(accepted rows without the error column, refused rows)."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())
