"""Joins of many rows to their parent where one parent may hold most of the rows.

A frequent-items sketch finds the keys that hold a notable part of all rows, in one pass and without a shuffle of rows. Rows of these
keys are dealt into shares by the hash of the row and their parents are repeated once per share; all other keys are joined plainly.
What the sketch finds decides about cost only, never about results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

TRACKED, REPORTED = 16_384, 1_000  # the sketch errs by 3.5 rows in TRACKED; at most REPORTED keys reach the driver
_PER_TASK = 8  # shares of a key that holds all rows, per task of a shuffle, so that hashing deals them evenly


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """(_hot, _shares): keys with more than 1 / (8 x shuffle partitions) of the rows; together at most 8 x partitions + 1,000 shares."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = F.expr(f"approx_top_k(`{key}`, {REPORTED}, {TRACKED})")
    total, found = df.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)), top).first()
    size = max(1.0, total / (_PER_TASK * tasks))
    rows = [(item, int(count / size) + 1) for item, count in found or [] if count > size]
    schema = StructType([StructField("_hot", df.schema[key].dataType), StructField("_shares", IntegerType())])
    return spark.createDataFrame(rows, schema)


def _with_shares(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    return df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").drop("_hot")


def join_children(parents: DataFrame, children: DataFrame, key: str, how: str = "inner", by: list[str] | None = None) -> DataFrame:
    """`parents` (one row per key) joined with `children` on `key`; no task gets more than a share of a hot parent's children.

    how: "inner", or "left" for parents without children too. Rows with a NULL key have no partner.
    by: columns of the children that tell those of one parent well enough apart (default: all but maps).
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    hot = hot_keys(children, key)
    plain = by or [c for c, kind in children.dtypes if "map<" not in kind and kind != "variant"]
    own: Column = F.coalesce(F.pmod(F.xxhash64(*plain), "_shares"), F.lit(0)).cast("int")
    dealt = _with_shares(children.dropna(subset=[key]), key, hot).withColumn("_share", own).drop("_shares")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))
    repeated = _with_shares(parents, key, hot).withColumn("_share", copies).withColumn("_many", F.col("_shares").isNotNull()).drop("_shares")
    if how == "inner":
        return repeated.drop("_many").join(dealt, [key, "_share"]).drop("_share")
    joined = repeated.join(dealt.withColumn("_child", F.lit(True)), [key, "_share"], "left")
    # a hot parent has children, so its copies without any are no rows
    return joined.where(F.col("_child") | ~F.col("_many")).drop("_share", "_many", "_child")
