"""Consecutive numbers over a global order without moving all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.functions.text import number_sort_value, zero_fill
from gatewright.session import cut_lineage

_IN_PARTITION = (1 << 33) - 1


def _ranged(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """The rows sorted by range and checkpointed, with `_slot`: the partition's number and the place in it."""
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    return cut_lineage(ranged.select("*", F.monotonically_increasing_id().alias("_slot")))


def number_rows(df: DataFrame, order: list[Column], name: str = "position", partitions: int | None = None) -> DataFrame:
    """Add 1-based positions in the total order `order`; equals row_number() over the whole relation.

    Rows are range-partitioned by the order columns, so equal leading values, however many, spread over tasks as
    long as the trailing columns tell rows apart. The sorted rows are checkpointed once: partition ids and offsets
    below come from the same materialised rows and survive lost executors. Offsets are one row per partition.
    """
    ranged = _ranged(df, order, partitions)
    pid = F.shiftright("_slot", 33)
    sizes = ranged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_pid", pid).join(F.broadcast(offsets), "_pid")
    return placed.select(
        *df.columns, (F.col("_before") + F.col("_slot").bitwiseAND(F.lit(_IN_PARTITION)) + 1).alias(name))


def number_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """1-based positions per key group; a group may span tasks.

    Rows find their group's start by (partition, key): what a hot key has in one partition meets one row, and no task gets
    more of it than a partition holds.
    """
    placed = _ranged(df, [F.col(k) for k in keys] + order).withColumn("_pid", F.shiftright("_slot", 33))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("_pid", *keys).agg(F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    runs = runs.select("_pid", *keys, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    runs = runs.withColumnsRenamed({k: f"_key_{k}" for k in keys}).withColumnRenamed("_pid", "_run")
    same = [F.col("_pid") == F.col("_run"), *[F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]]
    position = F.col("_before") + F.col("_slot") - F.col("_first") + 1
    return placed.join(runs, same).select(*df.columns, position.alias(name))


def allocate_numbers(
    existing: DataFrame, number_column: str, new_rows: DataFrame, order: list[Column], out: str
) -> DataFrame:
    """Give new rows the numbers after the largest stored one, in `order`, as 8-digit text."""
    top = existing.agg(F.coalesce(F.max(number_sort_value(number_column)), F.lit(0)).alias("_top")).scalar()
    return number_rows(new_rows, order, "_n").withColumn(
        out, zero_fill((F.col("_n") + top).cast("string"))).drop("_n")
