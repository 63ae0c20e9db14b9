"""Running values over ordered groups of any size.

Rows get a position within their group and a block number from it. Windows run per block; what earlier blocks end
with is carried over by a small second pass. A group that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.operators.numbering import number_within
from gatewright.session import cut_lineage

BLOCK_ROWS = 100_000


def in_blocks(df: DataFrame, group: list[str], order: list[Column], block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """Add pos and block, materialised; also the number of blocks of the largest group. Rows with a NULL group count as one block."""
    placed = number_within(df, group, order, "pos").withColumn("block", F.floor((F.col("pos") - 1) / block_rows))
    placed = cut_lineage(placed)
    return placed, 1 + (placed.dropna(subset=group).agg(F.max("block")).first()[0] or 0)


def running_values(df: DataFrame, keys: list[str], values: dict[str, tuple[str, Column]], blocks: int) -> DataFrame:
    """Add values over the earlier rows of each key: ('last', c) the last non-NULL c, ('max', c) the largest.

    keys starts with the columns the blocks were made for, so position order is also the order within the key.
    """
    w = Window.partitionBy(keys[0], "block", *keys[1:]).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    local = {n: (F.last(c, ignorenulls=True) if kind == "last" else F.max(c)).over(w) for n, (kind, c) in values.items()}
    if blocks == 1:
        return df.withColumns(local)
    ends = df.groupBy(*keys, "block").agg(*[
        (F.max_by(c, F.when(c.isNotNull(), F.col("pos"))) if kind == "last" else F.max(c)).alias(n)
        for n, (kind, c) in values.items()])
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "block", *[
        (F.last(n, ignorenulls=True) if kind == "last" else F.max(n)).over(before).alias(f"_carry_{n}")
        for n, (kind, _) in values.items()])
    joined = df.withColumns(local).join(carried, [*keys, "block"])
    return joined.withColumns({
        n: F.coalesce(n, f"_carry_{n}") if kind == "last" else F.greatest(n, f"_carry_{n}")
        for n, (kind, _) in values.items()
    }).drop(*[f"_carry_{n}" for n in values])
