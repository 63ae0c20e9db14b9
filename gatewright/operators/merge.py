"""Keyed merges, predicated updates and deletes as functions from old state to new state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.operators.clashes import accepted_in_order, total_order
from gatewright.session import cut_lineage
from gatewright.sizing import SMALL_ROWS, few_keys, is_small


def _ordered(df: DataFrame, columns: list[str]) -> bool:
    kinds = dict(df.dtypes)
    return not any("map<" in kinds[c] or "variant" in kinds[c] for c in columns)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by `order`, ties by all other columns. Partial aggregation reduces a hot key before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if _ordered(df, rest):  # each value once, in the row that is compared
        row = F.max(F.struct(*[c for c in order if c in rest], *[c for c in rest if c not in order], F.lit(0).alias("_")))
    else:
        row = F.max_by(F.struct(*rest), F.struct(*order))
    picked = df.groupBy(*keys).agg(row.alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def merge(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    *,
    update: list[str] | None = None,
    keep: list[str] | tuple = (),
    order: list[str] | None = None,
    small_source_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Upsert `source` into `target`.

    update: columns a matching source row overwrites, also with NULL (default: all non-key columns).
    keep:   columns where a stored non-NULL value wins over the source value.
    Columns in neither list keep the stored value. Source rows without a match are inserted; source columns the
    target lacks are ignored, target columns the source lacks become NULL in inserted rows.
    order:  columns that decide which of several source rows per key is the last; leave out if keys are unique.

    A source of few keys is materialised. If its measured size is small it is broadcast, so that the target is not
    shuffled; otherwise there is one full outer join, which shuffles the source once, as its last rows per key are
    picked in the same place. small_source_rows=0 always takes the join.
    """
    few = bool(small_source_rows) and few_keys(source, keys, small_source_rows)
    if order:
        source = latest_per_key(source, keys, order)
    columns = target.columns
    rest = [c for c in columns if c not in keys]
    offered = [c for c in rest if c in source.columns]
    update = [c for c in (offered if update is None else update) if c not in keep]
    src = source.select(*keys, F.struct(F.lit(1).alias("_present"), *offered).alias("_src"))
    src = cut_lineage(src) if few else src
    found = F.col("_src").isNotNull()

    def new_value(c: str) -> Column:
        stored = F.col(c)
        if c in keep and c in offered:
            return F.coalesce(stored, F.col("_src")[c])
        if c in update and c in offered:
            return F.when(found, F.col("_src")[c]).otherwise(stored)
        return stored

    types = dict(target.dtypes)

    def inserted(c: str) -> Column:
        return (F.col("_src")[c] if c in offered else F.lit(None)).cast(types[c])

    if few and is_small(src, small_source_rows):
        updated = target.join(F.broadcast(src), keys, "left").select(
            *[F.col(c) if c in keys else new_value(c).cast(types[c]).alias(c) for c in columns])
        matched = target.select(*keys).join(F.broadcast(src.select(*keys)), keys, "left_semi").distinct()
        fresh = src.join(matched, keys, "left_anti")
        return updated.unionByName(fresh.select(
            *[F.col(c) if c in keys else inserted(c).alias(c) for c in columns]))

    both = target.withColumn("_stored", F.lit(True)).join(src, keys, "full_outer")
    is_new = F.col("_stored").isNull()
    return both.select(*[
        F.col(c) if c in keys else F.when(is_new, inserted(c)).otherwise(new_value(c).cast(types[c])).alias(c)
        for c in columns
    ])


def insert_if_absent(
    target: DataFrame, source: DataFrame, unique_keys: list[list[str]], order: list[str]
) -> DataFrame:
    """Add source rows that collide with no stored row on any unique key; among source rows the earlier one wins.

    NULL key values never collide. With one unique key this is a single aggregation. With several, a row that lost
    on one key must not block others; `clashes.accepted_in_order` decides as insertion one by one would.
    """
    fresh = source.select(*target.columns)
    for key in unique_keys:
        fresh = fresh.join(target.select(*key), key, "left_anti").select(*target.columns)
    if len(unique_keys) == 1:
        return target.unionByName(_first_per_key(fresh, unique_keys[0], order))
    return target.unionByName(accepted_in_order(fresh, unique_keys, order))


def _first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows with the same key the first in `order`, ties by all other columns; rows with NULL in the key all stay, each on its own."""
    rest = [c for c in df.columns if c not in key]
    incomplete = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in key])
    own = F.when(incomplete, F.monotonically_increasing_id())
    if _ordered(df, rest):  # each value once, in the row that is compared
        row = F.min(F.struct(*[c for c in order if c in rest], *[c for c in rest if c not in order], F.lit(0).alias("_")))
    else:
        row = F.min_by(F.struct(*rest, F.lit(0).alias("_")), F.struct(*total_order(df, order)))
    picked = df.withColumn("_own", own).groupBy(*key, "_own").agg(row.alias("_row"))
    return picked.select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def update_where(df: DataFrame, condition: Column, assignments: dict[str, Column]) -> DataFrame:
    """Predicated update; rows where the condition is NULL stay unchanged. All values read the old row."""
    types = dict(df.dtypes)
    return df.withColumns({
        c: F.when(condition, v).otherwise(F.col(c) if c in types else F.lit(None)).cast(types.get(c, "string"))
        for c, v in assignments.items()
    })


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def update_parent(
    parents: DataFrame, children: DataFrame, changes: DataFrame, *, child_key: str, parent_key: str,
    columns: list[str], order: list[str],
) -> DataFrame:
    """Route changes given per child to the parent row; the last change per parent wins."""
    routed = changes.join(children.select(child_key, parent_key), child_key).select(
        parent_key, *columns, *[c for c in order if c not in columns])
    latest = latest_per_key(routed, [parent_key], order)
    merged = parents.join(
        latest.select(parent_key, F.struct(*columns).alias("_new")), parent_key, "left")
    return merged.select(*[
        F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in parents.columns
    ])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
