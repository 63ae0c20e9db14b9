"""Joined child texts per parent, in pieces of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.operators.numbering import number_within
from gatewright.session import cut_lineage

PIECE_ROWS = 10_000


def text_pieces(
    df: DataFrame, keys: list[str], text: Column, order: list[str], *, sep: str = " ", piece_rows: int = PIECE_ROWS,
    out: str = "text", dealt: bool = False, counted: DataFrame | None = None,
) -> DataFrame:
    """(keys, piece, <out>): the texts of each key joined in `order`, ties by text.

    Every key is cut by position: piece n holds the rows n * piece_rows + 1 and on. The pieces of a key put together in order
    are its whole text, whatever its size. Keys are counted first. A key of one piece is put together where its rows meet, after one
    shuffle. The rows of longer keys get positions from a range sort, so a hot key spreads over tasks. dealt: df is partitioned by the keys.
    counted: rows that hold at least those of df, not dealt yet, so that counting them brings one row of a key and task to the shuffle.
    """
    by = [c for c in order if c not in keys]
    rows = df.select(*keys, *by, text.alias("_text"))
    long = cut_lineage((df if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > piece_rows).select(
        *[F.col(k).alias(f"_long_{k}") for k in keys]))
    same = [F.col(k).eqNullSafe(F.col(f"_long_{k}")) for k in keys]
    any_long = not long.isEmpty()
    short = rows.join(long, same, "left_anti") if any_long else rows
    # dealt before they are listed, as lists of unfinished keys are no smaller than their rows
    whole = _joined(short if dealt else short.repartition(*keys), keys, by, sep, out).select(*keys, F.lit(0).cast("bigint").alias("piece"), out)
    if not any_long:
        return whole
    placed = number_within(rows.join(long, same, "left_semi"), keys, [*[F.col(c) for c in order], F.col("_text")], "_at")
    cut = placed.withColumn("piece", F.floor((F.col("_at") - 1) / F.lit(piece_rows)).cast("bigint"))
    return whole.unionByName(_joined(cut, [*keys, "piece"], ["_at"], sep, out))


def _joined(rows: DataFrame, keys: list[str], order: list[str], sep: str, out: str) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct(*order, "_text")))
    return rows.groupBy(*keys).agg(F.concat_ws(sep, F.transform(listed, lambda r: r["_text"])).alias(out))
