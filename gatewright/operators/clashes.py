"""Which of many new rows an insertion one by one would accept, if several unique keys must stay unique.

A row that lost on one key must not block others, so each decision may depend on the one before. Rows are numbered in their order,
and values of a key that several rows share become numbers too; from there on only these numbers move:

1. What clashes with nothing, or comes first on all of its keys, is accepted at once; what clashes with an accepted row goes.
2. The rest falls into connected components of the clash graph, which decide independently. Each is decided in order within one task,
   at most `block` rows of it at a time; rows beyond that which clash with an accepted row go, and the others start again with 1.

Passes are bounded by the size of the largest component over `block`; a chain of clashes shorter than a block takes one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.operators.components import components
from gatewright.operators.numbering import number_rows, number_within
from gatewright.session import cut_lineage

BLOCK_ROWS = 100_000
_DEALS = 64


def total_order(df: DataFrame, order: list[str]) -> list[Column]:
    """`order`, then all other columns, so that only rows that are equal throughout are left without an order."""
    kinds = dict(df.dtypes)
    return [F.to_json(F.struct(c)) if "map<" in kinds[c] or kinds[c] == "variant" else F.col(c)
            for c in [*order, *[c for c in df.columns if c not in order]]]


def with_group_values(df: DataFrame, key: list[str], deal: str, values: dict[str, tuple[Callable, str]]) -> DataFrame:
    """Adds values of each row's group, NULL where a key column is NULL; values: name -> (F.min, F.max or F.sum, column).

    Rows of a group are dealt by the number `deal`, reduced per share before the shuffle, and meet their share's row again, so
    no task gets more than a share of a hot group. A group has at most 64 shares.
    """
    dealt = df.withColumn("_share", F.pmod(deal, F.lit(_DEALS)))
    shares = dealt.dropna(subset=key).groupBy(*key, "_share").agg(*[f(c).alias(n) for n, (f, c) in values.items()])
    whole = Window.partitionBy(*key)
    shares = shares.select(*key, "_share", *[f(n).over(whole).alias(n) for n, (f, _) in values.items()])
    return dealt.join(shares, [*key, "_share"], "left").select(*df.columns, *values)


def _accepted_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component and number: accepts what meets no value that an accepted row of the component has."""
    component, taken = None, set()
    for batch in batches:
        of, *groups = [batch.column(i).to_pylist() for i in range(batch.num_columns) if batch.schema.names[i] != "_n"]
        won = []
        for own, *held in zip(of, *groups):
            if own != component:
                component, taken = own, set()
            values = {(i, g) for i, g in enumerate(held) if g is not None}
            won.append(taken.isdisjoint(values))
            if won[-1]:
                taken |= values
        yield pa.RecordBatch.from_arrays([batch.column("_n"), pa.array(won, pa.bool_())], ["_n", "_won"])


def _every(tests: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, tests)


def _still_open(marked: DataFrame, groups: list[str]) -> DataFrame:
    """Of rows with `_won` (NULL: undecided), the undecided ones that share no value with an accepted one."""
    for g in groups:
        marked = with_group_values(marked, [g], "_n", {f"_taken{g}": (F.max, "_won")})
    free = _every([~F.coalesce(F.col(f"_taken{g}"), F.lit(False)) for g in groups])
    return cut_lineage(marked.where(F.col("_won").isNull() & free).select("_n", *groups))


def _first_everywhere(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Adds `_won`: true for rows that come first on each of their values, else NULL."""
    for g in groups:
        rows = with_group_values(rows, [g], "_n", {f"_lead{g}": (F.min, "_n")})
    first = _every([F.coalesce(F.col(f"_lead{g}") == F.col("_n"), F.lit(True)) for g in groups])
    return rows.select("_n", *groups, F.when(first, True).alias("_won"))


def _component_blocks(rows: DataFrame, groups: list[str], block: int) -> DataFrame:
    """Adds `_won`: decisions for the first `block` rows of each component in order, NULL for the rest."""
    led = rows
    for g in groups:
        led = with_group_values(led, [g], "_n", {f"_lead{g}": (F.min, "_n")})
    links = led.select("_n", F.explode(F.array(*[f"_lead{g}" for g in groups])).alias("_to"))
    of = components(links, "_n", "_to").withColumnsRenamed({"node": "_n", "component": "_of"})
    placed = rows.join(of, "_n", "left").withColumn("_of", F.coalesce("_of", "_n"))
    placed = cut_lineage(number_within(placed, ["_of"], [F.col("_n")], "_place"))
    now = placed.where(F.col("_place") <= block).select("_of", "_n", *groups)
    decided = now.repartition("_of").sortWithinPartitions("_of", "_n").mapInArrow(_accepted_in_order, "_n bigint, _won boolean")
    return cut_lineage(placed.select("_n", *groups).join(decided, "_n", "left"))


def accepted_in_order(rows: DataFrame, unique_keys: list[list[str]], order: list[str], block: int = BLOCK_ROWS) -> DataFrame:
    """The rows that insertion one by one, in `order`, accepts: those that share no key value with an accepted earlier one.

    A key with a NULL column clashes with nothing, so rows without any whole key all stay. Ties in `order` go by all other columns;
    of rows that are equal throughout one is accepted. Columns whose names this module uses itself keep their values.
    """
    columns = rows.columns
    plain = rows.toDF(*[f"c{i}" for i in range(len(columns))])
    name = dict(zip(columns, plain.columns))
    keys = [[name[c] for c in key] for key in unique_keys]
    numbered = number_rows(plain, total_order(plain, [name[c] for c in order]), "_n")
    groups = [f"_g{i}" for i in range(len(keys))]
    places = numbered.select("_n", *dict.fromkeys(c for key in keys for c in key))
    for g, key in zip(groups, keys):
        places = with_group_values(places, key, "_n", {f"{g}_lo": (F.min, "_n"), f"{g}_hi": (F.max, "_n")})
    places = cut_lineage(places.select(
        "_n", *[F.when(F.col(f"{g}_lo") < F.col(f"{g}_hi"), F.col(f"{g}_lo")).alias(g) for g in groups]))
    alone = _every([F.col(g).isNull() for g in groups])
    accepted = [places.where(alone).select("_n")]
    left = places.where(~alone)
    while not left.isEmpty():
        for decide in (_first_everywhere, lambda r, g: _component_blocks(r, g, block)):
            marked = cut_lineage(decide(left, groups))
            accepted.append(marked.where("_won").select("_n"))
            left = _still_open(marked, groups)
            if left.isEmpty():
                break
    won = reduce(DataFrame.unionByName, accepted)
    return numbered.join(won, "_n", "left_semi").select(*[F.col(n).alias(c) for c, n in name.items()])
