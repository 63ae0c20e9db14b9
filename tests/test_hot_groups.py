"""One key with most of the rows."""

import pytest
from pyspark.sql import Window, functions as F

from gatewright.operators.numbering import number_rows, number_within
from gatewright.operators.running import in_blocks, running_values
from gatewright.operators.textroll import text_pieces


@pytest.fixture(scope="module")
def hot(spark):
    """Key 0 holds two thirds of 3,000 rows, key -1 is NULL."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, F.lit(0)).otherwise(F.nullif(F.col("id") % 50, F.lit(49))).cast("int").alias("k"), "id",
        (F.col("id") * 7919 % 1000).alias("v"))


def test_numbers_equal_row_number_and_spread(hot):
    order = [F.col("v"), F.col("id")]
    ours = number_rows(hot, order, "n", partitions=6)
    want = hot.withColumn("n", F.row_number().over(Window.orderBy("v", "id")))
    assert {(r.id, r.n) for r in ours.collect()} == {(r.id, r.n) for r in want.collect()}


def test_numbers_within_groups(hot):
    ours = number_within(hot, ["k"], [F.col("v").desc(), F.col("id")], "n")
    want = hot.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.col("v").desc(), "id")))
    assert {(r.id, r.n) for r in ours.collect()} == {(r.id, r.n) for r in want.collect()}


def test_a_hot_key_does_not_stay_in_one_partition(hot):
    placed = hot.repartitionByRange(6, "k", "v", "id").where("k = 0").select(F.spark_partition_id().alias("p")).distinct()
    assert placed.count() > 2


def test_text_pieces_hold_every_row(hot):
    df = hot.where("k IS NOT NULL")
    out = text_pieces(df, ["k"], F.col("id").cast("string"), ["v", "id"], piece_rows=100).collect()
    assert max(len(r.text.split()) for r in out) == 100
    assert len({r.piece for r in out if r.k == 0}) == -(-df.where("k = 0").count() // 100)
    got = sorted(int(x) for r in out for x in r.text.split())
    assert got == sorted(r.id for r in df.collect())
    pieces = sorted((r.piece, r.text) for r in text_pieces(df, ["k"], F.col("id").cast("string"), ["v", "id"], piece_rows=7).where("k = 0").collect())
    assert all(len(text.split()) == 7 for _, text in pieces[:-1])
    assert " ".join(text for _, text in pieces).split() == [str(r.id) for r in df.where("k = 0").orderBy("v", "id").collect()]
    whole = text_pieces(df, ["k"], F.col("id").cast("string"), ["v", "id"]).where("k = 0").first()
    assert whole.piece == 0 and whole.text.split() == [str(r.id) for r in df.where("k = 0").orderBy("v", "id").collect()]


@pytest.mark.parametrize("block_rows", [10_000, 37])
def test_running_values_over_blocks(hot, block_rows):
    df, blocks = in_blocks(hot.where("k IS NOT NULL"), ["k"], [F.col("v"), F.col("id")], block_rows)
    assert (blocks > 1) == (block_rows == 37)
    values = {"last_even": ("last", F.when(F.col("v") % 2 == 0, F.col("v"))), "top": ("max", F.col("id"))}
    got = {(r.id, r.last_even, r.top) for r in running_values(df, ["k"], values, blocks).collect()}
    w = Window.partitionBy("k").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = hot.where("k IS NOT NULL").withColumns({
        "last_even": F.last(F.when(F.col("v") % 2 == 0, F.col("v")), ignorenulls=True).over(w), "top": F.max("id").over(w)})
    assert got == {(r.id, r.last_even, r.top) for r in want.collect()}
