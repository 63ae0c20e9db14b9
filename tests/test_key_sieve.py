"""Rows whose key is surely absent stay where they are; what is kept between stages is written once, by columns."""

import pytest
from pyspark.sql import functions as F

from gatewright.operators import key_sieve
from gatewright.operators.key_sieve import KeySieve
from gatewright.operators.textroll import text_pieces
from gatewright.plans import answers as an, workflow as wf
from gatewright.session import cut_lineage
from gatewright.sources.adapter import Views, submissions, submitted_answers


class SmallTables:
    """Eight customers with fifty orders each, of which events name the first or last of two customers."""

    def __init__(self, spark):
        self.spark = spark
        self.region = spark.createDataFrame([(0, "ASIA")], "r_regionkey int, r_name string")
        self.nation = spark.createDataFrame([(0, "INDIA", 0)], "n_nationkey int, n_name string, n_regionkey int")
        self.customer = spark.range(1, 9).selectExpr("id c_custkey", "concat('C', id) c_name", "0 c_nationkey", "1.0d c_acctbal", "'BUILDING' c_mktsegment")
        self.supplier = spark.range(1, 13).selectExpr("id s_suppkey", "concat('S', id) s_name", "0 s_nationkey", "1.0d s_acctbal")
        self.orders = spark.range(1, 401).selectExpr("id o_orderkey", "1 + id % 8 o_custkey", "'O' o_orderstatus", "5e4d o_totalprice",
                                                     "timestamp_ntz'2024-01-01 00:00:00' o_orderdate", "'1-URGENT' o_orderpriority")
        self.events = spark.createDataFrame(
            [(i, 1 + i % 2, ("view", "click")[i % 2]) for i in range(1, 30)], "event_id bigint, user_id bigint, event_type string").selectExpr(
            "event_id", "timestamp_ntz'2024-02-01 00:00:00' ts", "user_id", "event_type", "1.0d value", "'' props")


@pytest.fixture(scope="module")
def small(spark):
    return Views(SmallTables(spark))


@pytest.fixture(scope="module")
def applied(small):
    return an.apply_answers(small, submissions(small), submitted_answers(small), mail_domain="example.com")


def test_every_row_of_a_key_that_is_there_goes_through(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("k"), "id")
    for keys, most in ((100, 27), (9_000, 15)):
        sieve = KeySieve(cut_lineage(rows.where(f"id < {keys}").select("k")), ["k"], most)
        through, rest = sieve.through(rows), sieve.rest(rows)
        assert through.columns == rest.columns == rows.columns
        assert through.where(f"id < {keys} AND k IS NOT NULL").count() == sum(1 for i in range(keys) if i % 7)
        assert sorted(r.id for r in through.unionByName(rest).collect()) == list(range(20_000))
    few = KeySieve(cut_lineage(rows.where("id < 100").select("k")), ["k"])
    assert few.bits == key_sieve.LEAST and few.through(rows.where("k IS NOT NULL")).count() < 1_000
    assert KeySieve(cut_lineage(rows.limit(0).select("k")), ["k"]).rest(rows).count() == 20_000


def test_rows_are_kept_by_columns(spark):
    kept = cut_lineage(spark.range(1000).select("id", F.lit("long text " * 20).alias("t"), F.array(F.struct("id")).alias("a")))
    assert kept.inputFiles() and kept.count() == 1000
    odd = cut_lineage(spark.range(3).select("id", F.lit(None).alias("nothing")))
    assert [tuple(r) for r in odd.orderBy("id").collect()] == [(0, None), (1, None), (2, None)]
    assert cut_lineage(spark.range(2).selectExpr("id a", "id + 1 A")).count() == 2


def test_stored_answers_of_other_products_are_not_merged(small, applied, monkeypatch):
    merged = []
    monkeypatch.setattr(an, "merge", lambda target, *a, m=an.merge, **k: merged.append(target.count()) or m(target, *a, **k))
    out, stored = applied.answers, small.answers.count()
    assert merged[0] < stored / 4
    assert out.count() >= stored and out.columns == small.answers.columns


def test_other_products_are_not_joined(small, applied, monkeypatch):
    joined = []
    monkeypatch.setattr(an, "_overlay", lambda df, *a, m=an._overlay: joined.append(df.count()) or m(df, *a))
    out = applied.products
    assert joined[0] < 100 and out.count() == 400 and out.columns == small.products.columns


def test_only_values_that_the_parent_shows_are_grouped(spark):
    rows = spark.createDataFrame([("a", "initiative", "x", 1), ("b", "jira_link", "y", 1)], "k string, requirement_key string, stored_value string, pos int")
    assert [r.k for r in an._last_written(rows, "k", ["initiative"]).collect()] == ["a"]


def test_answers_of_submissions_move_without_their_heads(applied):
    assert not {"submitted_at", "data_product_id", "request_id", "pos"} & set(applied.writes.columns)


def test_only_rows_that_may_be_submitted_for_are_compared(small, applied, monkeypatch):
    from gatewright.catalog.workflow import _differences

    sieved = []
    monkeypatch.setattr(KeySieve, "through", lambda self, rows, m=KeySieve.through: sieved.append(rows.columns) or m(self, rows))
    applied.__dict__.pop("changed", None)
    assert applied.changed.count() > 0 and len(sieved) == 2
    assert _differences(small).count() > 0 and len(sieved) == 4


def test_keys_are_counted_before_they_are_dealt(spark):
    rows = spark.range(60).select((F.col("id") % 2).alias("k"), "id")
    kept = rows.where("k = 0").repartition("k")
    counted = rows.where("k IS NOT NULL")
    got = {(r.k, r.piece): r.text.split() for r in text_pieces(
        kept, ["k"], F.col("id").cast("string"), ["id"], piece_rows=20, dealt=True, counted=counted).collect()}
    assert got == {(0, 0): [str(i) for i in range(0, 40, 2)], (0, 1): [str(i) for i in range(40, 60, 2)]}
