"""Inserts under several unique keys equal insertion one by one, at any block size and without a pass per link."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gatewright.operators import clashes
from gatewright.operators.components import components
from gatewright.operators.merge import insert_if_absent

SCHEMA = "k int, n string, m int"
KEYS = [["k"], ["n"], ["n", "m"]]


def one_by_one(rows, keys=((0,), (1,), (1, 2))):
    low = lambda row: [(v is not None, v) for v in row]
    taken, out = [set() for _ in keys], []
    for row in sorted(rows, key=low):
        held = [tuple(row[i] for i in key) for key in keys]
        held = [None if None in h else h for h in held]
        if all(h is None or h not in t for h, t in zip(held, taken)):
            out.append(row)
            for h, t in zip(held, taken):
                t.add(h)
    return sorted(out, key=low)


def decided(spark, rows, block=clashes.BLOCK_ROWS):
    df = clashes.accepted_in_order(spark.createDataFrame(rows, SCHEMA), KEYS, ["k"], block)
    return sorted((tuple(r) for r in df.collect()), key=lambda row: [(v is not None, v) for v in row])


ROWS = st.lists(st.tuples(st.none() | st.integers(0, 6), st.none() | st.sampled_from("abcde"), st.none() | st.integers(0, 2)), max_size=14)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS, block=st.sampled_from([1, 3, 1000]))
def test_equals_one_by_one(spark, rows, block):
    assert decided(spark, rows, block) == one_by_one(rows)


def test_dense_clashes_in_small_blocks(spark):
    r = random.Random(5)
    rows = [(r.randrange(160), "n%d" % r.randrange(120), r.choice([None, 0, 1])) for _ in range(600)]
    assert decided(spark, rows, 50) == one_by_one(rows)


@pytest.fixture
def passes(monkeypatch):
    seen, blocks = [], clashes._component_blocks
    monkeypatch.setattr(clashes, "_component_blocks", lambda *a: seen.append(1) or blocks(*a))
    return seen


def test_a_chain_of_10000_takes_one_pass(spark, passes):
    """Row i shares one key with the row before and the other with the row behind: every second row stays."""
    i = F.col("id")
    chain = spark.range(10_000).select(
        i.alias("at"), F.when(i % 2 == 0, i).otherwise(i - 1).alias("k"), F.when(i % 2 == 1, i).otherwise(i - 1).alias("n"))
    left = clashes.accepted_in_order(chain, [["k"], ["n"]], ["at"])
    assert len(passes) == 1
    assert left.where("at % 2 = 0").count() == 5000 and left.count() == 5000


def test_a_third_of_all_rows_share_one_value(spark, passes):
    i = F.col("id")
    rows = spark.range(30_000).select(i.alias("at"), F.when(i % 3 == 0, -1).otherwise(i).alias("k"), (i + i % 2).alias("n"))
    want = one_by_one([tuple(r) for r in rows.collect()], ((1,), (2,)))
    left = clashes.accepted_in_order(rows, [["k"], ["n"]], ["at"], block=500)
    assert sorted(tuple(r) for r in left.collect()) == want


def test_shares_of_a_hot_group(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, 7).alias("g"))
    out = clashes.with_group_values(rows, ["g"], "id", {"low": (F.min, "id"), "all": (F.sum, "id")})
    assert out.where("g = 7").select("low", "all").distinct().collect() == [(0, sum(range(900)))]
    assert out.where("g IS NULL AND low IS NULL AND `all` IS NULL").count() == 100


def test_insert_with_clashing_names_maps_and_no_rows(spark):
    schema = "_n int, _won string, c0 map<string,int>"
    target = spark.createDataFrame([(1, "a", None)], schema)
    source = spark.createDataFrame([(2, "a", None), (2, "b", {"x": 1}), (3, "b", None), (3, "c", None), (3, "c", None), (None, None, None), (None, None, None)], schema)
    out = insert_if_absent(target, source, [["_n"], ["_won"]], ["_n", "_won"])
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [
        (1, "a", None), (2, "b", {"x": 1}), (3, "c", None), (None, None, None), (None, None, None)]))
    assert insert_if_absent(target, source.limit(0), [["_n"], ["_won"]], ["_n"]).collect() == target.collect()


def test_components(spark):
    links = [(5, 4), (4, 9), (9, 9), (1, 2), (2, 1), (None, 3), (8, 8)] + [(i, i + 1) for i in range(100, 160)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(links, "a int, b int"), "a", "b").collect())
    assert found == {4: 4, 5: 4, 9: 4, 1: 1, 2: 1} | {i: 100 for i in range(100, 161)}
    assert components(spark.createDataFrame([], "a int, b int"), "a", "b").collect() == []
