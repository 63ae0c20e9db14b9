"""Merge policies, and that repeating a merge changes nothing."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gatewright.operators import merge as m

SCHEMA = "k bigint, a string, b string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("small", [0, 1000])
def test_policies(spark, small):
    target = spark.createDataFrame([(1, "x", None), (2, "y", "q"), (3, "z", "r")], SCHEMA)
    source = spark.createDataFrame([(2, None, "new"), (3, "n", None), (4, "w", None)], SCHEMA)
    go = lambda **kw: rows(m.merge(target, source, ["k"], small_source_rows=small, **kw))
    assert go() == [(1, "x", None), (2, None, "new"), (3, "n", None), (4, "w", None)]
    assert go(update=["a"]) == [(1, "x", None), (2, None, "q"), (3, "n", "r"), (4, "w", None)]
    assert go(update=["a"], keep=["b"]) == [(1, "x", None), (2, None, "q"), (3, "n", "r"), (4, "w", None)]
    once = m.merge(target, source, ["k"], small_source_rows=small)
    assert rows(m.merge(once, source, ["k"], small_source_rows=small)) == rows(once)


def test_last_row_per_key_wins(spark):
    target = spark.createDataFrame([(1, "x", "x")], SCHEMA)
    source = spark.createDataFrame([(1, "p", "p", 1), (1, "q", "q", 3), (1, "r", "r", 2)], SCHEMA + ", at int")
    assert rows(m.merge(target, source, ["k"], order=["at"])) == [(1, "q", "q")]


def greedy(target, source):
    ks, names, out = {t[0] for t in target}, {t[1] for t in target}, list(target)
    for k, n in sorted(set(source)):
        if k not in ks and n not in names:
            out.append((k, n))
            ks.add(k)
            names.add(n)
    return sorted(out)


PAIRS = st.lists(st.tuples(st.integers(0, 4), st.sampled_from("abcde")), max_size=7)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(source=PAIRS)
def test_insert_if_absent_with_two_unique_keys(spark, source):
    target = [(0, "a")]
    schema = "k int, n string"
    out = m.insert_if_absent(spark.createDataFrame(target, schema), spark.createDataFrame(sorted(set(source)), schema),
                             [["k"], ["n"]], ["k", "n"])
    assert rows(out) == greedy(target, source)


def test_insert_if_absent_with_one_key_ties_and_nulls(spark):
    target = spark.createDataFrame([(1, "x", None)], SCHEMA)
    source = spark.createDataFrame([(1, "n", "n"), (2, "b", "q"), (2, "b", "p"), (2, "b", "p"), (None, "u", None), (None, "u", None)], SCHEMA)
    assert rows(m.insert_if_absent(target, source, [["k"]], ["a"])) == [
        (1, "x", None), (2, "b", "p"), (None, "u", None), (None, "u", None)]


def test_predicates_with_null_leave_rows_alone(spark):
    df = spark.createDataFrame([(1, None, "b"), (2, "x", "b")], SCHEMA)
    assert rows(m.update_where(df, F.col("a") == "x", {"b": F.lit("hit")})) == [(1, None, "b"), (2, "x", "hit")]
    assert rows(m.delete_where(df, F.col("a") == "x")) == [(1, None, "b")]
