"""Parents with most of the children: the sketch finds them, no task gets much more than its part, rows equal the plain join."""

import pytest
from pyspark.sql import functions as F

from gatewright.operators.hot_keys import hot_keys, join_children
from gatewright.operators.search import matching_or_all


@pytest.fixture
def plain_shuffles(spark):
    """Neither broadcast nor adaptive help."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


@pytest.fixture(scope="module")
def family(spark):
    """Two thirds of 60,000 children are of parent p0; some have no parent, some a parent that is not there, some parents no children."""
    i = F.col("id")
    k = F.when(i % 3 < 2, F.lit("p0")).when(i % 30 == 2, F.lit(None)).otherwise(F.concat(F.lit("p"), (i % 997).cast("string")))
    parents = spark.range(1200).where("id % 5 <> 1").select(F.concat(F.lit("p"), i.cast("string")).alias("k"), F.lit("name").alias("name"))
    return parents, spark.range(60_000).select(k.alias("k"), i.alias("child"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_only_hot_keys_are_found(family):
    found = {r._hot: r._shares for r in hot_keys(family[1], "k").collect()}
    assert set(found) == {"p0"} and found["p0"] > 16


@pytest.mark.parametrize("how", ["inner", "left"])
def test_equals_the_plain_join(family, how):
    parents, children = family
    assert rows(join_children(parents, children, "k", how).select("k", "name", "child")) == rows(
        parents.join(children, "k", how).select("k", "name", "child"))


def test_no_task_gets_twice_the_mean(spark, family, plain_shuffles):
    parents, children = family
    joined = join_children(parents, children, "k", by=["child"]).groupBy(F.spark_partition_id()).count()
    counts = [r["count"] for r in joined.collect()]
    assert len(counts) == 8 and max(counts) <= 2 * sum(counts) / 8
    plain = parents.join(children, "k").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in plain.collect()) > 4 * sum(counts) / 8


def test_matching_children_of_a_hot_parent(family, plain_shuffles):
    children = family[1]
    some = matching_or_all(children, "k", F.col("child") == 6)
    assert some.where("k = 'p0'").count() == 1
    assert some.count() == children.where("k <> 'p0'").count() + 1


def test_no_rows_few_rows_and_clashing_names(spark):
    none = spark.createDataFrame([], "k int, c int")
    one = spark.createDataFrame([(1, "x"), (None, "y")], "k int, name string")
    assert rows(join_children(one, none, "k", "left")) == [(1, "x", None), (None, "y", None)]
    assert join_children(one, none, "k").collect() == []
    same = spark.createDataFrame([(1, 5), (1, 5), (None, 5)], "k int, c int")  # equal rows, all of one key
    assert rows(join_children(one, same, "k", "left")) == [(1, "x", 5), (1, "x", 5), (None, "y", None)]
    with pytest.raises(ValueError):
        join_children(one, same, "k", "outer")
