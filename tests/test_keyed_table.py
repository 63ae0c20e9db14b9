"""Keyed tables: every change equals the plain merge; files of untouched buckets keep name and bytes."""

import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F

from gatewright.operators.merge import insert_if_absent, merge
from gatewright.sources import buckets
from gatewright.sources.keyed_table import KeyedTable

SCHEMA = "k bigint, l string, a string, b string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(root):
    return {str(f): hashlib.sha256(f.read_bytes()).hexdigest() for f in pathlib.Path(root).glob("base/*/*/*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    stored = spark.range(300).select("id", F.col("id").cast("string"), F.lit("x"), F.when(F.col("id") % 2 == 0, "s")).toDF("k", "l", "a", "b")
    t = KeyedTable(spark, str(tmp_path / "t"), ["k", "l"], SCHEMA, buckets=16)
    assert t.read().count() == 0
    assert t.create(stored) == 0
    return t


def test_untouched_files_keep_name_and_bytes(spark, table):
    before, old = files(table.root), table.read()
    want = rows(old)
    source = spark.createDataFrame([(7, "7", "new"), (1000, "z", "new")], "k int, l string, a string")
    touched = table.touched(source)
    assert 1 <= len(touched) <= 2
    plain = rows(merge(table.read(), source, ["k", "l"]))
    assert table.upsert(source) == 1
    assert rows(table.read()) == plain and (7, "7", "new", None) in plain and (1000, "z", "new", None) in plain
    after = files(table.root)
    assert {f: after[f] for f in before} == before
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in set(after) - set(before)} == touched
    assert rows(table.read(0)) == want
    table.remove_superseded(keep=1)
    assert rows(table.read()) == plain
    left = files(table.root)
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in set(before) - set(left)} == touched


def test_policies_equal_the_plain_merge(spark, table):
    source = spark.createDataFrame([(1, "1", "p", "p", 1), (1, "1", "q", None, 2), (2, "2", None, "w", 1), (900, "n", "i", None, 1)], SCHEMA + ", at int")
    for policy in ({}, {"update": ["a"]}, {"keep": ["b"]}, {"update": ["a"], "keep": ["b"]}):
        want = rows(merge(table.read(), source, ["k", "l"], order=["at"], **policy))
        table.upsert(source, order=["at"], **policy)
        assert rows(table.read()) == want
        table.upsert(source, order=["at"], **policy)  # repeating changes nothing
        assert rows(table.read()) == want
    want = rows(insert_if_absent(table.read(), source.select("k", "l", "a", "b"), [["k", "l"]], ["a"]))
    table.insert_if_absent(source, ["a"])
    assert rows(table.read()) == want


def test_null_keys_match_nothing_and_are_not_lost(spark, table):
    source = spark.createDataFrame([(None, "1", str(i % 5)) for i in range(40)] + [(3, None, "n")], "k bigint, l string, a string")
    for done in (1, 2):
        table.upsert(source)
        assert table.read().where("k IS NULL OR l IS NULL").count() == 41 * done
        assert table.read().count() == 300 + 41 * done
    table.delete(source)
    assert table.read().count() == 300 + 82


def test_deletes_that_empty_buckets(spark, table):
    gone = table.read().where("k >= 5").select("k", "l", F.lit(1).alias("other"))
    table.delete(gone)
    assert [r[0] for r in rows(table.read())] == list(range(5))
    assert len(table.manifest().held) <= 5
    table.delete(table.read())
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([(1, "1", "again", None)], SCHEMA))
    assert rows(table.read()) == [(1, "1", "again", None)]
    version = table.manifest().version
    assert table.upsert(spark.createDataFrame([], SCHEMA)) == version  # nothing to do


def test_a_change_that_fails_is_not_seen(spark, table, monkeypatch):
    want, source = rows(table.read()), spark.createDataFrame([(1, "1", "new", "new")], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(buckets, "MANIFEST", "no schema")
        with pytest.raises(Exception):
            table._publish(buckets.Manifest(16, 0, -1, {}), table.touched(source), source)
    assert rows(table.read()) == want
    table.upsert(source)
    assert (1, "1", "new", "new") in rows(table.read()) and table.read().count() == 300
    with pytest.raises(RuntimeError):
        table._publish(table.manifest(), set(), source)
    assert table.read().count() == 300


def test_refusals(spark, tmp_path, table):
    with pytest.raises(ValueError):
        table.create(table.read())
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "u"), ["k"], SCHEMA).upsert(table.read())
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "u"), ["k"], SCHEMA + ", _bucket int")
