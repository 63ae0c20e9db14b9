"""Compacted stream state: equal to a plain replay, across replays and failures; what is read does not grow with the batches."""

import pytest

from gatewright.streaming import compacted as c

SCHEMA = "k bigint, v string, at int"


def batches(spark, n=7):
    """Batch i updates keys i..i+2, twice each, one key that all batches hold, and a null key in each third."""
    out = []
    for i in range(n):
        rows = [(k, f"{i}-{at}", at) for k in (*range(i, i + 3), 100) for at in (2, 1)] + ([(None, f"n{i}", 0)] if i % 3 == 0 else [])
        out.append(rows)
    return out


def want(done):
    state = {}
    for rows in done:
        for k, v, at in sorted(rows, key=lambda r: r[2]):
            state[k] = (v, at)
    return {(k, *x) for k, x in state.items()}


def got(spark, root):
    rows = [tuple(r) for r in c.current(spark, root, ["k"], SCHEMA).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_state_replays_and_removal(spark, tmp_path):
    root, done = str(tmp_path / "s"), []
    sink = c.compacting_sink(root, ["k"], ["at"], every=3, buckets=4)
    assert got(spark, root) == set()
    opened = []
    for i, rows in enumerate(batches(spark)):
        frame = spark.createDataFrame(rows, SCHEMA)
        sink(frame, i)
        sink(frame, i)  # run again, also just after a compaction
        done.append(rows)
        assert got(spark, root) == want(done)
        opened.append(len(c._numbers(spark, f"{root}/delta", "batch=")) - 1 - c.newest(spark, root, 4).upto)
    assert opened == [1, 2, 0, 1, 2, 0, 1]  # open deltas never exceed `every`
    assert c.newest(spark, root, 4).version == 1
    c.remove_superseded(spark, root, keep=1)
    assert got(spark, root) == want(done)
    assert c._numbers(spark, f"{root}/delta", "batch=") == [6]
    sink(spark.createDataFrame([], SCHEMA), 7)  # an empty batch
    assert got(spark, root) == want(done)


def test_untouched_buckets_are_neither_read_nor_written(spark, tmp_path):
    root = str(tmp_path / "s")
    sink = c.compacting_sink(root, ["k"], ["at"], every=1, buckets=16)
    sink(spark.createDataFrame([(k, "a", 0) for k in range(200)], SCHEMA), 0)
    sink(spark.createDataFrame([(5, "b", 0)], SCHEMA), 1)
    manifest = c.newest(spark, root, 16)
    assert sorted(manifest.held) == list(range(16))
    assert sorted(manifest.held.values()) == [0] * 15 + [1]
    assert got(spark, root) == {(k, "b" if k == 5 else "a", 0) for k in range(200)}


def test_a_compaction_that_failed_is_not_seen(spark, tmp_path, monkeypatch):
    """The base of a version is written, the job ends before its manifest; the batch is run again."""
    root, rows = str(tmp_path / "s"), batches(spark, 2)
    sink = c.compacting_sink(root, ["k"], ["at"], every=2, buckets=4)
    sink(spark.createDataFrame(rows[0], SCHEMA), 0)
    with monkeypatch.context() as m:
        m.setattr(c, "_MANIFEST", "no schema")
        with pytest.raises(Exception):
            sink(spark.createDataFrame(rows[1], SCHEMA), 1)
    assert c._numbers(spark, f"{root}/base", "version=") == [0]
    assert c.newest(spark, root, 4).version == -1
    assert got(spark, root) == want(rows)
    sink(spark.createDataFrame(rows[1], SCHEMA), 1)
    assert c.newest(spark, root, 4).upto == 1
    assert got(spark, root) == want(rows)
