"""Streams give what the batch gives, in several micro-batches and when a batch is replayed."""

import shutil

import pytest
from pyspark.sql import functions as F

from gatewright.operators.merge import latest_per_key, merge
from gatewright.plans.answers import apply_answers
from gatewright.sources import adapter
from gatewright.sources.tables import SCHEMAS
from gatewright.streaming import live, machine

KEYS = ["data_product_id", "requirement_id"]


@pytest.fixture(scope="module")
def event_files(spark, views, tmp_path_factory):
    """The events in three files, in order of time."""
    folder = str(tmp_path_factory.mktemp("events"))
    third = F.ntile(3)
    from pyspark.sql import Window

    parts = views.tables.events.withColumn("_part", third.over(Window.orderBy("ts", "event_id")))
    for i in (1, 2, 3):
        parts.where(F.col("_part") == i).drop("_part").coalesce(1).write.parquet(f"{folder}/{i}")
    return folder


def stream(spark, folder, n):
    return spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_latest_value_over_batches(spark, views, event_files, tmp_path):
    root = str(tmp_path)
    latest = live.latest_stream(stream(spark, event_files, 3), "user_id", "event_type", ["ts", "event_id"])
    live.run_available(latest, root, live.delta_sink(f"{root}/d"), "update")
    got = {(r.user_id, r.event_type, r.events) for r in live.latest_of_deltas(spark, f"{root}/d", ["user_id"]).collect()}
    want = views.tables.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")), F.count(F.lit(1)))
    assert got == {tuple(r) for r in want.collect()}
    assert live.read_deltas(spark, f"{root}/d").select("batch").distinct().count() == 3


def test_answer_upserts_and_replay(spark, views, tmp_path):
    root, base = str(tmp_path), views.answers
    new = adapter.submitted_answers(views).join(adapter.submissions(views), "submission_id").select(
        F.concat("data_product_id", F.lit(":"), "requirement_id").alias("answer_id"), *KEYS, "answer_value",
        F.col("submitted_at").alias("updated_at"), "submission_id")
    sink = live.upsert_sink(f"{root}/d", KEYS, ["updated_at", "submission_id"])
    sink(new.where("submission_id < '000000000500'"), 0)
    sink(new.where("submission_id >= '000000000500'"), 1)
    once = sorted(tuple(r) for r in live.upserted(base, f"{root}/d", KEYS, ["answer_value", "updated_at"]).collect())
    sink(new.where("submission_id >= '000000000500'"), 1)
    again = sorted(tuple(r) for r in live.upserted(base, f"{root}/d", KEYS, ["answer_value", "updated_at"]).collect())
    want = merge(base, new, KEYS, update=["answer_value", "updated_at"], order=["updated_at", "submission_id"])
    assert once == again == sorted(tuple(r) for r in want.collect())


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same_outcome(got, want):
    assert rows_of(got.results.select(want.results.columns)) == rows_of(want.results)
    assert rows_of(got.events) == rows_of(want.events)
    assert rows_of(got.products) == rows_of(want.products)
    assert rows_of(got.requests) == rows_of(want.requests)
    assert rows_of(got.answers) == rows_of(want.answers)


def test_stage_machine_equals_batch(spark, views, event_files, tmp_path):
    root = str(tmp_path)
    got = machine.run_stage_machine(views, adapter.submission_rows(views, stream(spark, event_files, 3)), root, "example.com")
    assert live.read_deltas(spark, f"{root}/decisions").select("batch").distinct().count() == 3
    want = apply_answers(views, adapter.submissions(views), adapter.submitted_answers(views), mail_domain="example.com")
    same_outcome(got, want)


def test_stage_machine_goes_on_from_its_state(spark, views, event_files, tmp_path):
    """A second run finds what the first one left; decisions of the first are not made again."""
    source, root = tmp_path / "in", str(tmp_path / "machine")
    source.mkdir()
    shutil.copytree(f"{event_files}/1", source / "1")
    rows = lambda: adapter.submission_rows(views, stream(spark, str(source), 1))
    first = rows_of(machine.run_stage_machine(views, rows(), root, "example.com").results)
    for k in ("2", "3"):
        shutil.copytree(f"{event_files}/{k}", source / k)
    got = machine.run_stage_machine(views, rows(), root, "example.com")
    want = apply_answers(views, adapter.submissions(views), adapter.submitted_answers(views), mail_domain="example.com")
    assert rows_of(got.results.select(want.results.columns)) == rows_of(want.results)
    assert set(first) < set(rows_of(got.results))


def test_stage_machine_keeps_states_of_what_is_submitted_for_only(spark, views, event_files, tmp_path):
    rows = adapter.submission_rows(views, stream(spark, f"{event_files}", 1)).where("submission_id < '000000000040'")
    got = machine.run_stage_machine(views, rows, str(tmp_path), "example.com")
    decided = got.decisions.where("pos IS NOT NULL").select("request_id", "data_product_id").distinct().collect()
    states = spark.read.format("statestore").option("stateVarName", "states").load(f"{tmp_path}/_checkpoint").count()
    assert 0 < len(decided) < states <= 2 * len(decided) < views.requests.count()
