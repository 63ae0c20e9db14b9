"""L: streams. Each query reads the event file as a stream and runs it to completion."""

import uuid

from pyspark.sql import functions as F

from gatewright.catalog import applied
from gatewright.catalog.registry import query
from gatewright.catalog.validation import MAIL
from gatewright.session import checkpoint_dir
from gatewright.sources.adapter import submission_rows
from gatewright.sources.tables import SCHEMAS
from gatewright.streaming import compacted, live, machine


def _events(t):
    return live.read_table_stream(t.spark, t.path, "events.parquet", SCHEMAS["events"])


def _root(t, name):
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("l1_stream_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def _(t, v):
    root = _root(t, "counts")
    live.run_available(live.count_stream(_events(t), "event_type"), root, live.delta_sink(f"{root}/counts"), "complete")
    return live.newest_delta(t.spark, f"{root}/counts")


@query("l2_stream_latest_status", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS events FROM events GROUP BY 1""")
def _(t, v):
    root = _root(t, "latest")
    latest = live.latest_stream(_events(t), "user_id", "event_type", ["ts", "event_id"])
    live.run_available(latest, root, live.delta_sink(f"{root}/deltas"), "update")
    return live.latest_of_deltas(t.spark, f"{root}/deltas", ["user_id"])


_UPSERTED = """
WITH s AS (SELECT user_id AS c_custkey, arg_max(event_type, (ts, event_id)) AS c_mktsegment FROM events GROUP BY 1)
SELECT coalesce(s.c_custkey, c.c_custkey) AS c_custkey, coalesce(s.c_mktsegment, c.c_mktsegment) AS c_mktsegment
FROM customer c FULL JOIN s ON s.c_custkey = c.c_custkey"""


@query("l3_stream_upsert", _UPSERTED)
def _(t, v):
    root = _root(t, "upsert")
    rows = _events(t).select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("c_mktsegment"), "ts", "event_id")
    live.run_available(rows, root, live.upsert_sink(f"{root}/deltas", ["c_custkey"], ["ts", "event_id"]))
    return live.upserted(t.customer.select("c_custkey", "c_mktsegment"), f"{root}/deltas", ["c_custkey"])


@query("l3_stream_upsert_compacted", _UPSERTED)
def _(t, v):
    """The same through the compacted state; every batch is compacted here."""
    root = _root(t, "compacted")
    rows = _events(t).select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("c_mktsegment"), "ts", "event_id")
    keys = ["c_custkey"]
    live.run_available(rows, root, compacted.compacting_sink(root, keys, ["ts", "event_id"], every=1))
    return compacted.upserted(t.customer.select("c_custkey", "c_mktsegment"), root, keys, rows.schema)


@query("l4_stream_stage_machine", applied.RESULTS)
def _(t, v):
    """Equals j8_apply_answers on the same events; compared in the tests with several micro-batches."""
    return machine.run_stage_machine(v, submission_rows(v, _events(t)), _root(t, "machine"), MAIL).results
