"""The set-based application of submissions against the one-by-one yardstick."""

import collections

import pytest

from gatewright.operators.labels import display_label_table, label_table
from gatewright.plans.answers import apply_answers
from gatewright.sources import adapter
from sequential import World


def sequential_world(v, submissions, submitted):
    rows = lambda df: [r.asDict() for r in df.collect()]
    world = World(rows(v.products), rows(v.requests), rows(v.answers), rows(label_table(v)), rows(display_label_table(v)),
                  rows(v.subdomains), rows(v.statuses), "example.com")
    given = collections.defaultdict(list)
    for a in sorted(rows(submitted), key=lambda a: a["position"]):
        given[a["submission_id"]].append((a["requirement_id"], a["answer_value"]))
    for s in sorted(rows(submissions), key=lambda s: (s["submitted_at"], s["submission_id"])):
        world.submit(s, given[s["submission_id"]])
    return world


@pytest.fixture(scope="module")
def world(views):
    return sequential_world(views, adapter.submissions(views), adapter.submitted_answers(views))


@pytest.mark.parametrize("block_rows", [100_000, 7])
def test_equals_sequential_application(views, world, block_rows):
    """A block of seven submissions makes every initiative span many blocks, as a hot one would."""
    out = apply_answers(views, adapter.submissions(views), adapter.submitted_answers(views), mail_domain="example.com",
                        block_rows=block_rows)
    results = {r.submission_id: (r.accepted, r.advanced, r.error) for r in out.results.collect()}
    assert results == world.results
    events = [
        (e.data_product_id, e.event_type, e.stage_id, e.from_stage_id, e.to_stage_id, e.status_id, e.event_label, e.event_detail,
         e.created_by, e.created_at) for e in out.events.collect()]
    assert sorted(events, key=repr) == sorted(world.events, key=repr)
    for got, want, key in ((out.products, world.products, "data_product_id"), (out.requests, world.requests, "request_id")):
        got = {r[key]: r.asDict() for r in got.collect()}
        assert got == want
    answers = {(a.data_product_id, a.requirement_id): a.answer_value for a in out.answers.collect()}
    assert answers == world.answers
