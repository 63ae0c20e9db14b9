"""Answer differences look at products that are submitted for only."""

from gatewright.catalog import workflow
from gatewright.plans import workflow as wf
from gatewright.sources.adapter import submissions


def test_only_submitted_products_are_spread_by_rule(views, monkeypatch):
    seen, spread = [], wf.rules_of_products
    monkeypatch.setattr(wf, "rules_of_products", lambda products, *args, **kw: seen.append(products) or spread(products, *args, **kw))
    workflow._differences(views)
    named = {r.data_product_id for r in submissions(views).select("data_product_id").collect()}
    stored = {r.data_product_id for r in views.products.select("data_product_id").collect()}
    assert {r.data_product_id for r in seen[0].collect()} == named & stored < stored
