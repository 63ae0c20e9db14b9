"""The planted cases of the workflow views."""

from pyspark.sql import functions as F


def test_every_driver_row_is_used(views):
    t = views.tables
    assert views.products.count() == t.orders.count()
    assert views.requests.count() == t.customer.count()
    assert views.timeline.count() == t.lineitem.count()


def test_planted_cases(views):
    products, requests = views.products, views.requests
    orphans = products.join(requests, "request_id", "left_anti").count()
    childless = requests.join(products, "request_id", "left_anti").count()
    assert orphans == 16 and childless == 22
    stray = products.join(views.subdomains.select(F.col("subdomain_id").alias("lead_subdomain_id"), "domain_id"), "lead_subdomain_id")
    assert stray.where("domain_id <> lead_domain_id").count() > 0
    assert requests.where("expected_date = '2024-02-30'").count() > 0
    assert products.where("jira_link LIKE 'javascript%'").count() > 0
