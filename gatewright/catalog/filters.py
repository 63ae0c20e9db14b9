"""B: projections, filters, predicates and search."""

from pyspark.sql import functions as F

from gatewright import model
from gatewright.catalog.registry import query
from gatewright.catalog.sql_text import normalize_number
from gatewright.functions import text as tx
from gatewright.operators import search as s
from gatewright.operators.labels import ROLE_COLLECTIONS
from gatewright.plans import overview
from gatewright.sources.adapter import with_views

AS_OF = "2024-07-01T00:00:00+00:00"


@query("b1_equality_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 42")
def _(t, v):
    return t.orders.where(F.col("o_custkey") == 42).select("o_orderkey", "o_orderstatus")


@query("b2_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(t, v):
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query("b3_prefix", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%'")
def _(t, v):
    return t.part.where(F.col("p_name").startswith("small")).select("p_partkey", "p_name")


@query("b4_contains", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_type) LIKE '%eco%'")
def _(t, v):
    return t.part.where(F.lower("p_name").contains("ring") | F.lower("p_type").contains("eco")).select("p_partkey", "p_name")


@query("b5_null_or_empty", with_views("requests", """
SELECT request_id FROM a_requests WHERE business_value IS NULL OR business_value = '' OR status_id = '' OR status_id IS NULL"""))
def _(t, v):
    return v.requests.where(tx.blank("business_value") | tx.blank("status_id")).select("request_id")


@query("b6_regex", r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '/[0-9]+(\?|$)')")
def _(t, v):
    return t.pages.where(F.col("url").rlike(r"/[0-9]+(\?|$)")).select("page_id", "url")


@query("b7_not_in_keys", """
SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _(t, v):
    building = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(building, "o_custkey", "left_anti").select("o_orderkey")


_P = with_views("products requests stages statuses domains platforms priorities product_types users", f"""
SELECT data_product_id AS "requestId", {normalize_number('data_product_number')} AS id,
  {normalize_number('r.request_number')} AS "initiativeNumber", coalesce(p.description, '') AS description,
  coalesce(d.domain_name, nullif(p.lead_domain_id, ''), 'Unassigned') AS domain,
  coalesce(pl.platform_name, nullif(p.target_platform_id, ''), 'Unassigned') AS platform,
  coalesce(pr.priority_name, nullif(r.priority_id, ''), 'Unassigned') AS priority,
  coalesce(nullif(st.status_name, ''), nullif(p.status_id, ''), 'Unassigned') AS status,
  s.stage_number AS "stageNumber", coalesce(p.alation_link, '') AS "alationLink",
  coalesce(nullif(dle.display_name, ''), p.delivery_lead, '') AS "deliveryLead",
  coalesce(nullif(ddo.display_name, ''), nullif(r.requester_name, ''), 'Unassigned') AS owner
FROM a_products p JOIN a_requests r USING (request_id) LEFT JOIN a_domains d ON d.domain_id = p.lead_domain_id
LEFT JOIN a_platforms pl ON pl.platform_id = p.target_platform_id LEFT JOIN a_priorities pr ON pr.priority_id = r.priority_id
LEFT JOIN a_statuses st ON st.status_id = p.status_id LEFT JOIN a_stages s ON s.stage_id = p.current_stage_id
LEFT JOIN a_users ddo ON ddo.user_id = p.data_domain_owner_user_id LEFT JOIN a_users dle ON dle.user_id = p.delivery_lead""")


@query("b8_product_projection", _P)
def _(t, v):
    return overview.product_overview(v, AS_OF).select(
        "requestId", "id", "initiativeNumber", "description", "domain", "platform", "priority", "status", "stageNumber",
        "alationLink", "deliveryLead", "owner")


@query("b9_initiative_projection", with_views("requests statuses priorities", f"""
SELECT request_id AS "requestId", {normalize_number('request_number')} AS id, coalesce(initiative, '') AS initiative,
  coalesce(nullif(initiative, ''), concat('Initiative ', {normalize_number('request_number')})) AS title,
  coalesce(business_decision, '') AS "businessDecision", coalesce(business_value, '') AS "businessValue",
  coalesce(pr.priority_name, '') AS priority, coalesce(nullif(st.status_name, ''), nullif(r.status_id, ''), 'Unassigned') AS status,
  coalesce(expected_date, '') AS "expectedDate", coalesce(additional_comments, '') AS "additionalComments", created_at AS "createdAt"
FROM a_requests r LEFT JOIN a_priorities pr USING (priority_id) LEFT JOIN a_statuses st ON st.status_id = r.status_id"""))
def _(t, v):
    return overview.initiative_overview(v).select(
        "requestId", "id", "initiative", "title", "businessDecision", "businessValue", "priority", "status",
        "expectedDate", "additionalComments", "createdAt")


@query("b10_rename_map", "SELECT event_id, event_type AS \"stageId\", props AS \"roleKey\" FROM events")
def _(t, v):
    raw = t.events.select("event_id", F.col("event_type").alias("stageid"), F.col("props").alias("rolekey"))
    return raw.withColumnsRenamed(model.CAMEL_NAMES)


@query("b11_falsy_default", with_views("requests", """
SELECT request_id, coalesce(nullif(business_value, ''), nullif(additional_comments, ''), 'Unassigned') AS shown FROM a_requests"""))
def _(t, v):
    return v.requests.select("request_id", tx.first_filled("business_value", "additional_comments", F.lit("Unassigned")).alias("shown"))


@query("b12_token_search", """
SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', CAST(doc_id AS VARCHAR), text, lang, source, CAST(n_chars AS VARCHAR))), 'the')
  AND contains(lower(concat_ws(' ', CAST(doc_id AS VARCHAR), text, lang, source, CAST(n_chars AS VARCHAR))), 'src1')""")
def _(t, v):
    return s.search(t.documents, "  The SRC1 ").select("doc_id")


_BLOB_C = "lower(concat_ws(' ', CAST(c_custkey AS VARCHAR), c_name, c_mktsegment))"
_BLOB_O = "lower(concat_ws(' ', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority))"


@query("b13_parent_search", f"""
WITH x AS (SELECT o_custkey, string_agg({_BLOB_O}, ' ') AS child FROM orders GROUP BY o_custkey)
SELECT c_custkey FROM customer LEFT JOIN x ON o_custkey = c_custkey
WHERE contains(concat({_BLOB_C}, ' ', coalesce(child, '')), 'building') AND contains(concat({_BLOB_C}, ' ', coalesce(child, '')), '77')
  AND contains(concat({_BLOB_C}, ' ', coalesce(child, '')), 'urgent')""")
def _(t, v):
    children = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return s.search_parents(t.customer, children, "c_custkey", "building 77 Urgent", ["c_custkey", "c_name", "c_mktsegment"],
                            ["o_orderkey", "o_orderstatus", "o_orderpriority"]).select("c_custkey")


@query("b14_child_match_or_all", """
SELECT o_orderkey, o_custkey FROM (SELECT *, count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
  OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n = 0 OR (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')""")
def _(t, v):
    match = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    return s.matching_or_all(t.orders, "o_custkey", match).select("o_orderkey", "o_custkey")


@query("b15_stage_filter", with_views("products stages", """
SELECT data_product_id FROM a_products JOIN a_stages ON stage_id = current_stage_id
WHERE stage_id = 'build_validate' OR lower(stage_name) = 'build / validate'"""))
def _(t, v):
    named = v.products.join(v.stages, F.col("current_stage_id") == F.col("stage_id"), "left")
    return s.in_stage(named, "build_validate", model.STAGES, "current_stage_id", "stage_name").select("data_product_id")


@query("b16_column_filters", """
WITH o AS (SELECT o_orderkey, o_orderpriority, greatest(0, date_sub('day', CAST(o_orderdate AS TIMESTAMP), TIMESTAMP '2001-01-01')) AS days FROM orders)
SELECT o_orderkey FROM o WHERE contains(lower(o_orderpriority), 'high') AND contains(lower(concat_ws(' ', CAST(days AS VARCHAR),
  CASE WHEN days <= 0 THEN '<1 day' WHEN days = 1 THEN '1 day' ELSE concat(CAST(days AS VARCHAR), ' days') END)), '7 days')""")
def _(t, v):
    from gatewright.functions.dates import days_since

    o = t.orders.withColumn("daysInStage", days_since(F.col("o_orderdate").cast("string"), "2001-01-01"))
    return s.column_filters(o, {"o_orderpriority": " High ", "o_orderstatus": "  ", "daysInStage": "7 days"},
                            days_columns=("daysInStage",)).select("o_orderkey")


@query("b17_role_lists", with_views("users", """
SELECT CASE role_key WHEN 'data_domain_owner' THEN 'dataDomainOwners' WHEN 'domain_delivery_lead' THEN 'domainDeliveryLeads'
  WHEN 'hub_owner' THEN 'hubOwners' ELSE 'lynxPms' END AS collection, user_id AS id, display_name AS name, email
FROM a_users WHERE role_key IN ('data_domain_owner', 'domain_delivery_lead', 'hub_owner', 'lynx_pm')"""))
def _(t, v):
    names = F.create_map(*[F.lit(x) for c, r in ROLE_COLLECTIONS.items() for x in (r, c)])
    return v.users.where(F.col("role_key").isin(list(ROLE_COLLECTIONS.values()))).select(
        names[F.col("role_key")].alias("collection"), F.col("user_id").alias("id"), F.col("display_name").alias("name"), "email")


@query("b18_dependent_options", with_views("subdomains domains products", """
SELECT p.data_product_id, count(*) AS options FROM a_products p JOIN a_domains d ON d.domain_id = coalesce(nullif(p.lead_domain_id, ''), 'asia')
JOIN a_subdomains s ON s.domain_id = d.domain_id GROUP BY 1"""))
def _(t, v):
    """How many subdomains each product may choose from, given its domain (or the default one)."""
    options = v.subdomains.join(v.domains, "domain_id").groupBy("domain_id").agg(F.count(F.lit(1)).alias("options"))
    chosen = v.products.select("data_product_id", tx.first_filled("lead_domain_id", F.lit("asia")).alias("domain_id"))
    return chosen.join(options, "domain_id").select("data_product_id", "options")


@query("b19_visible_of_total", """
SELECT o_custkey, concat(CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS VARCHAR), ' / ', CAST(count(*) AS VARCHAR)) AS shown
FROM orders GROUP BY o_custkey""")
def _(t, v):
    visible = F.count_if(F.col("o_orderstatus") == "O").cast("string")
    return t.orders.groupBy("o_custkey").agg(F.concat(visible, F.lit(" / "), F.count(F.lit(1)).cast("string")).alias("shown"))


@query("b20_joined_detail", with_views("users", """
SELECT user_id, concat_ws(' | ', nullif(email, ''), nullif(role_key, 'admin'), nullif('', '')) AS detail FROM a_users"""))
def _(t, v):
    return v.users.select("user_id", tx.joined_detail("email", F.nullif("role_key", F.lit("admin")), F.lit("")).alias("detail"))
