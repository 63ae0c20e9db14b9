"""D aggregations, E windows, F sorts, G set operations."""

from pyspark.sql import functions as F

from gatewright import model
from gatewright.catalog.registry import query
from gatewright.catalog.sql_text import complete, number_sort_value
from gatewright.functions.text import canonical_json, number_sort_value as sort_value
from gatewright.operators import rollup
from gatewright.operators.merge import duplicate_keys
from gatewright.operators.numbering import number_rows
from gatewright.operators.textroll import text_pieces
from gatewright.plans import overview, workflow as wf
from gatewright.sources.adapter import with_views
from gatewright.sources.tables import SCHEMAS, missing_names, row_counts


@query("d1_global_count", "SELECT count(*) AS orders FROM orders")
def _(t, v):
    return t.orders.agg(F.count(F.lit(1)).alias("orders"))


@query("d2_dashboard_totals", with_views("products requests", """
SELECT count(*) AS total, count(*) FILTER (WHERE status_id IN ('in_review', 'in_progress')) AS in_review,
  count(*) FILTER (WHERE status_id = 'blocked') AS blocked, count(*) FILTER (WHERE current_stage_id IN ('publish', 'operate')) AS live,
  (SELECT count(*) FROM a_requests) AS initiatives FROM a_products"""))
def _(t, v):
    return rollup.dashboard_totals(v.products, v.requests)


@query("d3_count_by_stage", with_views("products", "SELECT current_stage_id, count(*) AS products FROM a_products GROUP BY 1"))
def _(t, v):
    return rollup.count_by(v.products, "current_stage_id", out="products")


@query("d4_count_by_status", "SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY 1")
def _(t, v):
    return rollup.count_by(t.orders, "o_orderstatus", out="orders")


@query("d5_count_by_pair", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY ALL")
def _(t, v):
    return rollup.count_by(t.lineitem, "l_returnflag", "l_linestatus", out="n").orderBy("l_returnflag", "l_linestatus")


@query("d6_child_count", """
SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def _(t, v):
    counts = rollup.child_counts(t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "orders")
    return t.customer.select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("d7_child_titles", with_views("products", """
SELECT request_id, 0 AS piece, string_agg(title, ' ' ORDER BY data_product_id) AS titles FROM a_products GROUP BY 1"""))
def _(t, v):
    return overview.child_titles(v.products).withColumn("piece", F.col("piece").cast("int"))


@query("d8_answer_text", with_views("answers", """
SELECT data_product_id, CAST(0 AS BIGINT) AS piece, string_agg(concat_ws(' ', label, requirement_key, answer_value), ' ' ORDER BY requirement_id) AS answers_text
FROM a_answers LEFT JOIN a_requirements USING (requirement_id) GROUP BY 1"""))
def _(t, v):
    return overview.answer_text(v)


@query("d9_event_text", with_views("timeline", """
WITH e AS (SELECT *, concat_ws(' ', event_type, event_label, event_detail, created_by, stage_id, from_stage_id, to_stage_id, status_id) AS txt FROM a_timeline)
SELECT data_product_id, CAST(0 AS BIGINT) AS piece, string_agg(txt, ' ' ORDER BY created_at, timeline_id, event_type, txt) AS events_text FROM e GROUP BY 1"""))
def _(t, v):
    return overview.event_text(v)


@query("d10_filtered_max", """
SELECT l_orderkey, coalesce(CAST(CAST(max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS DATE) AS VARCHAR), '') AS last_return FROM lineitem GROUP BY 1""")
def _(t, v):
    last = F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).cast("date").cast("string")
    return t.lineitem.groupBy("l_orderkey").agg(F.coalesce(last, F.lit("")).alias("last_return"))


@query("d11_max_number", f"SELECT max({number_sort_value('c_name')}) AS last_number FROM customer")
def _(t, v):
    return t.customer.agg(F.max(sort_value("c_name")).alias("last_number"))


_RESOLVED_SQL = ("SELECT p.data_product_id, p.current_stage_id, r.requirement_id, r.stage_id, r.requirement_key, r.label, r.input_type, r.sort_order, r.is_required, "
                 "CASE r.requirement_key " + " ".join(
                     f"WHEN '{k}' THEN coalesce(CAST(p.{k} AS VARCHAR), '')" for k in model.PRODUCT_VALUE_KEYS) + " "
                 + " ".join(f"WHEN '{k}' THEN coalesce(q.{k}, '')" for k in model.PARENT_VALUE_KEYS)
                 + " ELSE coalesce(a.answer_value, '') END AS answer_value FROM a_products p JOIN a_requests q ON q.request_id = p.request_id "
                 "CROSS JOIN a_requirements r LEFT JOIN a_answers a ON a.data_product_id = p.data_product_id AND a.requirement_id = r.requirement_id")
RESOLVED = f"x AS ({_RESOLVED_SQL})"
COMPLETE = (f"{RESOLVED}, c AS (SELECT data_product_id, current_stage_id, stage_id, bool_and(is_required = 0 OR {complete('input_type', 'answer_value')}) AS complete "
            "FROM x GROUP BY ALL)")
RESOLVED_VIEWS = "products requests answers"


@query("d12_all_required_answered", with_views(RESOLVED_VIEWS, f"WITH {COMPLETE} SELECT data_product_id, bool_and(complete) AS complete FROM c GROUP BY 1"))
def _(t, v):
    flags = wf.stage_flags(v.products, v.requests, v.answers)
    done = F.lit(True)
    for s, _, _ in model.STAGES:
        done = done & F.col(f"complete_{s}")
    return flags.select("data_product_id", done.alias("complete"))


@query("d13_any_required_missing", with_views(RESOLVED_VIEWS, f"""
WITH {RESOLVED} SELECT data_product_id, bool_or(is_required = 1 AND NOT ({complete('input_type', 'answer_value')})) AS missing FROM x
WHERE stage_id = current_stage_id GROUP BY 1"""))
def _(t, v):
    current = wf.gating(wf.stage_flags(v.products, v.requests, v.answers)).where("is_current")
    return current.select("data_product_id", (~F.col("complete")).alias("missing"))


@query("d14_table_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in SCHEMAS))
def _(t, v):
    return row_counts({n: getattr(t, n) for n in SCHEMAS})


@query("d15_parent_columns_with_aggregate", """
SELECT c.c_custkey, c.c_name, c.c_nationkey, c.c_mktsegment, count(o_orderkey) AS orders FROM customer c LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY c.c_custkey, c.c_name, c.c_nationkey, c.c_mktsegment""")
def _(t, v):
    counts = rollup.child_counts(t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "orders")
    return t.customer.drop("c_acctbal").join(counts, "c_custkey", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


@query("d16_count_maps", with_views("products", """
SELECT 'stage' AS measure, current_stage_id AS key, count(*) AS value FROM a_products GROUP BY ALL
UNION ALL SELECT 'status', status_id, count(*) FROM a_products GROUP BY ALL"""))
def _(t, v):
    return rollup.count_maps(v.products).select("measure", F.explode("counts"))


@query("d17_stage_rail", with_views("products stages", """
SELECT stage_id, stage_name, stage_number, count(data_product_id) AS products,
  CAST(floor(count(data_product_id) * 100.0 / (SELECT count(*) FROM a_products) + 0.5) AS BIGINT) AS percent
FROM a_stages LEFT JOIN a_products ON current_stage_id = stage_id GROUP BY ALL"""))
def _(t, v):
    return rollup.stage_rail(v.products, v.stages)


@query("d18_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(t, v):
    return duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("d19_count_per_collection", with_views("domains subdomains users platforms product_types expected_outputs priorities scopes source_systems build_statuses", """
SELECT 'domains' AS collection, count(*) AS n FROM a_domains UNION ALL SELECT 'subdomains', count(*) FROM a_subdomains
UNION ALL SELECT 'productTypes', count(*) FROM a_product_types UNION ALL SELECT 'expectedOutputs', count(*) FROM a_expected_outputs
UNION ALL SELECT 'platforms', count(*) FROM a_platforms UNION ALL SELECT 'priorities', count(*) FROM a_priorities
UNION ALL SELECT 'scopeOptions', count(*) FROM a_scopes UNION ALL SELECT 'sourceSystems', count(*) FROM a_source_systems
UNION ALL SELECT 'buildStatuses', count(*) FROM a_build_statuses
UNION ALL SELECT CASE role_key WHEN 'data_domain_owner' THEN 'dataDomainOwners' WHEN 'domain_delivery_lead' THEN 'domainDeliveryLeads'
  WHEN 'hub_owner' THEN 'hubOwners' ELSE 'lynxPms' END, count(*) FROM a_users WHERE role_key IN ('data_domain_owner', 'domain_delivery_lead', 'hub_owner', 'lynx_pm') GROUP BY 1"""))
def _(t, v):
    from gatewright.operators.labels import label_table

    return rollup.count_by(label_table(v), "collection", out="n")


@query("d20_import_summary", with_views("requests", "SELECT count(*) AS imported FROM a_requests WHERE request_id LIKE 'req-%'"))
def _(t, v):
    return v.requests.where(F.col("request_id").startswith("req-")).agg(F.count(F.lit(1)).alias("imported"))


# ------------------------------------------------------------------------------------------------ windows

@query("e1_global_row_number", """
SELECT o_orderkey, row_number() OVER (ORDER BY coalesce(nullif(o_orderpriority, '5-LOW'), o_orderstatus), o_orderkey) AS n FROM orders""")
def _(t, v):
    keyed = t.orders.select("o_orderkey", F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), "o_orderstatus").alias("_key"))
    return number_rows(keyed, [F.col("_key"), F.col("o_orderkey")], "n").drop("_key")


_JSON_SQL = "CAST(to_json({'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment, 'c_name': c_name, 'c_nationkey': c_nationkey}) AS VARCHAR)"


@query("e2_row_text_number", f"""
SELECT c_custkey, concat('Imported initiative ', CAST(row_number() OVER (ORDER BY {_JSON_SQL}) AS VARCHAR)) AS title FROM customer""")
def _(t, v):
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    c = c.withColumn("_text", canonical_json(c.columns))
    return number_rows(c, [F.col("_text")], "n").select(
        "c_custkey", F.concat(F.lit("Imported initiative "), F.col("n").cast("string")).alias("title"))


@query("e3_running_and", with_views(RESOLVED_VIEWS, f"""
WITH {COMPLETE} SELECT data_product_id, c.stage_id, complete, coalesce(bool_and(complete) OVER (PARTITION BY data_product_id
  ORDER BY stage_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS can_submit FROM c JOIN a_stages s ON s.stage_id = c.stage_id"""))
def _(t, v):
    per_stage = wf.gating(wf.stage_flags(v.products, v.requests, v.answers)).drop("can_submit")
    return wf.gating_by_window(per_stage).select("data_product_id", "stage_id", "complete", "can_submit")


@query("e4_latest_stage_entry", with_views("products timeline", """
SELECT p.data_product_id, coalesce((SELECT max(t.created_at) FROM a_timeline t WHERE t.data_product_id = p.data_product_id
  AND t.event_type = 'stage_advanced' AND t.to_stage_id = p.current_stage_id), p.created_at) AS entered FROM a_products p"""))
def _(t, v):
    p = v.products.select("data_product_id", "current_stage_id", "created_at")
    return p.join(overview.stage_entries(v.timeline), ["data_product_id", "current_stage_id"], "left").select(
        "data_product_id", F.coalesce("entered_at", "created_at").alias("entered"))


@query("e5_next_stage", with_views("timeline stages", """
WITH n AS (SELECT stage_id, lead(stage_id) OVER (ORDER BY stage_number) AS next_stage FROM a_stages)
SELECT stage_id, coalesce(next_stage, '') AS next_stage, count(*) AS events FROM a_timeline JOIN n USING (stage_id) GROUP BY ALL"""))
def _(t, v):
    events = rollup.count_by(v.timeline, "stage_id", out="events")
    return events.join(wf.next_stages(v.stages), "stage_id").select(
        "stage_id", F.coalesce("next_stage_id", F.lit("")).alias("next_stage"), "events")


@query("e6_progress_percent", with_views("products stages", """
SELECT data_product_id, least(100.0, stage_number * 100.0 / (SELECT count(*) FROM a_stages))::DOUBLE AS progress
FROM a_products JOIN a_stages ON stage_id = current_stage_id"""))
def _(t, v):
    return wf.progress_percent(v.products.select("data_product_id", "current_stage_id"), v.stages).select("data_product_id", "progress")


@query("e7_first_six_and_more", """
WITH r AS (SELECT l_orderkey, concat(CAST(l_partkey AS VARCHAR), ':', l_returnflag) AS txt, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, concat(string_agg(txt, '; ' ORDER BY rn) FILTER (WHERE rn <= 6),
  CASE WHEN max(n) > 6 THEN concat('; ', CAST(max(n) - 6 AS VARCHAR), ' more field(s) changed') ELSE '' END) AS detail FROM r GROUP BY l_orderkey""")
def _(t, v):
    from gatewright.plans.changes import first_changes

    parts = t.lineitem.withColumn("_text", F.concat(F.col("l_partkey").cast("string"), F.lit(":"), "l_returnflag"))
    return first_changes(parts, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], "_text", "detail")


# ------------------------------------------------------------------------------------------------ sorts

@query("f1_newest_first", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def _(t, v):
    return t.orders.orderBy(F.col("o_orderdate").desc(), "o_orderkey").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))


@query("f2_multi_key_sort", "SELECT r_name, n_name FROM nation JOIN region ON r_regionkey = n_regionkey ORDER BY r_name, n_name")
def _(t, v):
    return t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name").orderBy("r_name", "n_name")


@query("f3_rank_sort", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS place FROM orders ORDER BY place, o_orderkey""")
def _(t, v):
    place = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return t.orders.select("o_orderkey", place.alias("place")).orderBy("place", "o_orderkey")


@query("f4_preview", with_views("products requests", """
SELECT data_product_id, title FROM a_products p WHERE NOT EXISTS (SELECT 1 FROM a_requests r WHERE r.request_id = p.request_id)
ORDER BY data_product_id LIMIT 50"""))
def _(t, v):
    from gatewright.plans.verify import orphan_products

    return orphan_products(v.products, v.requests).orderBy("data_product_id").limit(model.PREVIEW_ROWS)


@query("f5_first_by_order", """
SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY 1""")
def _(t, v):
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("f6_ordered_requirements", with_views("requirements products stages", """
SELECT r.stage_id, row_number() OVER (PARTITION BY r.stage_id ORDER BY sort_order) AS place, requirement_id,
  (SELECT count(*) FROM a_products p WHERE p.current_stage_id = r.stage_id) AS products FROM a_requirements r"""))
def _(t, v):
    per_stage = v.requirements.groupBy("stage_id").agg(
        F.array_sort(F.collect_list(F.struct("sort_order", "requirement_id"))).alias("items"))
    counts = rollup.count_by(v.products, F.col("current_stage_id").alias("stage_id"), out="products")
    return per_stage.select("stage_id", F.posexplode("items")).join(counts, "stage_id", "left").select(
        "stage_id", (F.col("pos") + 1).cast("bigint").alias("place"), F.col("col.requirement_id").alias("requirement_id"),
        F.coalesce("products", F.lit(0)).alias("products"))


# ------------------------------------------------------------------------------------------------ set operations

@query("g1_union_of_counts", """
SELECT 'customer' AS table_name, count(*) AS row_count FROM customer UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'lineitem', count(*) FROM lineitem ORDER BY table_name""")
def _(t, v):
    return row_counts({"customer": t.customer, "orders": t.orders, "lineitem": t.lineitem}).orderBy("table_name")


@query("g2_missing_names", """
(SELECT l_returnflag AS name FROM lineitem UNION SELECT l_linestatus FROM lineitem) EXCEPT SELECT o_orderstatus FROM orders""")
def _(t, v):
    required = t.lineitem.select(F.explode(F.array("l_returnflag", "l_linestatus")).alias("name")).distinct()
    present = t.orders.select(F.col("o_orderstatus").alias("name")).distinct()
    return missing_names(present, required, "name")


@query("g3_empty_collections", """
WITH c AS (SELECT 'labels' AS table_name, count(*) AS row_count FROM labels WHERE quality > 5 UNION ALL SELECT 'orders', count(*) FROM orders
  UNION ALL SELECT 'pages', count(*) FROM pages WHERE url = '') SELECT table_name FROM c WHERE row_count = 0""")
def _(t, v):
    from gatewright.plans.verify import empty_collections

    return empty_collections({"labels": t.labels.where("quality > 5"), "orders": t.orders, "pages": t.pages.where("url = ''")})
