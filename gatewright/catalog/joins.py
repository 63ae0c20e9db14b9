"""C: joins and subqueries."""

from pyspark.sql import functions as F

from gatewright.catalog.registry import query
from gatewright.operators.hot_keys import join_children
from gatewright.functions.text import first_filled, slug
from gatewright.operators.labels import COLLECTIONS, label_table, with_label
from gatewright.operators.textroll import text_pieces
from gatewright.plans import workflow as wf
from gatewright.sources.adapter import with_views


@query("c1_star_join", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c_name, n.n_name AS nation, r.r_name AS region,
  coalesce(p_name, 'Unassigned') AS part, CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS VARCHAR) AS revenue
FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation n ON n.n_nationkey = c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN part ON p_partkey = l_partkey""")
def _(t, v):
    c = F.col
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    return (
        lines.join(t.orders.select("o_orderkey", "o_custkey"), c("o_orderkey") == c("l_orderkey"))
        .join(t.customer.select("c_custkey", "c_name", "c_nationkey"), c("c_custkey") == c("o_custkey"), "left")
        .join(t.nation, c("n_nationkey") == c("c_nationkey"), "left")
        .join(t.region, c("r_regionkey") == c("n_regionkey"), "left")
        .join(t.part.select("p_partkey", "p_name"), c("p_partkey") == c("l_partkey"), "left")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c_name", c("n_name").alias("nation"),
                c("r_name").alias("region"), F.coalesce("p_name", F.lit("Unassigned")).alias("part"),
                F.expr("CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS string)")
                .alias("revenue"))
    )


@query("c2_role_playing_dimension", with_views("products users", """
SELECT data_product_id, coalesce(a.display_name, '') AS owner, coalesce(b.display_name, '') AS lead,
  coalesce(c.display_name, '') AS hub, coalesce(d.email, '') AS pm_email
FROM a_products p LEFT JOIN a_users a ON a.user_id = p.data_domain_owner_user_id LEFT JOIN a_users b ON b.user_id = p.delivery_lead
LEFT JOIN a_users c ON c.user_id = p.domain_delivery_lead_user_id LEFT JOIN a_users d ON d.user_id = p.lynx_pm_user_id"""))
def _(t, v):
    df = v.products.select("data_product_id", "data_domain_owner_user_id", "delivery_lead",
                           "domain_delivery_lead_user_id", "lynx_pm_user_id")
    roles = (("owner", "data_domain_owner_user_id", "display_name"), ("lead", "delivery_lead", "display_name"),
             ("hub", "domain_delivery_lead_user_id", "display_name"), ("pm_email", "lynx_pm_user_id", "email"))
    for out, key, column in roles:
        df = df.join(v.users.select(F.col("user_id").alias(key), F.col(column).alias(out)), key, "left")
    return df.select("data_product_id", *[F.coalesce(out, F.lit("")).alias(out) for out, _, _ in roles])


@query("c3_label_fallback", with_views("products platforms", """
SELECT data_product_id, coalesce(platform_name, nullif(target_platform_id, ''), 'Unassigned') AS platform
FROM a_products LEFT JOIN a_platforms ON platform_id = target_platform_id"""))
def _(t, v):
    return v.products.join(v.platforms, F.col("platform_id") == F.col("target_platform_id"), "left").select(
        "data_product_id",
        F.coalesce("platform_name", first_filled("target_platform_id", F.lit("Unassigned"))).alias("platform"))


@query("c4_parent_with_child_rollup", """
SELECT c_custkey, c_name, n_name, count(o_orderkey) AS orders, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(14,2))), 0.00) AS VARCHAR) AS total
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def _(t, v):
    per_parent = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(14,2)")).alias("total"))
    return (
        t.customer.join(per_parent, "c_custkey", "left")
        .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .select("c_custkey", "c_name", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"),
                F.coalesce("total", F.lit(0).cast("decimal(14,2)")).cast("string").alias("total"))
    )


@query("c5_parent_with_children", """
SELECT c_custkey, c_name, coalesce(o_orderkey, -1) AS o_orderkey, coalesce(o_orderstatus, '') AS o_orderstatus, coalesce(n, 0) AS children
FROM customer LEFT JOIN orders ON o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = c_custkey""")
def _(t, v):
    """A parent's children stay rows (flattened nesting), so a parent may have any number of them."""
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    parents = t.customer.select("c_custkey", "c_name").join(counts, "c_custkey", "left")
    children = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return join_children(parents, children, "c_custkey", "left", by=["o_orderkey"]).select(
        "c_custkey", "c_name", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"),
        F.coalesce("o_orderstatus", F.lit("")).alias("o_orderstatus"), F.coalesce("n", F.lit(0)).alias("children"))


@query("c6_requirements_of_products", with_views("products requests answers", """
SELECT p.data_product_id, r.requirement_id, coalesce(a.answer_value, '') AS stored_answer
FROM a_products p JOIN a_requests q ON q.request_id = p.request_id CROSS JOIN a_requirements r
LEFT JOIN a_answers a ON a.data_product_id = p.data_product_id AND a.requirement_id = r.requirement_id"""))
def _(t, v):
    stored = wf.rules_of_products(v.products, v.requests, v.answers, with_stored=True)
    return stored.select("data_product_id", "requirement_id", F.coalesce("stored_answer", F.lit("")).alias("stored_answer"))


@query("c7_timeline_enrichment", with_views("timeline stages statuses", """
SELECT timeline_id, event_type, coalesce(stage_name, '') AS stage_name, coalesce(status_name, '') AS status_name
FROM a_timeline LEFT JOIN a_stages USING (stage_id) LEFT JOIN a_statuses USING (status_id)"""))
def _(t, v):
    return wf.enriched_timeline(v.timeline, v.stages, v.statuses).select(
        "timeline_id", "event_type", F.coalesce("stage_name", F.lit("")).alias("stage_name"),
        F.coalesce("status_name", F.lit("")).alias("status_name"))


@query("c8_child_to_parent_dimension", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(t, v):
    return t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("c9_current_stage_ordinal", with_views("products stages", """
SELECT data_product_id, stage_number FROM a_products JOIN a_stages ON stage_id = current_stage_id"""))
def _(t, v):
    return v.products.select("data_product_id", F.col("current_stage_id").alias("stage_id")).join(
        v.stages, "stage_id").select("data_product_id", "stage_number")


_LINE_TEXT = ("concat_ws(' ', CAST(l_linenumber AS string), l_returnflag, l_linestatus, CAST(l_partkey AS string), "
              "CAST(l_suppkey AS string))")


@query("c10_aggregated_text_subquery", f"""
SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 2) THEN CAST(0 AS BIGINT) END AS piece,
  (SELECT string_agg({_LINE_TEXT}, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, {_LINE_TEXT})
  FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber > 2) AS lines FROM orders""")
def _(t, v):
    later = t.lineitem.where("l_linenumber > 2")  # so that some orders have none
    lines = text_pieces(later, ["l_orderkey"], F.expr(_LINE_TEXT), ["l_linenumber", "l_partkey", "l_suppkey"], out="lines")
    return t.orders.select("o_orderkey").join(lines.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left").select(
        "o_orderkey", "piece", "lines")


@query("c11_filtered_max_with_fallback", """
SELECT o_orderkey, CAST(CAST(coalesce((SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'),
  o_orderdate) AS DATE) AS VARCHAR) AS entered FROM orders""")
def _(t, v):
    last = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("last"))
    return t.orders.select("o_orderkey", "o_orderdate").join(last, "o_orderkey", "left").select(
        "o_orderkey", F.coalesce("last", "o_orderdate").cast("date").cast("string").alias("entered"))


@query("c12_scalar_subquery", """
SELECT count(*) AS imported_initiatives, (SELECT count(*) FROM orders) AS imported_products FROM customer WHERE c_name LIKE 'Customer#%'""")
def _(t, v):
    children = t.orders.agg(F.count(F.lit(1)).alias("n")).scalar()
    return t.customer.where(F.col("c_name").startswith("Customer#")).agg(
        F.count(F.lit(1)).alias("imported_initiatives")).withColumn("imported_products", children)


@query("c13_orphans", with_views("products requests", """
SELECT p.data_product_id, p.title FROM a_products p LEFT JOIN a_requests r USING (request_id) WHERE r.request_id IS NULL"""))
def _(t, v):
    return v.products.select("data_product_id", "title", "request_id").join(
        v.requests.select("request_id"), "request_id", "left_anti").select("data_product_id", "title")


@query("c14_reference_check", with_views("products platforms", """
SELECT data_product_id, target_platform_id IN (SELECT platform_id FROM a_platforms) AS valid,
  target_platform_id IN (SELECT platform_id FROM a_platforms WHERE platform_name <> 'Both') AS valid_single FROM a_products"""))
def _(t, v):
    from gatewright.operators.validate import reference_flag

    df = v.products.select("data_product_id", "target_platform_id")
    df = reference_flag(df, slug("target_platform_id"), v.platforms, "platform_id", "valid")
    return reference_flag(df, slug("target_platform_id"), v.platforms.where("platform_name <> 'Both'"), "platform_id",
                          "valid_single").select("data_product_id", "valid", "valid_single")


@query("c15_parents_with_child_at_stage", """
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderpriority = '5-LOW')""")
def _(t, v):
    staged = t.orders.where("o_orderstatus = 'P' AND o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(staged, "c_custkey", "left_semi")


_LABELS_SQL = " UNION ALL ".join(
    [f"SELECT '{c}' AS collection, {i} AS id, {n} AS name FROM a_{view}" for c, (view, i, n) in COLLECTIONS.items()]
    + ["SELECT CASE role_key WHEN 'data_domain_owner' THEN 'dataDomainOwners' WHEN 'domain_delivery_lead' THEN "
       "'domainDeliveryLeads' WHEN 'hub_owner' THEN 'hubOwners' ELSE 'lynxPms' END, user_id, display_name FROM a_users "
       "WHERE role_key NOT IN ('requester', 'admin')"])
LABEL_VIEWS = ("domains product_types expected_outputs platforms priorities scopes subdomains source_systems "
               "build_statuses users")


@query("c16_polymorphic_label", with_views(f"{LABEL_VIEWS} answers", f"""
WITH l AS ({_LABELS_SQL})
SELECT answer_id, coalesce(l.name, '') AS label FROM a_answers a JOIN a_requirements r USING (requirement_id)
LEFT JOIN l ON l.collection = r.master_data_type AND l.id = a.answer_value"""))
def _(t, v):
    typed = v.answers.join(v.requirements.select("requirement_id", "master_data_type"), "requirement_id")
    named = with_label(typed, label_table(v), F.col("master_data_type"), F.col("answer_value"), "label", ["answer_id"])
    return named.select("answer_id", F.coalesce("label", F.lit("")).alias("label"))


@query("c17_self_join_parent_label", """
WITH x AS (SELECT 'r' || r_regionkey AS scope_id, r_name AS scope_name, CAST(NULL AS VARCHAR) AS parent_scope_id FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation UNION ALL
  SELECT 's' || s_suppkey, s_name, CASE WHEN s_suppkey = 7 THEN 'gone' ELSE 'n' || s_nationkey END FROM supplier)
SELECT a.scope_id, CASE WHEN a.parent_scope_id IS NULL THEN a.scope_name
  ELSE concat(a.scope_name, ' (', coalesce(b.scope_name, a.parent_scope_id), ')') END AS shown
FROM x a LEFT JOIN x b ON b.scope_id = a.parent_scope_id""")
def _(t, v):
    scopes = (
        t.region.selectExpr("concat('r', r_regionkey) AS scope_id", "r_name AS scope_name", "CAST(NULL AS string) AS parent_scope_id")
        .unionByName(t.nation.selectExpr("concat('n', n_nationkey) AS scope_id", "n_name AS scope_name", "concat('r', n_regionkey) AS parent_scope_id"))
        .unionByName(t.supplier.selectExpr("concat('s', s_suppkey) AS scope_id", "s_name AS scope_name",
                                           "CASE WHEN s_suppkey = 7 THEN 'gone' ELSE concat('n', s_nationkey) END AS parent_scope_id"))
    )
    parents = scopes.select(F.col("scope_id").alias("parent_scope_id"), F.col("scope_name").alias("parent_name"))
    shown = F.when(F.col("parent_scope_id").isNull(), F.col("scope_name")).otherwise(
        F.concat("scope_name", F.lit(" ("), F.coalesce("parent_name", "parent_scope_id"), F.lit(")")))
    return scopes.join(parents, "parent_scope_id", "left").select("scope_id", shown.alias("shown"))


@query("c18_next_by_ordinal", with_views("products stages", """
SELECT data_product_id, coalesce((SELECT n.stage_id FROM a_stages n WHERE n.stage_number > c.stage_number ORDER BY n.stage_number LIMIT 1), '') AS next_stage
FROM a_products JOIN a_stages c ON c.stage_id = current_stage_id"""))
def _(t, v):
    return wf.with_next_stage(v.products, v.stages).select("data_product_id", F.coalesce("next_stage_id", F.lit("")).alias("next_stage"))
