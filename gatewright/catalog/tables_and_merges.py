"""A: scans, sources, sinks and merges."""

import uuid

from pyspark.sql import functions as F

from gatewright import model
from gatewright.catalog.registry import query
from gatewright.operators import merge as m
from gatewright.operators.rollup import count_by
from gatewright.session import checkpoint_dir
from gatewright.sources import documents, tables
from gatewright.sources.adapter import with_views
from gatewright.sources.keyed_table import KeyedTable

ALL_TABLES = list(tables.SCHEMAS)


@query("a1_ordered_scan", "SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier ORDER BY s_name")
def _(t, v):
    return t.supplier.select("s_suppkey", "s_name", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal")).orderBy("s_name")


@query("a2_schema_tolerant_scan", """
SELECT o_orderkey, coalesce(o_orderpriority, '') AS priority, '' AS scope, o_orderstatus AS status FROM orders""")
def _(t, v):
    o = t.orders
    priority, scope, status, _legacy = tables.optional(o, "o_orderpriority", "scope_id", "o_orderstatus", "status_text")
    return o.select("o_orderkey", F.coalesce(priority, F.lit("")).alias("priority"),
                    F.coalesce(scope, F.lit("")).alias("scope"), F.coalesce(_legacy, status).alias("status"))


_BODY = ("CASE event_type WHEN 'error' THEN '[1, 2]' WHEN 'view' THEN '' WHEN 'signup' THEN '{\"k\": ' "
         "ELSE props END")
_BODY_LIMIT = 8


@query("a3_json_ingest", f"""
WITH b AS (SELECT event_id, {_BODY} AS body FROM events), c AS (
  SELECT event_id, CASE WHEN body = '' THEN '{{}}' ELSE body END AS body, strlen(body) AS size FROM b), e AS (
  SELECT event_id, body, CASE WHEN size > {_BODY_LIMIT} THEN 'request body is too large'
    WHEN NOT json_valid(body) THEN 'body is not valid JSON'
    WHEN json_type(CASE WHEN json_valid(body) THEN body ELSE '{{}}' END) <> 'OBJECT' THEN 'JSON body must be an object' ELSE '' END AS body_error FROM c)
SELECT event_id, body_error, CASE WHEN body_error = '' THEN coalesce(json_extract_string(body, '$.k'), '') ELSE '' END AS k FROM e""")
def _(t, v):
    bodies = t.events.select("event_id", F.expr(_BODY).alias("body"))
    read = documents.read_bodies(bodies, "body", "k string", max_bytes=_BODY_LIMIT)
    return read.select("event_id", F.coalesce("body_error", F.lit("")).alias("body_error"),
                       F.coalesce(F.col("payload.k"), F.lit("")).alias("k"))


@query("a4_json_emit", """
SELECT o_orderkey, CAST(to_json({'o_orderkey': o_orderkey, 'o_custkey': o_custkey, 'o_orderstatus': o_orderstatus,
  'note': CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END}) AS VARCHAR) AS json FROM orders""")
def _(t, v):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus",
                           F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("note"))
    return documents.to_json_rows(rows, ["o_orderkey"])


@query("a5_append_rows", with_views("timeline products", """
SELECT timeline_id, data_product_id, event_type, created_at FROM a_timeline
UNION ALL SELECT concat('created-', data_product_id), data_product_id, 'created', created_at FROM a_products"""))
def _(t, v):
    created = v.products.select(F.concat(F.lit("created-"), "data_product_id").alias("timeline_id"), "data_product_id",
                                F.lit("created").alias("event_type"), "created_at")
    return v.timeline.select(*created.columns).unionByName(created)


_CHANGES_SQL = """
SELECT o_custkey + CASE WHEN o_orderstatus = 'P' THEN 10000000 ELSE 0 END AS c_custkey,
  concat('Changed#', CAST(o_orderkey AS VARCHAR)) AS c_name, CAST(NULL AS INTEGER) AS c_nationkey,
  o_totalprice AS c_acctbal, nullif(o_orderpriority, '5-LOW') AS c_mktsegment, o_orderdate, o_orderkey FROM orders"""
_LAST_CHANGE_SQL = f"""c AS ({_CHANGES_SQL}), s AS (SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM c) WHERE rn = 1)"""


def _changes(t):
    o = t.orders
    return o.select(
        (F.col("o_custkey") + F.when(F.col("o_orderstatus") == "P", 10_000_000).otherwise(0)).alias("c_custkey"),
        F.concat(F.lit("Changed#"), F.col("o_orderkey").cast("string")).alias("c_name"),
        F.lit(None).cast("int").alias("c_nationkey"), F.col("o_totalprice").alias("c_acctbal"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("c_mktsegment"), "o_orderdate", "o_orderkey")


def _show_customers(df):
    return df.select("c_custkey", F.coalesce("c_name", F.lit("")).alias("c_name"),
                     F.coalesce(F.col("c_nationkey").cast("string"), F.lit("")).alias("nation"),
                     F.round("c_acctbal", 2).alias("c_acctbal"),
                     F.coalesce("c_mktsegment", F.lit("")).alias("c_mktsegment"))


_MERGE_HEAD = f"WITH {_LAST_CHANGE_SQL} SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, "
_MERGE_TAIL = " FROM customer t FULL JOIN s ON t.c_custkey = s.c_custkey"


_A6 = _MERGE_HEAD + """
  CASE WHEN s.rn = 1 THEN s.c_name ELSE t.c_name END AS c_name,
  CASE WHEN s.rn = 1 THEN '' ELSE CAST(t.c_nationkey AS VARCHAR) END AS nation,
  round(CASE WHEN s.rn = 1 THEN s.c_acctbal ELSE t.c_acctbal END, 2) AS c_acctbal,
  coalesce(CASE WHEN s.rn = 1 THEN s.c_mktsegment ELSE t.c_mktsegment END, '') AS c_mktsegment""" + _MERGE_TAIL


@query("a6_upsert_all_columns", _A6)
def _(t, v):
    return _show_customers(m.merge(t.customer, _changes(t), ["c_custkey"], order=["o_orderdate", "o_orderkey"]))


def _keyed(t, name, keys, rows, order=None):
    """A keyed table in a folder of its own that holds the rows."""
    table = KeyedTable(t.spark, f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}", keys, rows.schema)
    table.create(rows, order)
    return table


@query("a6_upsert_touched_buckets", _A6)
def _(t, v):
    """The same into a stored table of which only the buckets with changed keys are written anew."""
    table = _keyed(t, "customer", ["c_custkey"], t.customer)
    table.upsert(_changes(t), order=["o_orderdate", "o_orderkey"])
    return _show_customers(table.read())


_LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax"]


_A7 = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag = 'R'
    ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_tax DESC) AS rn FROM lineitem),
  t AS (SELECT * FROM r WHERE rn = 1 AND l_returnflag <> 'R'), s AS (SELECT * FROM r WHERE rn = 1 AND l_returnflag = 'R')
SELECT coalesce(s.l_orderkey, t.l_orderkey) AS l_orderkey, coalesce(s.l_linenumber, t.l_linenumber) AS l_linenumber,
  coalesce(s.l_partkey, t.l_partkey) AS l_partkey, coalesce(s.l_returnflag, t.l_returnflag) AS l_returnflag
FROM t FULL JOIN s ON t.l_orderkey = s.l_orderkey AND t.l_linenumber = s.l_linenumber"""


@query("a7_upsert_composite_key", _A7)
def _(t, v):
    keys = ["l_orderkey", "l_linenumber"]
    is_new = F.col("l_returnflag") == "R"
    stored = m.latest_per_key(t.lineitem.where(~is_new), keys, _LINE_ORDER)
    merged = m.merge(stored, t.lineitem.where(is_new), keys, order=_LINE_ORDER)
    return merged.select(*keys, "l_partkey", "l_returnflag")


@query("a7_upsert_touched_buckets", _A7)
def _(t, v):
    keys, is_new = ["l_orderkey", "l_linenumber"], F.col("l_returnflag") == "R"
    table = _keyed(t, "lineitem", keys, t.lineitem.where(~is_new), _LINE_ORDER)
    table.upsert(t.lineitem.where(is_new), order=_LINE_ORDER)
    return table.read().select(*keys, "l_partkey", "l_returnflag")


@query("a8_insert_if_absent", """
WITH s AS (SELECT c_custkey + CASE WHEN c_nationkey < 5 THEN 1000000 ELSE 0 END AS s_suppkey,
    replace(c_name, 'Customer', 'Supplier') AS s_name FROM customer)
SELECT s_suppkey, s_name FROM supplier UNION ALL
SELECT s_suppkey, s_name FROM s WHERE NOT EXISTS (SELECT 1 FROM supplier x WHERE x.s_suppkey = s.s_suppkey OR x.s_name = s.s_name)""")
def _(t, v):
    offered = t.customer.select(
        (F.col("c_custkey") + F.when(F.col("c_nationkey") < 5, 1_000_000).otherwise(0)).alias("s_suppkey"),
        F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("s_name"))
    return m.insert_if_absent(t.supplier.select("s_suppkey", "s_name"), offered, [["s_suppkey"], ["s_name"]],
                              ["s_suppkey", "s_name"])


@query("a9_upsert_listed_columns", _MERGE_HEAD + """
  coalesce(t.c_name, s.c_name) AS c_name, coalesce(CAST(t.c_nationkey AS VARCHAR), '') AS nation,
  round(CASE WHEN s.rn = 1 THEN s.c_acctbal ELSE t.c_acctbal END, 2) AS c_acctbal,
  coalesce(CASE WHEN t.c_custkey IS NULL THEN s.c_mktsegment ELSE t.c_mktsegment END, '') AS c_mktsegment""" + _MERGE_TAIL)
def _(t, v):
    return _show_customers(m.merge(t.customer, _changes(t), ["c_custkey"], update=["c_acctbal"],
                                   order=["o_orderdate", "o_orderkey"]))


@query("a10_upsert_keep_stored", f"""
WITH {_LAST_CHANGE_SQL}, t AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)
SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN s.rn = 1 THEN s.c_name ELSE t.c_name END AS c_name,
  CASE WHEN s.rn = 1 THEN '' ELSE CAST(t.c_nationkey AS VARCHAR) END AS nation,
  round(CASE WHEN s.rn = 1 THEN s.c_acctbal ELSE t.c_acctbal END, 2) AS c_acctbal,
  coalesce(t.c_mktsegment, s.c_mktsegment, '') AS c_mktsegment FROM t FULL JOIN s ON t.c_custkey = s.c_custkey""")
def _(t, v):
    stored = t.customer.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return _show_customers(m.merge(stored, _changes(t), ["c_custkey"], keep=["c_mktsegment"],
                                   order=["o_orderdate", "o_orderkey"]))


_NEW_RULES = [
    ("intake_product_classification_id", "intake", "product_classification_id", "Product classification", "select",
     "productClassifications", 2, 1),
    ("publish_release_notes", "publish", "release_notes", "Release notes", "textarea", None, 5, 0),
]


@query("a11_upsert_rules", with_views("requirements products", f"""
WITH n AS ({model.values_sql(_NEW_RULES, ['requirement_id', *model.REQUIREMENT_COLUMNS])}),
 r AS (SELECT * FROM a_requirements WHERE requirement_id NOT IN (SELECT requirement_id FROM n) UNION ALL SELECT * FROM n),
 c AS (SELECT current_stage_id, count(*) AS products FROM a_products GROUP BY 1)
SELECT requirement_id, stage_id, label, sort_order, is_required, coalesce(products, 0) AS products
FROM r LEFT JOIN c ON c.current_stage_id = r.stage_id"""))
def _(t, v):
    new = model.literal_table(t.spark, _NEW_RULES, ["requirement_id", *model.REQUIREMENT_COLUMNS])
    rules = m.merge(v.requirements, new, ["requirement_id"])
    counts = count_by(v.products, F.col("current_stage_id").alias("stage_id"), out="products")
    return rules.join(counts, "stage_id", "left").select(
        "requirement_id", "stage_id", "label", "sort_order", "is_required",
        F.coalesce("products", F.lit(0)).alias("products"))


@query("a12_update_where", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '1-URGENT' THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def _(t, v):
    cond = (F.col("o_orderstatus") == "P") | (F.col("o_orderpriority") == "1-URGENT")
    return m.update_where(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), cond,
                          {"o_orderstatus": F.lit("N")}).drop("o_orderpriority")


@query("a13_update_arithmetic", """
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' AND p_size > 2 THEN p_size - 1 ELSE p_size END AS p_size FROM part""")
def _(t, v):
    return m.update_where(t.part.select("p_partkey", "p_type", "p_size"),
                          (F.col("p_type") == "ECONOMY") & (F.col("p_size") > 2),
                          {"p_size": F.col("p_size") - 1}).drop("p_type")


@query("a14_update_parent_of_child", """
WITH x AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderstatus = 'F')
SELECT c_custkey, CASE WHEN rn = 1 THEN o_orderpriority ELSE c_mktsegment END AS c_mktsegment
FROM customer LEFT JOIN x ON o_custkey = c_custkey AND rn = 1""")
def _(t, v):
    parents = t.customer.select("c_custkey", "c_mktsegment")
    children = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    changes = t.orders.where("o_orderstatus = 'F'").select(
        "o_orderkey", F.col("o_orderpriority").alias("c_mktsegment"), "o_orderdate", F.col("o_orderkey").alias("tie"))
    return m.update_parent(parents, children, changes, child_key="o_orderkey", parent_key="c_custkey",
                           columns=["c_mktsegment"], order=["o_orderdate", "tie"])


@query("a15_delete_where", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders "
       "WHERE NOT (o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '5-LOW'))")
def _(t, v):
    cond = (F.col("o_orderstatus") == "P") & F.col("o_orderpriority").isin("1-URGENT", "5-LOW")
    return m.delete_where(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), cond)


@query("a16_insert_select_copy", with_views("timeline", """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY event_type <> 'answers_saved', created_at, event_type, event_detail, status_id) AS rn FROM a_timeline)
SELECT timeline_id, event_type, event_label, created_at FROM d WHERE rn = 1"""))
def _(t, v):
    """Copy a schema's events into a store that already holds part of them."""
    order = ["created_at", "event_type", "event_detail", "status_id"]
    stored = v.timeline.where("event_type = 'answers_saved'")
    stored = m.insert_if_absent(stored.where("timeline_id IS NULL"), stored, [["timeline_id"]], order)
    merged = m.insert_if_absent(stored, v.timeline, [["timeline_id"]], order)
    return merged.select("timeline_id", "event_type", "event_label", "created_at")


@query("a17_inline_dimension", with_views("stages products", """
SELECT s.stage_id, stage_name, stage_number, count(data_product_id) AS products FROM a_stages s
LEFT JOIN a_products p ON p.current_stage_id = s.stage_id GROUP BY ALL"""))
def _(t, v):
    counts = count_by(v.products, F.col("current_stage_id").alias("stage_id"), out="products")
    return model.stages(t.spark).join(counts, "stage_id", "left").select(
        "stage_id", "stage_name", "stage_number", F.coalesce("products", F.lit(0)).alias("products"))


@query("a18_add_column_backfill", """
SELECT p_partkey, p_name, 'table_dataset' AS expected_output_id,
  CASE WHEN p_type = 'PROMO' THEN p_type ELSE 'databricks' END AS target_platform_id FROM part""")
def _(t, v):
    parts = t.part.select("p_partkey", "p_name", F.when(F.col("p_type") == "PROMO", F.col("p_type")).alias("target_platform_id"))
    parts = tables.with_missing_columns(parts, ["expected_output_id", "target_platform_id"])
    for column, default in (("expected_output_id", "table_dataset"), ("target_platform_id", "databricks")):
        empty = F.col(column).isNull() | (F.col(column) == "")
        parts = m.update_where(parts, empty, {column: F.lit(default)})
    return parts


@query("a19_source_profile", f"""
WITH n AS ({' UNION ALL '.join(f"SELECT '{x}' AS table_name, count(*) AS row_count FROM {x}" for x in ALL_TABLES)})
SELECT n.table_name, c.column_name, CAST(c.ordinal_position AS BIGINT) AS ordinal_position, row_count
FROM n JOIN information_schema.columns c ON c.table_name = n.table_name""")
def _(t, v):
    profile = tables.column_profile({n: getattr(t, n) for n in ALL_TABLES})
    return profile.select("table_name", "column_name", F.col("ordinal_position").cast("bigint").alias("ordinal_position"), "row_count")
