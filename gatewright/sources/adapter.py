"""Workflow-shaped views over the TPC-H-like driver tables.

They give the workflow operators input of any size with the awkward cases planted: orphan products, requests
without products, bad mail addresses and dates, blank and NULL text, unknown references, mixed number formats,
subdomains outside their domain. Every driver row is used.

The column expressions are plain SQL that means the same in Spark and DuckDB, so the correctness queries build
the same views; everything computed from the views is written separately for each engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright import model
from gatewright.sources.tables import Tables

BUSINESS_UNITS = [
    ("automobile", "Automobile"), ("building", "Building"), ("furniture", "Furniture"), ("machinery", "Machinery"),
]
_NULL = "CAST(NULL AS string)"
_DOMAIN = "replace(lower(r_name), ' ', '_')"


def _stage_case(expr: str, first: int = 1) -> str:
    whens = " ".join(f"WHEN {n + first - 1} THEN '{s}'" for s, _, n in model.STAGES)
    return f"CASE {expr} {whens} END"


DOMAINS = {"domain_id": _DOMAIN, "domain_name": "r_name"}
SUBDOMAINS = {"subdomain_id": "lower(n_name)", "subdomain_name": "n_name", "domain_id": _DOMAIN}
USERS = {
    "user_id": "concat('user_', CAST(s_suppkey AS string))",
    "display_name": "s_name",
    "email": "concat('user', CAST(s_suppkey AS string), '@example.com')",
    "role_key": "CASE s_suppkey % 6 WHEN 0 THEN 'requester' WHEN 1 THEN 'admin' WHEN 2 THEN 'data_domain_owner' "
                "WHEN 3 THEN 'domain_delivery_lead' WHEN 4 THEN 'hub_owner' ELSE 'lynx_pm' END",
}
REQUESTS = {
    "request_id": "concat('req-', CAST(c_custkey AS string))",
    "request_number": "CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey + 1 AS string) "
                      "WHEN 1 THEN concat('REQ-', CAST(c_custkey + 1 AS string)) "
                      "ELSE concat('DP-', lpad(CAST(c_custkey + 1 AS string), 8, '0')) END",
    "priority_id": "CASE c_custkey % 3 WHEN 0 THEN 'p1' WHEN 1 THEN 'p2' ELSE 'p3' END",
    "business_unit_id": "lower(c_mktsegment)",
    "scope_id": _DOMAIN,
    "requester_name": "c_name",
    "requester_email": "CASE WHEN c_custkey % 11 = 0 THEN 'not-an-email' "
                       "ELSE concat('User', CAST(c_custkey AS string), '@Example.com') END",
    "initiative": "concat('Initiative ', c_name)",
    "business_decision": "concat('Decision for ', lower(c_mktsegment))",
    "business_value": f"CASE c_custkey % 16 WHEN 0 THEN '' WHEN 1 THEN {_NULL} "
                      "ELSE concat('Value for ', lower(c_mktsegment)) END",
    "expected_output_id": f"CASE c_custkey % 5 WHEN 0 THEN {_NULL} WHEN 1 THEN 'dashboard' WHEN 2 THEN 'api' "
                          "WHEN 3 THEN 'report' ELSE 'table_dataset' END",
    "target_platform_id": "CASE c_custkey % 4 WHEN 0 THEN 'databricks' WHEN 1 THEN 'lynx' WHEN 2 THEN 'both' "
                          "ELSE 'unknown_platform' END",
    "expected_date": "CASE c_custkey % 12 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '' ELSE '2024-06-15' END",
    "additional_comments": f"CASE WHEN c_custkey % 10 = 0 THEN {_NULL} "
                           "ELSE concat('Comment ', CAST(c_custkey AS string)) END",
    "status_id": "CASE c_custkey % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'in_review' WHEN 2 THEN 'in_progress' "
                 "WHEN 3 THEN 'blocked' ELSE '' END",
    "status_change_reason": f"CASE WHEN c_custkey % 5 = 3 THEN 'waiting for budget' ELSE {_NULL} END",
    "last_status_change_date": _NULL,
    "last_status_changed_by": _NULL,
    "note": f"CASE WHEN c_custkey % 8 = 0 THEN 'New initiative submitted for triage' ELSE {_NULL} END",
    "created_at": "concat('2024-01-', lpad(CAST(1 + c_custkey % 28 AS string), 2, '0'), 'T00:00:00+00:00')",
    "updated_at": "concat('2024-01-', lpad(CAST(1 + c_custkey % 28 AS string), 2, '0'), 'T00:00:00+00:00')",
}
_ORDER_DAY = "concat(CAST(CAST(o_orderdate AS date) AS string), 'T00:00:00+00:00')"
PRODUCTS = {
    "data_product_id": "concat('dp-', CAST(o_orderkey AS string))",
    # customers divisible by seven hand their products to the next customer, so they stay without children
    "request_id": "CASE WHEN o_orderkey % 97 = 0 THEN concat('req-missing-', CAST(o_orderkey AS string)) "
                  "WHEN o_custkey % 7 = 0 THEN concat('req-', CAST(o_custkey + 1 AS string)) "
                  "ELSE concat('req-', CAST(o_custkey AS string)) END",
    "data_product_number": "CAST(o_orderkey + 1 AS string)",
    "title": "concat('Product ', CAST(o_orderkey AS string))",
    "description": f"CASE WHEN o_orderkey % 6 = 0 THEN {_NULL} ELSE concat('Description ', o_orderpriority) END",
    "expected_output_id": f"CASE o_orderkey % 19 WHEN 0 THEN {_NULL} WHEN 1 THEN 'dashboard' WHEN 2 THEN 'api' "
                          "ELSE 'table_dataset' END",
    "product_type_id": "CASE o_orderkey % 3 WHEN 0 THEN 'structured' WHEN 1 THEN 'unstructured' ELSE 'mixed' END",
    "target_platform_id": "CASE o_orderkey % 4 WHEN 0 THEN 'databricks' WHEN 1 THEN 'lynx' WHEN 2 THEN 'both' "
                          "ELSE 'unknown_platform' END",
    "data_product_owner": f"CASE WHEN o_orderkey % 17 = 0 THEN {_NULL} "
                          "ELSE concat('Owner ', CAST(o_orderkey % 10 AS string)) END",
    "lead_domain_id": _DOMAIN,
    "lead_subdomain_id": f"CASE WHEN o_orderkey % 21 = 0 THEN {_NULL} "
                         "WHEN o_orderkey % 4 = 0 THEN concat('nation_', CAST(o_orderkey % 25 AS string)) "
                         "ELSE lower(n_name) END",
    "delivery_lead": "concat('user_', CAST(o_orderkey % 10 AS string))",
    "data_domain_owner_user_id": f"CASE WHEN o_orderkey % 5 = 0 THEN {_NULL} "
                                 "ELSE concat('user_', CAST((o_orderkey + 2) % 10 AS string)) END",
    "domain_delivery_lead_user_id": "concat('user_', CAST((o_orderkey + 1) % 10 AS string))",
    "lynx_pm_user_id": f"CASE WHEN o_orderkey % 2 = 0 THEN {_NULL} "
                       "ELSE concat('user_', CAST((o_orderkey + 3) % 10 AS string)) END",
    "delivery_date": "'2024-06-30'",
    "effort": "CASE WHEN o_orderkey % 23 = 0 THEN CAST(NULL AS int) "
              "ELSE CAST(floor(o_totalprice / 10000) AS int) END",
    "jira_epic_id": "concat('EPIC-', CAST(o_orderkey AS string))",
    "jira_link": "CASE WHEN o_orderkey % 29 = 0 THEN 'javascript:alert(1)' "
                 "ELSE concat('https://tracker.example.com/', CAST(o_orderkey AS string)) END",
    "alation_link": "CASE WHEN o_orderkey % 9 = 0 THEN '' "
                    "ELSE concat('https://catalog.example.com/', CAST(o_orderkey AS string)) END",
    "source_system_id": "CASE o_orderkey % 3 WHEN 0 THEN 'sap' WHEN 1 THEN 'sharepoint' ELSE 'unlisted' END",
    "build_status_id": f"CASE o_orderkey % 3 WHEN 0 THEN 'testing' WHEN 1 THEN 'built' ELSE {_NULL} END",
    "current_stage_id": _stage_case("1 + o_orderkey % 8"),
    "status_id": "CASE WHEN o_orderkey % 13 = 0 THEN 'blocked' WHEN o_orderstatus = 'O' THEN 'in_review' "
                 "WHEN o_orderstatus = 'P' THEN 'in_progress' ELSE 'operating' END",
    "status_change_reason": _NULL,
    "last_status_change_date": _NULL,
    "last_status_changed_by": _NULL,
    "note": f"CASE WHEN o_orderkey % 4 = 1 THEN 'Product created for governance' ELSE {_NULL} END",
    "created_at": _ORDER_DAY,
    "updated_at": _ORDER_DAY,
}
_NEXT_STAGE = _stage_case("l_linenumber + 1")
TIMELINE = {
    "timeline_id": "concat_ws('-', CAST(l_orderkey AS string), CAST(l_linenumber AS string), "
                   "CAST(l_partkey AS string), CAST(l_suppkey AS string))",
    "entity_type": "'product'",
    "request_id": _NULL,
    "data_product_id": "concat('dp-', CAST(l_orderkey AS string))",
    "event_type": "CASE l_returnflag WHEN 'R' THEN 'stage_advanced' WHEN 'A' THEN 'status_changed' "
                  "ELSE 'answers_saved' END",
    "stage_id": _stage_case("l_linenumber"),
    "from_stage_id": f"CASE WHEN l_returnflag = 'R' THEN {_stage_case('l_linenumber')} END",
    "to_stage_id": f"CASE WHEN l_returnflag = 'R' THEN {_NEXT_STAGE} END",
    "status_id": "CASE WHEN l_linestatus = 'O' THEN 'in_review' ELSE 'in_progress' END",
    "event_label": "concat('Line ', CAST(l_linenumber AS string))",
    "event_detail": "concat('Quantity ', CAST(CAST(l_quantity AS bigint) AS string))",
    "created_by": "concat('user_', CAST(l_suppkey % 10 AS string))",
    "created_at": "concat(CAST(CAST(l_shipdate AS date) AS string), 'T00:00:00+00:00')",
}
# A flat record layout of an older generation: some names missing, some blank, free spellings.
LEGACY = {
    "request_id": "CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('L', CAST(o_orderkey AS string)) END",
    "business_request_id": f"CASE WHEN o_orderkey % 6 = 0 THEN {_NULL} WHEN o_orderkey % 6 = 1 THEN 'none' "
                           "ELSE concat('BR-', CAST(o_orderkey + 100000000 AS string)) END",
    "data_product_name": "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('Data product ', o_orderpriority, ' ', "
                         "CAST(o_orderkey AS string)) END",
    "data_object": f"CASE WHEN o_orderkey % 14 = 0 THEN {_NULL} ELSE concat('Object ', CAST(o_orderkey AS string)) END",
    "type": "CASE o_orderkey % 9 WHEN 0 THEN 'Retail dashboard' WHEN 1 THEN 'Lynx AI' WHEN 2 THEN 'Semi-structured' "
            "WHEN 3 THEN 'Unstructured text' WHEN 4 THEN 'REST API' WHEN 5 THEN 'Semantic model' "
            f"WHEN 6 THEN 'Monthly report' WHEN 7 THEN {_NULL} ELSE 'table' END",
    "target_platform_id": f"CASE o_orderkey % 4 WHEN 0 THEN 'LYNX' WHEN 1 THEN 'other' ELSE {_NULL} END",
    "priority": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'high' "
                f"WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN {_NULL} ELSE 'LOW' END",
    "lead_domain_id": "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'commercial' END",
    "business_unit": "CASE o_orderkey % 5 WHEN 0 THEN 'Crop Protection' WHEN 1 THEN 'SEEDS' WHEN 2 THEN 'vegetables' "
                     f"WHEN 3 THEN {_NULL} ELSE 'other' END",
    "region": "CASE o_orderkey % 8 WHEN 0 THEN 'Worldwide' WHEN 1 THEN 'EU' WHEN 2 THEN 'latam region' "
              "WHEN 3 THEN 'NARM' WHEN 4 THEN 'latin_america' WHEN 5 THEN 'north america' WHEN 6 THEN 'amea' "
              "ELSE 'JANZ' END",
    "requestor": f"CASE WHEN o_custkey % 9 = 0 THEN {_NULL} ELSE concat('Person', CAST(o_custkey AS string)) END",
    "requested_by": "CASE WHEN o_custkey % 9 = 1 THEN '' ELSE concat('Person', CAST(o_custkey AS string), "
                    "'@Example.com') END",
    "data_owner": "CASE WHEN o_custkey % 4 = 0 THEN '' ELSE concat('Owner ', CAST(o_custkey % 100 AS string)) END",
    "initiative": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('Programme ', o_orderstatus) END",
    "business_value": f"CASE WHEN o_orderkey % 4 = 0 THEN {_NULL} ELSE 'Faster reporting' END",
    "business_expected_date": "CAST(CAST(o_orderdate AS date) AS string)",
    "data_engineer": "concat('Engineer ', CAST(o_orderkey % 12 AS string))",
    "effort": f"CASE o_orderkey % 4 WHEN 0 THEN '12' WHEN 1 THEN '12 days' WHEN 2 THEN '' ELSE {_NULL} END",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Open' ELSE 'In Progress' END",
    "status_id": f"CASE WHEN o_orderkey % 11 = 0 THEN 'on_hold' WHEN o_orderkey % 11 = 1 THEN 'new' ELSE {_NULL} END",
    "requested_date": "CAST(CAST(o_orderdate AS date) AS string)",
}

# Batches of commands over the driver tables, with planted errors.
INTAKE = {
    "batch_id": "concat('in-', lpad(CAST(c_custkey AS string), 12, '0'))",
    "request_number": f"CASE c_custkey % 20 WHEN 0 THEN concat('REQ-', CAST(c_custkey + 5000000 AS string)) WHEN 1 THEN '1' ELSE {_NULL} END",
    "initiative": "CASE WHEN c_custkey % 19 = 0 THEN '  ' ELSE concat(' New ', c_name, ' ') END",
    "description": f"CASE WHEN c_custkey % 4 = 0 THEN {_NULL} ELSE concat('Decide ', c_mktsegment) END",
    "businessValue": "'value'",
    "requester": "CASE WHEN c_custkey % 23 = 0 THEN '' ELSE c_name END",
    "requesterEmail": "CASE WHEN c_custkey % 11 = 0 THEN 'nobody' ELSE concat('Ann', CAST(c_custkey AS string), '@Example.com') END",
    "status": f"CASE c_custkey % 7 WHEN 0 THEN 'in_review' WHEN 1 THEN '' WHEN 2 THEN 'odd' ELSE {_NULL} END",
    "priority": f"CASE c_custkey % 5 WHEN 0 THEN 'P1' WHEN 1 THEN '' WHEN 2 THEN 'p9' ELSE {_NULL} END",
    "businessUnit": "CASE c_custkey % 3 WHEN 0 THEN '' ELSE c_mktsegment END",
    "scope": f"CASE c_custkey % 4 WHEN 0 THEN 'Latin America' WHEN 1 THEN '' ELSE {_NULL} END",
    "expectedOutput": f"CASE c_custkey % 6 WHEN 0 THEN 'API' ELSE {_NULL} END",
    "platform": f"CASE c_custkey % 9 WHEN 0 THEN 'Both' WHEN 1 THEN 'cloud' ELSE {_NULL} END",
    "expectedDate": "CASE c_custkey % 13 WHEN 0 THEN '' WHEN 1 THEN '2024-02-30' ELSE '2024-09-30' END",
    "additionalComments": _NULL,
    "note": f"CASE c_custkey % 2 WHEN 0 THEN 'by hand' ELSE {_NULL} END",
    "submitted_at": "concat('2024-07-', lpad(CAST(1 + c_custkey % 28 AS string), 2, '0'), 'T08:00:00+00:00')",
}
NEW_PRODUCTS = {
    "batch_id": "concat('np-', lpad(CAST(o_orderkey AS string), 12, '0'))",
    "request_id": "CASE WHEN o_orderkey % 31 = 0 THEN 'req-none' ELSE concat('req-', CAST(o_custkey AS string)) END",
    "productNumber": f"CASE o_orderkey % 25 WHEN 0 THEN CAST(o_orderkey + 70000000 AS string) WHEN 1 THEN '00000007' ELSE {_NULL} END",
    "title": "CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE concat('Offer ', CAST(o_orderkey AS string)) END",
    "description": "o_orderpriority",
    "stage": f"CASE o_orderkey % 7 WHEN 0 THEN 'Publish' WHEN 1 THEN 'someday' ELSE {_NULL} END",
    "status": f"CASE o_orderkey % 8 WHEN 0 THEN 'ready' ELSE {_NULL} END",
    "domain": "CASE o_orderkey % 3 WHEN 0 THEN 'Europe' WHEN 1 THEN 'Middle East' ELSE 'nowhere' END",
    "expectedOutput": f"CASE o_orderkey % 5 WHEN 0 THEN 'report' ELSE {_NULL} END",
    "productType": f"CASE o_orderkey % 6 WHEN 0 THEN 'mixed' WHEN 1 THEN 'solid' ELSE {_NULL} END",
    "platform": f"CASE o_orderkey % 10 WHEN 0 THEN 'Lynx' WHEN 1 THEN '' ELSE {_NULL} END",
    "dataProductOwner": "concat('Owner ', CAST(o_orderkey % 9 AS string))",
    "note": _NULL,
    "actor": "concat('user', CAST(o_custkey AS string), '@example.com')",
    "submitted_at": f"{_ORDER_DAY}",
}
STATUS_CHANGES = {
    "change_id": "lpad(CAST(event_id AS string), 12, '0')",
    "data_product_id": "concat('dp-', CAST(user_id AS string))",
    "request_id": "concat('req-', CAST(user_id AS string))",
    "status_id": "CASE event_type WHEN 'error' THEN 'Blocked' WHEN 'click' THEN 'in_progress' WHEN 'view' THEN 'ready' "
                 "WHEN 'signup' THEN '' ELSE 'unheard' END",
    "reason": f"CASE event_id % 3 WHEN 0 THEN ' late ' WHEN 1 THEN '' ELSE {_NULL} END",
    "updated_by": f"CASE event_id % 7 WHEN 0 THEN 'robot' WHEN 1 THEN {_NULL} ELSE 'Ann@example.com' END",
    "changed_at": "concat(replace(substring(CAST(ts AS string), 1, 19), ' ', 'T'), '+00:00')",
}
MASTER_USERS = {
    "id": _NULL,
    "name": "CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE c_name END",
    "email": "CASE c_custkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'x@other.org' ELSE concat('User', CAST(c_custkey % 40 AS string), '@Example.com') END",
    "roleKey": "CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'Hub Owner' WHEN 2 THEN 'boss' ELSE 'lynx_pm' END",
    "seq": "c_custkey",
}

_FROM = {
    "domains": ("region", DOMAINS),
    "subdomains": ("nation JOIN region ON n_regionkey = r_regionkey", SUBDOMAINS),
    "users": ("supplier", USERS),
    "requests": ("customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", REQUESTS),
    "products": ("orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
                 "JOIN region ON n_regionkey = r_regionkey", PRODUCTS),
    "timeline": ("lineitem", TIMELINE),
    "legacy": ("orders", LEGACY),
    "intake": ("customer", INTAKE),
    "new_products": ("orders", NEW_PRODUCTS),
    "status_changes": ("events", STATUS_CHANGES),
    "master_users": ("customer", MASTER_USERS),
}
_LITERALS = {
    "stages": (model.STAGES, ["stage_id", "stage_name", "stage_number"]),
    "statuses": (model.STATUSES, ["status_id", "status_name"]),
    "priorities": (model.PRIORITIES, ["priority_id", "priority_name"]),
    "platforms": (model.PLATFORMS, ["platform_id", "platform_name"]),
    "product_types": (model.PRODUCT_TYPES, ["product_type_id", "product_type_name"]),
    "expected_outputs": (model.EXPECTED_OUTPUTS, ["expected_output_id", "expected_output_name"]),
    "scopes": (model.SCOPES, ["scope_id", "scope_name", "scope_type", "parent_scope_id"]),
    "build_statuses": (model.BUILD_STATUSES, ["build_status_id", "build_status_name"]),
    "source_systems": (model.SOURCE_SYSTEMS, ["source_system_id", "source_system_name"]),
    "business_units": (BUSINESS_UNITS, ["business_unit_id", "business_unit_name"]),
    "requirements": ([(r.rule_id, *row) for r, row in zip(model.RULES, model.REQUIREMENTS)],
                     ["requirement_id", *model.REQUIREMENT_COLUMNS]),
}


class Views:
    """The workflow-shaped views of one folder of driver tables."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.spark = tables.spark

    def _shape(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        return df.selectExpr(*[f"{e} AS {a}" for a, e in columns.items()])

    def __getattr__(self, name: str) -> DataFrame:
        if name in _LITERALS:
            return model.literal_table(self.spark, *_LITERALS[name])
        raise AttributeError(name)

    @property
    def _nations(self) -> DataFrame:
        t = self.tables
        return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))

    @property
    def domains(self) -> DataFrame:
        return self._shape(self.tables.region, DOMAINS)

    @property
    def subdomains(self) -> DataFrame:
        return self._shape(self._nations, SUBDOMAINS)

    @property
    def users(self) -> DataFrame:
        return self._shape(self.tables.supplier, USERS)

    @property
    def requests(self) -> DataFrame:
        joined = self.tables.customer.join(self._nations, F.col("c_nationkey") == F.col("n_nationkey"))
        return self._shape(joined, REQUESTS)

    @property
    def products(self) -> DataFrame:
        t = self.tables
        homes = t.customer.join(self._nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
            "c_custkey", "n_name", "r_name")
        return self._shape(t.orders.join(homes, F.col("o_custkey") == F.col("c_custkey")), PRODUCTS)

    @property
    def timeline(self) -> DataFrame:
        return self._shape(self.tables.lineitem, TIMELINE)

    @property
    def intake(self) -> DataFrame:
        return self._shape(self.tables.customer, INTAKE)

    @property
    def new_products(self) -> DataFrame:
        return self._shape(self.tables.orders, NEW_PRODUCTS)

    @property
    def status_changes(self) -> DataFrame:
        return self._shape(self.tables.events, STATUS_CHANGES)

    @property
    def master_users(self) -> DataFrame:
        return self._shape(self.tables.customer, MASTER_USERS)

    @property
    def legacy(self) -> DataFrame:
        return self._shape(self.tables.orders, LEGACY)

    @cached_property
    def answers(self) -> DataFrame:
        """Full answers for the stages before the current one with a few gaps, partial ones for the current stage."""
        keyed = self.products.select(
            "data_product_id", F.expr("CAST(substring(data_product_id, 4) AS bigint)").alias("k"),
            F.expr("1 + CAST(substring(data_product_id, 4) AS bigint) % 8").alias("current_stage"))
        return (
            keyed.select("*", F.inline(F.array(*[_rule_entry(r) for r in model.RULES]))).where(F.expr(ANSWER_FILTER))
            .selectExpr("concat(data_product_id, ':', requirement_id) AS answer_id", "data_product_id",
                        "requirement_id", f"{ANSWER_VALUE} AS answer_value",
                        "'2024-02-01T00:00:00+00:00' AS updated_at")
        )


ANSWER_FILTER = (
    "(rule_stage < current_stage AND (k + sort_order + rule_stage) % 101 <> 0) "
    "OR (rule_stage = current_stage AND (k % 3 = 0 OR (k + sort_order) % 3 = 0))"
)
ANSWER_VALUE = (
    "CASE WHEN input_type = 'checkbox' THEN CASE WHEN (k + sort_order) % 41 = 0 THEN 'false' ELSE 'true' END "
    "WHEN (k + sort_order) % 43 = 0 THEN ' ' WHEN input_type = 'number' THEN CAST(k % 30 AS string) "
    "WHEN input_type = 'date' THEN '2024-06-30' "
    "WHEN master_data_type IN ('dataDomainOwners','domainDeliveryLeads','hubOwners','lynxPms') "
    "THEN concat('user_', CAST(k % 10 AS string)) "
    "WHEN master_data_type = 'sourceSystems' THEN 'sap' WHEN master_data_type = 'buildStatuses' THEN 'testing' "
    "WHEN input_type = 'select' THEN concat('id_', CAST(sort_order AS string)) "
    "ELSE concat('text ', CAST(sort_order AS string)) END"
)
_ANSWERS_SQL = f"""
SELECT concat(data_product_id, ':', requirement_id) AS answer_id, data_product_id, requirement_id,
  {ANSWER_VALUE} AS answer_value, '2024-02-01T00:00:00+00:00' AS updated_at
FROM (SELECT p.data_product_id, CAST(substring(p.data_product_id, 4) AS bigint) AS k, r.requirement_id, r.input_type,
        r.master_data_type, r.sort_order, s.stage_number AS rule_stage, c.stage_number AS current_stage
      FROM a_products p JOIN a_stages c ON c.stage_id = p.current_stage_id
      CROSS JOIN a_requirements r JOIN a_stages s ON s.stage_id = r.stage_id) x
WHERE {ANSWER_FILTER}"""


def view_sql(name: str) -> str:
    """The same view as SQL text, for the correctness queries."""
    if name == "answers":
        return _ANSWERS_SQL
    if name in _LITERALS:
        return model.values_sql(*_LITERALS[name])
    source, columns = _FROM[name]
    return "SELECT " + ", ".join(f"{e} AS {a}" for a, e in columns.items()) + f" FROM {source}"


def with_views(names: str, body: str) -> str:
    """Prefix `body` with the named views as CTEs called a_<name>."""
    wanted = list(names.split())
    if "answers" in wanted:
        wanted = [n for n in ("products", "stages", "requirements") if n not in wanted] + wanted
        wanted.sort(key=lambda n: n == "answers")
    ctes = ", ".join(f"a_{n} AS ({view_sql(n)})" for n in wanted)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


# Submissions of stage answers, one per event: the user stands for a customer, whose first or last product is edited. A user
# without products edits an unknown one.
SUBMISSION = {
    "submission_id": "lpad(CAST(event_id AS string), 12, '0')",
    "data_product_id": "CASE WHEN event_id % 71 = 0 OR first_order IS NULL THEN 'dp-unknown' WHEN event_id % 2 = 0 THEN "
                       "concat('dp-', CAST(first_order AS string)) ELSE concat('dp-', CAST(last_order AS string)) END",
    "stage_id": "CASE WHEN event_id % 53 = 0 THEN 'nowhere' WHEN event_type = 'view' THEN 'intake' WHEN event_type = 'click' "
                "THEN 'reuse_domain' WHEN event_type = 'signup' THEN 'ownership' WHEN event_type = 'purchase' THEN "
                "CASE event_id % 3 WHEN 0 THEN 'requirements' WHEN 1 THEN 'architecture_review' ELSE 'build_validate' END "
                "ELSE CASE event_id % 2 WHEN 0 THEN 'publish' ELSE 'operate' END END",
    "status_id": f"CASE event_id % 9 WHEN 0 THEN 'blocked' WHEN 1 THEN 'In Progress' WHEN 2 THEN '' ELSE {_NULL} END",
    "updated_by": "CASE event_id % 31 WHEN 0 THEN 'not-an-email' WHEN 1 THEN '' ELSE "
                  "concat('User', CAST(user_id AS string), '@example.com') END",
    "submitted_at": "concat(replace(substring(CAST(ts AS string), 1, 19), ' ', 'T'), '+00:00')",
}
SUBMITTED_VALUE = (
    "CASE WHEN input_type = 'checkbox' THEN CASE WHEN event_id % 13 = sort_order THEN 'no' ELSE 'TRUE' END "
    "WHEN (event_id + sort_order) % 47 = 0 THEN ' ' "
    "WHEN input_type = 'number' THEN CASE WHEN event_id % 37 = 0 THEN '-1' ELSE CAST(event_id % 40 AS string) END "
    "WHEN input_type = 'date' THEN CASE WHEN event_id % 41 = 0 THEN '2024-02-30' ELSE '2024-07-01' END "
    "WHEN requirement_key IN ('jira_link', 'alation_link') THEN concat('https://links.example.com/', CAST(event_id % 5 AS string)) "
    "WHEN master_data_type = 'productTypes' THEN CASE event_id % 2 WHEN 0 THEN 'Mixed' ELSE 'structured' END "
    "WHEN master_data_type = 'expectedOutputs' THEN CASE event_id % 2 WHEN 0 THEN 'dashboard' ELSE 'api' END "
    "WHEN master_data_type = 'platforms' THEN CASE WHEN event_id % 43 = 0 THEN 'mainframe' ELSE 'both' END "
    "WHEN master_data_type = 'priorities' THEN concat('p', CAST(1 + event_id % 3 AS string)) "
    "WHEN master_data_type = 'scopeOptions' THEN CASE event_id % 2 WHEN 0 THEN 'Latin America' ELSE 'europe' END "
    "WHEN master_data_type = 'domains' THEN CASE event_id % 3 WHEN 0 THEN 'Asia' WHEN 1 THEN 'middle east' ELSE 'europe' END "
    "WHEN master_data_type = 'subdomains' THEN concat('Nation ', CAST(event_id % 25 AS string)) "
    "WHEN master_data_type = 'dataDomainOwners' THEN concat('user_', CAST(2 + 6 * (event_id % 2) AS string)) "
    "WHEN master_data_type = 'domainDeliveryLeads' THEN concat('user_', CAST(3 + 6 * (event_id % 2) AS string)) "
    "WHEN master_data_type = 'hubOwners' THEN 'user_4' WHEN master_data_type = 'lynxPms' THEN 'user_5' "
    "WHEN master_data_type = 'sourceSystems' THEN 'Salesforce' WHEN master_data_type = 'buildStatuses' THEN 'in_uat' "
    "ELSE concat(requirement_key, ' ', CAST(event_id % 7 AS string)) END"
)


def submissions(v: Views, events: DataFrame | None = None) -> DataFrame:
    return v._shape((v.tables.events if events is None else events).join(_owners(v), "user_id", "left"), SUBMISSION)


def submitted_answers(v: Views, events: DataFrame | None = None) -> DataFrame:
    """All answers of the submitted stage, in form order."""
    heads = (v.tables.events if events is None else events).selectExpr(
        f"{SUBMISSION['submission_id']} AS submission_id", "event_id", f"{SUBMISSION['stage_id']} AS stage_id")
    return heads.select("*", F.inline(_rules_for(F.col("stage_id")))).selectExpr(
        "submission_id", "sort_order AS position", "requirement_id", f"{SUBMITTED_VALUE} AS answer_value")


def submission_rows(v: Views, events: DataFrame) -> DataFrame:
    """Submissions with their answers, one row per answer (one of null requirement, if there are none): for streams of events."""
    heads = events.join(_owners(v), "user_id", "left")
    heads = heads.select("event_id", *[F.expr(e).alias(a) for a, e in SUBMISSION.items()])
    rows = heads.select("*", F.inline_outer(_rules_for(F.col("stage_id"))))
    return rows.select(*SUBMISSION, F.col("sort_order").alias("position"), "requirement_id",
                       F.when(F.col("requirement_id").isNotNull(), F.expr(SUBMITTED_VALUE)).alias("answer_value"))


def _owners(v: Views) -> DataFrame:
    return v.tables.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.min("o_orderkey").alias("first_order"), F.max("o_orderkey").alias("last_order"))


def _rule_entry(r: model.Rule):
    number = {s: n for s, _, n in model.STAGES}
    return F.struct(
        F.lit(r.rule_id).alias("requirement_id"), F.lit(r.key).alias("requirement_key"),
        F.lit(r.input_type).alias("input_type"), F.lit(r.master_type).cast("string").alias("master_data_type"),
        F.lit(r.sort_order).alias("sort_order"), F.lit(number[r.stage_id]).alias("rule_stage"))


def _rules_for(stage):
    """Array of the rules of a stage; NULL for an unknown stage."""
    per_stage = [
        x for s, _, _ in model.STAGES for x in (F.lit(s), F.array(*[_rule_entry(r) for r in model.RULES if r.stage_id == s]))]
    return F.create_map(*per_stage)[stage]
