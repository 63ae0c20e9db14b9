"""Table layouts and reference data of the governed-workflow model.

Everything below the "fixed values" comments has to equal the values stored in
existing deployments, because results (labels, stage order, rule ids, accepted
spellings) depend on them literally.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------- fixed values
STAGES = [
    ("intake", "Intake", 1),
    ("reuse_domain", "Domain Ownership", 2),
    ("ownership", "Estimation", 3),
    ("requirements", "Requirements", 4),
    ("architecture_review", "Architecture Review", 5),
    ("build_validate", "Build / Validate", 6),
    ("publish", "Publish", 7),
    ("operate", "Operate", 8),
]
STATUSES = [
    ("new", "New"),
    ("not_started", "Not started"),
    ("in_review", "In review"),
    ("in_progress", "In progress"),
    ("blocked", "Blocked"),
    ("ready", "Ready"),
    ("operating", "Operating"),
    ("completed", "Completed"),
    ("on_hold", "On hold"),
    ("cancelled", "Cancelled"),
    ("deprecated", "Deprecated"),
]
PRIORITIES = [("p1", "P1"), ("p2", "P2"), ("p3", "P3")]
PLATFORMS = [("databricks", "Databricks"), ("lynx", "Lynx"), ("both", "Both")]
PRODUCT_TYPES = [("structured", "Structured"), ("unstructured", "Unstructured"), ("mixed", "Mixed")]
EXPECTED_OUTPUTS = [
    ("table_dataset", "Table / dataset"),
    ("dashboard", "Dashboard"),
    ("api", "API"),
    ("semantic_layer", "Semantic layer"),
    ("lynx_knowledge_base", "Lynx knowledge base"),
    ("ai_search_feature", "AI / search feature"),
    ("report", "Report"),
    ("other", "Other"),
]
SCOPES = [
    ("global", "Global", "Global", None),
    ("europe", "Europe", "Region", None),
    ("latin_america", "Latin America", "Region", None),
    ("north_america", "North America", "Region", None),
    ("amea", "AMEA", "Region", None),
    ("janz", "JANZ", "Region", None),
]
BUILD_STATUSES = [
    ("not_started", "Not started"),
    ("in_build", "In build"),
    ("testing", "Testing"),
    ("in_uat", "In UAT"),
    ("built", "Built"),
    ("blocked", "Blocked"),
]
SOURCE_SYSTEMS = [
    ("sap", "SAP"),
    ("salesforce", "Salesforce"),
    ("sharepoint", "SharePoint"),
    ("databricks", "Databricks"),
    ("manual_upload", "Manual upload"),
]
ROLE_KEYS = ["requester", "admin", "data_domain_owner", "domain_delivery_lead", "hub_owner", "lynx_pm"]
ADMIN_ROLE_KEYS = ["admin", "data_domain_owner", "domain_delivery_lead", "hub_owner", "lynx_pm"]
PROTECTED_ITEMS = {"businessUnits": ["cp", "seeds", "vegetables"], "domains": ["commercial"]}

# (stage_id, requirement_key, label, input_type, master_data_type, sort_order, is_required)
REQUIREMENTS = [
    ("intake", "data_product_owner", "Data Product Owner", "text", None, 1, 1),
    ("intake", "expected_output_id", "Expected output", "select", "expectedOutputs", 2, 1),
    ("intake", "product_type_id", "Product type", "select", "productTypes", 3, 1),
    ("intake", "target_platform_id", "Target platform", "select", "platforms", 4, 1),
    ("intake", "priority_id", "Priority", "select", "priorities", 5, 1),
    ("intake", "scope_id", "Scope", "select", "scopeOptions", 6, 1),
    ("intake", "business_decision", "Business decision supported", "textarea", None, 7, 1),
    ("intake", "business_value", "Business value", "textarea", None, 8, 1),
    ("intake", "expected_date", "Expected date", "date", None, 9, 1),
    ("intake", "additional_comments", "Additional comments", "textarea", None, 10, 1),
    ("reuse_domain", "lead_domain_id", "Lead domain", "select", "domains", 1, 1),
    ("reuse_domain", "lead_subdomain_id", "Lead subdomain", "select", "subdomains", 2, 1),
    ("reuse_domain", "delivery_lead", "Delivery lead", "select", "domainDeliveryLeads", 3, 1),
    ("reuse_domain", "data_domain_owner_user_id", "Data Domain Owner", "select", "dataDomainOwners", 4, 1),
    ("reuse_domain", "domain_delivery_lead_user_id", "Hub Owner", "select", "hubOwners", 5, 1),
    ("reuse_domain", "lynx_pm_user_id", "Lynx PM input", "select", "lynxPms", 6, 0),
    ("ownership", "delivery_date", "Delivery date", "date", None, 1, 1),
    ("ownership", "effort", "Effort", "number", None, 2, 1),
    ("ownership", "jira_epic_id", "Jira epic ID", "text", None, 3, 1),
    ("ownership", "jira_link", "Jira link", "text", None, 4, 1),
    ("ownership", "reuse_checked", "Existing product reuse checked", "checkbox", None, 5, 1),
    ("ownership", "source_system_id", "Source system outputs", "select", "sourceSystems", 6, 1),
    ("requirements", "kpis_defined", "KPIs defined", "checkbox", None, 1, 1),
    ("requirements", "definitions_defined", "Definitions defined", "checkbox", None, 2, 1),
    ("requirements", "grain_defined", "Grains defined", "checkbox", None, 3, 1),
    ("requirements", "sources_defined", "Sources defined", "checkbox", None, 4, 1),
    ("requirements", "cde_defined", "CDE defined", "checkbox", None, 5, 1),
    ("requirements", "dq_rules_defined", "Data Quality rules defined", "checkbox", None, 6, 1),
    ("architecture_review", "architecture_review_complete", "Architecture review complete", "checkbox", None, 1, 1),
    ("architecture_review", "security_pattern_confirmed", "Security pattern confirmed", "checkbox", None, 2, 1),
    ("architecture_review", "tooling_confirmed", "Databricks / Lynx tooling confirmed", "checkbox", None, 3, 1),
    ("build_validate", "build_status_id", "Build status", "select", "buildStatuses", 1, 1),
    ("build_validate", "build_evidence", "Build / test notes", "textarea", None, 2, 1),
    ("publish", "alation_link", "Alation link", "text", None, 1, 1),
    ("publish", "alation_documented", "Documented in Alation", "checkbox", None, 2, 1),
    ("publish", "release_notes", "Release notes", "textarea", None, 3, 1),
    ("operate", "support_model_confirmed", "Support model confirmed", "checkbox", None, 1, 1),
    ("operate", "review_cycle_confirmed", "Review cycle confirmed", "checkbox", None, 2, 1),
]

# Requirement keys whose shown value is a product / parent column; every other key shows its stored answer.
PRODUCT_VALUE_KEYS = [
    "product_type_id", "data_product_owner", "expected_output_id", "target_platform_id", "lead_domain_id",
    "lead_subdomain_id", "delivery_date", "delivery_lead", "domain_delivery_lead_user_id", "effort",
    "jira_epic_id", "jira_link", "alation_link",
]
PARENT_VALUE_KEYS = [
    "priority_id", "scope_id", "business_decision", "business_value", "expected_date", "additional_comments",
]
# Written to a product column too, but shown from the stored answer.
ANSWER_SHOWN_COLUMNS = ["data_domain_owner_user_id", "source_system_id", "lynx_pm_user_id", "build_status_id"]

TEXT_LIMIT = 500
TEXTAREA_LIMIT = 4000
URL_LIMIT = 2048
BODY_LIMIT_BYTES = 1_000_000
LOG_TEXT_LIMIT = 90
LOG_CHANGES_LISTED = 6
PREVIEW_ROWS = 50
HUB_OWNER_KEY = "domain_delivery_lead_user_id"
SUBDOMAIN_RULE_ID = "reuse_domain_lead_subdomain_id"

# Output names of the product overview, in the order consumers read them.
CAMEL_NAMES = {
    "stageid": "stageId", "statusid": "statusId", "domainid": "domainId", "domainname": "domainName",
    "parentid": "parentId", "rolekey": "roleKey",
}
# Table names and column layouts of existing deployments.
REQUIRED_TABLES = [
    "md_domains", "md_business_units", "md_product_types", "md_expected_outputs", "md_platforms",
    "md_priorities", "md_stages", "md_statuses", "md_subdomains", "md_users", "md_source_systems",
    "md_scope_options", "md_build_statuses", "md_stage_requirements", "governance_requests",
    "data_products", "product_stage_answers", "governance_timeline",
]

TIMELINE_COLUMNS = [
    "timeline_id", "entity_type", "request_id", "data_product_id", "event_type", "stage_id", "from_stage_id",
    "to_stage_id", "status_id", "event_label", "event_detail", "created_by", "created_at",
]
REQUEST_COLUMNS = [
    "request_id", "request_number", "priority_id", "business_unit_id", "scope_id", "requester_name",
    "requester_email", "initiative", "business_decision", "business_value", "expected_output_id",
    "target_platform_id", "expected_date", "additional_comments", "status_id", "status_change_reason",
    "last_status_change_date", "last_status_changed_by", "note", "created_at", "updated_at",
]
PRODUCT_COLUMNS = [
    "data_product_id", "request_id", "data_product_number", "title", "description", "expected_output_id",
    "product_type_id", "target_platform_id", "data_product_owner", "lead_domain_id", "lead_subdomain_id",
    "delivery_lead", "data_domain_owner_user_id", "domain_delivery_lead_user_id", "lynx_pm_user_id",
    "delivery_date", "effort", "jira_epic_id", "jira_link", "alation_link", "source_system_id",
    "build_status_id", "current_stage_id", "status_id", "status_change_reason", "last_status_change_date",
    "last_status_changed_by", "note", "created_at", "updated_at",
]
# ------------------------------------------------------------ end fixed values


@dataclass(frozen=True)
class Rule:
    """One form requirement of a stage."""

    stage_id: str
    key: str
    label: str
    input_type: str
    master_type: str | None
    sort_order: int
    required: bool

    @property
    def rule_id(self) -> str:
        return f"{self.stage_id}_{self.key}"


RULES = [Rule(s, k, lbl, t, m, o, bool(r)) for s, k, lbl, t, m, o, r in REQUIREMENTS]


def sql_literal(value) -> str:
    if value is None:
        return "CAST(NULL AS string)"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(rows, columns) -> str:
    """Inline VALUES relation; portable between Spark SQL and DuckDB."""
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


def literal_table(spark: SparkSession, rows, columns) -> DataFrame:
    """A literal dimension as a local relation, so that Catalyst knows its exact size."""
    return spark.sql(values_sql(rows, columns))


REQUIREMENT_COLUMNS = [
    "stage_id", "requirement_key", "label", "input_type", "master_data_type", "sort_order", "is_required",
]


def stages(spark):
    return literal_table(spark, STAGES, ["stage_id", "stage_name", "stage_number"])


def statuses(spark):
    return literal_table(spark, STATUSES, ["status_id", "status_name"])


def priorities(spark):
    return literal_table(spark, PRIORITIES, ["priority_id", "priority_name"])


def platforms(spark):
    return literal_table(spark, PLATFORMS, ["platform_id", "platform_name"])


def product_types(spark):
    return literal_table(spark, PRODUCT_TYPES, ["product_type_id", "product_type_name"])


def expected_outputs(spark):
    return literal_table(spark, EXPECTED_OUTPUTS, ["expected_output_id", "expected_output_name"])


def scopes(spark):
    return literal_table(spark, SCOPES, ["scope_id", "scope_name", "scope_type", "parent_scope_id"])


def build_statuses(spark):
    return literal_table(spark, BUILD_STATUSES, ["build_status_id", "build_status_name"])


def source_systems(spark):
    return literal_table(spark, SOURCE_SYSTEMS, ["source_system_id", "source_system_name"])


def requirements(spark):
    rows = [(r.rule_id, *row) for r, row in zip(RULES, REQUIREMENTS)]
    return literal_table(spark, rows, ["requirement_id", *REQUIREMENT_COLUMNS])


def load_rules(df: DataFrame) -> list[Rule]:
    """Read a rule table into plan-time metadata. Rules describe the form, not the data: their number does not follow the volume."""
    rows = df.select(*REQUIREMENT_COLUMNS).collect()
    rules = [
        Rule(r.stage_id, r.requirement_key, r.label, r.input_type, r.master_data_type, r.sort_order, bool(r.is_required))
        for r in rows
    ]
    return sorted(rules, key=lambda r: (r.stage_id, r.sort_order, r.key))
