"""I: validation, access and data quality."""

from pyspark.sql import functions as F

from gatewright import model
from gatewright.catalog import sql_text as q
from gatewright.catalog.registry import query
from gatewright.functions import checks
from gatewright.plans import commands, verify
from gatewright.plans.answers import validate_answers
from gatewright.operators.labels import label_table
from gatewright.catalog.joins import LABEL_VIEWS, _LABELS_SQL
from gatewright.sources.adapter import (
    SUBMISSION, SUBMITTED_VALUE, submitted_answers, with_views,
)

MAIL = "example.com"
MAIL_SQL = r"'^[^@\s]+@example\.com$'"


def ref(column, label, dim, default, required=True, absent_only=False):
    """SQL for (reference value, error) of one intake field."""
    raw = column if default is None else (f"coalesce({column}, '{default}')" if absent_only else f"coalesce(nullif({column}, ''), '{default}')")
    value = q.slug(raw)
    need = f"WHEN {value} = '' THEN '{label} is required' " if required else ""
    return value, f"CASE {need}WHEN {value} <> '' AND {value} NOT IN (SELECT * FROM {dim}) THEN '{label} is not valid' END"


def _ids(names):
    keys = {"statuses": "status_id", "priorities": "priority_id", "business_units": "business_unit_id", "scopes": "scope_id",
            "expected_outputs": "expected_output_id", "platforms": "platform_id", "stages": "stage_id", "product_types": "product_type_id",
            "domains": "domain_id"}
    return ", ".join(f"k_{n} AS (SELECT {keys[n]} FROM a_{n})" for n in names.split())


INTAKE_DIMS = "statuses priorities business_units scopes expected_outputs platforms"
INTAKE_REFS = {
    "status": ref("status", "status", "k_statuses", "new", absent_only=True),
    "priority": ref("priority", "priority", "k_priorities", "p2"),
    "businessUnit": ref('"businessUnit"', "business unit", "k_business_units", "cp", required=False, absent_only=True),
    "scope": ref("scope", "scope", "k_scopes", "global", required=False),
    "expectedOutput": ref('"expectedOutput"', "expected output", "k_expected_outputs", "table_dataset", required=False),
    "platform": ref("platform", "target platform", "k_platforms", "databricks"),
}
_DATE_BAD = "NOT regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') OR try_strptime({0}, '%Y-%m-%d') IS NULL"
INTAKE_HEAD_ERROR = f"""CASE WHEN {q.strip('initiative')} = '' THEN 'initiative is required'
  WHEN NOT regexp_matches(lower({q.strip('"requesterEmail"')}), {MAIL_SQL}) THEN 'requester email must use example.com' END"""
INTAKE_ERROR = f"""coalesce({INTAKE_HEAD_ERROR}, {', '.join(e for _, e in INTAKE_REFS.values())},
  CASE WHEN {q.strip('requester')} = '' THEN 'requester is required' END,
  CASE WHEN {q.strip('"expectedDate"')} = '' THEN 'expected date is required'
    WHEN {_DATE_BAD.format(q.strip('"expectedDate"'))} THEN 'expected date must use YYYY-MM-DD format' END)"""

PRODUCT_DIMS = "stages statuses expected_outputs product_types platforms domains"
_DOMAIN = q.slug("coalesce(nullif(domain, ''), 'commercial')")
PRODUCT_REFS = {
    "stage": ref("stage", "stage", "k_stages", "intake", absent_only=True),
    "status": ref("status", "status", "k_statuses", "in_review", absent_only=True),
    "expectedOutput": ref('"expectedOutput"', "expected output", "k_expected_outputs", "table_dataset", required=False),
    "productType": ref('"productType"', "product type", "k_product_types", "structured"),
    "platform": ref("platform", "target platform", "k_platforms", "databricks"),
}
PRODUCT_ERROR = f"""coalesce(CASE WHEN request_id NOT IN (SELECT request_id FROM a_requests) THEN 'initiative not found' END,
  {PRODUCT_REFS['stage'][1]}, {PRODUCT_REFS['status'][1]}, CASE WHEN {_DOMAIN} NOT IN (SELECT * FROM k_domains) THEN 'domain is not valid' END,
  CASE WHEN {q.strip('title')} = '' THEN 'product title is required' END, {PRODUCT_REFS['expectedOutput'][1]}, {PRODUCT_REFS['productType'][1]},
  {PRODUCT_REFS['platform'][1]})"""
PRODUCT_DOMAIN = _DOMAIN


@query("i1_rule_engine", f"""
SELECT page_id, coalesce(CASE WHEN {q.strip('html')} = '' THEN 'html is required' WHEN length({q.strip('html')}) > 4000 THEN 'html must be 4000 characters or fewer' END,
  CASE WHEN {q.strip('url')} = '' THEN 'url is required' WHEN length({q.strip('url')}) > 2048 THEN 'url must be 2048 characters or fewer'
    WHEN NOT regexp_matches({q.strip('url')}, '(?i)^https?://[^/?#]+') THEN 'url must be a valid http(s) URL' END, '') AS error FROM pages""")
def _(t, v):
    error = checks.first_error(checks.text("html", "html", required=True, max_length=model.TEXTAREA_LIMIT),
                               checks.http_url("url", "url", required=True))
    return t.pages.select("page_id", F.coalesce(error, F.lit("")).alias("error"))


@query("i2_intake_head", with_views("intake", f"SELECT batch_id, coalesce({INTAKE_HEAD_ERROR}, '') AS error FROM a_intake"))
def _(t, v):
    error = checks.first_error(
        F.when(commands.strip("initiative") == "", F.lit("initiative is required")),
        F.when(~checks.is_mail("requesterEmail", MAIL), F.lit(f"requester email must use {MAIL}")))
    return v.intake.select("batch_id", F.coalesce(error, F.lit("")).alias("error"))


@query("i3_intake_references", with_views(f"intake {INTAKE_DIMS}", f"""
WITH {_ids(INTAKE_DIMS)}
SELECT batch_id, coalesce({INTAKE_ERROR}, '') AS error, {', '.join(f'{val} AS "{c}_ref"' for c, (val, _) in INTAKE_REFS.items())} FROM a_intake"""))
def _(t, v):
    checked = commands.validate_initiatives(v, v.intake, MAIL)
    return checked.select("batch_id", F.coalesce("error", F.lit("")).alias("error"), *[f"{c}_ref" for c in INTAKE_REFS])


@query("i4_product_references", with_views(f"new_products requests {PRODUCT_DIMS}", f"""
WITH {_ids(PRODUCT_DIMS)}
SELECT batch_id, coalesce({PRODUCT_ERROR}, '') AS error, {PRODUCT_REFS['stage'][0]} AS stage_ref FROM a_new_products"""))
def _(t, v):
    return commands.validate_products(v, v.new_products).select("batch_id", F.coalesce("error", F.lit("")).alias("error"), "stage_ref")


@query("i5_domain_default", with_views("new_products domains", f"""
SELECT batch_id, {_DOMAIN} AS domain_ref, CASE WHEN {_DOMAIN} NOT IN (SELECT domain_id FROM a_domains) THEN 'domain is not valid' ELSE '' END AS domain_error FROM a_new_products"""))
def _(t, v):
    return commands.resolve_domain(v.new_products.select("batch_id", "domain"), "domain", v.domains).select(
        "batch_id", "domain_ref", F.coalesce("domain_error", F.lit("")).alias("domain_error"))


_S = q.strip("answer_value")
_REF = q.slug("answer_value")
SUBMITTED = f"""sub AS (SELECT submission_id, sort_order AS position, requirement_id, requirement_key, input_type, label,
    CASE WHEN requirement_key = 'domain_delivery_lead_user_id' THEN 'hubOwners' ELSE master_data_type END AS collection, {SUBMITTED_VALUE} AS answer_value
  FROM (SELECT {SUBMISSION['submission_id']} AS submission_id, event_id, {SUBMISSION['stage_id']} AS submitted_stage FROM events) e
  JOIN a_requirements r ON r.stage_id = e.submitted_stage)"""


ANSWER_CLEAN = """CASE WHEN input_type = 'checkbox' THEN CASE WHEN lower(s) = 'true' THEN 'true' ELSE 'false' END
    WHEN input_type = 'number' THEN CASE WHEN regexp_matches(s, '^[0-9]+$') THEN CAST(CAST(s AS BIGINT) AS VARCHAR) ELSE '' END
    WHEN collection IS NOT NULL AND input_type <> 'date' THEN CASE WHEN s = '' THEN '' ELSE ref END ELSE s END"""
ANSWER_ERROR = """CASE WHEN input_type = 'number' AND s <> '' AND NOT regexp_matches(s, '^[0-9]+$') THEN concat(label, ' must be a whole number')
    WHEN input_type = 'date' AND s <> '' AND try_strptime(s, '%Y-%m-%d') IS NULL THEN concat(label, ' must use YYYY-MM-DD format')
    WHEN collection IS NOT NULL AND input_type = 'select' AND s <> '' AND NOT found THEN concat(label, ' is not valid')
    WHEN requirement_key = 'product_type_id' AND s = '' THEN 'product type is required'
    WHEN requirement_key = 'target_platform_id' AND s = '' THEN 'target platform is required'
    WHEN requirement_key = 'priority_id' AND s = '' THEN 'priority is required'
    WHEN requirement_key = 'lead_domain_id' AND s = '' THEN 'domain is not valid' END"""
CHECKED = f"""l AS ({_LABELS_SQL}), {SUBMITTED}, sv AS (SELECT s.*, {_S} AS s, {_REF} AS ref, l.id IS NOT NULL AS found FROM sub s
  LEFT JOIN l ON l.collection = s.collection AND l.id = {_REF})"""


@query("i6_answer_validation", with_views(LABEL_VIEWS + " requirements", f"""
WITH {CHECKED} SELECT submission_id, requirement_id, {ANSWER_CLEAN} AS clean_value, coalesce({ANSWER_ERROR}, '') AS error FROM sv"""))
def _(t, v):
    rules = v.requirements.select("requirement_id", "requirement_key", "label", "input_type", "master_data_type")
    checked = validate_answers(submitted_answers(v).join(rules, "requirement_id"), label_table(v))
    return checked.select("submission_id", "requirement_id", "clean_value", F.coalesce("answer_error", F.lit("")).alias("error"))


_MU_ID = q.slug("coalesce(email, '')")
_MU_MAIL = f"lower({q.strip('email')})"
_MU_ROLE = q.slug("coalesce(nullif(\"roleKey\", ''), 'requester')")
MASTER_USER_ERROR = f"""coalesce(CASE WHEN {_MU_ID} = '' THEN 'id or name is required' END, CASE WHEN {q.strip('name')} = '' THEN 'name is required' END,
  CASE WHEN {_MU_MAIL} <> '' AND NOT regexp_matches({_MU_MAIL}, {MAIL_SQL}) THEN 'user email must use example.com' END,
  CASE WHEN {_MU_ROLE} NOT IN ('requester','admin','data_domain_owner','domain_delivery_lead','hub_owner','lynx_pm') THEN 'roleKey is not valid' END)"""
MASTER_USER_ROW = f"{_MU_ID} AS user_id, {q.strip('name')} AS display_name, {_MU_MAIL} AS email, {_MU_ROLE} AS role_key"


@query("i7_master_data_validation", with_views("master_users", f"""
SELECT seq, {MASTER_USER_ROW}, coalesce({MASTER_USER_ERROR}, '') AS error FROM a_master_users"""))
def _(t, v):
    checked = commands.validate_master_data(v, "users", v.master_users, MAIL)
    return checked.select("seq", "user_id", "display_name", "email", "role_key", F.coalesce("error", F.lit("")).alias("error"))


@query("i8_protected_rows", with_views("products", """
SELECT data_product_id, lead_domain_id FROM a_products WHERE lead_domain_id = 'asia' OR lead_domain_id NOT IN ('asia', 'africa')"""))
def _(t, v):
    """Delete two domains' worth of products' domain rows; one of them is protected."""
    wanted = t.spark.sql("SELECT * FROM VALUES ('asia'), ('africa') AS d(domain_id)")
    left, _refused = commands.delete_master_data(v.domains, "domains", wanted, "domain_id", protected={"domains": ["asia"]})
    return v.products.select("data_product_id", "lead_domain_id").join(
        left.select(F.col("domain_id").alias("lead_domain_id")), "lead_domain_id", "left_semi")


@query("i9_role_resolution", with_views("users", f"""
WITH m AS (SELECT c_custkey, lower(CASE c_custkey % 3 WHEN 0 THEN concat('USER', CAST(c_custkey AS VARCHAR), '@example.com') WHEN 1 THEN 'who@other.org'
  ELSE concat('boss', CAST(c_custkey AS VARCHAR), '@example.com') END) AS mail FROM customer),
 x AS (SELECT c_custkey, mail, display_name, coalesce(role_key, '') AS role_key, regexp_matches(mail, {MAIL_SQL}) AS inside,
   mail IN ('boss2@example.com') AS conf FROM m LEFT JOIN a_users u ON lower(u.email) = mail)
SELECT c_custkey, mail AS email, CASE WHEN inside AND (conf OR role_key NOT IN ('', 'requester')) THEN 'admin' ELSE 'requester' END AS role,
  inside AND (conf OR role_key NOT IN ('', 'requester')) AS can_admin, inside AND (conf OR role_key = 'admin') AS can_delete,
  CASE WHEN NOT inside THEN 'Requester' ELSE coalesce(display_name, split_part(mail, '@', 1)) END AS name FROM x"""))
def _(t, v):
    mail = (F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("USER"), F.col("c_custkey").cast("string"), F.lit("@example.com")))
            .when(F.col("c_custkey") % 3 == 1, F.lit("who@other.org"))
            .otherwise(F.concat(F.lit("boss"), F.col("c_custkey").cast("string"), F.lit("@example.com"))))
    return commands.resolve_roles(t.customer.select("c_custkey", mail.alias("email")), v.users, MAIL, ["Boss2@example.com "])


@query("i10_first_identity", f"""
WITH h AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'proxy' ELSE concat(' A', CAST(s_suppkey AS VARCHAR), '@Example.com') END AS forwarded,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('b', CAST(s_suppkey AS VARCHAR), '@example.com') END AS login FROM supplier)
SELECT s_suppkey, coalesce(CASE WHEN regexp_matches(lower(trim(forwarded)), {MAIL_SQL}) THEN lower(trim(forwarded)) END, login, '') AS user_email,
  CASE WHEN regexp_matches(lower(trim(forwarded)), {MAIL_SQL}) THEN 'forwarded' WHEN login IS NOT NULL THEN 'login' ELSE '' END AS identity_source FROM h""")
def _(t, v):
    key = F.col("s_suppkey").cast("string")
    heads = t.supplier.select(
        "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.lit("proxy")).otherwise(F.concat(F.lit(" A"), key, F.lit("@Example.com"))).alias("forwarded"),
        F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("b"), key, F.lit("@example.com"))).alias("login"))
    found = commands.first_identity(heads, ["forwarded", "login"], MAIL)
    return found.select("s_suppkey", F.coalesce("user_email", F.lit("")).alias("user_email"), F.coalesce("identity_source", F.lit("")).alias("identity_source"))


@query("i11_readiness", """
SELECT 'missing' AS problem, 'md_users' AS table_name UNION ALL
SELECT 'empty', 'labels' WHERE (SELECT count(*) FROM labels WHERE quality > 5) = 0 UNION ALL
SELECT 'empty', 'orders' WHERE (SELECT count(*) FROM orders) = 0""")
def _(t, v):
    required = t.spark.sql("SELECT * FROM VALUES ('md_users'), ('labels'), ('orders') AS r(table_name)")
    return verify.readiness({"labels": t.labels.where("quality > 5"), "orders": t.orders, "pages": t.pages}, required)


@query("i12_product_quality", with_views("products statuses", """
SELECT data_product_id, jira_link, alation_link FROM a_products WHERE jira_link IS NULL OR jira_link = '' OR alation_link IS NULL OR alation_link = ''
  OR current_stage_id NOT IN (SELECT stage_id FROM a_stages WHERE stage_number < 8) OR status_id NOT IN (SELECT status_id FROM a_statuses WHERE status_id <> 'blocked')""").replace(
    "WITH ", "WITH a_stages AS (" + model.values_sql(model.STAGES, ["stage_id", "stage_name", "stage_number"]) + "), ", 1))
def _(t, v):
    return verify.quality_findings(v.products, v.stages.where("stage_number < 8"), v.statuses.where("status_id <> 'blocked'"),
                                   key="data_product_id", number="jira_link", title="alation_link")


@query("i13_orphan_products", with_views("products requests", """
SELECT data_product_id, title FROM a_products WHERE request_id NOT IN (SELECT request_id FROM a_requests)"""))
def _(t, v):
    return verify.orphan_products(v.products, v.requests)
