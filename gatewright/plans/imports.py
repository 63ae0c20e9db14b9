"""Imports of older record layouts: tolerant reads, mapping ladders, merges, event backfill, rule edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright import model
from gatewright.functions.text import canonical_json, digits_only, ladder, last_digits_number, row_md5, zero_fill
from gatewright.operators.merge import delete_where, insert_if_absent, merge, update_where
from gatewright.operators.numbering import number_rows
from gatewright.plans.changes import timeline_events
from gatewright.sources.tables import with_missing_columns

# fixed values: accepted spellings and what they map to, tested in this order
PRIORITY_STEPS = [("in", ["p1", "high", "critical"], "p1"), ("in", ["p3", "low"], "p3")]
UNIT_STEPS = [("in", ["cp", "crop protection"], "cp"), ("in", ["seeds"], "seeds"), ("in", ["vegetables"], "vegetables")]
SCOPE_STEPS_FLAT = [
    ("in", ["global", "worldwide"], "global"), ("in", ["europe", "eu"], "europe"),
    ("in", ["latin america", "latam", "latam region"], "latin_america"),
    ("in", ["north america", "na", "narm"], "north_america"), ("in", ["amea"], "amea"), ("in", ["janz"], "janz"),
]
SCOPE_STEPS_PARENT = [
    ("in", ["global", "worldwide"], "global"), ("in", ["europe", "eu"], "europe"),
    ("in", ["latin america", "latam", "latin_america"], "latin_america"),
    ("in", ["north america", "na", "north_america"], "north_america"), ("in", ["amea"], "amea"), ("in", ["janz"], "janz"),
]
TYPE_STEPS = [("contains", ["unstructured"], "unstructured"), ("contains", ["semi"], "mixed"), ("contains", ["mixed"], "mixed")]
TYPE_IDS = ["structured", "unstructured", "mixed"]
PLATFORM_IDS = ["databricks", "lynx", "both"]
PLATFORM_STEPS = [("contains", ["lynx"], "lynx"), ("contains", ["ai"], "lynx")]
OUTPUT_IDS = [i for i, _ in model.EXPECTED_OUTPUTS]
OUTPUT_STEPS = [
    ("contains", ["dashboard"], "dashboard"), ("contains", ["api"], "api"), ("contains", ["semantic"], "semantic_layer"),
    ("contains", ["lynx"], "lynx_knowledge_base"), ("contains", ["ai"], "ai_search_feature"), ("contains", ["report"], "report"),
]
STAGE_IDS = [s for s, _, _ in model.STAGES]
STAGE_FROM_STATUS = [
    ("in", ["completed", "closed", "operating"], "operate"), ("in", ["in progress", "approved", "in_progress"], "build_validate"),
]
STATUS_IDS_FLAT = [
    "not_started", "in_review", "in_progress", "blocked", "ready", "operating", "completed", "on_hold", "cancelled", "deprecated",
]
STATUS_STEPS = [
    ("in", ["pending", "open"], "in_review"), ("in", ["in progress", "approved"], "in_progress"),
    ("in", ["completed", "closed"], "operating"), ("in", ["cancelled"], "cancelled"), ("in", ["blocked"], "blocked"),
]
FLAT_COLUMNS = [
    "request_id", "request_number", "title", "description", "product_type_id", "target_platform_id", "priority_id",
    "lead_domain_id", "business_unit_id", "scope_id", "requester_name", "requester_email", "data_product_owner",
    "initiative", "expected_output_id", "business_value", "expected_date", "delivery_date", "delivery_lead", "effort",
    "jira_epic_id", "jira_link", "alation_link", "additional_comments", "current_stage_id", "status_id",
    "status_change_reason", "last_status_change_date", "last_status_changed_by", "lead_subdomain_id",
    "data_domain_owner_user_id", "source_system_id", "domain_delivery_lead_user_id", "lynx_pm_user_id",
    "build_status_id", "note", "created_at", "updated_at",
]
# stored values a repeated legacy import does not touch
FLAT_KEPT = [
    "business_value", "alation_link", "additional_comments", "lead_subdomain_id", "data_domain_owner_user_id",
    "source_system_id", "domain_delivery_lead_user_id", "lynx_pm_user_id", "build_status_id", "created_at",
]
# columns the application copy never delivers
COPY_ABSENT = ["data_product_owner", "expected_output_id", "business_value", "alation_link"]
PARENT_UPDATED = [
    "initiative", "business_decision", "business_value", "expected_output_id", "target_platform_id", "priority_id",
    "business_unit_id", "scope_id", "requester_name", "requester_email", "expected_date", "additional_comments",
    "updated_at",
]
PARENT_IMPORT_NOTE = "Imported from v2 request/product row. Products will be added later."


def on(column: Column, steps) -> list[tuple]:
    """Bind a mapping to a column."""
    return [(kind, column, patterns, result) for kind, patterns, result in steps]


class Source:
    """Columns of a layout in which any name may be missing; a missing name reads as NULL."""

    def __init__(self, df: DataFrame):
        self.columns = set(df.columns)

    def __call__(self, name: str) -> Column:
        return F.col(name).cast("string") if name in self.columns else F.lit(None).cast("string")

    def first(self, *names: str, default: str | None = None) -> Column:
        """First non-NULL; an empty text stops the search."""
        return F.coalesce(*[self(n) for n in names], F.lit(default).cast("string"))

    def filled(self, *names: str) -> list[Column]:
        return [F.nullif(self(n), F.lit("")) for n in names]

    def nonblank(self, *names: str) -> Column:
        """First non-NULL, with '' turned into NULL afterwards."""
        return F.nullif(self.first(*names), F.lit(""))


def legacy_to_flat(df: DataFrame, as_of: str) -> DataFrame:
    """One flat record of 38 columns per legacy row."""
    s = Source(df)
    df = df.withColumn("_hash", row_md5(df.columns))
    hashed = F.col("_hash")
    key = F.coalesce(*s.filled("request_id", "data_product_id"), hashed)
    digits = F.coalesce(F.nullif(digits_only(s.first(
        "business_request_id", "data_product_business_id", "request_number", "request_id", "data_product_id", default="")), F.lit("")),
        F.substring(hashed, 1, 8))
    kind = F.lower(s.first("data_structure_type", "type", "product_type_id", default=""))
    subject = F.lower(s.first("type", "data_product_name", "title", "data_object", default=""))
    status = F.lower(s.first("status", "status_id", default=""))
    own = lambda name: F.nullif(s(name), F.lit(""))
    lowered_in = lambda name, ids: ("in", F.lower(s.first(name, default="")), ids, F.lower(s(name)))
    exactly_in = lambda name, ids: ("in", s.first(name, default=""), ids, s(name))
    none = F.lit(None).cast("string")
    fields = {
        "request_id": F.concat(F.lit("legacy-"), key),
        "request_number": last_digits_number(digits),
        "title": F.left(F.coalesce(*s.filled("data_product_name", "title", "data_object"),
                                   F.concat(F.lit("Imported data product "), key)), F.lit(model.TEXT_LIMIT)),
        "description": s.nonblank("description", "data_object"),
        "product_type_id": ladder([*on(kind, TYPE_STEPS), lowered_in("product_type_id", TYPE_IDS)], "structured"),
        "target_platform_id": ladder([lowered_in("target_platform_id", PLATFORM_IDS), *on(subject, PLATFORM_STEPS)], "databricks"),
        "priority_id": ladder(on(F.lower(s.first("priority", "priority_id", default="")), PRIORITY_STEPS), "p2"),
        "lead_domain_id": F.coalesce(own("lead_domain_id"), F.lit("commercial")),
        "business_unit_id": ladder(on(F.lower(s.first("business_unit", "business_unit_id", default="")), UNIT_STEPS), none),
        "scope_id": ladder(on(F.lower(s.first("scope", "region", "scope_id", default="")), SCOPE_STEPS_FLAT), "global"),
        "requester_name": s.nonblank("requester_name", "requestor"),
        "requester_email": F.lower(s.nonblank("requester_email", "requested_by", "requestor")),
        "data_product_owner": s.nonblank("data_product_owner", "data_owner"),
        "expected_output_id": ladder([exactly_in("expected_output_id", OUTPUT_IDS), *on(subject, OUTPUT_STEPS)], "table_dataset"),
        "expected_date": s.nonblank("expected_date", "business_expected_date"),
        "delivery_lead": s.nonblank("delivery_lead", "data_engineer"),
        "effort": F.when(s.first("effort", default="").rlike(r"^\d+$"), s("effort").try_cast("int")),
        "current_stage_id": ladder([exactly_in("current_stage_id", STAGE_IDS), *on(status, STAGE_FROM_STATUS)], "intake"),
        "status_id": ladder([exactly_in("status_id", STATUS_IDS_FLAT), *on(F.lower(s.first("status", default="")), STATUS_STEPS)], "in_review"),
        "note": s.nonblank("note", "status_change_reason"),
        "created_at": F.coalesce(*s.filled("created_at", "requested_date", "last_status_change_date"), F.lit(as_of)),
        "updated_at": F.coalesce(*s.filled("updated_at", "last_status_change_date", "requested_date"), F.lit(as_of)),
    }
    return df.select(*[(fields[c] if c in fields else own(c)).alias(c) for c in FLAT_COLUMNS])


def import_legacy(target: DataFrame, legacy: DataFrame, as_of: str) -> DataFrame:
    """New state of the flat table; a repeated import leaves FLAT_KEPT columns of stored rows alone."""
    rows = legacy_to_flat(legacy, as_of)
    update = [c for c in FLAT_COLUMNS if c not in ("request_id", *FLAT_KEPT)]
    return merge(target, rows, ["request_id"], update=update, order=["updated_at", "request_number", "title"])


def copy_to_flat(app: DataFrame) -> DataFrame:
    """Application rows in the flat layout: numeric numbers keep eight digits, undelivered columns are NULL."""
    number = F.col("request_number")
    df = with_missing_columns(app, [c for c in FLAT_COLUMNS if c != "effort"])
    return df.withColumns({
        "request_number": F.when(number.rlike(r"^\d+$"), last_digits_number(number)).otherwise(number),
        **{c: F.lit(None).cast("string") for c in COPY_ABSENT},
    }).select(*FLAT_COLUMNS)


def copied_rows(flat: DataFrame, app_rows: DataFrame) -> DataFrame:
    """The flat table after the application's rows: stored values win in the four undelivered columns."""
    update = [c for c in FLAT_COLUMNS if c not in ("request_id", "created_at", *COPY_ABSENT)]
    return merge(flat, copy_to_flat(app_rows), ["request_id"], update=update, keep=COPY_ABSENT, order=["updated_at", "request_number"])


def copied_answers(answers: DataFrame, app_answers: DataFrame) -> DataFrame:
    return merge(answers, app_answers, ["data_product_id", "requirement_id"], update=["answer_value", "updated_at"],
                 order=["updated_at", "answer_id"])


def copied_timeline(timeline: DataFrame, app_timeline: DataFrame) -> DataFrame:
    return insert_if_absent(timeline, app_timeline, [["timeline_id"]], ["created_at", "event_type", "event_detail"])


def import_app_copy(flat: DataFrame, answers: DataFrame, timeline: DataFrame, app_rows: DataFrame, app_answers: DataFrame,
                    app_timeline: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge a copy of the application's tables. The three parts do not depend on each other and can be had one by one."""
    return copied_rows(flat, app_rows), copied_answers(answers, app_answers), copied_timeline(timeline, app_timeline)


def flat_to_parents(df: DataFrame, as_of: str) -> DataFrame:
    """Each flat row as one parent request, renumbered in the order of its old number."""
    s = Source(df)
    names = df.columns
    df = df.withColumn("_text", canonical_json(names))
    old_number = s.first("request_number", "data_product_business_id", "request_id", "created_at")
    df = df.withColumn("_old", F.coalesce(old_number, F.col("_text")))
    df = number_rows(df, [F.col("_old"), F.col("_text")], "_number")
    df = number_rows(df, [F.col("_text")], "_place")
    key = F.coalesce(*s.filled("request_id", "data_product_id"), F.md5("_text"))
    trimmed = [F.nullif(F.trim(s(n)), F.lit("")) for n in ("title", "data_product_name", "data_object", "initiative")]
    platform = s.first("target_platform_id", default="databricks")
    output = s.first("expected_output_id", default="table_dataset")
    created = s.first("created_at", "requested_date", "last_status_change_date", default=as_of)
    blank_to_null = lambda c: F.nullif(c, F.lit(""))
    none = F.lit(None).cast("string")
    fields = {
        "request_id": F.concat(F.lit("v2-request-"), key),
        "request_number": zero_fill(F.col("_number").cast("string")),
        "initiative": F.coalesce(*trimmed, F.concat(F.lit("Imported initiative "), F.col("_place").cast("string"))),
        "business_decision": blank_to_null(s.first("description", "data_object", default="")),
        "business_value": blank_to_null(s.first("business_value", default="")),
        "expected_output_id": ladder([("in", output, OUTPUT_IDS, output)], "table_dataset"),
        "target_platform_id": ladder([("in", platform, PLATFORM_IDS, platform)], "databricks"),
        "priority_id": ladder(on(F.lower(s.first("priority_id", "priority", default="p2")), PRIORITY_STEPS), "p2"),
        "business_unit_id": ladder(on(F.lower(s.first("business_unit_id", "business_unit", default="cp")), UNIT_STEPS), "cp"),
        "scope_id": ladder(on(F.lower(s.first("scope_id", "scope", "region", default="global")), SCOPE_STEPS_PARENT), "global"),
        "requester_name": blank_to_null(s.first("requester_name", "requestor", default="")),
        "requester_email": blank_to_null(F.lower(s.first("requester_email", "requested_by", "requestor", default=""))),
        "expected_date": blank_to_null(s.first("expected_date", "business_expected_date", default="")),
        "additional_comments": blank_to_null(s.first("additional_comments", default="")),
        "status_id": F.lit("new"), "note": F.lit(PARENT_IMPORT_NOTE), "created_at": created, "updated_at": created,
    }
    return df.select(*[fields.get(c, none).alias(c) for c in model.REQUEST_COLUMNS])


def import_parents(requests: DataFrame, flat: DataFrame, as_of: str) -> DataFrame:
    """New state of the requests; a repeated import keeps stored numbers and creation times."""
    return merge_parents(requests, flat_to_parents(flat, as_of))


def merge_parents(requests: DataFrame, parents: DataFrame) -> DataFrame:
    """As import_parents, of rows that flat_to_parents has already numbered."""
    return merge(requests, parents, ["request_id"], update=PARENT_UPDATED, order=["updated_at", "request_number"])


def backfill_created(timeline: DataFrame, rows: DataFrame, *, id_prefix: str, event_prefix: str, label: str, detail: str,
                     per: str = "request") -> DataFrame:
    """Add one 'created' event per imported row; running it again adds nothing."""
    imported = rows.where(F.col("request_id").startswith(id_prefix))
    have = lambda c: F.col(c) if c in rows.columns and per == "flat" else F.lit(None)
    events = timeline_events(imported, {
        "entity_type": F.lit("request"), "request_id": F.col("request_id"), "event_type": F.lit("created"),
        "stage_id": have("current_stage_id"), "to_stage_id": have("current_stage_id"), "status_id": have("status_id"),
        "event_label": F.lit(label), "event_detail": F.lit(detail), "created_by": F.lit("migration")}, F.col("created_at"), F.lit(""))
    events = events.withColumn("timeline_id", F.concat(F.lit(event_prefix), "request_id"))
    return insert_if_absent(timeline, events.select(*timeline.columns), [["timeline_id"]], ["created_at"])


def backfill_request_defaults(requests: DataFrame) -> DataFrame:
    """Defaults for status, expected output and platform, adding the columns where they are missing."""
    df = with_missing_columns(requests, ["expected_output_id", "target_platform_id"])
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    df = update_where(df, empty("status_id") | (F.col("status_id") == "in_review"), {"status_id": F.lit("new")})
    df = update_where(df, empty("expected_output_id"), {"expected_output_id": F.lit("table_dataset")})
    return update_where(df, empty("target_platform_id"), {"target_platform_id": F.lit("databricks")})


def edit_rules(requirements: DataFrame) -> DataFrame:
    """Drop the classification rule, close the gap it leaves, make the PM rule optional, rename the hub owner rule."""
    df = delete_where(requirements, F.col("requirement_id") == "intake_product_classification_id")
    df = update_where(df, (F.col("stage_id") == "intake") & (F.col("sort_order") > 2), {"sort_order": F.col("sort_order") - 1})
    df = update_where(df, F.col("requirement_id") == "reuse_domain_lynx_pm_user_id", {"is_required": F.lit(0)})
    return update_where(df, F.col("requirement_key") == model.HUB_OWNER_KEY,
                        {"label": F.lit("Hub Owner"), "master_data_type": F.lit("hubOwners")})


def import_summary(rows: DataFrame, prefix: str, children: DataFrame) -> DataFrame:
    n = children.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.where(F.col("request_id").startswith(prefix)).agg(
        F.count(F.lit(1)).alias("imported_initiatives")).withColumn("imported_products", n)
