"""Denormalised overviews of products and initiatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.functions import dates
from gatewright.functions.text import first_filled, normalize_number, or_empty, search_tokens, strip
from gatewright.operators.search import token_hits
from gatewright.operators.text_index import TextIndex, build_index
from gatewright.operators.textroll import text_pieces


def stage_entries(timeline: DataFrame) -> DataFrame:
    """Per product and stage, the time text of the latest advance into it."""
    return (
        timeline.where((F.col("event_type") == "stage_advanced") & F.col("to_stage_id").isNotNull())
        .groupBy("data_product_id", F.col("to_stage_id").alias("current_stage_id"))
        .agg(F.max("created_at").alias("entered_at"))
    )


def stage_entered_at(products: DataFrame, timeline: DataFrame, as_of: str) -> DataFrame:
    """Products with the entry into their current stage: last advance into it, else creation, else as_of.

    Adds current_stage_entered_at (text) and current_stage_entered_us (microseconds); each text is parsed once.
    """
    df = products.join(stage_entries(timeline), ["data_product_id", "current_stage_id"], "left")
    df = df.withColumns({"entered_at": strip(F.coalesce("entered_at", "created_at")), "_created": strip("created_at")})
    df = df.withColumns({"_entered_us": dates.stripped_micros(F.col("entered_at")),
                         "_created_us": dates.stripped_micros(F.col("_created"))})
    text = F.when(F.col("_entered_us").isNotNull(), F.col("entered_at")).when(
        F.col("_created_us").isNotNull(), F.col("_created")).otherwise(F.lit(as_of))
    us = F.coalesce("_entered_us", "_created_us", F.lit(dates.epoch_micros(as_of)))
    return df.withColumns({"current_stage_entered_at": text, "current_stage_entered_us": us}).drop(
        "entered_at", "_created", "_entered_us", "_created_us")


def _label(name: str, raw: str) -> Column:
    return first_filled(F.coalesce(F.col(name), F.nullif(F.col(raw), F.lit(""))), F.lit("Unassigned"))


def _user(users: DataFrame, role: str, key: str) -> DataFrame:
    return users.select(F.col("user_id").alias(key), F.col("display_name").alias(f"{role}_name"),
                        F.col("email").alias(f"{role}_email"))


_PARENT_COLUMNS = [
    "request_number", "initiative", "business_decision", "business_value", "business_unit_id", "scope_id",
    "requester_name", "requester_email", "expected_date", "additional_comments", "priority_id",
]
_PARENT_CHANGE_COLUMNS = ["status_change_reason", "last_status_change_date", "last_status_changed_by"]

# fixed values: the order in which the fields and labels are listed in the search texts
_SEARCH_FIELDS = [
    "request_number", "request_id", "initiative", "business_decision", "business_value", "expected_date",
    "additional_comments", "requester_name", "requester_email", "data_product_id", "data_product_number", "title",
    "description", "data_product_owner", "delivery_date", "effort", "jira_epic_id", "jira_link", "alation_link",
    "r_status_change_reason", "r_last_status_change_date", "r_last_status_changed_by", "status_change_reason",
    "last_status_change_date", "last_status_changed_by", "note", "product_type_id", "target_platform_id",
    "priority_id", "lead_domain_id", "business_unit_id", "scope_id", "delivery_lead", "current_stage_id", "status_id",
    "lead_subdomain_id", "data_domain_owner_user_id", "source_system_id", "domain_delivery_lead_user_id",
    "lynx_pm_user_id", "build_status_id", "domain_name", "business_unit_name", "product_type_name",
    "expected_output_name", "platform_name", "priority_name", "stage_name", "status_name", "scope_name",
    "subdomain_name", "ddo_name", "ddo_email", "source_system_name", "dle_name", "dle_email", "ddl_name", "ddl_email",
    "lpm_name", "lpm_email", "build_status_name",
]


def joined_products(v, products: DataFrame | None = None) -> DataFrame:
    """Products with their parent (inner join: orphans drop out) and all labels.

    The dimension joins carry no hints: the literal dimensions are local relations of known size, the user
    dimension may grow and is broadcast only if Catalyst or adaptive execution finds it small.
    """
    parents = v.requests.select(
        "request_id", *_PARENT_COLUMNS, *[F.col(c).alias(f"r_{c}") for c in _PARENT_CHANGE_COLUMNS])
    df = (v.products if products is None else products).join(parents, "request_id")
    df = df.join(v.domains.withColumnRenamed("domain_id", "lead_domain_id"), "lead_domain_id", "left")
    df = df.join(v.business_units, "business_unit_id", "left").join(v.product_types, "product_type_id", "left")
    df = df.join(v.expected_outputs, "expected_output_id", "left")
    df = df.join(v.platforms.withColumnRenamed("platform_id", "target_platform_id"), "target_platform_id", "left")
    df = df.join(v.priorities, "priority_id", "left")
    df = df.join(v.stages.withColumnRenamed("stage_id", "current_stage_id"), "current_stage_id", "left")
    df = df.join(v.statuses, "status_id", "left").join(v.scopes.select("scope_id", "scope_name"), "scope_id", "left")
    subdomains = v.subdomains.select(F.col("subdomain_id").alias("lead_subdomain_id"), "subdomain_name",
                                     F.col("domain_id").alias("subdomain_domain_id"))
    df = df.join(subdomains, "lead_subdomain_id", "left").join(v.source_systems, "source_system_id", "left")
    df = df.join(v.build_statuses, "build_status_id", "left")
    for role, key in (("ddo", "data_domain_owner_user_id"), ("dle", "delivery_lead"),
                      ("ddl", "domain_delivery_lead_user_id"), ("lpm", "lynx_pm_user_id")):
        df = df.join(_user(v.users, role, key), key, "left")
    return df


def own_search_text() -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in _SEARCH_FIELDS])


def product_overview(v, as_of: str) -> DataFrame:
    """One row per product with a parent: ids, labels with fallbacks, stage entry and days, own search text.

    The joined texts of answers and events are unbounded per product and come from `product_search_text`.
    """
    # the stage entry first: it shuffles products, which are narrower before the labels are joined
    df = joined_products(v, stage_entered_at(v.products, v.timeline, as_of))
    entered = F.col("current_stage_entered_us")
    fields = {
        "id": normalize_number("data_product_number"),
        "requestId": F.col("data_product_id"),
        "initiativeRequestId": F.col("request_id"),
        "initiativeNumber": normalize_number("request_number"),
        "title": F.col("title"),
        "description": or_empty("description"),
        "domain": _label("domain_name", "lead_domain_id"),
        "domainId": or_empty("lead_domain_id"),
        "businessUnit": or_empty("business_unit_name"),
        "type": _label("product_type_name", "product_type_id"),
        "dataProductOwner": or_empty("data_product_owner"),
        "expectedOutput": or_empty("expected_output_name"),
        "expectedOutputId": or_empty("expected_output_id"),
        "businessValue": or_empty("business_value"),
        "platform": _label("platform_name", "target_platform_id"),
        "priority": _label("priority_name", "priority_id"),
        "scope": or_empty("scope_name"),
        "requester": or_empty("requester_name"),
        "requesterEmail": or_empty("requester_email"),
        "initiative": or_empty("initiative"),
        "expectedDate": or_empty("expected_date"),
        "deliveryDate": or_empty("delivery_date"),
        "deliveryLead": first_filled("dle_name", or_empty("delivery_lead")),
        "deliveryLeadId": or_empty("delivery_lead"),
        "effort": F.col("effort"),
        "jiraEpicId": or_empty("jira_epic_id"),
        "jiraLink": or_empty("jira_link"),
        "alationLink": or_empty("alation_link"),
        "additionalComments": or_empty("additional_comments"),
        "stage": _label("stage_name", "current_stage_id"),
        "stageId": or_empty("current_stage_id"),
        "stageNumber": F.coalesce("stage_number", F.lit(0)),
        "currentStageEnteredAt": dates.micros_to_date_text(entered),
        "daysInStage": dates.days_until(entered, as_of),
        "status": _label("status_name", "status_id"),
        "statusId": or_empty("status_id"),
        "statusChangeReason": or_empty("status_change_reason"),
        "lastStatusChangeDate": or_empty("last_status_change_date"),
        "lastStatusChangedBy": or_empty("last_status_changed_by"),
        "leadSubdomain": or_empty("subdomain_name"),
        "leadSubdomainDomainId": or_empty("subdomain_domain_id"),
        "dataDomainOwner": or_empty("ddo_name"),
        "sourceSystem": or_empty("source_system_name"),
        "domainDeliveryLead": or_empty("ddl_name"),
        "hubOwner": or_empty("ddl_name"),
        "lynxPm": or_empty("lpm_name"),
        "buildStatus": or_empty("build_status_name"),
        "owner": first_filled("ddo_name", "requester_name", F.lit("Unassigned")),
        "note": or_empty("note"),
        "searchText": own_search_text(),
    }
    return df.select(*[c.alias(n) for n, c in fields.items()])


def answer_text(v, answers: DataFrame | None = None) -> DataFrame:
    """(data_product_id, piece, answers_text): label, key and value of every answer. answers: rows that a join has dealt by product."""
    rules = v.requirements.select("requirement_id", "label", "requirement_key")
    # dealt before they are named, as labels make rows longer
    named = (v.answers.repartition("data_product_id") if answers is None else answers).join(rules, "requirement_id", "left")
    return text_pieces(named, ["data_product_id"], F.concat_ws(" ", "label", "requirement_key", "answer_value"),
                       ["requirement_id", "answer_id"], out="answers_text", dealt=True, counted=v.answers)


# fixed values: the fields of an event in its search text
_EVENT_FIELDS = ["event_type", "event_label", "event_detail", "created_by", "stage_id", "from_stage_id", "to_stage_id", "status_id"]


def event_text(v) -> DataFrame:
    """(data_product_id, piece, events_text): eight fields of every event."""
    return text_pieces(v.timeline.where("data_product_id IS NOT NULL"), ["data_product_id"],
                       F.concat_ws(" ", *_EVENT_FIELDS), ["created_at", "timeline_id", *_EVENT_FIELDS[:1]], out="events_text")


def product_search_text(v) -> DataFrame:
    """(data_product_id, part, piece, text): the whole search text of a product in pieces.

    Part 0 holds the own fields and labels, part 1 the answers, part 2 the events; joined in (part, piece) order
    they give the complete text, whatever the number of events of one product.
    """
    own = joined_products(v).select("data_product_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("piece"),
                                    own_search_text().alias("text"))
    with_parent = v.products.select("data_product_id", "request_id").join(
        v.requests.select("request_id"), "request_id", "left_semi").select("data_product_id")
    # a product has few answers, so they are filtered before they are joined and the texts are shuffled once;
    # events are filtered as finished pieces, since a product may have any number of them
    kept = v.answers.join(with_parent, "data_product_id", "left_semi")
    answers = answer_text(v, kept).select("data_product_id", F.lit(1).alias("part"), "piece", F.col("answers_text").alias("text"))
    events = event_text(v).select("data_product_id", F.lit(2).alias("part"), "piece", F.col("events_text").alias("text"))
    return own.unionByName(answers).unionByName(events.join(with_parent, "data_product_id", "left_semi"))


# fixed values: the fields of an initiative in its search texts, list view and single view
_INITIATIVE_SEARCH = [
    "request_id", "request_number", "initiative", "business_decision", "business_value", "requester_name",
    "requester_email", "expected_date", "additional_comments", "note", "business_unit_name", "priority_name",
    "scope_name", "status_name", "expected_output_name", "platform_name",
]
_SINGLE_SEARCH = [
    "request_id", "request_number", "initiative", "business_decision", "business_value", "requester_name",
    "requester_email", "note",
]


def _answer_texts(v, answers: DataFrame, keys: list[str], out: str = "text") -> DataFrame:
    rules = v.requirements.select("requirement_id", "label", "requirement_key")
    return answers.join(rules, "requirement_id", "left").select(*keys, F.lower(F.concat_ws(" ", "label", "requirement_key", "answer_value")).alias(out))


def _event_texts(timeline: DataFrame, keys: list[str], out: str = "text") -> DataFrame:
    return timeline.select(*keys, F.lower(F.concat_ws(" ", *_EVENT_FIELDS)).alias(out))


def _product_texts(v) -> DataFrame:
    """(data_product_id, _text): fields with labels, answers and events of the products, in lower case."""
    own = joined_products(v).select("data_product_id", F.lower(own_search_text()).alias("_text"))
    keys = ["data_product_id"]
    return own.unionByName(_answer_texts(v, v.answers, keys, "_text")).unionByName(_event_texts(v.timeline.dropna(subset=keys), keys, "_text"))


def _with_parent(v) -> DataFrame:
    return v.products.select("data_product_id", "request_id").join(v.requests.select("request_id"), "request_id", "left_semi")


def _product_hits(v, tokens: list[str]) -> DataFrame:
    """(data_product_id, request_id, _hit0, ...): which words the product's fields, labels, answers and events have, all together."""
    return _with_parent(v).join(token_hits(_product_texts(v), ["data_product_id"], F.col("_text"), tokens), "data_product_id")


INDEX_KEYS = ["data_product_id", "request_id"]


def index_texts(v, root: str) -> TextIndex:
    """Index all texts of initiatives (of no product) and of their products under `root`, for many searches.

    search(query, ["data_product_id"]) then equals search_products, search(query, ["request_id"]) search_initiatives.
    """
    # answers and events meet their parents before they become texts, which are longer
    parents = _with_parent(v)
    own_products = joined_products(v).select(*INDEX_KEYS, F.lower(own_search_text()).alias("text"))
    answers = _answer_texts(v, parents.join(v.answers, "data_product_id"), INDEX_KEYS)
    events = _event_texts(parents.join(v.timeline.drop("request_id"), "data_product_id"), INDEX_KEYS)
    products = own_products.unionByName(answers).unionByName(events)
    own = initiative_overview(v).select(F.lit(None).cast("string").alias("data_product_id"), F.col("requestId").alias("request_id"), F.lower("searchText").alias("text"))
    return build_index(products.unionByName(own), INDEX_KEYS, root)


def search_products(v, query: str) -> DataFrame:
    """(data_product_id) of the products whose whole text, answers and events included, has every word of the query, ignoring case."""
    tokens = search_tokens(query)
    found = _product_hits(v, tokens)
    for i in range(len(tokens)):
        found = found.where(f"_hit{i}")
    return found.select("data_product_id")


def search_initiatives(v, query: str) -> DataFrame:
    """(request_id) of the initiatives whose own text and all their products' whole texts together have every word, ignoring case."""
    tokens = search_tokens(query)
    flags = [f"_hit{i}" for i in range(len(tokens))]
    own = initiative_overview(v).select(F.col("requestId").alias("request_id"), F.lower("searchText").alias("_text"))
    own = own.select("request_id", *[F.col("_text").contains(w).alias(f) for f, w in zip(flags, tokens)])
    both = own.unionByName(_product_hits(v, tokens).select("request_id", *flags))
    found = both.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"), *[F.max(f).alias(f) for f in flags])
    for f in flags:
        found = found.where(f)
    return found.select("request_id")


def child_titles(products: DataFrame) -> DataFrame:
    """(request_id, piece, titles): child titles in id order, NULL titles as ''."""
    return text_pieces(products, ["request_id"], F.coalesce("title", F.lit("")), ["data_product_id"], out="titles")


def initiative_overview(v, single_view: bool = False) -> DataFrame:
    """One row per request with labels, child count and search text.

    The search text holds the initiative's own fields and labels. Titles, answers and events of its products, of which there may be
    any number, are no part of a row: `child_titles` and `product_search_text` list them, `search_initiatives` searches them.
    """
    counts = v.products.groupBy("request_id").agg(F.count(F.lit(1)).alias("product_count"))
    df = v.requests.join(counts, "request_id", "left").join(v.business_units, "business_unit_id", "left")
    df = df.join(v.priorities, "priority_id", "left").join(v.scopes.select("scope_id", "scope_name"), "scope_id", "left")
    df = df.join(v.statuses, "status_id", "left").join(v.expected_outputs, "expected_output_id", "left")
    df = df.join(v.platforms.withColumnRenamed("platform_id", "target_platform_id"), "target_platform_id", "left")
    search_text = F.concat_ws(" ", *(_SINGLE_SEARCH if single_view else _INITIATIVE_SEARCH))
    number = normalize_number("request_number")
    fields = {
        "id": number,
        "requestId": F.col("request_id"),
        "initiative": or_empty("initiative"),
        "title": first_filled("initiative", F.concat(F.lit("Initiative "), number)),
        "businessDecision": or_empty("business_decision"),
        "description": or_empty("business_decision"),
        "businessValue": or_empty("business_value"),
        "businessUnit": or_empty("business_unit_name"),
        "businessUnitId": or_empty("business_unit_id"),
        "scope": or_empty("scope_name"),
        "scopeId": or_empty("scope_id"),
        "priority": or_empty("priority_name"),
        "priorityId": or_empty("priority_id"),
        "expectedOutput": or_empty("expected_output_name"),
        "expectedOutputId": or_empty("expected_output_id"),
        "platform": or_empty("platform_name"),
        "platformId": or_empty("target_platform_id"),
        "requester": or_empty("requester_name"),
        "requesterEmail": or_empty("requester_email"),
        "expectedDate": or_empty("expected_date"),
        "additionalComments": or_empty("additional_comments"),
        "status": _label("status_name", "status_id"),
        "statusId": or_empty("status_id"),
        "statusChangeReason": or_empty("status_change_reason"),
        "lastStatusChangeDate": or_empty("last_status_change_date"),
        "lastStatusChangedBy": or_empty("last_status_changed_by"),
        "productCount": F.coalesce("product_count", F.lit(0)),
        "note": or_empty("note"),
        "createdAt": or_empty("created_at"),
        "updatedAt": or_empty("updated_at"),
        "searchText": search_text,
    }
    return df.select(*[c.alias(n) for n, c in fields.items()])


def initiative_products(v, as_of: str) -> DataFrame:
    """Each initiative's products as rows: the single view's nested list without a per-parent limit."""
    return product_overview(v, as_of).withColumnRenamed("requestId", "productId").withColumnRenamed(
        "initiativeRequestId", "requestId")
