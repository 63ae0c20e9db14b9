"""Requirement resolution, completeness, gating and the product timeline.

Rules are form metadata of bounded number (see model.load_rules), so the plans are built from them: one output
column or one generated row per rule, never a join of products with rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright import model
from gatewright.functions.text import or_empty, strip
from gatewright.operators.numbering import number_within

_COLUMN_KEYS = set(model.PRODUCT_VALUE_KEYS) | set(model.PARENT_VALUE_KEYS)


def form_of(v, rules=None, stages=None) -> tuple[list[model.Rule], list[tuple[str, str, int]]]:
    """The rules and the stages in order, as the deployment's own tables say unless they are given."""
    rules = rules or model.load_rules(v.requirements)
    stages = stages or [tuple(r) for r in v.stages.select("stage_id", "stage_name", "stage_number").collect()]
    return rules, sorted(stages, key=lambda s: s[2])


def shown_column(key: str) -> Column:
    """The column that shows a requirement key, as text, '' for NULL."""
    return or_empty(F.col(key).cast("string"))


def with_parent_values(products: DataFrame, requests: DataFrame) -> DataFrame:
    """Products with a parent, with the columns that requirement keys show."""
    parents = requests.select("request_id", *model.PARENT_VALUE_KEYS)
    own = products.select("data_product_id", "request_id", "current_stage_id", *model.PRODUCT_VALUE_KEYS)
    return own.join(parents, "request_id")


def stored_answers(answers: DataFrame, rules: list[model.Rule]) -> DataFrame:
    """One row per product with one column per rule; rows of one product are combined before the shuffle."""
    known = answers.where(F.col("requirement_id").isin([r.rule_id for r in rules]))
    return known.groupBy("data_product_id").agg(*[
        F.max(F.when(F.col("requirement_id") == r.rule_id, F.col("answer_value"))).alias(f"a_{r.rule_id}")
        for r in rules
    ])


def _answer_shown(rules) -> list[model.Rule]:
    return [r for r in rules if r.key not in _COLUMN_KEYS]


def rules_of_products(
    products: DataFrame, requests: DataFrame, answers: DataFrame, rules=None, with_stored: bool = False
) -> DataFrame:
    """One row per product with a parent and rule: the rule's fields and the shown value.

    with_stored adds the stored answer also of rules that show a column; otherwise those answers are not read.
    """
    rules = rules or model.RULES
    wanted = rules if with_stored else _answer_shown(rules)
    joined = with_parent_values(products, requests).join(stored_answers(answers, wanted), "data_product_id", "left")
    entries = F.array(*[
        F.struct(
            F.lit(r.rule_id).alias("requirement_id"), F.lit(r.stage_id).alias("stage_id"),
            F.lit(r.key).alias("requirement_key"), F.lit(r.label).alias("label"),
            F.lit(r.input_type).alias("input_type"), F.lit(r.master_type).cast("string").alias("master_data_type"),
            F.lit(r.sort_order).alias("sort_order"), F.lit(r.required).alias("is_required"),
            *([F.col(f"a_{r.rule_id}").alias("stored_answer")] if with_stored else []),
            (shown_column(r.key) if r.key in _COLUMN_KEYS else or_empty(f"a_{r.rule_id}")).alias("answer_value"),
        )
        for r in rules
    ])
    return joined.select("data_product_id", "request_id", "current_stage_id", F.inline(entries))


def complete_flag(r: model.Rule, value: Column) -> Column:
    v = strip(value)
    return v == "true" if r.input_type == "checkbox" else v != ""


def answered_flags(answers: DataFrame, rules: list[model.Rule]) -> DataFrame:
    """One row per product with one boolean per rule that is shown from a stored answer.

    Booleans are fixed-width aggregation state, so this stays a hash aggregation with map-side combine.
    """
    asked = [r for r in rules if r.key not in _COLUMN_KEYS and r.required]
    known = answers.where(F.col("requirement_id").isin([r.rule_id for r in asked]))
    v = strip("answer_value")
    slim = known.select("data_product_id", "requirement_id", (v != "").alias("_filled"), (v == "true").alias("_true"))
    return slim.groupBy("data_product_id").agg(*[
        F.max((F.col("requirement_id") == r.rule_id)
              & F.col("_true" if r.input_type == "checkbox" else "_filled")).alias(f"ok_{r.rule_id}")
        for r in asked
    ])


def stage_flags(products: DataFrame, requests: DataFrame, answers: DataFrame, rules=None, stages=None) -> DataFrame:
    """One row per product with a parent and one boolean `complete_<stage>` per stage.

    A stage is complete if every required rule of it has a value; a stage without required rules is complete.
    """
    rules, stages = rules or model.RULES, stages or model.STAGES
    df = with_parent_values(products, requests).join(answered_flags(answers, rules), "data_product_id", "left")
    flags = []
    for stage_id, _, _ in stages:
        done = F.lit(True)
        for r in rules:
            if r.stage_id != stage_id or not r.required:
                continue
            done = done & (complete_flag(r, shown_column(r.key)) if r.key in _COLUMN_KEYS
                           else F.coalesce(F.col(f"ok_{r.rule_id}"), F.lit(False)))
        flags.append(done.alias(f"complete_{stage_id}"))
    return df.select("data_product_id", "request_id", "current_stage_id", *flags)


def gating(flags: DataFrame, stages=None) -> DataFrame:
    """One row per product and stage: complete, can_submit (all earlier stages complete), is_current.

    The running AND over the ordered stages is an expression of the product's own row; no window is needed.
    """
    ordered = sorted(stages or model.STAGES, key=lambda s: s[2])
    entries, open_so_far = [], F.lit(True)
    for stage_id, name, number in ordered:
        complete = F.col(f"complete_{stage_id}")
        entries.append(F.struct(
            F.lit(stage_id).alias("stage_id"), F.lit(name).alias("stage_name"), F.lit(number).alias("stage_number"),
            complete.alias("complete"), open_so_far.alias("can_submit"),
            F.coalesce(F.col("current_stage_id") == stage_id, F.lit(False)).alias("is_current")))
        open_so_far = open_so_far & complete
    return flags.select("data_product_id", "request_id", F.inline(F.array(*entries)))


def stage_status_text() -> Column:
    return (
        F.when(~F.col("can_submit"), "Locked until previous stages are complete")
        .when(F.col("complete"), "Complete").when(F.col("is_current"), "Current stage").otherwise("Available")
    )


def workflow_document(products: DataFrame, requests: DataFrame, answers: DataFrame, rules=None, stages=None) -> DataFrame:
    """One row per product with its nested stages and their requirements in form order.

    Both nesting levels are bounded by the form definition. The timeline of a product is not, so it stays a
    relation: see product_timeline.
    """
    rules = rules or model.RULES
    ordered = sorted(stages or model.STAGES, key=lambda s: s[2])
    df = with_parent_values(products, requests).join(stored_answers(answers, _answer_shown(rules)), "data_product_id", "left")

    def value(r):
        return shown_column(r.key) if r.key in _COLUMN_KEYS else or_empty(f"a_{r.rule_id}")

    per_stage = {s: sorted((r for r in rules if r.stage_id == s), key=lambda r: r.sort_order) for s, _, _ in ordered}
    # flags first, as columns of their own, so that later stages do not repeat the tests of earlier ones
    flags = {}
    for stage_id, own in per_stage.items():
        done = F.lit(True)
        for r in own:
            done = done & complete_flag(r, value(r)) if r.required else done
        flags[f"complete_{stage_id}"] = done
    df = df.withColumns(flags)
    entries, open_so_far = [], F.lit(True)
    for stage_id, name, number in ordered:
        items = [
            F.struct(F.lit(r.rule_id).alias("requirement_id"), F.lit(r.key).alias("requirement_key"),
                     F.lit(r.label).alias("label"), F.lit(r.input_type).alias("input_type"),
                     F.lit(r.required).alias("is_required"), value(r).alias("answer_value"))
            for r in per_stage[stage_id]
        ]
        complete = F.col(f"complete_{stage_id}")
        entries.append(F.struct(
            F.lit(stage_id).alias("stage_id"), F.lit(name).alias("name"), F.lit(number).alias("number"),
            (F.array(*items) if items else F.lit(None)).alias("requirements"), complete.alias("complete"),
            open_so_far.alias("can_submit"),
            F.coalesce(F.col("current_stage_id") == stage_id, F.lit(False)).alias("is_current")))
        open_so_far = open_so_far & complete
    return df.select("data_product_id", "request_id", F.array(*entries).alias("stages"))


def enriched_timeline(timeline: DataFrame, stages: DataFrame, statuses: DataFrame) -> DataFrame:
    return timeline.join(stages.select("stage_id", "stage_name"), "stage_id", "left").join(statuses, "status_id", "left")


def product_timeline(timeline: DataFrame, stages: DataFrame, statuses: DataFrame) -> DataFrame:
    """Each product's events with labels and their place, newest first; a product may have any number of events."""
    events = enriched_timeline(timeline.where("data_product_id IS NOT NULL"), stages, statuses)
    order = [F.col("created_at").desc(), F.col("timeline_id"), F.col("event_type"), F.col("event_detail")]
    return number_within(events, ["data_product_id"], order, "place")


def next_stages(stages: DataFrame) -> DataFrame:
    """The stage dimension with the stage that follows by ordinal. One row per stage of the form."""
    w = Window.orderBy("stage_number")
    return stages.select("stage_id", "stage_number", F.lead("stage_id").over(w).alias("next_stage_id"))


def with_next_stage(products: DataFrame, stages: DataFrame) -> DataFrame:
    nexts = next_stages(stages).withColumnRenamed("stage_id", "current_stage_id")
    return products.join(nexts, "current_stage_id")


def progress_percent(df: DataFrame, stages: DataFrame, stage_column: str = "current_stage_id") -> DataFrame:
    """Share of the stage ordinal in the number of stages, at most 100, 0 for an unknown or missing stage."""
    total = stages.agg(F.count(F.lit(1)).alias("n")).scalar()
    numbered = df.join(stages.select(F.col("stage_id").alias(stage_column), "stage_number"), stage_column, "left")
    return numbered.withColumn("_total", total).withColumn(
        "progress", F.coalesce(F.least(F.lit(100.0), F.col("stage_number") * 100.0 / F.col("_total")), F.lit(0.0))
    ).drop("_total", "stage_number")


def gating_by_window(per_stage: DataFrame) -> DataFrame:
    """can_submit from completeness rows (data_product_id, stage_number, complete), for stages kept as data.

    The window holds the few stages of one product.
    """
    earlier = Window.partitionBy("data_product_id").orderBy("stage_number").rowsBetween(Window.unboundedPreceding, -1)
    return per_stage.withColumn("can_submit", F.coalesce(F.bool_and("complete").over(earlier), F.lit(True)))
