"""Applying batches of stage-answer submissions, set-based.

A submission is applied completely or not at all. Whether it may be applied depends on the state its predecessors
left (earlier stages complete), and six answers change the parent row that sibling products share. Instead of
replaying submissions one by one, the accepted set is found as a fixed point: assume every valid submission is
accepted, derive the state before each one with running last-values, re-decide all of them, repeat until nothing
changes; initiatives whose decisions stay leave the worklist. The first n decisions of every chain are final after n passes, so the result equals the sequential one,
and the number of passes follows the depth of dependent refusals, not the number of submissions.

Hot initiatives: submissions get a block number from their position, windows run within (initiative, block), and
the last values of earlier blocks are carried over. No task holds more than one block of one initiative.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright import model
from gatewright.functions import checks
from gatewright.functions.dates import calendar_date
from gatewright.functions.text import log_text, or_empty, slug, strip
from gatewright.operators.key_sieve import KeySieve
from gatewright.operators.labels import display_label_table, label_table, spread
from gatewright.operators.merge import latest_per_key, merge, union_all
from gatewright.operators.running import BLOCK_ROWS, in_blocks, running_values
from gatewright.plans import changes as ch
from gatewright.plans import workflow as wf
from gatewright.session import cut_lineage

ADVANCE_NOTE = "Advanced automatically after required information was completed."
LOCKED = "Previous stages must be completed before this stage can be submitted"
# fixed values: labels of write-back errors and the default domain
REQUIRED_ON_WRITE = {"product_type_id": "product type", "target_platform_id": "target platform", "priority_id": "priority"}
DEFAULT_DOMAIN = "commercial"

# both start with the initiative, so one shuffle by (initiative, block) serves both window specifications
_INITIATIVE, _PRODUCT = ["request_id"], ["request_id", "data_product_id"]
_OWN = set(model.PRODUCT_VALUE_KEYS)
_PARENT = set(model.PARENT_VALUE_KEYS)
PRODUCT_WRITE_KEYS = model.PRODUCT_VALUE_KEYS + model.ANSWER_SHOWN_COLUMNS


# --------------------------------------------------------------------------------------------- validation

def validate_answers(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Check raw answers against their rule. Expects requirement_key, input_type, master_data_type, label, answer_value.

    Adds clean_value, stored_value (column form, NULL for blank), shown_value (what the form shows afterwards) and
    answer_error.
    """
    key, given = F.col("requirement_key"), F.col("input_type")
    collection = ch.shown_master_type(key, F.col("master_data_type"))
    # how a value is treated, decided once per row and used by all rules below
    treated = (
        F.when(given.isin("checkbox", "number", "date"), given).when(key.isin("jira_link", "alation_link"), "link")
        .when(collection.isNotNull(), "reference").when(given == "textarea", "textarea").otherwise("text")
    )
    added = ["_as", "_text", "_label", "_ref", "_collection", "_known"]
    df = rows.withColumns({"_as": treated, "_text": strip("answer_value"), "_label": ch.shown_label(key, F.col("label"))})
    how, text, label = F.col("_as"), F.col("_text"), F.col("_label")
    df = df.withColumn("_ref", F.when((how == "reference") & (text != ""), slug(text)))
    default_ref = F.when((how == "reference") & (text == "") & (key == "lead_domain_id"), F.lit(DEFAULT_DOMAIN))
    known = labels.select(F.col("collection").alias("_collection"), F.col("id").alias("_id"), F.lit(True).alias("_known"))
    df = df.withColumns({
        "_collection": F.when(how == "reference", collection).otherwise(""),
        "_id": spread(F.coalesce(F.nullif("_ref", F.lit("")), default_ref), how == "reference", df, ["submission_id"]),
    }).join(known.distinct(), ["_collection", "_id"], "left").drop("_id")
    ref, unknown = F.col("_ref"), F.col("_known").isNull()

    whole = text.rlike(r"^\d+$")
    clean = (
        F.when(how == "checkbox", F.when(F.lower(text) == "true", "true").otherwise("false"))
        .when(how == "number", F.when(whole, text.try_cast("bigint").cast("string")).otherwise(""))
        .when(how == "reference", F.coalesce("_ref", F.lit("")))
        .otherwise(text)
    )
    limit = F.when(how == "textarea", model.TEXTAREA_LIMIT).when(how == "link", model.URL_LIMIT).otherwise(model.TEXT_LIMIT)
    problem = (
        F.when(text == "", F.lit(None).cast("string"))
        .when(how == "number", F.when(~whole, "must be a whole number").when(text.try_cast("int").isNull(), "is too large"))
        .when(how == "date", F.when(calendar_date(text).isNull(), "must use YYYY-MM-DD format"))
        .when(how == "reference", F.when(ref == "", "is required").when(unknown, "is not valid"))
        .when(how.isin("link", "textarea", "text") & (F.length(text) > limit),
              F.concat(F.lit("must be "), limit.cast("string"), F.lit(" characters or fewer")))
        .when(how == "link", F.when(~text.rlike(checks.HTTP_URL), "must be a valid http(s) URL"))
    )
    df = df.withColumns({"clean_value": clean, "_problem": problem})
    blank_write = F.when(key == "lead_domain_id", F.when((how == "reference") & unknown, F.lit("domain is not valid")))
    for k, name in REQUIRED_ON_WRITE.items():
        blank_write = blank_write.when(key == k, F.lit(f"{name} is required"))
    value = F.col("clean_value")
    df = df.withColumns({
        "answer_error": F.when(F.col("_problem").isNotNull(), F.concat_ws(" ", label, "_problem")).when(value == "", blank_write),
        "stored_value": F.when(value != "", value).when(key == "lead_domain_id", F.lit(DEFAULT_DOMAIN)),
    })
    shows_column = key.isin(list(_OWN | _PARENT))
    return df.withColumn("shown_value", F.when(shows_column, or_empty("stored_value")).otherwise(value)).drop(*added, "_problem")


def check_headers(submissions: DataFrame, products: DataFrame, requests: DataFrame, stages, statuses: DataFrame,
                  mail_domain: str) -> DataFrame:
    """Submissions with request_id, base stage and status of the product, actor, header_error and status_error."""
    actor = checks.email(F.col("updated_by"), mail_domain, "updated by", required=False)
    parents = products.select("data_product_id", "request_id", F.col("current_stage_id").alias("base_stage_id"),
                              F.col("status_id").alias("base_status_id")).join(requests.select("request_id"), "request_id")
    number = F.create_map(*[F.lit(x) for s in stages for x in (s[0], s[2])])
    name = F.create_map(*[F.lit(x) for s in stages for x in (s[0], s[1])])
    known = statuses.select(F.col("status_id").alias("new_status_id"), F.col("status_name").alias("new_status_name"))
    df = submissions.withColumn("new_status_id", F.when(~or_empty("status_id").isin(""), slug("status_id"))).drop("status_id")
    df = df.join(parents, "data_product_id", "left").join(known, "new_status_id", "left")
    header_error = F.coalesce(
        actor.error,
        F.when(or_empty("stage_id") == "", F.lit("stageId is required")),
        F.when(F.col("request_id").isNull(), F.lit("request not found")),
        F.when(number[F.col("stage_id")].isNull(), F.lit("stage not found")),
    )
    status_error = F.when(F.col("new_status_id") == "", F.lit("status is required")).when(
        F.col("new_status_id").isNotNull() & F.col("new_status_name").isNull(), F.lit("status is not valid"))
    return df.withColumns({
        "actor": F.when(actor.value == "", F.lit("system")).otherwise(actor.value),
        "stage_number": number[F.col("stage_id")], "stage_name": name[F.col("stage_id")],
        "header_error": header_error, "status_error": status_error,
    })


# --------------------------------------------------------------------------------------------- the subdomain rule

def _subdomain_before(df: DataFrame, blocks: int) -> DataFrame:
    """Add sub_shown_before / sub_cleared_now: the subdomain before each submission after all clearings so far.

    Every accepted submission clears a subdomain that is not in the product's lead domain at that time.
    Expects accepted, and for writes w_domain, w_sub (shown texts), w_sub_domain (the domain the subdomain is in).
    """
    ok = F.col("accepted")
    df = running_values(df, _PRODUCT, {
        "_domain_before": ("last", F.when(ok, F.col("w_domain"))),
        "_sub_before": ("last", F.when(ok & F.col("w_sub").isNotNull(), F.struct(
            F.col("w_sub").alias("value"), F.col("w_sub_domain").alias("domain"), F.col("pos").alias("at")))),
    }, blocks)
    base = F.struct(or_empty("b_sub").alias("value"), F.col("b_sub_domain").alias("domain"), F.lit(0).cast("bigint").alias("at"))
    written = F.struct(F.col("w_sub").alias("value"), F.col("w_sub_domain").alias("domain"), F.col("pos").alias("at"))
    df = df.withColumn("_sub_before", F.coalesce("_sub_before", base))
    df = df.withColumn("_sub_now", F.when(ok & F.col("w_sub").isNotNull(), written).otherwise(F.col("_sub_before")))
    domain_now = F.coalesce(F.when(ok, F.col("w_domain")), F.col("_domain_before"), or_empty("b_domain"))
    bad = ok & (F.col("_sub_now.value") != "") & ~domain_now.eqNullSafe(F.col("_sub_now.domain"))
    df = df.withColumn("_clear_at", F.when(bad, F.col("pos")))
    df = running_values(df, _PRODUCT, {"_cleared_before": ("max", F.col("_clear_at"))}, blocks)
    cleared_before = F.coalesce(F.col("_cleared_before") >= F.col("_sub_before.at"), F.lit(False)) & F.col("_cleared_before").isNotNull()
    last_clear = F.greatest("_cleared_before", "_clear_at")
    cleared_now = F.coalesce(last_clear >= F.col("_sub_now.at"), F.lit(False))
    return df.withColumns({
        "sub_before": F.when(cleared_before, F.lit("")).otherwise(F.col("_sub_before.value")),
        "sub_after": F.when(cleared_now, F.lit("")).otherwise(F.col("_sub_now.value")),
        "sub_cleared_at": last_clear, "sub_written_at": F.col("_sub_now.at"),
    })


# --------------------------------------------------------------------------------------------- the plan

class Form:
    """Rules and stages as SQL texts over bit sets: one bit for each required rule, 62 to a bigint.

    Columns m<k>, s<k>: which rules a submission writes and which of them it fills; b<k>: which are filled in the stored state. The
    subdomain is looked at separately, as it can be cleared. Every pass uses the same columns, so they are made once.
    """

    def __init__(self, rules, stages):
        self.rules, self.stages = rules, sorted(stages, key=lambda s: s[2])
        self.needed = [r for r in rules if r.required and r.key != "lead_subdomain_id"]
        self.place = {r.rule_id: divmod(i, 62) for i, r in enumerate(self.needed)}
        self.words = range(max(1, -(-len(self.needed) // 62)))
        self.parent = {f"p_{r.rule_id}": ("last", self._written(r)) for r in self.needed if r.key in _PARENT}
        self.own = {f"p_{r.rule_id}": ("last", self._written(r)) for r in self.needed if r.key not in _PARENT}
        here = {k: [(r, i) for r in self.needed for w, i in [self.place[r.rule_id]] if w == k] for k in self.words}
        self.before = {
            f"before{k}": F.expr(" | ".join(
                f"shiftleft(cast(coalesce(`p_{r.rule_id}`, (shiftright(b{k}, {i}) & 1) = 1) as bigint), {i})" for r, i in here[k]) or "0L")
            for k in self.words}
        self.after = {f"after{k}": F.expr(f"(before{k} & ~m{k}) | s{k}") for k in self.words}
        self.unlocked = F.expr(" AND ".join(
            f"(stage_number <= {number} OR {self._filled('before', s, 'sub_before')})" for s, _, number in self.stages))
        self.completes = F.expr("CASE stage_id " + " ".join(
            f"WHEN {model.sql_literal(s)} THEN {self._filled('after', s, 'sub_after')}" for s, _, _ in self.stages) + " ELSE false END")

    def _written(self, r) -> Column:
        k, i = self.place[r.rule_id]
        return F.expr(f"CASE WHEN accepted AND (shiftright(m{k}, {i}) & 1) = 1 THEN (shiftright(s{k}, {i}) & 1) = 1 END")

    def _filled(self, prefix: str, stage: str, sub: str) -> str:
        masks = [0 for _ in self.words]
        tests = [f"{sub} <> ''" for r in self.rules if r.stage_id == stage and r.required and r.key == "lead_subdomain_id"]
        for r in self.needed:
            if r.stage_id == stage:
                k, i = self.place[r.rule_id]
                masks[k] |= 1 << i
        tests += [f"({prefix}{k} & {mask}L) = {mask}L" for k, mask in enumerate(masks) if mask]
        return "(" + (" AND ".join(tests) or "true") + ")"

    def bits(self) -> list[tuple[str, int, int]]:
        """(requirement_id, _word, _bit) of the rules that have one."""
        return [(rule_id, k, 1 << i) for rule_id, (k, i) in self.place.items()]


def _decide(df: DataFrame, form: Form, blocks: int) -> DataFrame:
    """Add _accepted (by the state that the rows accepted so far leave), unlocked, completes and the subdomain before and after."""
    if form.parent:
        df = running_values(df, _INITIATIVE, form.parent, blocks)
    if form.own:
        df = running_values(df, _PRODUCT, form.own, blocks)
    df = _subdomain_before(df, blocks).withColumns(form.before).withColumns(form.after).withColumn("unlocked", form.unlocked)
    return df.withColumn("_accepted", F.col("valid") & F.col("unlocked")).withColumn("completes", F.col("_accepted") & form.completes)


_DECIDED = ["unlocked", "completes", "sub_before", "sub_after", "sub_cleared_at", "sub_written_at"]


def _settle(subs: DataFrame, form: Form, blocks: int) -> DataFrame:
    """The decisions at the fixed point. Initiatives do not depend on each other: those without a changed decision leave the worklist."""
    columns, settled = subs.columns, []
    while True:
        decided = cut_lineage(_decide(subs, form, blocks).select(*columns, "_accepted", *_DECIDED))
        changed = cut_lineage(decided.where("_accepted <> accepted").select("request_id").distinct())
        if changed.isEmpty():
            settled.append(decided)
            return cut_lineage(union_all([d.select(*columns, *_DECIDED) for d in settled]))
        settled.append(decided.join(changed, "request_id", "left_anti"))
        again = decided.join(changed, "request_id", "left_semi")
        subs = again.select(*[F.col("_accepted").alias("accepted") if c == "accepted" else F.col(c) for c in columns])


def apply_answers(
    v, submissions: DataFrame, submitted: DataFrame, *, mail_domain: str, rules=None, stages=None,
    block_rows: int = BLOCK_ROWS,
) -> Applied:
    """Apply submissions in (submitted_at, submission_id) order per initiative.

    v: frames products, requests, answers and the dimensions.
    submissions: submission_id, data_product_id, stage_id, status_id, updated_by, submitted_at.
    submitted: submission_id, position, requirement_id, answer_value; unknown requirements are ignored.
    """
    rules, stages = wf.form_of(v, rules, stages)
    form = Form(rules, stages)
    heads = check_headers(submissions, v.products, v.requests, stages, v.statuses, mail_domain)
    heads, blocks = in_blocks(heads, ["request_id"], [F.col("submitted_at"), F.col("submission_id")], block_rows)
    known = heads.where("header_error IS NULL")

    # every answer of a known rule of the submitted stage, checked; dealt by submission once, for the last answer to a rule and for the join
    writes = latest_per_key(submitted.select("submission_id", "requirement_id", "position", "answer_value").repartition("submission_id"),
                            ["submission_id", "requirement_id"], ["position"])
    writes = writes.join(rule_table(v.spark, form), "requirement_id").join(
        known.select("submission_id", F.col("stage_id").alias("_stage")), "submission_id")
    writes = writes.where("stage_id >= _stage AND stage_id <= _stage").drop("_stage", "stage_id")  # = would be a join key and deal them again
    writes = cut_lineage(checked_writes(v, writes))

    # one narrow row per submission: what it writes, as bits
    fills = F.when(F.col("input_type") == "checkbox", strip("shown_value") == "true").otherwise(strip("shown_value") != "")
    per_submission = writes.groupBy("submission_id").agg(
        F.min_by("answer_error", F.when(F.col("answer_error").isNotNull(), F.col("position"))).alias("answer_error"),
        F.max(F.when(F.col("requirement_key") == "lead_domain_id", F.col("shown_value"))).alias("w_domain"),
        F.max(F.when(F.col("requirement_key") == "lead_subdomain_id", F.col("shown_value"))).alias("w_sub"),
        F.max(F.when(F.col("requirement_key") == "lead_subdomain_id", F.col("_sub_domain"))).alias("w_sub_domain"),
        *[F.coalesce(F.bit_or(F.when(F.col("_word") == k, F.col("_bit"))), F.lit(0)).cast("bigint").alias(f"m{k}") for k in form.words],
        *[F.coalesce(F.bit_or(F.when((F.col("_word") == k) & fills, F.col("_bit"))), F.lit(0)).cast("bigint").alias(f"s{k}") for k in form.words])

    # the stored state of the products that are submitted for, likewise
    touched = cut_lineage(known.select("data_product_id").distinct())
    sieve = KeySieve(touched, ["data_product_id"])
    own = sieve.through(v.products).join(touched, "data_product_id", "left_semi")
    answers = sieve.through(v.answers).join(touched, "data_product_id", "left_semi")
    stored = wf.with_parent_values(own, v.requests).join(wf.answered_flags(answers, rules), "data_product_id", "left")
    base_sub = v.subdomains.select(F.col("subdomain_id").alias("lead_subdomain_id"), F.col("domain_id").alias("b_sub_domain"))
    filled = {k: F.lit(0).cast("bigint") for k in form.words}
    for r in form.needed:
        k, i = form.place[r.rule_id]
        there = wf.complete_flag(r, wf.shown_column(r.key)) if r.key in (_OWN | _PARENT) else F.coalesce(F.col(f"ok_{r.rule_id}"), F.lit(False))
        filled[k] = filled[k].bitwiseOR(F.when(there, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    base = stored.join(base_sub, "lead_subdomain_id", "left").select(
        "data_product_id", F.col("lead_domain_id").alias("b_domain"), F.col("lead_subdomain_id").alias("b_sub"), "b_sub_domain",
        *[c.alias(f"b{k}") for k, c in filled.items()])

    subs = known.select("submission_id", "request_id", "data_product_id", "pos", "block", "stage_id", "stage_number", "status_error")
    subs = subs.join(per_submission, "submission_id", "left").join(base, "data_product_id")
    subs = subs.fillna(0, [f"{c}{k}" for c in "ms" for k in form.words])
    subs = subs.withColumn("valid", F.col("answer_error").isNull() & F.col("status_error").isNull())
    decided = _settle(cut_lineage(subs.withColumn("accepted", F.col("valid"))), form, blocks)
    moves = _advances(decided, v.products, stages)
    return Applied(v, rules, stages, heads, writes, decided, moves, blocks, sieve)


def rule_table(spark, form: Form) -> DataFrame:
    """The rules with their bits, as a literal table."""
    bits = {rule_id: (k, bit) for rule_id, k, bit in form.bits()}
    rows = [(r.rule_id, r.stage_id, r.key, r.label, r.input_type, r.master_type, *bits.get(r.rule_id, (-1, 0))) for r in form.rules]
    return model.literal_table(spark, rows, ["requirement_id", "stage_id", "requirement_key", "label", "input_type", "master_data_type", "_word", "_bit"])


def checked_writes(v, writes: DataFrame) -> DataFrame:
    """Answers with their rule's fields, checked, and the domain that a submitted subdomain is in."""
    homes = v.subdomains.select(F.col("subdomain_id").alias("stored_value"), F.col("domain_id").alias("_sub_domain"))
    return validate_answers(writes, label_table(v)).join(homes, "stored_value", "left")


def _advances(decided: DataFrame, products: DataFrame, stages) -> DataFrame:
    """(submission_id, data_product_id, pos, from_stage_id, to_stage_id): the saves that moved their product.

    A product leaves a stage at the first complete save of that stage after it entered it: one aggregation per step
    of the stage ladder, over all products at once.
    """
    spark = products.sparkSession
    ladder = model.literal_table(
        spark, [(a[0], b[0]) for a, b in zip(stages, stages[1:])], ["from_stage_id", "to_stage_id"])
    saves = decided.where("completes").select("submission_id", "data_product_id", "pos", "stage_id")
    at = saves.select("data_product_id").distinct().join(
        products.select("data_product_id", F.col("current_stage_id").alias("stage_id")), "data_product_id").withColumn(
        "since", F.lit(0).cast("bigint"))
    steps = []
    for _ in stages[1:]:
        due = saves.join(at, ["data_product_id", "stage_id"]).where("pos > since")
        first = due.groupBy("data_product_id", F.col("stage_id").alias("from_stage_id")).agg(
            F.min("pos").alias("pos"), F.min_by("submission_id", "pos").alias("submission_id"))
        step = cut_lineage(first.join(ladder, "from_stage_id").select(
            "submission_id", "data_product_id", "pos", "from_stage_id", "to_stage_id"))
        if step.isEmpty():
            break
        steps.append(step)
        at = step.select("data_product_id", F.col("to_stage_id").alias("stage_id"), F.col("pos").alias("since"))
    if not steps:
        return step
    return union_all(steps)


def _last_written(rows: DataFrame, key: str, value_keys: list[str]) -> DataFrame:
    """Per key the last accepted stored value of each value key as a struct, NULL where never written; keys without any are left out."""
    return rows.where(F.col("requirement_key").isin(list(value_keys))).groupBy(key).agg(*[
        F.max_by(F.struct(F.col("stored_value").alias("v")), F.when(F.col("requirement_key") == k, F.col("pos"))).alias(f"n_{k}")
        for k in value_keys])


def _overlay(df: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    types = dict(df.dtypes)
    joined = df.join(new, key, "left")
    return joined.withColumns({
        k: F.when(F.col(f"n_{k}").isNotNull(), F.col(f"n_{k}")["v"].try_cast(types[k])).otherwise(F.col(k)) for k in columns
    }).select(*df.columns, *[c for c in new.columns if c != key and not c.startswith("n_")])


class Applied:
    """New states and what happened; each part is planned when it is asked for. results: one row per submission with accepted, advanced and error."""

    def __init__(self, v, rules, stages, heads, writes, decided, moves, blocks, sieve):
        self.v, self.rules, self.stages = v, rules, stages
        self.heads, self.writes, self.decided, self.moves, self.blocks = heads, writes, decided, moves, blocks
        self.sieve = sieve  # tells stored rows of products that no submission names

    @property
    def steps(self) -> DataFrame:
        return self.moves.select("submission_id", "from_stage_id", "to_stage_id")

    @cached_property
    def accepted(self) -> DataFrame:
        """One row per accepted submission with what it did to its product: stage, status and subdomain before and after."""
        last_stage = self.stages[-1][0]
        accepted = self.decided.where("accepted").select(
            "submission_id", "request_id", "data_product_id", "pos", "block", "stage_id", "completes", "sub_before", "sub_after",
            "sub_cleared_at", "sub_written_at")
        head_columns = self.heads.select("submission_id", "new_status_id", "new_status_name", "base_status_id", "base_stage_id",
                                         "actor", "stage_name", "submitted_at")
        entered_last = self.moves.where(F.col("to_stage_id") == last_stage).select("data_product_id", F.col("pos").alias("_last_since"))
        acc = accepted.join(head_columns, "submission_id").join(self.steps, "submission_id", "left").join(entered_last, "data_product_id", "left")
        in_last = (F.col("base_stage_id") == last_stage) | (F.col("pos") > F.col("_last_since"))
        finished = F.coalesce(F.col("completes") & (F.col("stage_id") == last_stage) & in_last, F.lit(False))
        moved_status = F.when(F.col("to_stage_id").isNotNull(), F.when(F.col("to_stage_id") == "operate", "operating").otherwise("in_review"))
        acc = acc.withColumn("finished", finished).withColumn(
            "end_status", F.coalesce(moved_status, F.when(F.col("finished"), "operating"), F.col("new_status_id")))
        acc = running_values(acc, _PRODUCT, {"_status": ("last", F.col("end_status"))}, self.blocks)
        return cut_lineage(acc.withColumn("status_before", F.coalesce("_status", "base_status_id")))

    @cached_property
    def done(self) -> DataFrame:
        """The answers of the accepted submissions."""
        heads = self.decided.where("accepted").select("submission_id", "data_product_id", "request_id", "pos", "block", "sub_before")
        return self.writes.join(heads, "submission_id")

    @property
    def dated(self) -> DataFrame:
        """The same with the time of their submission."""
        return self.done.join(self.heads.select("submission_id", "submitted_at"), "submission_id")

    @cached_property
    def changed(self) -> DataFrame:
        """The answers that differ from what was shown before: old and new."""
        key_of = lambda parent: F.col("requirement_key").isin(list(_PARENT)) == parent
        before = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)

        def with_previous(rows, unit):
            if self.blocks == 1:
                return rows.withColumn("_prev", F.last("shown_value").over(before.partitionBy(unit, "requirement_id")))
            group = [unit, "requirement_id"]
            w = before.partitionBy(*group, "block")
            ends = rows.groupBy(*group, "block").agg(F.max_by("shown_value", "pos").alias("_end"))
            wb = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
            ends = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(wb)).drop("_end")
            return rows.withColumn("_prev", F.last("shown_value").over(w)).join(ends, [*group, "block"]).withColumn(
                "_prev", F.coalesce("_prev", "_carry")).drop("_carry")

        v, touched = self.v, self.decided.where("accepted").select("data_product_id").distinct()
        base_values = wf.rules_of_products(
            self.sieve.through(v.products).join(touched, "data_product_id", "left_semi"), v.requests,
            self.sieve.through(v.answers).join(touched, "data_product_id", "left_semi"), self.rules,
        ).select("data_product_id", "requirement_id", F.col("answer_value").alias("_base"))
        compared = with_previous(self.done.where(key_of(True)), "request_id").unionByName(
            with_previous(self.done.where(key_of(False)), "data_product_id")).join(base_values, ["data_product_id", "requirement_id"], "left")
        old = F.when(F.col("requirement_key") == "lead_subdomain_id", F.col("sub_before")).otherwise(
            F.coalesce("_prev", "_base", F.lit("")))
        return compared.withColumns({"old": strip(old), "new": strip("clean_value")}).where(F.col("old") != F.col("new"))

    @cached_property
    def events(self) -> DataFrame:
        lines = ch.change_lines(self.changed.select("submission_id", "position", "requirement_id", "requirement_key", "label",
                                                    "input_type", "master_data_type", "old", "new"), display_label_table(self.v))
        described = ch.describe_changes(self.accepted.select("submission_id"), lines, ["submission_id"], ["position", "requirement_id"])
        names = self.v.statuses.select(F.col("status_id").alias("status_before"), F.col("status_name").alias("_old_name"))
        ev = self.accepted.join(described, "submission_id").join(names, "status_before", "left")
        old_status = F.when(strip("status_before") == "", F.lit("empty")).otherwise(F.coalesce("_old_name", log_text("status_before")))
        common = {"entity_type": F.lit("product"), "request_id": F.col("request_id"), "data_product_id": F.col("data_product_id")}

        def event(n, condition, **columns):
            entry = ch.timeline_event(common | columns, F.col("submitted_at"), F.concat("submission_id", F.lit(f".{n}")))
            return F.when(condition, entry)

        stage, status = {"stage_id": F.col("stage_id")}, {"status_id": F.col("new_status_id"), "created_by": F.col("actor")}
        entries = [
            event(1, F.col("new_status_id").isNotNull() & ~F.col("new_status_id").eqNullSafe(F.col("status_before")), event_type=F.lit("status_changed"),
                  event_label=F.lit("Status updated"), event_detail=F.concat(F.lit("Status changed from "), old_status, F.lit(" to "), F.col("new_status_name"), F.lit(".")),
                  **stage, **status),
            event(2, F.lit(True), event_type=F.lit("answers_saved"), event_label=F.concat("stage_name", F.lit(" saved")), event_detail=F.col("event_detail"),
                  **stage, **status),
            event(3, F.col("to_stage_id").isNotNull(), event_type=F.lit("stage_advanced"), event_label=F.lit("Stage advanced"),
                  event_detail=F.concat(F.lit("Advanced from "), F.col("from_stage_id"), F.lit(" to "), F.col("to_stage_id"), F.lit(".")),
                  stage_id=F.col("to_stage_id"), from_stage_id=F.col("from_stage_id"), to_stage_id=F.col("to_stage_id"), status_id=F.col("end_status"),
                  created_by=F.lit("system")),
            event(4, F.col("finished"), event_type=F.lit("completed"), event_label=F.lit("Workflow completed"), event_detail=F.lit("All stages are complete."),
                  status_id=F.lit("operating"), created_by=F.lit("admin"), **stage),
        ]
        return ev.select(F.inline(F.array_compact(F.array(*entries))))

    @cached_property
    def products(self) -> DataFrame:
        v = self.v
        ends = self.accepted.groupBy("data_product_id").agg(
            F.max_by("end_status", F.when(F.col("end_status").isNotNull(), F.col("pos"))).alias("_status"),
            F.max_by("to_stage_id", F.when(F.col("to_stage_id").isNotNull(), F.col("pos"))).alias("_stage"),
            F.max_by("submitted_at", "pos").alias("_at"), F.max_by("sub_after", "pos").alias("_sub"))
        stored = v.products
        products = _overlay(self.sieve.through(stored), _last_written(self.done, "data_product_id", PRODUCT_WRITE_KEYS), "data_product_id", PRODUCT_WRITE_KEYS)
        return products.join(ends, "data_product_id", "left").withColumns({
            "lead_subdomain_id": F.when(F.col("_at").isNotNull(), F.nullif("_sub", F.lit(""))).otherwise(F.col("lead_subdomain_id")),
            "status_id": F.coalesce("_status", "status_id"),
            "current_stage_id": F.coalesce("_stage", "current_stage_id"),
            "note": F.when(F.col("_stage").isNotNull(), F.lit(ADVANCE_NOTE)).otherwise(F.col("note")),
            "updated_at": F.coalesce("_at", "updated_at"),
        }).select(*stored.columns).unionByName(self.sieve.rest(stored))

    @cached_property
    def requests(self) -> DataFrame:
        written = _last_written(self.done, "request_id", model.PARENT_VALUE_KEYS)
        return _overlay(self.v.requests, written, "request_id", model.PARENT_VALUE_KEYS)

    @cached_property
    def answers(self) -> DataFrame:
        keys, stored = ["data_product_id", "requirement_id"], self.v.answers
        latest = latest_per_key(self.dated.select(*keys, "clean_value", "submitted_at", "pos"), keys, ["pos"])
        upserts = latest.select(
            F.md5(F.concat_ws("|", *keys)).alias("answer_id"), *keys, F.col("clean_value").alias("answer_value"), F.col("submitted_at").alias("updated_at"))
        answers = merge(self.sieve.through(stored), upserts, keys, update=["answer_value", "updated_at"])
        dropped = self.accepted.groupBy("data_product_id").agg(
            F.max("sub_cleared_at").alias("_cleared"), F.max("sub_written_at").alias("_written")).where("_cleared >= _written").select(
            "data_product_id", F.lit(model.SUBDOMAIN_RULE_ID).alias("requirement_id"))
        return answers.join(dropped, keys, "left_anti").select(*stored.columns).unionByName(self.sieve.rest(stored))

    @cached_property
    def results(self) -> DataFrame:
        flags = self.decided.select("submission_id", "accepted", "unlocked", "answer_error")
        return self.heads.select("submission_id", "data_product_id", "stage_id", "header_error", "status_error").join(
            flags, "submission_id", "left").join(self.steps, "submission_id", "left").select(
            "submission_id", "data_product_id", "stage_id", F.coalesce("accepted", F.lit(False)).alias("accepted"),
            F.col("to_stage_id").isNotNull().alias("advanced"),
            F.coalesce("header_error", F.when(~F.col("unlocked"), F.lit(LOCKED)), "answer_error", "status_error").alias("error"))


# --------------------------------------------------------------------------------------------- single steps

def write_back(products: DataFrame, requests: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copy checked answers to the columns they stand for; the last write per column wins.

    writes: data_product_id, requirement_key, stored_value, pos. Six keys go to the parent row of the product.
    """
    routed = writes.where(F.col("requirement_key").isin(model.PARENT_VALUE_KEYS)).join(
        products.select("data_product_id", "request_id"), "data_product_id")
    return (
        _overlay(products, _last_written(writes, "data_product_id", PRODUCT_WRITE_KEYS), "data_product_id", PRODUCT_WRITE_KEYS),
        _overlay(requests, _last_written(routed, "request_id", model.PARENT_VALUE_KEYS), "request_id", model.PARENT_VALUE_KEYS),
    )


def reconcile_domain_subdomain(products: DataFrame, answers: DataFrame, subdomains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clear subdomains that are not in the product's lead domain, and delete their answers."""
    homes = subdomains.select(F.col("subdomain_id").alias("lead_subdomain_id"), F.col("domain_id").alias("_home"))
    joined = products.join(homes, "lead_subdomain_id", "left")
    stray = (or_empty("lead_subdomain_id") != "") & ~F.col("_home").eqNullSafe(F.col("lead_domain_id"))
    cleared = joined.where(stray).select("data_product_id", F.lit(model.SUBDOMAIN_RULE_ID).alias("requirement_id"))
    fixed = joined.withColumn("lead_subdomain_id", F.when(~stray, F.col("lead_subdomain_id"))).select(*products.columns)
    return fixed, answers.join(cleared, ["data_product_id", "requirement_id"], "left_anti").select(*answers.columns)


def advance_if_complete(v, saved: DataFrame, rules=None, stages=None) -> tuple[DataFrame, DataFrame]:
    """(products, events) after one save per product; saved: data_product_id, stage_id, saved_at.

    A product moves one stage if the saved stage is its current one and complete. In the last stage it is marked
    operating and the completion is logged each time.
    """
    rules, stages = wf.form_of(v, rules, stages)
    nexts = dict(zip([s[0] for s in stages], [s[0] for s in stages[1:]] + [None]))
    next_of = F.create_map(*[F.lit(x) for a, b in nexts.items() if b for x in (a, b)])
    flags = wf.stage_flags(v.products, v.requests, v.answers, rules, stages)
    due = saved.join(flags, "data_product_id").where(F.col("stage_id") == F.col("current_stage_id"))
    complete = F.expr("CASE stage_id " + " ".join(f"WHEN {model.sql_literal(s)} THEN `complete_{s}`" for s, _, _ in stages) + " ELSE false END")
    due = due.where(complete).select(
        "data_product_id", "request_id", "stage_id", "saved_at", next_of[F.col("stage_id")].alias("to_stage_id"))
    to = F.col("to_stage_id")
    due = due.withColumn("new_status", F.when(to.isNull() | (to == "operate"), "operating").otherwise("in_review"))
    new = due.select("data_product_id", F.struct("to_stage_id", "new_status").alias("_n"))
    moved = F.col("_n.to_stage_id").isNotNull()
    products = v.products.join(new, "data_product_id", "left").withColumns({
        "current_stage_id": F.coalesce("_n.to_stage_id", "current_stage_id"),
        "status_id": F.coalesce("_n.new_status", "status_id"),
        "note": F.when(moved, F.lit(ADVANCE_NOTE)).otherwise(F.col("note")),
    }).select(*v.products.columns)
    common = {"entity_type": F.lit("product"), "request_id": F.col("request_id"), "data_product_id": F.col("data_product_id"),
              "status_id": F.col("new_status")}
    steps = ch.timeline_events(due.where("to_stage_id IS NOT NULL"), {
        **common, "event_type": F.lit("stage_advanced"), "event_label": F.lit("Stage advanced"),
        "event_detail": F.concat(F.lit("Advanced from "), F.col("stage_id"), F.lit(" to "), to, F.lit(".")), "stage_id": to,
        "from_stage_id": F.col("stage_id"), "to_stage_id": to, "created_by": F.lit("system")}, F.col("saved_at"), F.lit("advance"))
    ends = ch.timeline_events(due.where("to_stage_id IS NULL"), {
        **common, "event_type": F.lit("completed"), "event_label": F.lit("Workflow completed"),
        "event_detail": F.lit("All stages are complete."), "stage_id": F.col("stage_id"), "created_by": F.lit("admin"),
    }, F.col("saved_at"), F.lit("complete"))
    return products, steps.unionByName(ends)
