"""The stage machine as a stateful stream, keyed by initiative.

Everything that looks at one submission by itself (headers, values, labels) is checked by stream-static joins. What depends on earlier
submissions is decided per initiative over state in the state store: what the form shows for each product, its stage and its status,
and the values that sibling products share. A batch reads and writes the states of the products it names and no others. What is stored of a
product comes with the submissions that name it, by a stream-static join, and counts until the machine has a state of its own, so the state
grows with what is submitted for and not with the stored tables. What comes out is one decision per submission; states, events and
results follow from the decisions as they do from a batch.

Submissions of one initiative are applied one after the other, as each depends on those before it; within a micro-batch they are
sorted by time, so a micro-batch (maxFilesPerTrigger) has to fit in the memory of a task.
"""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gatewright import model
from gatewright.functions.text import or_empty, strip
from gatewright.operators.key_sieve import KeySieve
from gatewright.plans import workflow as wf
from gatewright.plans.answers import LOCKED, Applied, Form, check_headers, checked_writes, rule_table
from gatewright.session import cut_lineage
from gatewright.streaming.live import delta_sink, read_deltas, run_available

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ANSWERS = ("array<struct<position int, requirement_id string, stored_value string, clean_value string, old string, new string>>")
DECISION = (
    "request_id string, submission_id string, data_product_id string, stage_id string, stage_name string, submitted_at string, actor string, "
    "new_status_id string, new_status_name string, pos long, accepted boolean, error string, to_stage_id string, finished boolean, "
    f"status_before string, end_status string, sub_after string, sub_cleared_at long, sub_written_at long, answers {_ANSWERS}")
_STATE = "stage string, status string, sub_home string, cleared_at long, written_at long, shown array<string>"
_SHARED = ""  # the owner of the values that sibling products share
_UNOWNED = 1024  # keys for submissions that no product owns; they have no state and any of them can be decided alone


def _is_parent(r: model.Rule) -> bool:
    return r.key in model.PARENT_VALUE_KEYS


def prepared(v, rows: DataFrame, mail_domain: str, form: Form) -> DataFrame:
    """Checked submissions, one row per answer, keyed by `initiative`; what no product owns is dealt over keys without state.

    rows: submission_id, data_product_id, stage_id, status_id, updated_by, submitted_at, position, requirement_id, answer_value. A
    submission without answers is one row of null requirement. Works on streams: joins with static tables only.
    """
    heads = check_headers(rows, v.products, v.requests, form.stages, v.statuses, mail_domain)
    rules = rule_table(v.spark, form).withColumnRenamed("stage_id", "_rule_stage")
    typed = heads.join(rules, "requirement_id", "left").withColumn("_asked", F.col("stage_id") == F.col("_rule_stage"))
    return checked_writes(v, typed).select(
        F.coalesce("request_id", F.concat(F.lit("\0"), F.pmod(F.xxhash64("submission_id"), F.lit(_UNOWNED)).cast("string"))).alias("initiative"), "request_id", "submission_id", "data_product_id", "stage_id",
        "stage_number", "stage_name", "submitted_at", "actor", "new_status_id", "new_status_name", "header_error", "status_error", "position",
        F.when(F.col("_asked"), F.col("requirement_id")).alias("requirement_id"), "answer_error", "stored_value", "clean_value",
        strip("clean_value").alias("new"), strip("shown_value").alias("shown"), "_sub_domain")


def with_stored(v, given: DataFrame, form: Form) -> DataFrame:
    """Checked submissions with `own` and `shared`: what the stored tables say of the product and of its initiative, as JSON lists.

    own: stage, status and the subdomain's domain, then what the form shows, in the order of its rules; shared: what it shows.
    """
    own = [r for r in form.rules if not _is_parent(r)]
    columns = set(model.PRODUCT_VALUE_KEYS)
    products = v.products.select("data_product_id", "request_id", "current_stage_id", "status_id", *model.PRODUCT_VALUE_KEYS)
    products = products.join(wf.stored_answers(v.answers, [r for r in own if r.key not in columns]), "data_product_id", "left")
    homes = v.subdomains.select(F.col("subdomain_id").alias("lead_subdomain_id"), F.col("domain_id").alias("sub_home"))
    none = F.lit(None).cast("string")
    shown = [none if _is_parent(r) else strip(wf.shown_column(r.key)) if r.key in columns else strip(or_empty(f"a_{r.rule_id}")) for r in form.rules]
    states = products.join(homes, "lead_subdomain_id", "left").where("request_id is not null").select(
        "data_product_id", F.to_json(F.array("current_stage_id", "status_id", "sub_home", *shown)).alias("own"))
    shared = v.requests.select("request_id", F.to_json(F.array(
        *[strip(wf.shown_column(r.key)) if _is_parent(r) else none for r in form.rules])).alias("shared"))
    return given.join(states, "data_product_id", "left").join(shared, "request_id", "left")


class StageMachine(StatefulProcessor):
    """Decides the submissions of one initiative in order."""

    def __init__(self, form: Form):
        number = {s: n for s, _, n in form.stages}
        self.at = {r.rule_id: i for i, r in enumerate(form.rules)}
        self.parent = [_is_parent(r) for r in form.rules]
        self.tick = [r.input_type == "checkbox" for r in form.rules]
        self.needed = [(number[r.stage_id], i) for i, r in enumerate(form.rules) if r.required and r.stage_id in number]
        self.next = {a[0]: b[0] for a, b in zip(form.stages, form.stages[1:])}
        by_key = {r.key: i for i, r in enumerate(form.rules)}
        self.domain, self.sub = by_key.get("lead_domain_id"), by_key.get("lead_subdomain_id")

    def init(self, handle) -> None:
        self.states = handle.getMapState("states", "owner string", _STATE)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timers):
        submissions: dict[str, list[Row]] = {}
        for row in rows:
            submissions.setdefault(row.submission_id, []).append(row)
        held: dict[str, dict] = {}
        count = None
        for answers in sorted(submissions.values(), key=lambda a: (a[0].submitted_at, a[0].submission_id)):
            head = answers[0]
            if head.header_error is None:
                count = ((self.count.get() or (0,))[0] if count is None else count) + 1
                own, shared = self._state(held, head.data_product_id, head.own), self._state(held, _SHARED, head.shared)
                yield self._decide(head, answers, own, shared, count)
            else:
                yield self._decision(head, None, False, head.header_error)
        for owner, s in held.items():
            self.states.updateValue((owner,), (s["stage"], s["status"], s["sub_home"], s["cleared_at"], s["written_at"], s["shown"]))
        if count is not None:
            self.count.update((count,))

    def _state(self, held: dict, owner: str, stored: str | None) -> dict:
        if owner not in held:
            state = self.states.getValue((owner,))
            if state is not None:
                held[owner] = state.asDict() | {"shown": list(state.shown)}
            else:
                stage, status, home, *shown = ([None] * 3 if owner == _SHARED else []) + json.loads(stored or "[]") or [None] * 3
                held[owner] = {"stage": stage, "status": status, "sub_home": home, "cleared_at": 0, "written_at": 0, "shown": shown or [""] * len(self.at)}
        return held[owner]

    def _filled(self, own: dict, shared: dict, wanted) -> bool:
        for number, i in self.needed:
            if wanted(number):
                value = (shared if self.parent[i] else own)["shown"][i] or ""
                if value != "true" if self.tick[i] else value == "":
                    return False
        return True

    def _decide(self, head: Row, answers: list[Row], own: dict, shared: dict, pos: int) -> Row:
        if not self._filled(own, shared, lambda n: n < head.stage_number):
            return self._decision(head, pos, False, LOCKED)
        last = {}
        for a in sorted((a for a in answers if a.requirement_id in self.at), key=lambda a: a.position):
            last[a.requirement_id] = a
        given = sorted(last.values(), key=lambda a: a.position)
        error = next((a.answer_error for a in given if a.answer_error is not None), head.status_error)
        if error is not None:
            return self._decision(head, pos, False, error)
        written = []
        for a in given:
            i = self.at[a.requirement_id]
            shown = (shared if self.parent[i] else own)["shown"]
            written.append((a.position, a.requirement_id, a.stored_value, a.clean_value, shown[i] or "", a.new))
            shown[i] = a.shown
            if i == self.sub:
                own["sub_home"], own["written_at"] = a._sub_domain, pos
        if self.sub is not None:
            domain = own["shown"][self.domain] if self.domain is not None else ""
            if own["shown"][self.sub] and own["sub_home"] != domain:
                own["shown"][self.sub], own["cleared_at"] = "", pos
        before, to_stage, finished, end = own["status"], None, False, head.new_status_id
        if own["stage"] == head.stage_id and self._filled(own, shared, lambda n: n == head.stage_number):
            to_stage = self.next.get(head.stage_id)
            finished = to_stage is None
            end = "operating" if finished or to_stage == "operate" else "in_review"
        own["stage"], own["status"] = to_stage or own["stage"], end or before
        return self._decision(
            head, pos, True, None, to_stage, finished, before, end, own["shown"][self.sub] if self.sub is not None else "",
            own["cleared_at"] or None, own["written_at"], written)

    @staticmethod
    def _decision(head: Row, pos, accepted, error, to_stage=None, finished=False, before=None, end=None, sub=None, cleared=None, written=None, answers=()) -> Row:
        return Row(
            request_id=head.request_id, submission_id=head.submission_id, data_product_id=head.data_product_id, stage_id=head.stage_id, stage_name=head.stage_name,
            submitted_at=head.submitted_at, actor=head.actor, new_status_id=head.new_status_id, new_status_name=head.new_status_name, pos=pos, accepted=accepted,
            error=error, to_stage_id=to_stage, finished=finished, status_before=before, end_status=end, sub_after=sub, sub_cleared_at=cleared,
            sub_written_at=written, answers=list(answers))

    def close(self) -> None:
        pass


class Decided(Applied):
    """States, events and results that follow from decisions; v: the stored tables from before the first of them."""

    def __init__(self, v, form: Form, decisions: DataFrame):
        self.v, self.form, self.decisions = v, form, decisions

    @cached_property
    def accepted(self) -> DataFrame:
        return self.decisions.where("accepted").withColumn("from_stage_id", F.when(F.col("to_stage_id").isNotNull(), F.col("stage_id"))).drop("answers")

    @cached_property
    def done(self) -> DataFrame:
        rows = self.decisions.where("accepted").select("submission_id", "request_id", "data_product_id", "pos", "submitted_at", F.inline("answers"))
        return rows.join(rule_table(self.v.spark, self.form).drop("stage_id"), "requirement_id")

    @property
    def dated(self) -> DataFrame:
        return self.done

    @cached_property
    def sieve(self) -> KeySieve:
        return KeySieve(cut_lineage(self.decisions.where("accepted").select("data_product_id").distinct()), ["data_product_id"])

    @cached_property
    def changed(self) -> DataFrame:
        return self.done.where("old <> new")

    @cached_property
    def results(self) -> DataFrame:
        return self.decisions.select("submission_id", "data_product_id", "stage_id", "accepted", F.col("to_stage_id").isNotNull().alias("advanced"), "error")


def run_stage_machine(v, rows: DataFrame, root: str, mail_domain: str, rules=None, stages=None) -> Decided:
    """Decide all submissions of a stream that are there, and what follows from all decisions under `root` so far.

    The state, the stream's progress and the decisions (one folder per micro-batch, overwritten when it is run again) live under root;
    a later call with the same root goes on from there. rows: as for `prepared`. v: the stored tables from before the first call.
    """
    form = Form(*wf.form_of(v, rules, stages))
    given = with_stored(v, prepared(v, rows, mail_domain, form), form)
    decided = given.groupBy("initiative").transformWithState(
        statefulProcessor=StageMachine(form), outputStructType=DECISION, outputMode="Append", timeMode="None")
    conf = v.spark.conf
    provider = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)  # the machine's state cannot live in another store
    try:
        run_available(decided, root, delta_sink(f"{root}/decisions"))
    finally:
        conf.set(PROVIDER, provider)
    return Decided(v, form, read_deltas(v.spark, f"{root}/decisions").drop("batch"))
