"""Submissions applied one after the other with plain dictionaries: the yardstick for the set-based plan."""

import re

from gatewright import model

RULES = {r.rule_id: r for r in model.RULES}
NUMBER = {s: n for s, _, n in model.STAGES}
NAME = {s: n for s, n, _ in model.STAGES}
STAGE_AT = {n: s for s, _, n in model.STAGES}
OWN, PARENT = model.PRODUCT_VALUE_KEYS, model.PARENT_VALUE_KEYS


class Refused(Exception):
    pass


def slug(x):
    return re.sub("[^a-z0-9]+", "_", (x or "").strip().lower()).strip("_")


class World:
    def __init__(self, products, requests, answers, labels, display, subdomains, statuses, mail_domain):
        self.products = {p["data_product_id"]: dict(p) for p in products}
        self.requests = {r["request_id"]: dict(r) for r in requests}
        self.answers = {(a["data_product_id"], a["requirement_id"]): a["answer_value"] for a in answers}
        self.labels = {(x["collection"], x["id"]) for x in labels}
        self.display = {(x["collection"], x["id"]): x["name"] for x in display}
        self.sub_domain = {s["subdomain_id"]: s["domain_id"] for s in subdomains}
        self.statuses = {s["status_id"]: s["status_name"] for s in statuses}
        self.mail = re.compile(rf"^[^@\s]+@{re.escape(mail_domain)}$")
        self.mail_domain = mail_domain
        self.events, self.results = [], {}

    def shown(self, p, r):
        if r.key in OWN:
            value = p[r.key]
        elif r.key in PARENT:
            value = self.requests[p["request_id"]][r.key]
        else:
            value = self.answers.get((p["data_product_id"], r.rule_id))
        return "" if value is None else str(value)

    def complete(self, p, stage):
        for r in RULES.values():
            if r.stage_id == stage and r.required:
                v = self.shown(p, r).strip()
                if (v != "true") if r.input_type == "checkbox" else (v == ""):
                    return False
        return True

    def clean(self, r, raw):
        label = "Hub Owner" if r.key == model.HUB_OWNER_KEY else r.label
        kind = "hubOwners" if r.key == model.HUB_OWNER_KEY else r.master_type
        text = (raw or "").strip()
        if r.input_type == "checkbox":
            return "true" if text.lower() == "true" else "false"
        if r.input_type == "number":
            if text and not re.match(r"^\d+$", text):
                raise Refused(f"{label} must be a whole number")
            return str(int(text)) if text else ""
        if r.input_type == "date":
            if text in ("2024-02-30",):
                raise Refused(f"{label} must use YYYY-MM-DD format")
            return text
        if kind and text:
            if (kind, slug(text)) not in self.labels:
                raise Refused(f"{label} is not valid")
            text = slug(text)
        for key, name in (("product_type_id", "product type"), ("target_platform_id", "target platform"), ("priority_id", "priority")):
            if r.key == key and not text:
                raise Refused(f"{name} is required")
        if r.key == "lead_domain_id" and not text and ("domains", "commercial") not in self.labels:
            raise Refused("domain is not valid")
        return text

    def show(self, r, v):
        v = v.strip()
        if not v:
            return "empty"
        if r.input_type == "checkbox":
            return "checked" if v == "true" else "unchecked"
        kind = "hubOwners" if r.key == model.HUB_OWNER_KEY else r.master_type
        return " ".join((self.display.get((kind, v)) or v).split())

    def log(self, p, kind, **more):
        self.events.append((p["data_product_id"], kind, more.get("stage_id"), more.get("from_stage_id"), more.get("to_stage_id"),
                            more.get("status_id"), more["label"], more["detail"], more["by"], more["at"]))

    def submit(self, s, answers):
        advanced, snapshot = False, None
        try:
            actor = (s["updated_by"] or "").strip().lower()
            if actor and not self.mail.match(actor):
                raise Refused(f"updated by must use {self.mail_domain}")
            p = self.products.get(s["data_product_id"])
            if p is None or p["request_id"] not in self.requests:
                raise Refused("request not found")
            stage = s["stage_id"]
            if stage not in NUMBER:
                raise Refused("stage not found")
            if not all(self.complete(p, STAGE_AT[n]) for n in range(1, NUMBER[stage])):
                raise Refused("Previous stages must be completed before this stage can be submitted")
            cleaned = []
            for rule_id, raw in answers:
                r = RULES.get(rule_id)
                if r and r.stage_id == stage:
                    cleaned.append((r, self.clean(r, raw)))
            status = s["status_id"] or None
            if status:
                status = slug(status)
                if status not in self.statuses:
                    raise Refused("status is not valid")
        except Refused as e:
            self.results[s["submission_id"]] = (False, False, str(e))
            return
        changes = []
        for r, value in cleaned:
            old = self.shown(p, r).strip()
            if old != value.strip():
                changes.append((r, old, value))
        for r, value in cleaned:
            self.answers[(p["data_product_id"], r.rule_id)] = value
            stored = value or ("commercial" if r.key == "lead_domain_id" else None)
            if r.key in PARENT:
                self.requests[p["request_id"]][r.key] = stored
            elif r.key in OWN or r.key in model.ANSWER_SHOWN_COLUMNS:
                p[r.key] = int(stored) if r.key == "effort" and stored else stored
        sub = p["lead_subdomain_id"]
        if sub and self.sub_domain.get(sub) != p["lead_domain_id"]:
            p["lead_subdomain_id"] = None
            self.answers.pop((p["data_product_id"], model.SUBDOMAIN_RULE_ID), None)
        at = s["submitted_at"]
        actor = actor or "system"
        if status and status != p["status_id"]:
            before = self.statuses.get(p["status_id"], p["status_id"]) or "empty"
            self.log(p, "status_changed", stage_id=stage, status_id=status, label="Status updated", by=actor, at=at,
                     detail=f"Status changed from {before} to {self.statuses[status]}.")
        if status:
            p["status_id"] = status
        lines = [f"{'Hub Owner' if r.key == model.HUB_OWNER_KEY else r.label}: {self.show(r, o)} -> {self.show(r, n)}" for r, o, n in changes]
        detail = "; ".join(lines[:6] + ([f"{len(lines) - 6} more field(s) changed"] if len(lines) > 6 else []))
        self.log(p, "answers_saved", stage_id=stage, status_id=status, label=f"{NAME[stage]} saved", by=actor, at=at,
                 detail=detail or "Submitted with no field changes.")
        if p["current_stage_id"] == stage and self.complete(p, stage):
            nxt = STAGE_AT.get(NUMBER[stage] + 1)
            if nxt is None:
                p["status_id"] = "operating"
                self.log(p, "completed", stage_id=stage, status_id="operating", label="Workflow completed", by="admin", at=at,
                         detail="All stages are complete.")
            else:
                p["current_stage_id"], p["status_id"] = nxt, "operating" if nxt == "operate" else "in_review"
                p["note"] = "Advanced automatically after required information was completed."
                advanced = True
                self.log(p, "stage_advanced", stage_id=nxt, from_stage_id=stage, to_stage_id=nxt, status_id=p["status_id"],
                         label="Stage advanced", detail=f"Advanced from {stage} to {nxt}.", by="system", at=at)
        p["updated_at"] = at
        self.results[s["submission_id"]] = (True, advanced, None)
