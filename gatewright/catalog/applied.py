"""SQL for applying submissions: a recursive fold that takes one submission of every initiative at a time.

The state of an initiative is a map of texts: `p|<rule>` for the values that sibling products share, `<product>|<rule>` for a product's
own, `<product>#stage` and `<product>#status`. This says in order what the library finds set-based.
"""

from gatewright import model
from gatewright.catalog import sql_text as q
from gatewright.catalog.counts_windows_sorts import RESOLVED, RESOLVED_VIEWS
from gatewright.catalog.joins import LABEL_VIEWS, _LABELS_SQL
from gatewright.catalog.validation import ANSWER_CLEAN, ANSWER_ERROR, CHECKED, MAIL_SQL
from gatewright.plans.answers import ADVANCE_NOTE, LOCKED, PRODUCT_WRITE_KEYS
from gatewright.sources.adapter import SUBMISSION, with_views

HEADS = f"""h AS (SELECT {', '.join(f'{e} AS {a}' for a, e in SUBMISSION.items())} FROM events LEFT JOIN
  (SELECT o_custkey AS k, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order FROM orders GROUP BY 1) ON k = user_id)"""

DISPLAY = f"""dl AS (SELECT * FROM ({_LABELS_SQL}) WHERE collection NOT IN ('dataDomainOwners','domainDeliveryLeads','hubOwners','lynxPms')
  UNION ALL SELECT c, user_id, display_name FROM a_users, (VALUES ('dataDomainOwners'),('domainDeliveryLeads'),('hubOwners'),('lynxPms')) z(c))"""


def log_sql(value, name, kind="input_type"):
    return (f"CASE WHEN {value} = '' THEN 'empty' WHEN {kind} = 'checkbox' THEN CASE WHEN {value} = 'true' THEN 'checked' ELSE 'unchecked' END "
            f"ELSE {q.log_text(f'coalesce({name}, {value})')} END")


def _in(keys) -> str:
    return "(" + ", ".join(f"'{k}'" for k in keys) + ")"


_PARENT = _in(model.PARENT_VALUE_KEYS)
_SHOWN = _in(model.PRODUCT_VALUE_KEYS + model.PARENT_VALUE_KEYS)
_DOMAIN_RULE, _SUB_RULE = "reuse_domain_lead_domain_id", model.SUBDOMAIN_RULE_ID
_NEXT = "CASE stage_id " + " ".join(f"WHEN '{a[0]}' THEN '{b[0]}'" for a, b in zip(model.STAGES, model.STAGES[1:])) + " END"
_LAST = model.STAGES[-1][0]
_MAIL_TEXT = f"lower({q.strip('updated_by')})"
_STATUS = q.slug("h.status_id")


def _all_filled(state: str, which: str) -> str:
    """SQL: every required rule that `which` names has a value in the state."""
    value = f"coalesce({state}[(CASE WHEN r.parent THEN 'p' ELSE data_product_id END) || '|' || r.id], '')"
    return f"len(list_filter(rules, lambda r: r.number {which} AND NOT (CASE WHEN r.tick THEN {value} = 'true' ELSE {value} <> '' END))) = 0"


_FOLD = f"""WITH {RESOLVED}, {HEADS}, {CHECKED},
va AS (SELECT submission_id, position, requirement_id, requirement_key, input_type, label, collection, {ANSWER_CLEAN} AS clean, {ANSWER_ERROR} AS error FROM sv),
vw AS (SELECT *, requirement_key IN {_PARENT} AS parent, coalesce(nullif(clean, ''), CASE WHEN requirement_key = 'lead_domain_id' THEN 'commercial' END) AS stored FROM va),
ps AS (SELECT submission_id, arg_min(error, position) FILTER (WHERE error IS NOT NULL) AS answer_error FROM va GROUP BY 1),
hd AS (SELECT h.submission_id, h.data_product_id, h.stage_id, h.submitted_at, p.request_id, p.current_stage_id, p.status_id AS base_status, s.stage_number, s.stage_name,
    coalesce(nullif({_MAIL_TEXT}, ''), 'system') AS actor, CASE WHEN coalesce(h.status_id, '') <> '' THEN {_STATUS} END AS new_status, st.status_name AS new_name,
    coalesce(CASE WHEN {_MAIL_TEXT} <> '' AND NOT regexp_matches({_MAIL_TEXT}, {MAIL_SQL}) THEN 'updated by must use example.com' END,
      CASE WHEN coalesce(h.stage_id, '') = '' THEN 'stageId is required' END, CASE WHEN p.request_id IS NULL THEN 'request not found' END,
      CASE WHEN s.stage_id IS NULL THEN 'stage not found' END) AS header_error,
    CASE WHEN coalesce(h.status_id, '') <> '' THEN CASE WHEN {_STATUS} = '' THEN 'status is required' WHEN st.status_id IS NULL THEN 'status is not valid' END END AS status_error
  FROM h LEFT JOIN (SELECT z.* FROM a_products z JOIN a_requests USING (request_id)) p ON p.data_product_id = h.data_product_id
  LEFT JOIN a_stages s ON s.stage_id = h.stage_id LEFT JOIN a_statuses st ON st.status_id = {_STATUS}),
w AS (SELECT vw.submission_id, map_from_entries(list(({{'k': CASE WHEN parent THEN 'p' ELSE data_product_id END || '|' || requirement_id,
    'v': {q.strip(f"CASE WHEN requirement_key IN {_SHOWN} THEN stored ELSE clean END")}}}))) AS w FROM vw JOIN hd USING (submission_id) WHERE header_error IS NULL GROUP BY 1),
o AS (SELECT hd.*, answer_error, w, row_number() OVER (PARTITION BY request_id ORDER BY submitted_at, submission_id) AS pos
  FROM hd LEFT JOIN ps USING (submission_id) LEFT JOIN w USING (submission_id) WHERE header_error IS NULL),
own AS (SELECT DISTINCT request_id, data_product_id, current_stage_id, base_status FROM o),
start AS (SELECT request_id, map_from_entries(list({{'k': k, 'v': v}})) AS m FROM (
    SELECT DISTINCT own.request_id, CASE WHEN requirement_key IN {_PARENT} THEN 'p' ELSE own.data_product_id END || '|' || requirement_id AS k, {q.strip('answer_value')} AS v
    FROM own JOIN x ON x.data_product_id = own.data_product_id
    UNION ALL SELECT request_id, data_product_id || '#stage', current_stage_id FROM own UNION ALL SELECT request_id, data_product_id || '#status', base_status FROM own) GROUP BY 1),
rl AS (SELECT list({{'id': requirement_id, 'number': stage_number, 'parent': requirement_key IN {_PARENT}, 'tick': input_type = 'checkbox'}}) AS rules
  FROM a_requirements JOIN a_stages USING (stage_id) WHERE is_required = 1),
homes AS (SELECT map_from_entries(list({{'k': subdomain_id, 'v': domain_id}})) AS homes FROM a_subdomains),
f AS (
  SELECT request_id, CAST(0 AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS submission_id, false AS unlocked, false AS accepted, false AS cleared, CAST(NULL AS VARCHAR) AS to_stage,
    false AS finished, CAST(NULL AS VARCHAR) AS status_before, CAST(NULL AS VARCHAR) AS end_status, m AS before, m FROM start
  UNION ALL
  SELECT request_id, pos, submission_id, unlocked, accepted, cleared, to_stage, finished, before[data_product_id || '#status'], end_status, before,
    CASE WHEN accepted THEN map_concat(m2, MAP {{data_product_id || '#stage': coalesce(to_stage, before[data_product_id || '#stage']),
      data_product_id || '#status': coalesce(end_status, before[data_product_id || '#status'])}}) ELSE before END
  FROM (SELECT *, CASE WHEN to_stage IS NOT NULL THEN CASE WHEN to_stage = 'operate' THEN 'operating' ELSE 'in_review' END
      WHEN finished THEN 'operating' ELSE new_status END AS end_status
    FROM (SELECT *, CASE WHEN saved THEN {_NEXT} END AS to_stage, coalesce(saved AND stage_id = '{_LAST}', false) AS finished
      FROM (SELECT *, accepted AND before[data_product_id || '#stage'] = stage_id AND {_all_filled('m2', '= stage_number')} AS saved
        FROM (SELECT *, CASE WHEN cleared THEN map_concat(m1, MAP {{data_product_id || '|{_SUB_RULE}': ''}}) ELSE m1 END AS m2
          FROM (SELECT *, accepted AND m1[data_product_id || '|{_SUB_RULE}'] <> '' AND homes[m1[data_product_id || '|{_SUB_RULE}']] IS DISTINCT FROM m1[data_product_id || '|{_DOMAIN_RULE}'] AS cleared
            FROM (SELECT *, CASE WHEN accepted AND w IS NOT NULL THEN map_concat(before, w) ELSE before END AS m1
              FROM (SELECT *, unlocked AND answer_error IS NULL AND status_error IS NULL AS accepted
                FROM (SELECT *, {_all_filled('before', '< stage_number')} AS unlocked
                  FROM (SELECT o.*, f.m AS before, rules, homes FROM f JOIN o ON o.request_id = f.request_id AND o.pos = f.pos + 1, rl, homes)))))))))
),
g AS (SELECT o.*, f.unlocked, f.accepted, f.cleared, f.to_stage, f.finished, f.status_before, f.end_status, f.before FROM f JOIN o USING (submission_id)),
ok AS (SELECT * FROM g WHERE accepted),
wrote AS (SELECT ok.request_id, ok.data_product_id, ok.pos, ok.submitted_at, ok.before, vw.* FROM ok JOIN vw USING (submission_id)),
final AS (SELECT request_id, arg_max(m, pos) AS m FROM f GROUP BY 1)"""

_VIEWS = " ".join(dict.fromkeys(f"{RESOLVED_VIEWS} {LABEL_VIEWS} products requests stages statuses requirements answers".split()))


def _sql(rest: str) -> str:
    return with_views(_VIEWS, f"{_FOLD}{rest}").replace("WITH ", "WITH RECURSIVE ", 1)


RESULTS = _sql(f"""
SELECT hd.submission_id, hd.data_product_id, hd.stage_id, coalesce(accepted, false) AS accepted, to_stage IS NOT NULL AS advanced,
  coalesce(hd.header_error, CASE WHEN NOT unlocked THEN '{LOCKED}' END, answer_error, hd.status_error) AS error
FROM hd LEFT JOIN g USING (submission_id)""")


def _event(kind: str, seq: int, where: str, **columns: str) -> str:
    at = {"entity_type": "'product'", "request_id": "request_id", "data_product_id": "data_product_id", "event_type": f"'{kind}'", "stage_id": "stage_id",
          "from_stage_id": "CAST(NULL AS VARCHAR)", "to_stage_id": "CAST(NULL AS VARCHAR)"} | columns | {"created_at": "submitted_at"}
    identity = f"md5(concat_ws('|', data_product_id, '{kind}', submitted_at, submission_id || '.{seq}'))"
    return f"SELECT {identity} AS timeline_id, {', '.join(f'{at[c]} AS {c}' for c in model.TIMELINE_COLUMNS[1:])} FROM ev WHERE {where}"


_KEY = "(CASE WHEN parent THEN 'p' ELSE data_product_id END) || '|' || requirement_id"
EVENTS = _sql(f""", {DISPLAY},
df AS (SELECT submission_id, position, requirement_id, requirement_key, input_type, label, collection, coalesce(before[{_KEY}], '') AS old, {q.strip('clean')} AS new FROM wrote),
ln AS (SELECT submission_id, position, requirement_id, concat(CASE WHEN requirement_key = '{model.HUB_OWNER_KEY}' THEN 'Hub Owner' ELSE label END, ': ', {log_sql('old', 'a.name')},
    ' -> ', {log_sql('new', 'b.name')}) AS line
  FROM df LEFT JOIN dl a ON a.collection = df.collection AND a.id = old LEFT JOIN dl b ON b.collection = df.collection AND b.id = new WHERE old <> new),
rn AS (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY position, requirement_id) AS rn, count(*) OVER (PARTITION BY submission_id) AS n FROM ln),
d AS (SELECT submission_id, concat(string_agg(line, '; ' ORDER BY rn) FILTER (WHERE rn <= 6), CASE WHEN max(n) > 6 THEN concat('; ', CAST(max(n) - 6 AS VARCHAR), ' more field(s) changed') ELSE '' END) AS detail
  FROM rn GROUP BY 1),
ev AS (SELECT ok.*, detail, st.status_name AS old_name FROM ok LEFT JOIN d USING (submission_id) LEFT JOIN a_statuses st ON st.status_id = ok.status_before)
{_event('status_changed', 1, 'new_status IS NOT NULL AND new_status IS DISTINCT FROM status_before', status_id='new_status', event_label="'Status updated'", created_by='actor',
        event_detail=f"concat('Status changed from ', CASE WHEN {q.strip('status_before')} = '' THEN 'empty' ELSE coalesce(old_name, {q.log_text('status_before')}) END, ' to ', new_name, '.')")}
UNION ALL {_event('answers_saved', 2, 'true', status_id='new_status', event_label="concat(stage_name, ' saved')", event_detail="coalesce(detail, 'Submitted with no field changes.')", created_by='actor')}
UNION ALL {_event('stage_advanced', 3, 'to_stage IS NOT NULL', stage_id='to_stage', from_stage_id='stage_id', to_stage_id='to_stage', status_id='end_status', event_label="'Stage advanced'",
                  event_detail="concat('Advanced from ', stage_id, ' to ', to_stage, '.')", created_by="'system'")}
UNION ALL {_event('completed', 4, 'finished', status_id="'operating'", event_label="'Workflow completed'", event_detail="'All stages are complete.'", created_by="'admin'")}""")


def _columns(names, written, special=None) -> str:
    special = special or {}
    number = lambda c, e: f"TRY_CAST({e} AS INTEGER)" if c == "effort" else e
    new = {c: f"CASE WHEN map_contains(n.m, '{c}') THEN {number(c, f'n.m[{chr(39)}{c}{chr(39)}].v')} ELSE t.{c} END" for c in written}
    return ", ".join(f"{(new | special).get(c, f't.{c}')} AS {c}" for c in names)


def _newest(key: str, keys) -> str:
    """SQL: per key a map from requirement key to the last value written (which may be NULL, within a struct)."""
    return (f"n AS (SELECT {key}, map_from_entries(list({{'k': requirement_key, 'v': v}})) AS m FROM (SELECT {key}, requirement_key, "
            f"arg_max({{'v': stored}}, pos) AS v FROM wrote WHERE requirement_key IN {_in(keys)} GROUP BY 1, 2) GROUP BY 1)")


PRODUCTS = _sql(f""", {_newest('data_product_id', PRODUCT_WRITE_KEYS)},
e AS (SELECT data_product_id, any_value(request_id) AS request_id, max_by(end_status, pos) FILTER (WHERE end_status IS NOT NULL) AS status, max_by(to_stage, pos) FILTER (WHERE to_stage IS NOT NULL) AS stage,
  max_by(submitted_at, pos) AS at FROM ok GROUP BY 1)
SELECT {_columns(model.PRODUCT_COLUMNS, PRODUCT_WRITE_KEYS, {
    'lead_subdomain_id': f"CASE WHEN e.at IS NOT NULL THEN nullif(final.m[t.data_product_id || '|{_SUB_RULE}'], '') ELSE t.lead_subdomain_id END",
    'status_id': 'coalesce(e.status, t.status_id)', 'current_stage_id': 'coalesce(e.stage, t.current_stage_id)',
    'note': f"CASE WHEN e.stage IS NOT NULL THEN '{ADVANCE_NOTE}' ELSE t.note END", 'updated_at': 'coalesce(e.at, t.updated_at)'})}
FROM a_products t LEFT JOIN n ON n.data_product_id = t.data_product_id LEFT JOIN e ON e.data_product_id = t.data_product_id LEFT JOIN final ON final.request_id = e.request_id""")

REQUESTS = _sql(f""", {_newest('request_id', model.PARENT_VALUE_KEYS)}
SELECT {_columns(model.REQUEST_COLUMNS, model.PARENT_VALUE_KEYS)} FROM a_requests t LEFT JOIN n ON n.request_id = t.request_id""")

ANSWERS = _sql(f""",
n AS (SELECT data_product_id, requirement_id, max_by(clean, pos) AS answer_value, max_by(submitted_at, pos) AS updated_at FROM wrote GROUP BY 1, 2),
gone AS (SELECT c.data_product_id FROM (SELECT data_product_id, max(pos) AS at FROM ok WHERE cleared GROUP BY 1) c LEFT JOIN
  (SELECT data_product_id, max(pos) AS at FROM wrote WHERE requirement_id = '{_SUB_RULE}' GROUP BY 1) z USING (data_product_id) WHERE c.at >= coalesce(z.at, 0)),
u AS (SELECT coalesce(t.answer_id, md5(concat_ws('|', n.data_product_id, n.requirement_id))) AS answer_id, coalesce(t.data_product_id, n.data_product_id) AS data_product_id,
    coalesce(t.requirement_id, n.requirement_id) AS requirement_id, CASE WHEN n.data_product_id IS NOT NULL THEN n.answer_value ELSE t.answer_value END AS answer_value,
    coalesce(n.updated_at, t.updated_at) AS updated_at FROM a_answers t FULL JOIN n ON n.data_product_id = t.data_product_id AND n.requirement_id = t.requirement_id)
SELECT * FROM u WHERE NOT (requirement_id = '{_SUB_RULE}' AND data_product_id IN (SELECT data_product_id FROM gone))""")
