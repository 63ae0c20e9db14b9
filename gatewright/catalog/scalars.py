"""H: scalar functions."""

from pyspark.sql import functions as F

from gatewright.catalog import sql_text as q
from gatewright.catalog.registry import query
from gatewright.functions import checks, dates, text as tx
from gatewright.sources.adapter import with_views

AS_OF = "2024-07-01 00:00:00"
_NUMBERS = "CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey AS string) WHEN 1 THEN concat(' req-', CAST(c_custkey AS string), ' ') " \
           "WHEN 2 THEN concat('1234567', CAST(c_custkey + 10 AS string)) WHEN 3 THEN c_name ELSE concat('12a', CAST(c_custkey AS string), 'x') END"


@query("h1_slug", f"SELECT p_partkey, {q.slug('p_name')} AS name_slug, {q.slug('p_brand')} AS brand_slug FROM part")
def _(t, v):
    return t.part.select("p_partkey", tx.slug("p_name").alias("name_slug"), tx.slug("p_brand").alias("brand_slug"))


@query("h2_normalize_number", f"WITH c AS (SELECT c_custkey, {_NUMBERS} AS raw FROM customer) SELECT c_custkey, {q.normalize_number('raw')} AS number FROM c")
def _(t, v):
    return t.customer.select("c_custkey", tx.normalize_number(F.expr(_NUMBERS)).alias("number"))


@query("h3_number_sort_value", f"WITH c AS (SELECT c_custkey, {_NUMBERS} AS raw FROM customer) SELECT c_custkey, {q.number_sort_value('raw')} AS value FROM c")
def _(t, v):
    return t.customer.select("c_custkey", tx.number_sort_value(F.expr(_NUMBERS)).alias("value"))


@query("h4_format_number", "SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey * 7919 + 1 AS VARCHAR)) >= 8 THEN CAST(o_orderkey * 7919 + 1 AS VARCHAR) "
       "ELSE lpad(CAST(o_orderkey * 7919 + 1 AS VARCHAR), 8, '0') END AS number FROM orders")
def _(t, v):
    return t.orders.select("o_orderkey", tx.zero_fill((F.col("o_orderkey") * 7919 + 1).cast("string")).alias("number"))


@query("h5_clean_text", f"""
SELECT doc_id, length({q.strip('text')}) AS chars, CASE WHEN {q.strip('text')} = '' THEN 'text is required'
  WHEN length({q.strip('text')}) > 500 THEN 'text must be 500 characters or fewer' ELSE '' END AS error FROM documents""")
def _(t, v):
    c = checks.text("text", "text", required=True)
    return t.documents.select("doc_id", F.length(c.value).cast("bigint").alias("chars"), F.coalesce(c.error, F.lit("")).alias("error"))


_MAIL = "CASE s_suppkey % 5 WHEN 0 THEN concat(' User', CAST(s_suppkey AS string), '@Example.com ') WHEN 1 THEN 'a b@example.com' " \
        "WHEN 2 THEN 'x@exampleXcom' WHEN 3 THEN '  ' ELSE concat(s_name, '@example.com') END"


@query("h6_clean_email", f"""
WITH s AS (SELECT s_suppkey, lower({q.strip('(' + _MAIL + ')')}) AS mail FROM supplier)
SELECT s_suppkey, mail, CASE WHEN mail = '' THEN 'email is required'
  WHEN NOT regexp_matches(mail, '^[^@\\s]+@example\\.com$') THEN 'email must use example.com' ELSE '' END AS error FROM s""")
def _(t, v):
    c = checks.email(F.expr(_MAIL), "example.com")
    return t.supplier.select("s_suppkey", c.value.alias("mail"), F.coalesce(c.error, F.lit("")).alias("error"))


_DATES = "CASE o_orderkey % 6 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-2-3' WHEN 2 THEN '' WHEN 3 THEN '24-01-01' WHEN 4 THEN " \
         "concat(' ', CAST(CAST(o_orderdate AS date) AS string), ' ') ELSE '2024-01-01x' END"


@query("h7_clean_date", f"""
WITH o AS (SELECT o_orderkey, {q.strip('(' + _DATES + ')')} AS d FROM orders)
SELECT o_orderkey, d AS value, CASE WHEN d = '' THEN '' WHEN NOT regexp_matches(d, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') OR try_strptime(d, '%Y-%m-%d') IS NULL
  THEN 'delivery date must use YYYY-MM-DD format' ELSE '' END AS error FROM o""")
def _(t, v):
    c = checks.date(F.expr(_DATES), "delivery date")
    return t.orders.select("o_orderkey", c.value.alias("value"), F.coalesce(c.error, F.lit("")).alias("error"))


_INTS = "CASE o_orderkey % 4 WHEN 0 THEN concat(' ', CAST(o_custkey AS string)) WHEN 1 THEN '-3' WHEN 2 THEN '' ELSE '1.5' END"


@query("h8_whole_number", f"""
WITH o AS (SELECT o_orderkey, {q.strip('(' + _INTS + ')')} AS s FROM orders)
SELECT o_orderkey, coalesce(CASE WHEN regexp_matches(s, '^[0-9]+$') THEN TRY_CAST(s AS BIGINT) END, -1) AS value,
  CASE WHEN s <> '' AND NOT regexp_matches(s, '^[0-9]+$') THEN 'effort must be a whole number' ELSE '' END AS error FROM o""")
def _(t, v):
    c = checks.whole_number(F.expr(_INTS), "effort")
    return t.orders.select("o_orderkey", F.coalesce(c.value, F.lit(-1)).alias("value"), F.coalesce(c.error, F.lit("")).alias("error"))


_URLS = "CASE page_id % 5 WHEN 0 THEN 'javascript:alert(1)' WHEN 1 THEN 'http://' WHEN 2 THEN upper(url) WHEN 3 THEN '' ELSE url END"


@query("h9_http_url", f"""
WITH p AS (SELECT page_id, {_URLS} AS u FROM pages)
SELECT page_id, CASE WHEN u <> '' AND NOT regexp_matches(u, '(?i)^https?://[^/?#]+') THEN 'link must be a valid http(s) URL'
  WHEN length(u) > 2048 THEN 'link must be 2048 characters or fewer' ELSE '' END AS error FROM p""")
def _(t, v):
    return t.pages.select("page_id", F.coalesce(checks.http_url(F.expr(_URLS), "link").error, F.lit("")).alias("error"))


_BOXES = "CASE event_type WHEN 'click' THEN ' TRUE ' WHEN 'view' THEN 'true' WHEN 'error' THEN '1' ELSE '' END"


@query("h10_checkbox", f"SELECT event_id, CASE WHEN lower(trim({_BOXES})) = 'true' THEN 'true' ELSE 'false' END AS value FROM events")
def _(t, v):
    return t.events.select("event_id", tx.checkbox(F.expr(_BOXES)).alias("value"))


@query("h11_answer_complete", with_views("answers", f"""
SELECT answer_id, {q.complete('input_type', 'answer_value')} AS complete FROM a_answers JOIN a_requirements USING (requirement_id)"""))
def _(t, v):
    return v.answers.join(v.requirements.select("requirement_id", "input_type"), "requirement_id").select(
        "answer_id", tx.answer_complete("input_type", "answer_value").alias("complete"))


@query("h12_log_text", f"SELECT doc_id, {q.log_text('text')} AS short FROM documents")
def _(t, v):
    return t.documents.select("doc_id", tx.log_text("text").alias("short"))


_TS = "CASE event_id % 5 WHEN 0 THEN 'soon' WHEN 1 THEN '2024-13-01' WHEN 2 THEN substring(CAST(ts AS string), 1, 10) " \
      "WHEN 3 THEN concat(replace(substring(CAST(ts AS string), 1, 19), ' ', 'T'), 'Z') ELSE substring(CAST(ts AS string), 1, 19) END"


@query("h13_parse_instant", f"""
WITH e AS (SELECT event_id, {_TS} AS raw FROM events)
SELECT event_id, coalesce(epoch_us(TRY_CAST(replace(raw, 'Z', '') AS TIMESTAMP)), -1) AS micros FROM e""")
def _(t, v):
    return t.events.select("event_id", F.coalesce(dates.instant_micros(F.expr(_TS)), F.lit(-1)).alias("micros"))


@query("h14_valid_instant", f"""
WITH e AS (SELECT event_id, {_TS} AS raw FROM events)
SELECT event_id, CASE WHEN TRY_CAST(replace(raw, 'Z', '') AS TIMESTAMP) IS NULL THEN '' ELSE raw END AS value FROM e""")
def _(t, v):
    return t.events.select("event_id", dates.valid_instant_or_empty(F.expr(_TS)).alias("value"))


@query("h15_days_since", f"SELECT o_orderkey, {q.days_since('CAST(o_orderdate AS VARCHAR)', '2000-01-01 12:00:00')} AS days FROM orders")
def _(t, v):
    return t.orders.select("o_orderkey", dates.days_since(F.col("o_orderdate").cast("string"), "2000-01-01 12:00:00").alias("days"))


_OFFSETS = "CASE o_orderkey % 3 WHEN 0 THEN concat(CAST(CAST(o_orderdate AS date) AS string), 'T23:30:00-02:00') WHEN 1 THEN 'not a date at all' " \
           "ELSE concat(CAST(CAST(o_orderdate AS date) AS string), 'T05:00:00Z') END"


@query("h16_date_text", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(o_orderdate + INTERVAL 1 DAY AS DATE) AS VARCHAR) WHEN 1 THEN 'not a date'
  ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders""")
def _(t, v):
    return t.orders.select("o_orderkey", dates.date_text(F.expr(_OFFSETS)).alias("day"))


@query("h17_days_label", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN 'Not set' WHEN l_linenumber - 2 <= 0 THEN '<1 day'
  WHEN l_linenumber - 2 = 1 THEN '1 day' ELSE concat(CAST(l_linenumber - 2 AS VARCHAR), ' days') END AS label FROM lineitem""")
def _(t, v):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             dates.days_label(F.when(F.col("l_linenumber") < 7, F.col("l_linenumber") - 2)).alias("label"))


@query("h18_stage_status_text", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'Locked until previous stages are complete' WHEN l_linestatus = 'F' THEN 'Complete'
  WHEN l_linenumber = 1 THEN 'Current stage' ELSE 'Available' END AS status FROM lineitem""")
def _(t, v):
    from gatewright.plans.workflow import stage_status_text

    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_returnflag") != "R").alias("can_submit"),
                           (F.col("l_linestatus") == "F").alias("complete"), (F.col("l_linenumber") == 1).alias("is_current"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", stage_status_text().alias("status"))


@query("h19_concat_ws", with_views("requests", "SELECT request_id, concat_ws(' ', initiative, business_value, additional_comments, note) AS txt FROM a_requests"))
def _(t, v):
    return v.requests.select("request_id", F.concat_ws(" ", "initiative", "business_value", "additional_comments", "note").alias("txt"))


@query("h20_coalesce_raw", with_views("legacy", "SELECT o.data_object, coalesce(data_product_name, data_object, type) AS chosen FROM a_legacy o"))
def _(t, v):
    return v.legacy.select("data_object", F.coalesce("data_product_name", "data_object", "type").alias("chosen"))


@query("h21_coalesce_filled", with_views("legacy", "SELECT request_id, coalesce(nullif(data_product_name, ''), nullif(data_object, ''), concat('Imported ', request_id)) AS chosen FROM a_legacy"))
def _(t, v):
    return v.legacy.select("request_id", tx.first_filled("data_product_name", "data_object", F.concat(F.lit("Imported "), "request_id")).alias("chosen"))


@query("h22_digits_only", "SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM customer")
def _(t, v):
    return t.customer.select("c_custkey", tx.digits_only("c_name").alias("digits"))


@query("h23_last_eight", f"WITH c AS (SELECT c_custkey, {_NUMBERS} AS raw FROM customer) SELECT c_custkey, lpad(right(raw, 8), 8, '0') AS number FROM c")
def _(t, v):
    return t.customer.select("c_custkey", tx.last_digits_number(F.expr(_NUMBERS)).alias("number"))


@query("h24_plain_lpad", "SELECT o_orderkey, lpad(CAST(o_orderkey * 1000003 AS VARCHAR), 8, '0') AS number FROM orders")
def _(t, v):
    return t.orders.select("o_orderkey", F.lpad((F.col("o_orderkey") * 1000003).cast("string"), 8, "0").alias("number"))


_ROW_MD5 = "md5(CAST(to_json({'n_name': n_name, 'n_nationkey': n_nationkey, 'n_regionkey': n_regionkey, 'note': CASE WHEN n_regionkey = 1 THEN n_name END}) AS VARCHAR))"


@query("h25_row_hash", f"SELECT n_nationkey, {_ROW_MD5} AS hash, substring({_ROW_MD5}, 1, 8) AS short FROM nation")
def _(t, v):
    n = t.nation.withColumn("note", F.when(F.col("n_regionkey") == 1, F.col("n_name")))
    return n.select("n_nationkey", tx.row_md5(n.columns).alias("hash"), F.substring(tx.row_md5(n.columns), 1, 8).alias("short"))


@query("h26_left_500", "SELECT doc_id, left(text, 500) AS title FROM documents")
def _(t, v):
    return t.documents.select("doc_id", F.left("text", F.lit(500)).alias("title"))


@query("h27_guarded_int", with_views("legacy", "SELECT data_object, requested_date, coalesce(CASE WHEN regexp_matches(effort, '^[0-9]+$') THEN CAST(effort AS INTEGER) END, -1) AS effort FROM a_legacy"))
def _(t, v):
    return v.legacy.select("data_object", "requested_date",
                           F.coalesce(F.when(F.col("effort").rlike(r"^\d+$"), F.col("effort").try_cast("int")), F.lit(-1)).alias("effort"))


@query("h28_json_field", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.absent'), '') AS absent FROM events")
def _(t, v):
    from gatewright.sources.documents import field

    return t.events.select("event_id", F.coalesce(field("props", "k"), F.lit("")).alias("k"), F.coalesce(field("props", "absent"), F.lit("")).alias("absent"))


@query("h29_case_trim_concat", f"SELECT p_partkey, lower(trim(concat(' ', p_brand, ' '))) AS brand, concat(p_type, '/', CAST(p_size AS VARCHAR)) AS kind, '{AS_OF}' AS seen_at FROM part")
def _(t, v):
    return t.part.select("p_partkey", F.lower(F.trim(F.concat(F.lit(" "), "p_brand", F.lit(" ")))).alias("brand"),
                         F.concat("p_type", F.lit("/"), F.col("p_size").cast("string")).alias("kind"), F.lit(AS_OF).alias("seen_at"))


@query("h30_display_name", with_views("users", "SELECT user_id, coalesce(nullif(display_name, 'Supplier#000000007'), split_part(email, '@', 1)) AS shown FROM a_users"))
def _(t, v):
    return v.users.select("user_id", tx.display_name(F.nullif("display_name", F.lit("Supplier#000000007")), "email").alias("shown"))


@query("h31_log_value_strip", with_views("answers", f"SELECT answer_id, {q.strip('answer_value')} AS value FROM a_answers"))
def _(t, v):
    return v.answers.select("answer_id", tx.strip("answer_value").alias("value"))
