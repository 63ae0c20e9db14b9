"""DuckDB SQL for those queries that SQL can express, over whole tables."""

from gatewright.llm.licenses import NOTICES, PHRASES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _list(words: str, distinct: bool = False) -> str:
    return "[" + ", ".join(f"'{w}'" for w in (sorted(set(words.split())) if distinct else words.split())) + "]"


SHINGLE_JOIN = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) END AS s FROM w
), u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * common >= 90 * (na + nb - common)),
r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(other) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.s
"""

COVER_TREE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LICENSE_SCAN = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w FROM d),
p AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {_list(v)})" for k, v in PHRASES.items())}) z(label, p)),
places AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1 : i + len(p)] = p)) AS k FROM w, p),
base AS (SELECT doc_id, count(*) AS n, min(k) AS lo, max(k) AS hi, list_distinct(list(label)) AS labels FROM places GROUP BY 1),
b AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
bw AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{_WORD}')) AS w FROM b),
n AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {_list(v, True)})" for k, v in NOTICES)}) z(label, p)),
f AS (SELECT doc_id, label, len(list_intersect(w, p)) AS common, len(p) AS size FROM bw, n),
found AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(CAST(common AS DOUBLE) / size) AS best FROM f WHERE 10 * common >= 8 * size GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, lo AS first_word, hi AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
  CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""

FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS x FROM documents),
h AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, CAST('0x' || x[1:8] AS UBIGINT) AS h1, CAST('0x' || x[9:16] AS UBIGINT) AS h2,
    CAST('0x' || x[17:24] AS UBIGINT) AS h3, CAST('0x' || x[25:32] AS UBIGINT) AS h4 FROM d
), c AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, CAST(least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS BIGINT) AS lo, CAST(greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS BIGINT) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT doc_id, n, form, t, array_to_string(w[1:lo], '') AS prefix, array_to_string(w[lo + 1:hi], '') AS middle, array_to_string(w[hi + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

COLLOCATIONS = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM s, range(1, 5) z(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND a >= 30),
inner_ AS (SELECT lang, array_to_string(w[i : i + j - 1], ' ') AS phrase, max(a) AS longer FROM c, range(1, 4) x(i), range(2, 4) y(j) WHERE j < m AND i + j - 1 <= m GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
k AS (SELECT kept.lang, kept.phrase, kept.a, k, x.a AS l, y.a AS r, (2000000 * CAST(kept.a AS HUGEINT)) // (x.a + y.a) AS score
  FROM kept, range(1, 4) z(k), f x, f y WHERE k < kept.m AND x.lang = kept.lang AND y.lang = kept.lang
  AND x.phrase = array_to_string(w[1:k], ' ') AND y.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLES = {"op2_shingle_join": SHINGLE_JOIN, "op3_cover_tree_top_k": COVER_TREE, "op7_license_scan": LICENSE_SCAN, "op11_fill_in_middle": FILL_IN_MIDDLE, "op12_collocations": COLLOCATIONS}
