"""SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from chatterforge.llm.license_scan import PHRASES, TEMPLATES
from chatterforge.llm.secret_scan import BASE, RULES

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def decontaminate(width: int = 10) -> str:
    return f"""
WITH docs AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
items AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i:i + {width - 1}], ' ') AS k, least({width}, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {width - 1}) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows)),
found AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x ON x.n = p.n AND x.k = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT at_word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS at_word FROM found) GROUP BY 1),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN met USING (doc_id)"""


def _template_pattern(template: str) -> str:
    out = []
    for token in template.split():
        if token == "[":
            out.append("(?:")
        elif token == "]":
            out.append(")?")
        elif token.startswith("{"):
            out.append(f"(?:[^ ]+ ){{0,{token[1:-1]}}}")
        else:
            out.append(f"{token} ")
    return " " + "".join(out)


def license_scan() -> str:
    starts = " || ".join(
        f"list_filter(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + {len(p.split()) - 1}], ' ') = '{p}')" for p in PHRASES
    )
    base = ", ".join(f"CASE WHEN contains(j, ' {p} ') THEN '{label}' END" for p, label in PHRASES.items())
    own = ", ".join(f"CASE WHEN regexp_matches(j, '{_template_pattern(t)}') THEN '{label}' END" for label, t in TEMPLATES.items())
    spelled = "array_to_string(list_sort(list_distinct(list_filter({0}, lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH docs AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
joined AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS j FROM docs),
found AS (SELECT doc_id, w, {starts} AS s, [{base}] AS b, [{own}] AS o FROM joined)
SELECT doc_id, len(w) AS n_words, len(s) AS n_base, list_min(s) - 1 AS first_word, list_max(s) - 1 AS last_word,
  {spelled.format('b')} AS base_labels, {spelled.format('b || o')} AS labels,
  CASE WHEN len(list_filter(o, lambda x: x IS NOT NULL)) > 0 THEN 1.0::DOUBLE WHEN len(s) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM found"""


def bm25(k: int = 10, every: int = 20, k1: float = 1.2, b: float = 0.75) -> str:
    return f"""
WITH docs AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
corpus AS (SELECT count(*)::DOUBLE AS n, sum(len(w))::DOUBLE / count(*) AS mean FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, unnest(w) AS term, len(w) AS size FROM docs) GROUP BY doc_id, term),
idf AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, corpus GROUP BY term),
parts AS (SELECT doc_id, term, tf * {k1 + 1}::DOUBLE / (tf + {k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * size / mean)) AS part FROM tf, corpus),
asked AS (SELECT doc_id AS query_id, term, idf FROM tf JOIN idf USING (term) WHERE doc_id % {every} = 0),
scored AS (SELECT query_id, doc_id, list_sum(list(idf * part ORDER BY term)) AS score FROM asked JOIN parts USING (term) GROUP BY query_id, doc_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM scored
QUALIFY rank <= {k}"""


def suffix_dedup(width: int = 100) -> str:
    return f"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(0, length(h) // 2 - {width - 1})) AS p, h FROM docs WHERE length(h) >= {2 * width}),
strings AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, {2 * width})) AS s FROM starts),
again AS (SELECT doc_id, p FROM strings QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
marked AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {width} THEN 0 ELSE 1 END AS fresh FROM again),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM marked),
runs AS (SELECT doc_id, g, min(p) AS b, max(p) + {width} AS e FROM grouped GROUP BY ALL),
gaps AS (SELECT r.doc_id, r.b, r.e, coalesce(lag(r.e) OVER (PARTITION BY r.doc_id ORDER BY r.b), 0) AS before FROM runs r),
kept AS (SELECT g.doc_id, count(*) AS n_spans, sum(e - b) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (b - before)), '' ORDER BY b)
  || substr(any_value(h), 2 * max(e) + 1) AS left_hex FROM gaps g JOIN docs USING (doc_id) GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(left_hex, h))) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)"""


def line_templates(depth: int = 2, min_docs: int = 3, min_tokens: int = 3) -> str:
    enough = "{0} >= " + str(min_tokens) + " AND 2 * {0} >= {1}"
    return f"""
WITH split AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS no FROM split),
masked AS (SELECT doc_id, no, string_split(regexp_replace(trim(line, ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') AS t FROM lines WHERE trim(line, ' ') <> ''),
forms AS (SELECT t, count(*) AS n FROM masked GROUP BY 1),
leaves AS (SELECT len(t) AS size, t[:{depth}] AS lead, count(*) AS n_forms, sum(n) AS n FROM forms GROUP BY ALL HAVING count(*) > 1 AND sum(n) >= {min_docs}),
open AS (SELECT t, size, lead, n_forms FROM forms JOIN leaves ON len(t) = size AND t[:{depth}] = lead),
places AS (SELECT t, size, lead, n_forms, unnest(t) AS token, generate_subscripts(t, 1) AS at_place FROM open),
common AS (SELECT size, lead, at_place, token FROM places GROUP BY size, lead, n_forms, at_place, token HAVING 2 * count(*) > n_forms),
shapes AS (SELECT p.t, list(coalesce(c.token, '<*>') ORDER BY p.at_place) AS shape FROM places p
  LEFT JOIN common c ON c.size = p.size AND c.lead = p.lead AND c.at_place = p.at_place AND c.token = p.token GROUP BY p.t),
keyed AS (SELECT f.t, CASE WHEN {enough.format("len(list_filter(s.shape, lambda x: x <> '<*>'))", "len(s.shape)")} THEN 's' || array_to_string(s.shape, ' ')
  WHEN {enough.format("len(list_filter(f.t, lambda x: x <> '<*>'))", "len(f.t)")} THEN 'f' || array_to_string(f.t, ' ') END AS key FROM forms f LEFT JOIN shapes s USING (t)),
seen AS (SELECT m.doc_id, m.no, len(m.t) AS size, m.t[:{depth}] AS lead, k.key FROM masked m JOIN keyed k USING (t) WHERE k.key IS NOT NULL),
often AS (SELECT size, lead, key, min({{'d': doc_id, 'n': no}}) AS head FROM seen GROUP BY ALL HAVING count(DISTINCT doc_id) >= {min_docs}),
dropped AS (SELECT doc_id, list_sort(list(no)) AS d FROM seen JOIN often USING (size, lead, key) WHERE NOT (doc_id = head.d AND no = head.n) GROUP BY 1)
SELECT doc_id, coalesce(len(d), 0) AS n_dropped, coalesce(array_to_string(d, ','), '') AS dropped_lines,
  sha256(CASE WHEN d IS NULL THEN coalesce(text, '') ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(d, i - 1)), chr(10)) END) AS kept_sha256
FROM split LEFT JOIN dropped USING (doc_id)"""


def paragraph_dedup(size: int = 5, least: float = 0.8) -> str:
    return f"""
WITH RECURSIVE split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS no, {_WORDS.format('unnest(l)')} AS w FROM split),
paras AS (SELECT doc_id, no, array_to_string(w, ' ') AS k, w FROM lines WHERE len(w) >= {size}),
reps AS (SELECT k, min({{'d': doc_id, 'n': no}}) AS head, any_value(w) AS w FROM paras GROUP BY 1),
ids AS (SELECT *, row_number() OVER (ORDER BY head) AS id FROM reps),
sets AS (SELECT id, list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' '))) AS g FROM ids),
grams AS (SELECT id, len(g) AS n, unnest(g) AS g FROM sets),
links AS (SELECT a.id AS x, b.id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n
  HAVING count(*) >= {least}::DOUBLE * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT DISTINCT x, x FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
classes AS (SELECT x AS id, min(y) AS c FROM reach GROUP BY 1),
heads AS (SELECT i.k, h.head FROM ids i LEFT JOIN classes USING (id) JOIN ids h ON h.id = coalesce(c, i.id)),
gone AS (SELECT doc_id, no, head FROM paras JOIN heads USING (k) WHERE NOT (doc_id = head.d AND no = head.n)),
found AS (SELECT doc_id, list(no) AS d, string_agg(no || ':' || head.d || ':' || head.n, ',' ORDER BY no) AS removed FROM gone GROUP BY 1)
SELECT doc_id, len(l) AS n_lines, coalesce(len(d), 0) AS n_removed, coalesce(removed, '') AS removed,
  sha256(CASE WHEN d IS NULL THEN array_to_string(l, chr(10)) ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(d, i - 1)), chr(10)) END) AS kept_sha256
FROM split LEFT JOIN found USING (doc_id)"""


_ENTITIES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (
        r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "len(list_filter(string_split(v, '.'), lambda p: NOT regexp_full_match(p, '0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])'))) = 0",
    ),
    "card": (
        r"[0-9](?:[ -]?[0-9])+",
        "length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda i: CASE WHEN i % 2 = 0 THEN substr(d, length(d) - i, 1)::INT "
        "ELSE (substr(d, length(d) - i, 1)::INT * 2) // 10 + (substr(d, length(d) - i, 1)::INT * 2) % 10 END)) % 10 = 0",
    ),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
}


def _spans_sql(source: str, pattern: str) -> str:
    """doc_id, s, e, v of the matches in the texts of a relation, in code points."""
    return f"""SELECT doc_id, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s,
  h[i] AS v, s + length(h[i]) AS e FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS h,
  unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) AS i FROM {source})"""


_GROUP = (
    "CASE kind WHEN 'email' THEN lower(split_part(v, '@', 2)) WHEN 'ip' THEN regexp_extract(v, '^[0-9]+\\.[0-9]+') "
    "WHEN 'card' THEN left(regexp_replace(v, '[^0-9]', '', 'g'), 6) ELSE left(regexp_replace(v, '[^0-9]', '', 'g'), 4) END"
)


def pii_disclosure(generalise: float = 0.8, remove: float = 0.95, z: float = 1.645, sure: float = 0.5) -> str:
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS k, '{kind}' AS kind, s, e, v FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM ({_spans_sql('docs', pattern)})) WHERE {valid}"
        for n, (kind, (pattern, valid)) in enumerate(_ENTITIES.items())
    )
    counts = ", ".join(f"coalesce(count_if(kind = '{k}'), 0) AS n_{k}" for k in _ENTITIES)
    term, zz = r"[\p{L}\p{N}]+", f"({z}::DOUBLE * {z}::DOUBLE)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS digest FROM documents),
base AS ({kinds}),
steps AS (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_end FROM base),
gaps AS (SELECT steps.*, CASE WHEN e > at_end THEN substr(text, at_end + 1, greatest(s - at_end, 0)) || ' ' ELSE '' END AS gap FROM steps JOIN docs USING (doc_id)),
outer_texts AS (SELECT g.doc_id, string_agg(gap, '' ORDER BY s, e, k) || any_value(substr(d.text, last_end + 1)) AS text
  FROM gaps g JOIN docs d USING (doc_id) JOIN (SELECT doc_id, max(e) AS last_end FROM base GROUP BY 1) USING (doc_id) GROUP BY 1),
texts AS (SELECT digest, any_value(coalesce(o.text, d.text)) AS text FROM docs d LEFT JOIN outer_texts o USING (doc_id) GROUP BY 1),
entities AS (SELECT DISTINCT kind, v, digest FROM base JOIN docs USING (doc_id)),
classes AS (SELECT DISTINCT kind, unnest([kind, kind || '|g|' || {_GROUP}, kind || '|v|' || v]) AS c, digest FROM entities),
known AS (SELECT c, count(*) AS n_c FROM classes GROUP BY 1),
words AS (SELECT digest, unnest(list_distinct(list_transform(regexp_extract_all(text, '{term}'), lambda x: lower(x)))) AS term FROM texts),
together AS (SELECT c, kind, term, count(*) AS n_ct FROM classes JOIN words USING (digest) GROUP BY ALL),
n_t AS (SELECT term, count(*)::DOUBLE AS n_t FROM words WHERE term IN (SELECT term FROM together) GROUP BY 1),
n AS (SELECT count(*)::DOUBLE AS n FROM texts),
shares AS (SELECT *, n_ct / n_t AS q FROM together JOIN n_t USING (term) JOIN known USING (c), n WHERE n > n_c),
bounds AS (SELECT *, (q + {zz} / (2 * n_t) - {z}::DOUBLE * sqrt(q * (1 - q) / n_t + {zz} / (4 * n_t * n_t))) / (1 + {zz} / n_t) AS p FROM shares),
risky AS (SELECT term, m.d AS d, m.k AS own FROM (SELECT term, max({{'d': ln(p * n / n_c) / ln(n / n_c), 'k': kind}}) AS m FROM bounds WHERE p >= {sure} GROUP BY 1) WHERE m.d >= {generalise}),
held AS (SELECT doc_id, text FROM docs WHERE digest IN (SELECT digest FROM words JOIN risky USING (term))),
runs AS ({_spans_sql('held', term)}),
added AS (SELECT doc_id, CASE WHEN d >= {remove} THEN 5 ELSE 4 END AS k, CASE WHEN d >= {remove} THEN 'removed' ELSE 'generalised' END AS kind, s, e, own
  FROM runs JOIN risky ON term = lower(v) WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = runs.doc_id AND b.s < runs.e AND runs.s < b.e)),
every AS (SELECT doc_id, k, kind, s, e, '<' || kind || '>' AS tag FROM base UNION ALL SELECT doc_id, k, kind, s, e, CASE k WHEN 5 THEN '' ELSE '<' || own || ' term>' END FROM added),
ordered AS (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e, tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_end FROM every),
pieces AS (SELECT o.*, CASE WHEN e > at_end THEN substr(text, at_end + 1, greatest(s - at_end, 0)) || tag ELSE '' END AS piece FROM ordered o JOIN docs USING (doc_id)),
found AS (SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4) AS base_spelled,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans, string_agg(piece, '' ORDER BY s, e, tag) AS pieces, max(e) AS last_end FROM pieces GROUP BY 1)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in _ENTITIES)}, sha256(coalesce(base_spelled, '')) AS base_sha256, coalesce(spans, '') AS spans,
  sha256(CASE WHEN last_end IS NULL THEN text ELSE pieces || substr(text, last_end + 1) END) AS sanitised_sha256 FROM docs LEFT JOIN found USING (doc_id)"""


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_FLOORED = "CASE WHEN n > 0 THEN (s - (((s % n) + n) % n)) // n ELSE old END"


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Exhaustive rounds: ``a`` tables are assignments, ``b`` tables codebooks with one row for each part and entry."""
    assign = "{0} AS MATERIALIZED (SELECT r, p, arg_min(k, d * 256 + k) AS k, min(d) AS d FROM (SELECT x.r, x.p, b.k, list_sum(list_transform(range(1, len(x.v) + 1), "
    assign += "lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))::BIGINT AS d FROM cut x JOIN {1} b ON b.p = x.p) GROUP BY r, p)"
    move = f"""b{{1}} AS MATERIALIZED (SELECT p, k, list({_FLOORED} ORDER BY i) AS v FROM (
  SELECT b.p, b.k, b.i, any_value(b.old) AS old, coalesce(sum(x.c), 0)::HUGEINT AS s, count(x.c) AS n
  FROM (SELECT p, k, unnest(v) AS old, generate_subscripts(v, 1) AS i FROM b{{0}}) b
  LEFT JOIN (SELECT a.p, a.k, unnest(x.v) AS c, generate_subscripts(x.v, 1) AS i FROM a{{0}} a JOIN cut x ON x.r = a.r AND x.p = a.p) x
  ON x.p = b.p AND x.k = b.k AND x.i = b.i GROUP BY ALL) GROUP BY p, k)"""
    steps = []
    for n in range(rounds):
        steps += [assign.format(f"a{n}", f"b{n}"), move.format(n, n + 1)]
    steps.append(assign.format(f"a{rounds}", f"b{rounds}"))
    return f"""
WITH ok AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale}::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_FINITE}),
kept AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r FROM ok),
cut AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS k, v FROM cut WHERE r <= {entries}),
{(',' + chr(10)).join(steps)},
coded AS (SELECT r, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), book"""


def centroids(dim: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1:") -> str:
    assign = "{0} AS MATERIALIZED (SELECT r, arg_min(k, d * 256 + k) AS k, min(d) AS d FROM (SELECT x.r, b.k, list_sum(list_transform(range(1, " + str(dim + 1) + "), "
    assign += "lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))::BIGINT AS d FROM kept x, {1} b) GROUP BY r)"
    move = f"""b{{1}} AS MATERIALIZED (SELECT k, list({_FLOORED} ORDER BY i) AS v FROM (
  SELECT b.k, b.i, any_value(b.old) AS old, coalesce(sum(x.c), 0)::HUGEINT AS s, count(x.c) AS n
  FROM (SELECT k, unnest(v) AS old, generate_subscripts(v, 1) AS i FROM b{{0}}) b
  LEFT JOIN (SELECT a.k, unnest(x.v) AS c, generate_subscripts(x.v, 1) AS i FROM a{{0}} a JOIN kept x USING (r)) x ON x.k = b.k AND x.i = b.i GROUP BY ALL) GROUP BY k)"""
    steps = []
    for n in range(rounds):
        steps += [assign.format(f"a{n}", f"b{n}"), move.format(n, n + 1)]
    steps.append(assign.format(f"a{rounds}", f"b{rounds}"))
    return f"""
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale}::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dim} AND {_FINITE}),
kept AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sha256('{seed}' || vec_id) NULLS LAST, v) AS r FROM ok),
b0 AS MATERIALIZED (SELECT r - 1 AS k, v FROM kept WHERE r <= {k}),
{(',' + chr(10)).join(steps)}
SELECT vec_id, a.k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(b.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN kept USING (r) JOIN b{rounds} b ON b.k = a.k"""


def secret_scan() -> str:
    """Every pattern over every text; rows are numbered, as ids may repeat."""
    parts = []
    for n, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        long_enough = f"length(regexp_extract(v, '{pattern}', {r.group})) >= {r.least}"
        parts.append(f"SELECT doc_id, {n} AS k, '{r.kind}' AS kind, s, e FROM ({_spans_sql('numbered', pattern)}) WHERE {long_enough}")
    counts = ", ".join(f"count_if(kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    kinds = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS doc_id, doc_id AS own, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(parts)}),
told AS (SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (kind IN ({kinds})) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM found GROUP BY 1)
SELECT own AS doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM numbered LEFT JOIN told USING (doc_id)"""


ORACLE_SQL = {
    "op1_bm25_topk": bm25(),
    "op2_paragraph_dedup": paragraph_dedup(),
    "op3_pii_disclosure": pii_disclosure(),
    "op6_suffix_dedup": suffix_dedup(),
    "op7_decontaminate": decontaminate(),
    "op8_license_scan": license_scan(),
    "op9_line_templates": line_templates(),
    "op11_vector_codes": vector_codes(),
    "op12_centroids": centroids(),
    "op13_secret_scan": secret_scan(),
}
