"""DuckDB SQL for the queries that SQL can express over whole tables.

Not here: op4's scores (a model fitted by expectation maximisation), op7's copies (Newton iterations), op8's spans
(decoding) and op10's runs (SQL would try every place of every text). Their tests hold them against plain versions.
"""

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"regexp_extract_all(coalesce(" + _LOWER + r", ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = f"""
WITH d AS (SELECT doc_id, {_TERMS.format("text")} AS w FROM documents),
i AS (SELECT DISTINCT item_id::VARCHAR AS item_id, {_TERMS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
items AS (SELECT row_number() OVER () AS k, item_id, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
item_windows AS (SELECT k, item_id, n, min(s) AS s, win FROM (SELECT k, item_id, n, s, w[s + 1 : s + n] AS win FROM items, unnest(range(len(w) - n + 1)) AS t(s)) GROUP BY k, item_id, n, win),
sizes AS (SELECT DISTINCT n FROM items),
hits AS (SELECT d.doc_id, p, n, item_id FROM (SELECT doc_id, n, p, w[p + 1 : p + n] AS win FROM d, sizes, unnest(range(greatest(len(w) - n + 1, 0))) AS t(p)) d JOIN item_windows USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hits, unnest(range(p, p + n)) AS t(q) GROUP BY doc_id),
met AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id),
item_words AS (SELECT k, place - 1 AS place, term FROM (SELECT k, unnest(w) AS term, generate_subscripts(w, 1) AS place FROM items)),
doc_words AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS position FROM d),
freq AS (SELECT term, count(*) AS c FROM doc_words WHERE term IN (SELECT term FROM item_words) GROUP BY term),
ranked AS (SELECT iw.k, iw.s, x.place, x.term, row_number() OVER (PARTITION BY iw.k, iw.s ORDER BY coalesce(c, 0), x.place) AS r
  FROM item_windows iw JOIN item_words x ON x.k = iw.k AND x.place BETWEEN iw.s AND iw.s + iw.n - 1 LEFT JOIN freq USING (term)),
pairs AS (SELECT DISTINCT k, min(place) AS a, max(place) AS b, arg_min(term, place) AS ta, arg_max(term, place) AS tb FROM ranked WHERE r <= 2 GROUP BY k, s HAVING count(*) = 2),
sides AS (SELECT k, a, b, a AS place, ta AS term FROM pairs UNION ALL SELECT k, a, b, b, tb FROM pairs),
lists AS (SELECT doc_id, k, a, b, place, position - place AS off, position FROM doc_words JOIN sides USING (term)),
near AS (SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, k, place, off, lag(place) OVER o AS other, off - lag(off) OVER o AS drift FROM lists
  WINDOW o AS (PARTITION BY doc_id, k, a, b ORDER BY off, place, position)) JOIN items USING (k) WHERE other <> place AND drift <= 5)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(m, 0) AS n_near_items
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN met USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS m FROM near GROUP BY doc_id) USING (doc_id)"""

_OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
windows AS (SELECT doc_id, p, sha256(array_to_string(w[p : p + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(p)),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, q AS position FROM late, unnest(range(p, p + 50)) AS t(q)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS position FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY position) AS rest, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, position) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_OP3 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""

_OP5 = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(text, '') AS t FROM documents),
grams AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS times FROM (SELECT doc_id, p, w[p : p + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS t(p))),
repeated AS (SELECT doc_id, count(DISTINCT q) AS n FROM grams, unnest([p, p + 1, p + 2]) AS t(q) WHERE times > 1 GROUP BY doc_id),
top AS (SELECT doc_id, max(c) AS n FROM (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY 1, 2) GROUP BY doc_id),
f AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, len(lines) AS n_lines, coalesce(top.n, 0) AS top_word,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS lettered,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•·‣]'))) AS bullets, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS cut_off
  FROM d LEFT JOIN repeated USING (doc_id) LEFT JOIN top USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR word_chars NOT BETWEEN 3 * n_words AND 10 * n_words
  OR 5 * n_dup_lines > 2 * n_lines OR 10 * lettered < 7 * n_words OR 10 * top_word > 3 * n_words OR 10 * bullets > 9 * n_lines OR 10 * cut_off > 3 * n_lines) AS kept FROM b"""

_SAID = "'</s>[INST] ok [/INST]'"


def _length(text: str) -> str:
    """Characters of a text once its backslashes are doubled and its control strings broken."""
    return rf"(length({text}) + length({text}) - length(replace({text}, '\', '')) + len(regexp_extract_all({text}, '<s>|</s>|\[INST\]|\[/INST\]|\[OUT\]')))"


_OP6 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', {_SAID}), (-7, 1, 'assistant', {_SAID})),
l AS (SELECT *, {_length("role")} + length(role) - length(replace(role, chr(10), '')) + 1 + {_length("text")} + CASE role WHEN 'assistant' THEN 9 ELSE 13 END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(3 + sum(chars) AS BIGINT) AS formatted_chars FROM l GROUP BY conv_id"""

_OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, w[p : p + 4] AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(p) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v),
found AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN sizes USING (doc_id) JOIN found USING (doc_id)"""

_INTEGERS = """SELECT row_number() OVER () AS k, *, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"""
_SCORE = "list_inner_product({0}.v, {1}.v)::BIGINT"

_OP11 = f"""
WITH r AS (SELECT k, vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM ({_INTEGERS}) WHERE label IS NOT NULL),
s AS (SELECT a.k AS anchor, a.vec_id AS anchor_id, x.k, x.vec_id, x.label = a.label AS same, {_SCORE.format("a", "x")} AS score FROM r a JOIN r x ON a.k <> x.k WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY anchor, p.k ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n USING (anchor) WHERE NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY anchor, p.k ORDER BY n.score DESC, n.vec_id) <= 3"""

_OP12 = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
f AS (SELECT lang, p, len(p) AS m, count(*) AS f FROM (SELECT lang, w[s : s + m - 1] AS p FROM w, unnest([1, 2, 3, 4]) AS l(m), unnest(range(1, len(w) - m + 2)) AS t(s)) GROUP BY lang, p),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND f >= 30),
cuts AS (SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1 : c.m]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_parts AS (SELECT DISTINCT c.lang, c.f AS longer, c.p[s : s + q - 1] AS p FROM c, unnest(range(2, m)) AS l(q), unnest(range(1, m - q + 2)) AS t(s)),
gone AS (SELECT DISTINCT b.lang, b.p FROM best b JOIN inner_parts i ON i.lang = b.lang AND i.p = b.p WHERE 100 * i.longer >= 80 * b.a),
ranked AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score::BIGINT AS score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM best ANTI JOIN gone USING (lang, p))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

_OP13 = f"""
WITH r AS ({_INTEGERS})
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.k ORDER BY {_SCORE.format("q", "c")} DESC, c.vec_id)::INTEGER AS rank, c.vec_id, {_SCORE.format("q", "c")} AS score
FROM r q JOIN r c ON q.k <> c.k WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5"""

SQL: dict[str, str] = {"op1_decontaminate": _OP1, "op2_repeats": _OP2, "op3_warc": _OP3, "op5_quality": _OP5, "op6_chat": _OP6, "op9_near": _OP9, "op11_negatives": _OP11, "op12_collocations": _OP12, "op13_topk": _OP13}
