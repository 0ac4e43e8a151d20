"""DuckDB SQL for the queries of registry.py."""

from fieldglass.functions.text import BLANK, ENTITIES
from fieldglass.plans import adjudication, alerts, delivery, enrichment, ledger, payloads, places, relevance, rows, snapshot, stored, texts
from fieldglass.plans.mentions import DOCUMENTS_SQL, MENTIONS_SQL

_M, _D = MENTIONS_SQL, DOCUMENTS_SQL

_METRICS = """, ends AS (SELECT data_origin, max(seen_at) AS e FROM live GROUP BY 1),
r AS (SELECT l.*, e, seen_at > e - INTERVAL 7 DAYS AND seen_at <= e AS nw, seen_at > e - INTERVAL 35 DAYS AND seen_at <= e - INTERVAL 7 DAYS AS bf FROM live l JOIN ends USING (data_origin)),
wm AS (SELECT data_origin, topic, count(*) FILTER (nw) AS mentions, count(*) AS lifetime, count(DISTINCT author_id) FILTER (nw) AS voices,
  count(DISTINCT district) FILTER (nw) AS districts, count(DISTINCT platform) FILTER (nw) AS source_types, (count(*) FILTER (bf)) / 4.0::DOUBLE AS weekly,
  count(*) FILTER (nw AND stance IS NOT NULL) AS carrying,
  round(count(*) FILTER (nw AND stance = 'critical') / nullif(count(*) FILTER (nw AND stance IS NOT NULL), 0)::DOUBLE, 6) AS concern,
  round(count(*) FILTER (nw AND stance = 'supportive') / nullif(count(*) FILTER (nw AND stance IS NOT NULL), 0)::DOUBLE, 6) AS supportive,
  round(count(*) FILTER (bf AND stance = 'critical') / nullif(count(*) FILTER (bf AND stance IS NOT NULL), 0)::DOUBLE, 6) AS base_concern,
  count(*) FILTER (nw AND author_type = 'government' AND stance = 'supportive') AS official_support,
  round(count(*) FILTER (nw AND author_type <> 'government' AND stance = 'critical') / nullif(count(*) FILTER (nw AND author_type <> 'government' AND stance IS NOT NULL), 0)::DOUBLE, 6) AS public_concern
  FROM r GROUP BY 1, 2 HAVING count(*) FILTER (nw) > 0)"""

_FINDINGS = (
    _METRICS
    + """,
f AS (SELECT data_origin, topic, mentions, voices, districts, source_types,
  CASE WHEN mentions >= 6 AND districts >= 2 AND source_types >= 3 THEN 'emerging' WHEN mentions >= 2 THEN 'watch' END AS category,
  CASE WHEN carrying = 0 THEN 'coverage' WHEN supportive >= 0.5 AND supportive > concern THEN 'positive' WHEN concern >= 0.5 THEN 'concern'
    WHEN concern >= 0.2 AND concern - base_concern >= 0.15 THEN 'escalating' ELSE 'coverage' END AS signal,
  CASE WHEN weekly = 0 THEN CASE WHEN lifetime > mentions THEN 'resurfacing' ELSE 'new' END WHEN mentions / weekly >= 1.5 THEN 'rising'
    WHEN mentions / weekly <= 1 / 1.5::DOUBLE THEN 'falling' ELSE 'steady' END AS trajectory,
  official_support > 0 AND coalesce(public_concern, 0) >= 0.5 AS divergence,
  round(least(0.9::DOUBLE, 0.35::DOUBLE + 0.04::DOUBLE * voices + 0.06::DOUBLE * source_types), 6) AS confidence,
  round(least(mentions, 20) * 0.5::DOUBLE + least(voices, 10) + least(districts, 8) * 1.5::DOUBLE
    + 2 * least(coalesce(CASE WHEN weekly <> 0 THEN mentions / weekly END, 4), 4)
    + 4 * coalesce(concern, 0) + 5 * greatest(0, coalesce(concern, 0) - coalesce(base_concern, coalesce(concern, 0))), 4) AS score
  FROM wm),
ranked AS (SELECT *, row_number() OVER (PARTITION BY data_origin ORDER BY score DESC, topic) AS rank FROM f WHERE category IS NOT NULL)"""
)

_BALANCE = """, c AS (SELECT data_origin, district, count(*) FILTER (stance = 'supportive') AS favourable, count(*) FILTER (stance = 'critical') AS unfavourable, count(*) AS mentions
  FROM live WHERE district IS NOT NULL GROUP BY 1, 2), b AS (SELECT *, (favourable - unfavourable) / nullif(favourable + unfavourable, 0)::DOUBLE AS bal FROM c),
t AS (SELECT data_origin, district, topic, row_number() OVER (PARTITION BY data_origin, district ORDER BY count(*) DESC, topic) AS r FROM live WHERE district IS NOT NULL GROUP BY 1, 2, 3)"""

_NORMAL = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_TOKENS = "list_filter(string_split(" + _NORMAL + ", ' '), lambda x: x <> '')"
_WORDS = _TOKENS.format("text")
_CORE = "list_distinct(list_filter(" + _TOKENS + ", lambda x: length(x) > 1 AND x NOT IN ('a','an','and','as','at','by','for','from','in','is','of','on','the','to')))"


def _hit(where: str, word: str) -> str:
    return f"CASE WHEN regexp_matches({where}, '(?i)(?:^|[^a-z])(?:{word})(?:[^a-z]|$)') THEN 1 ELSE 0 END"


_TITLE = "split_part(text, chr(10), 1)"
_IN_TITLE = "(" + " + ".join(_hit(_TITLE, w) for w in ("and", "que", "und")) + ")"
_IN_BODY = "(" + " + ".join(_hit("text", w) for w in ("with", "que", "der")) + ")"

_EXACT = (
    _D
    + ", h AS (SELECT *, sha256("
    + _NORMAL.format("text")
    + ") AS ch FROM mentions), ex AS (SELECT data_origin, mention_id, first_value(mention_id) OVER (PARTITION BY data_origin, ch ORDER BY seen_at NULLS LAST, mention_id) AS canonical_id FROM h)"
)

_PAGE = "html"
_PAGE = f"regexp_replace({_PAGE}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"
_PAGE = rf"regexp_replace({_PAGE}, '(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|ul|ol|table|section|article)>', chr(10), 'g')"
_PAGE = f"regexp_replace({_PAGE}, '<[^>]+>', ' ', 'g')"
for _a, _b in ENTITIES:
    _PAGE = f"regexp_replace({_PAGE}, '(?i){_a}', '" + _b.replace("'", "''") + "', 'g')"
_PAGE = rf"regexp_replace({_PAGE}, '[ \t\r\x{{A0}}]+', ' ', 'g')"
_PAGE = rf"regexp_replace(regexp_replace(regexp_replace({_PAGE}, ' ?\n ?', chr(10), 'g'), '\n{{2,}}', chr(10), 'g'), '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"

SQL: dict[str, str] = {
    "win01_ranked_findings": _M + _FINDINGS + " SELECT data_origin, topic, mentions, voices, districts, source_types, category, signal, trajectory, divergence, confidence, score, rank FROM ranked",
    "agg01_environment": _M + " SELECT count(*) AS mentions, count(*) FILTER (NOT is_duplicate) AS relevant, count(DISTINCT data_origin) AS origins, arg_min(data_origin, CASE data_origin WHEN 'live' THEN 0 WHEN 'verified_snapshot' THEN 1 ELSE 2 END) AS active_origin, max(seen_at) AS newest FROM mentions",
    "agg04_daily_histogram": _M + " SELECT data_origin, strftime(seen_at, '%Y-%m-%d') AS day, count(*) AS n FROM live GROUP BY 1, 2",
    "agg05_district_overview": _M + " SELECT data_origin, district, count(*) AS mentions, count(DISTINCT coalesce(author_id, mention_id)) AS voices, count(stance) AS carrying, round(count(*) FILTER (stance = 'critical') / nullif(count(stance), 0)::DOUBLE, 6) AS critical_share FROM live WHERE district IS NOT NULL GROUP BY 1, 2",
    "agg06_coverage_balance": _M + _BALANCE + " SELECT b.data_origin, b.district, favourable, unfavourable, mentions, round(bal, 6) AS balance, CAST(CASE WHEN bal IS NULL OR bal = 0 THEN 0 ELSE sign(bal) * CASE WHEN abs(bal) < 0.34 THEN 1 WHEN abs(bal) < 0.67 THEN 2 ELSE 3 END END AS BIGINT) AS step, t.topic AS top_topic FROM b JOIN t ON t.r = 1 AND t.data_origin = b.data_origin AND t.district = b.district",
    "agg07_coverage_counts": _M + " SELECT data_origin, district, CAST(grouping(district) AS BIGINT) AS level, count(*) AS mentions, count(DISTINCT author_id) AS voices, count(*) FILTER (stance = 'critical') AS critical FROM live GROUP BY GROUPING SETS ((data_origin), (data_origin, district)) HAVING grouping(district) = 1 OR district IS NOT NULL",
    "agg08_composition_mix": _M + ", p AS (SELECT data_origin, 'voice' AS kind, coalesce(author_type, 'unknown') AS bucket, count(*) AS n FROM live GROUP BY 1, 2, 3 UNION ALL SELECT data_origin, 'platform', platform, count(*) FROM live GROUP BY 1, 2, 3) SELECT data_origin, kind, bucket, n, round(n / CAST(sum(n) OVER (PARTITION BY data_origin, kind) AS DOUBLE), 6) AS share FROM p",
    "agg09_narrative_metrics": _M + " SELECT data_origin, topic, count(*) AS mentions, count(DISTINCT coalesce(author_id, mention_id)) AS voices, count(*) FILTER (platform = 'official') AS official, round(sum(value), 2) AS value, min(seen_at) AS first_at, max(seen_at) AS last_at FROM live GROUP BY 1, 2",
    "agg09_stance_by_voice": _M + " SELECT data_origin, topic, author_type, coalesce(stance, 'none') AS stance, count(*) AS n FROM live GROUP BY 1, 2, 3, 4",
    "agg10_window_end": _M + " SELECT data_origin, max(seen_at) AS window_end FROM live GROUP BY 1",
    "agg11_window_metrics": _M + _METRICS + " SELECT * FROM wm",
    "agg12_query_yield": "WITH i AS (SELECT l_orderkey, count(*) AS items, count(*) FILTER (l_returnflag = 'R') AS rejected FROM lineitem GROUP BY 1), r AS (SELECT o_custkey, count(*) AS runs, sum(items) AS items, sum(rejected) AS rejected, max(o_orderdate) AS last_run FROM orders LEFT JOIN i ON l_orderkey = o_orderkey GROUP BY 1) SELECT c_custkey AS plan, c_mktsegment AS tier, coalesce(runs, 0) AS runs, CAST(coalesce(items, 0) AS BIGINT) AS items, CAST(coalesce(rejected, 0) AS BIGINT) AS rejected, last_run FROM customer LEFT JOIN r ON o_custkey = c_custkey",
    "agg13_quality": _M + " SELECT data_origin, count(*) AS mentions, round(count(*) FILTER (is_duplicate) / count(*)::DOUBLE, 6) AS duplicate_share, round(count(district) / count(*)::DOUBLE, 6) AS located_share, round(count(stance) / count(*)::DOUBLE, 6) AS stance_share FROM mentions GROUP BY 1",
    "agg15_version_histogram": "WITH v AS (SELECT CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INT) % 5 END AS v FROM events) SELECT coalesce(CAST(v AS VARCHAR), 'none') AS version, count(*) AS n FROM v WHERE v IS DISTINCT FROM 3 GROUP BY 1",
    "agg18_manifest": _M + " SELECT data_origin, count(*) AS rows, array_to_string(list_sort(list(DISTINCT platform)), ',') AS platforms, min(seen_at) AS first_at, max(seen_at) AS last_at FROM mentions GROUP BY 1",
    "agg19_voice_classes": _M + " SELECT data_origin, CASE WHEN author_type IN ('farmer', 'fpo') THEN 'producers' WHEN author_type = 'media' THEN 'media' WHEN author_type = 'government' THEN 'government' WHEN author_type IN ('expert', 'citizen') THEN 'public' ELSE 'unknown' END AS voice_class, count(*) AS n FROM live GROUP BY 1, 2",
    "agg20_brief_totals": _M + " SELECT data_origin, count(*) AS mentions, count(DISTINCT district) AS districts, count(DISTINCT topic) AS topics FROM live GROUP BY 1",
    "agg21_topic_candidates": _M + ", s AS (SELECT data_origin, topic, subtopic, count(*) AS n FROM live GROUP BY 1, 2, 3 HAVING count(*) >= 3) SELECT * FROM s UNION ALL SELECT data_origin, topic, CAST(NULL AS INT) AS subtopic, count(*) AS n FROM live l WHERE NOT EXISTS (FROM s WHERE s.data_origin = l.data_origin AND s.topic = l.topic AND s.subtopic = l.subtopic) GROUP BY 1, 2 HAVING count(*) >= 2",
    "arr01_headline_core": "SELECT doc_id, array_to_string(list_sort(" + _CORE.format(f"split_part({_TITLE}, '|', 1)") + "), ' ') AS core FROM documents",
    "dat04_seasonal_urgency": _M + ", s AS (SELECT *, month(seen_at) * 100 + day(seen_at) AS md, topic * 100 + 15 AS a, ((topic + 1) % 13) * 100 + 10 AS b FROM live) SELECT data_origin, topic, CASE WHEN CASE WHEN a <= b THEN md >= a AND md <= b ELSE md >= a OR md <= b END THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END AS urgency, count(*) AS n FROM s GROUP BY 1, 2, 3",
    "jn09_evidence_star": "SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS roles, count(*) AS turns FROM conversations GROUP BY 1",
    "jn15_dictionary_match": r"SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)(?:^|[^a-z])(?:license|licensed)(?:[^a-z]|$)') AND NOT regexp_matches(text, '(?i)(?:^|[^a-z])(?:apache)(?:[^a-z]|$)') THEN 'license' END, CASE WHEN regexp_matches(text, '(?i)(?:^|[^a-z])(?:token|password)(?:[^a-z]|$)') THEN 'secret' END, CASE WHEN regexp_matches(text, '(?i)(?:^|[^a-z])(?:the|der|les)(?:[^a-z]|$)') THEN 'the' END], lambda x: x IS NOT NULL), ',') AS terms FROM documents",
    "jn17_anti_new_rows": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "jn21_trace": _M + " SELECT author_id, row_number() OVER (PARTITION BY author_id ORDER BY seen_at, mention_id) AS step, mention_id, data_origin, platform FROM mentions",
    "jsn02_contract": "WITH e AS (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type FROM events) SELECT CASE WHEN coalesce(k BETWEEN 0 AND 49 AND event_type IN ('click', 'view', 'purchase'), false) THEN 'accepted' ELSE 'failed' END AS branch, count(*) AS n, CAST(sum(coalesce(k, 0)) AS BIGINT) AS total FROM e GROUP BY 1",
    "scr01_relevance": f"WITH s AS (SELECT doc_id, round(least((CASE WHEN {_IN_TITLE} > 0 THEN 0.6 ELSE 0 END)::DOUBLE + (CASE WHEN {_IN_TITLE} > 1 THEN 0.2 ELSE 0 END)::DOUBLE + least(0.3::DOUBLE, 0.15::DOUBLE * {_IN_BODY}), 1::DOUBLE), 6) AS topical, round(greatest(0::DOUBLE, least(1::DOUBLE, (CASE WHEN lang IN ('en', 'de') THEN 0.6 ELSE 0 END)::DOUBLE - (CASE WHEN {_hit('text', 'les')} = 1 THEN 0.15 ELSE 0 END)::DOUBLE)), 6) AS regional FROM documents) SELECT *, topical >= 0.5 AND regional >= 0.4 AS accepted FROM s",
    "scr20_lens": _M + _BALANCE + " SELECT * FROM (SELECT data_origin, district, 'all' AS lens, mentions AS total FROM c UNION ALL SELECT data_origin, district, 'concern', unfavourable FROM c UNION ALL SELECT data_origin, district, 'positive', favourable FROM c) WHERE total > 0",
    "set05_cross_plan": r"SELECT issue || ' ' || regexp_replace(lower(n_name), '\s+', '-', 'g') AS query, language, 'C' AS tier FROM nation, (SELECT unnest(['prices', 'water', 'power', 'roads']) AS issue), (SELECT unnest(['en', 'te']) AS language)",
    "snk10_superseded": "SELECT CASE WHEN o_orderdate = m THEN 'active' ELSE 'superseded' END AS status, count(*) AS n FROM (SELECT o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders) GROUP BY 1",
    "snk12_last_wins": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    "snk16_snapshot_remap": _M + " SELECT sha256('snap:' || mention_id) AS mention_key, 'verified_snapshot' AS data_origin, platform, seen_at FROM mentions WHERE data_origin = 'live'",
    "srt01_feed_topk": _D + " SELECT data_origin, place, mention_id, seen_at FROM (SELECT *, row_number() OVER (PARTITION BY data_origin ORDER BY seen_at DESC NULLS FIRST, mention_id) AS place FROM mentions) WHERE place <= 30",
    "srt04_evidence_order": _M + " SELECT data_origin, topic, place, mention_id FROM (SELECT *, row_number() OVER (PARTITION BY data_origin, topic ORDER BY platform = 'official', coalesce(seen_at, TIMESTAMP '1970-01-01') DESC, mention_id) AS place FROM live) WHERE place <= 6",
    "srt05_due_queries": "SELECT o_orderstatus, place, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM orders) WHERE place <= 20",
    "srt07_alert_order": _M + _FINDINGS + " SELECT data_origin, topic, place, rank FROM (SELECT *, row_number() OVER (PARTITION BY data_origin ORDER BY divergence DESC, rank DESC) AS place FROM ranked WHERE topic % 4 <> 0) WHERE place <= 3",
    "stg05_exact_dups": _EXACT + " SELECT data_origin, mention_id, canonical_id FROM ex",
    "stg05_near_pairs": _EXACT
    + f""", w AS (SELECT m.data_origin, m.mention_id, m.seen_at, {_WORDS} AS w, {_CORE.format("split_part(title, '|', 1)")} AS core FROM mentions m JOIN ex ON ex.mention_id = m.mention_id AND ex.canonical_id = m.mention_id),
g AS (SELECT data_origin, mention_id, seen_at, core, list_distinct(w) AS uni, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS bi FROM w),
x AS (SELECT data_origin, mention_id, len(bi) AS n, unnest(bi) AS gram FROM g),
o AS (SELECT a.data_origin, a.mention_id AS p, b.mention_id AS q, count(*) AS shared, any_value(a.n + b.n) AS n FROM x a JOIN x b ON a.data_origin = b.data_origin AND a.gram = b.gram AND a.mention_id < b.mention_id GROUP BY 1, 2, 3),
s AS (SELECT *, shared / (n - shared)::DOUBLE AS score FROM o WHERE shared / (n - shared)::DOUBLE >= 0.4),
k AS (SELECT s.*, len(list_intersect(a.uni, b.uni)) / len(list_distinct(list_concat(a.uni, b.uni)))::DOUBLE AS u, CASE WHEN len(a.core) = 0 OR len(b.core) = 0 THEN 1 ELSE len(list_intersect(a.core, b.core)) / len(list_distinct(list_concat(a.core, b.core)))::DOUBLE END AS t,
  (coalesce(a.seen_at, TIMESTAMP '9999-01-01'), p) < (coalesce(b.seen_at, TIMESTAMP '9999-01-01'), q) AS forward FROM s JOIN g a ON a.mention_id = p JOIN g b ON b.mention_id = q)
SELECT data_origin, CASE WHEN forward THEN p ELSE q END AS a, CASE WHEN forward THEN q ELSE p END AS b, round(score, 6) AS score FROM k WHERE u >= 0.6 AND t >= 0.3""",
    "txt01_normalize": "SELECT doc_id, sha256(" + _NORMAL.format("text") + ") AS content_hash FROM documents",
    "txt03_shingle_counts": f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT doc_id, len(list_distinct(w)) AS n1, len(list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS n2 FROM w",
    "txt13_html_to_text": f"WITH t AS (SELECT page_id, {_PAGE} AS t FROM pages) SELECT page_id, sha256(t) AS text_hash, length(t) AS chars FROM t",
    "txt14_extract_image": """SELECT page_id, nullif(regexp_extract(html, '(?i)<img[^>]+src="([^"]+)"', 1), '') AS image FROM pages""",
    "txt17_language_ratio": r"WITH s AS (SELECT doc_id, round(CASE WHEN length(regexp_replace(text, '[^\p{L}\p{M}]', '', 'g')) = 0 THEN 0 ELSE length(regexp_replace(text, '[^\x{00C0}-\x{00FF}]', '', 'g')) / length(regexp_replace(text, '[^\p{L}\p{M}]', '', 'g'))::DOUBLE END, 6) AS share FROM documents) SELECT *, CASE WHEN share > 0.15 THEN 'marked' WHEN share > 0.02 THEN 'mixed' ELSE 'plain' END AS kind FROM s",
    "win02_snapshot_delta": _M + ", d AS (SELECT data_origin, topic, strftime(seen_at, '%Y-%m-%d') AS day, count(*) AS n FROM live GROUP BY 1, 2, 3), c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY data_origin, topic ORDER BY day) AS BIGINT) AS mentions FROM d) SELECT data_origin, topic, day, mentions, CAST(greatest(0, mentions - lag(mentions, 1, 0) OVER (PARTITION BY data_origin, topic ORDER BY day)) AS BIGINT) AS new FROM c",
    "win04_trend_status": _M + ", ends AS (SELECT data_origin, max(seen_at) AS e FROM live GROUP BY 1), t AS (SELECT data_origin, topic, e, count(*) FILTER (seen_at > e - INTERVAL 2 DAYS) AS recent, count(*) FILTER (seen_at <= e - INTERVAL 2 DAYS AND seen_at > e - INTERVAL 4 DAYS) AS earlier, min(seen_at) AS f, max(seen_at) FILTER (seen_at <= e - INTERVAL 2 DAYS) AS lb, max(seen_at) AS l FROM live JOIN ends USING (data_origin) GROUP BY 1, 2, 3) SELECT data_origin, topic, recent, earlier, CASE WHEN f > e - INTERVAL 2 DAYS THEN 'emerging' WHEN recent > 0 AND lb <= l - INTERVAL 7 DAYS THEN 'resurfacing' WHEN recent > 0 AND recent >= 1.5 * earlier THEN 'rising' WHEN recent <= 0.5 * earlier THEN 'falling' ELSE 'stable' END AS status FROM t",
    "win05_rolling_baseline": _M + ", d AS (SELECT topic, CAST(seen_at AS DATE) AS day, count(*) AS n FROM live GROUP BY 1, 2) SELECT topic, strftime(day, '%Y-%m-%d') AS day, n, round(CAST(sum(n) OVER (PARTITION BY topic ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS DOUBLE) / 7.0, 6) AS baseline FROM d",
    "win06_first_narrative": _M + " SELECT data_origin, author_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY data_origin, author_id ORDER BY seen_at, mention_id) AS r FROM live) WHERE r = 1",
    "win08_argmax_topic": _M + ", c AS (SELECT data_origin, platform, topic, count(*) AS n FROM live GROUP BY 1, 2, 3) SELECT data_origin, platform, topic, n FROM (SELECT *, row_number() OVER (PARTITION BY data_origin, platform ORDER BY n DESC, topic) AS r FROM c) WHERE r = 1",
    "win09_top3_districts": _M + ", c AS (SELECT data_origin, topic, district, row_number() OVER (PARTITION BY data_origin, topic ORDER BY count(*) DESC, district) AS r FROM live WHERE district IS NOT NULL GROUP BY 1, 2, 3) SELECT data_origin, topic, string_agg(district, ', ' ORDER BY r) FILTER (r <= 3) AS districts, greatest(count(*) - 3, 0) AS more FROM c GROUP BY 1, 2",
} | rows.sql(_FINDINGS, _EXACT) | alerts.sql(_FINDINGS) | enrichment.sql(_METRICS)
SQL |= delivery.sql(SQL["scr14_finding_texts"], SQL["src13_transcripts"])
SQL |= texts.SQL
SQL |= payloads.SQL
SQL |= ledger.sql(_FINDINGS, _EXACT)
SQL |= relevance.SQL
SQL |= stored.SQL
SQL |= snapshot.SQL | places.SQL | adjudication.sql(_M)
SQL |= {
    "str02_dedupe_stream": "SELECT DISTINCT event_id, user_id FROM events",
    "str04_sliding_window_stream": "WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 12 HOUR]) AS s FROM events) SELECT s AS start, s + INTERVAL 1 DAY AS end, event_type, count(*) AS n FROM w GROUP BY s, event_type",
    "str08_session_stream": "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, count(*) AS n FROM s GROUP BY user_id, session",
}
