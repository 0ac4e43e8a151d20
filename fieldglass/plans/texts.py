"""Text rules bound to the testdata's documents and events. SQL has the DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import rules, wording
from fieldglass.functions import text as T

GOOD, BAD, HANDLES = ["no shortage", "con ", "the "], ["shortage", "not", "que"], ["nation01", "user7", "user12"]
#: Lines that some documents get at their end, as few have any that the rules are about.
TAILS = [
    ["#a | #b | #c | #d", ",,,,,", "Report on issue #12", "word#tag #one", "last", "last", "Rain in the north #x #y", "a, b, c, d, e"],
    ["https://a.example/b", "#one#two", "  a b , c d , , e f, g h, i", "#x words here and there", "  Follow US on x", "after it"],
    ["a, b, c, one two three four five six seven, d", "tail text #x #y_1  ", "-----", "#é tag é", " ", "tail text"],
]
ENVELOPES = ['{"result": "over quota", "api_error_status": 429}', '{"result": "expired"}', "{}", "not json", '{"result": ""}']


def _pick(values: list[str], by: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.col(by) % len(values))


def _documents(plan: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _events(plan: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: plan(spark.read.parquet(f"{sf_dir}/events.parquet"))


def with_tail(docs: DataFrame) -> DataFrame:
    """docs whose whole text ends in one of the tails."""
    tails = F.array(*[F.lit("\n" + "\n".join(t)) for t in TAILS])
    return docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.get(tails, F.col("doc_id") % len(TAILS))))


def _noise(docs: DataFrame) -> DataFrame:
    """Of all lines of each text: how many are noise of either kind, and all without their trailing hashtags."""
    lines = T.once(with_tail(docs), "lines", F.split("text", "\r?\n"))
    count = lambda rule: F.size(F.filter("lines", rule)).cast("long")
    return lines.select("doc_id", count(T.is_hashtag_noise).alias("hashtags"), count(T.is_keyword_stuffing).alias("stuffed"), F.sha2(F.array_join(F.transform("lines", T.without_trailing_hashtags), "\n"), 256).alias("bare_hash"))


def _content(docs: DataFrame) -> DataFrame:
    """The cleaned body of each whole text under its title: its first line, another, or none."""
    cleaned = T.cleaned_lines(with_tail(docs))
    title = F.when(F.col("doc_id") % 4 == 0, F.element_at(F.split("text", "\n"), 1)).when(F.col("doc_id") % 4 == 1, F.lit("Notice"))
    made = wording.content_text(title, F.array_join("lines", "\n"), F.col("text"))
    return cleaned.select("doc_id", F.length(made).cast("long").alias("chars"), F.sha2(made, 256).alias("content_hash"))


#: Letters of a script that stands, letter for letter, for a-z in some documents.
SCRIPT = "".join(chr(0x0C05 + i) for i in range(26))
ALPHABET, VOWELS = "abcdefghijklmnopqrstuvwxyz", "aeiou"


def _language(docs: DataFrame) -> DataFrame:
    """Whole texts as they are, with other vowels, in another script, and without letters."""
    text, kind = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    made = F.when(kind == 1, F.translate(text, VOWELS, SCRIPT[:5])).when(kind == 2, F.translate(text, ALPHABET, SCRIPT)).when(kind == 3, F.regexp_replace(text, "[a-zA-Z]", "")).otherwise(text)
    return T.once(docs, "made", made).select("doc_id", F.round(T.letter_share(F.col("made")), 6).alias("share"), T.language_class(F.col("made")).alias("language"))


def _markers(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", rules.count_markers(text, GOOD).cast("long").alias("good"), rules.count_markers(rules.without(text, GOOD), BAD).cast("long").alias("bad"))


def _handles(events: DataFrame) -> DataFrame:
    handle = F.lower(F.regexp_replace(F.concat(F.lit("@User"), F.col("user_id").cast("string")), "^@", ""))
    return events.groupBy(handle.isin(HANDLES).alias("official")).agg(F.count("*").alias("n"))


def _objects(events: DataFrame) -> DataFrame:
    chatty = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n``` done"))
    return events.select("event_id", F.get_json_object(rules.json_object(chatty), "$.k").cast("long").alias("k"), rules.error_of(_pick(ENVELOPES, "event_id")).alias("error"))


QUERIES = {
    "txt09_line_noise": _documents(_noise),
    "txt12_content_text": _documents(_content),
    "txt17_language_class": _documents(_language),
    "txt20_markers": _documents(_markers),
    "txt22_official_handle": _events(_handles),
    "txt24_json_object": _events(_objects),
    "txt26_markdown_cell": _documents(lambda d: d.select("doc_id", F.sha2(wording.cell(F.concat(F.lit("a|b\n\n"), "text")), 256).alias("cell_hash"))),
}


def _list(values: list[str], by: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{by} % {len(values)} + 1]"


def _count(text: str, markers: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, '{m}') THEN 1::BIGINT ELSE 0::BIGINT END" for m in markers) + ")"


_WITHOUT = "t"
for _g in GOOD:
    _WITHOUT = f"replace({_WITHOUT}, '{_g}', ' ')"

SQL = {
    "txt20_markers": f"SELECT doc_id, {_count('t', GOOD)} AS good, {_count(_WITHOUT, BAD)} AS bad FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)",
    "txt22_official_handle": "SELECT 'user' || user_id IN (" + ", ".join(f"'{h}'" for h in HANDLES) + ") AS official, count(*) AS n FROM events GROUP BY 1",
    "txt24_json_object": f"SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN json_valid(e) AND json_extract_string(e, '$.result') <> '' THEN json_extract_string(e, '$.result') || coalesce(' (HTTP ' || json_extract_string(e, '$.api_error_status') || ')', '') END AS error FROM (SELECT *, {_list(ENVELOPES, 'event_id')} AS e FROM events)",
    "txt26_markdown_cell": "SELECT doc_id, sha256(coalesce(left(trim(regexp_replace(replace('a|b' || chr(10) || chr(10) || text, '|', '\\|'), '\\n+', ' ', 'g'), ' '), 180), '—')) AS cell_hash FROM documents",
}

_S = T.BLANK
_TRIM = lambda x: f"regexp_replace({x}, '^[{_S}]+|[{_S}]+$', '', 'g')"
_NOISY = rf"(contains(x, '#') AND length(regexp_replace(regexp_replace({_TRIM('x')}, '{T.HASHTAG}', '', 'g'), '[{_S}|,·-]', '', 'g')) <= greatest(3, length({_TRIM('x')}) * 0.15))"
_STUFFED = rf"(length(x) - length(replace(x, ',', '')) >= 4 AND len([p FOR p IN string_split(x, ',') IF regexp_matches(p, '[^{_S}]') AND len(regexp_extract_all(p, '[^{_S}]+')) <= 6]) / len(string_split(x, ','))::DOUBLE > 0.8)"
_BARE = _TRIM(f"regexp_replace(x, '([{_S}]+{T.HASHTAG}){{2,}}[{_S}]*$', '')")
_ANY = lambda patterns: "regexp_matches(x, '" + "|".join(f"(?:{p})" for p in patterns) + "')"
_TAILS = "[" + ", ".join("chr(10) || " + " || chr(10) || ".join(f"'{x}'" for x in t) for t in TAILS) + f"][doc_id % {len(TAILS)} + 1]"
_LINES = rf"l AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, '') || {_TAILS}, '\r?\n') AS a FROM documents))"
SQL["txt09_line_noise"] = f"WITH {_LINES} SELECT doc_id, count(*) FILTER ({_NOISY}) AS hashtags, count(*) FILTER ({_STUFFED}) AS stuffed, sha256(string_agg({_BARE}, chr(10) ORDER BY i)) AS bare_hash FROM l GROUP BY doc_id"
#: The lines of whole texts that stay, in order; txt08 and txt12 are made of them.
CLEAN = f"""{_LINES}, ends AS (SELECT doc_id, coalesce(min(i) FILTER ({_ANY(T.CUT_MARKERS)}), 1000000000000) AS stop FROM l GROUP BY doc_id),
good AS (SELECT doc_id, i, {_BARE} AS x FROM l JOIN ends USING (doc_id) WHERE i < stop AND NOT {_ANY(T.DROP_LINES)} AND NOT {_NOISY} AND NOT {_STUFFED}),
fresh AS (SELECT * FROM (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM good WHERE x <> '') WHERE before IS DISTINCT FROM x),
clean AS (SELECT doc_id, count(x) AS lines, coalesce(string_agg(x, chr(10) ORDER BY i), '') AS t FROM (SELECT doc_id FROM documents) LEFT JOIN fresh USING (doc_id) GROUP BY doc_id)"""
SQL["txt08_boilerplate"] = f"WITH {CLEAN} SELECT doc_id, lines, sha256(t) AS clean_hash FROM clean"
SQL["txt12_content_text"] = f"""WITH {CLEAN},
b AS (SELECT doc_id, CASE WHEN length(t) >= 20 THEN t ELSE coalesce(text, '') || {_TAILS} END AS body, CASE doc_id % 4 WHEN 0 THEN string_split(coalesce(text, '') || {_TAILS}, chr(10))[1] WHEN 1 THEN 'Notice' END AS title FROM clean JOIN documents USING (doc_id)),
c AS (SELECT doc_id, CASE WHEN coalesce(title, '') = '' OR starts_with(body, title) THEN body ELSE title || chr(10) || chr(10) || body END AS x FROM b)
SELECT doc_id, length({_TRIM("x")}) AS chars, sha256({_TRIM("x")}) AS content_hash FROM c"""
SQL["txt17_language_class"] = rf"""WITH m AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN translate(t, '{VOWELS}', '{SCRIPT[:5]}') WHEN 2 THEN translate(t, '{ALPHABET}', '{SCRIPT}') WHEN 3 THEN regexp_replace(t, '[a-zA-Z]', '', 'g') ELSE t END AS t FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
n AS (SELECT doc_id, len(regexp_extract_all(t, '[\x{{0C00}}-\x{{0C7F}}]'))::DOUBLE AS own, len(regexp_extract_all(t, '[a-zA-Z]'))::DOUBLE AS latin FROM m)
SELECT doc_id, round(coalesce(own / nullif(own + latin, 0), 0), 6) AS share, CASE WHEN own > 0.75 * (own + latin) THEN 'te' WHEN own > 0.15 * (own + latin) THEN 'mixed' WHEN latin > 0 THEN 'en' ELSE 'other' END AS language FROM n"""
