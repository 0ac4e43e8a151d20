"""Text functions: normal forms, shingles, cleaning, matching. All are columns that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say nothing about a headline's topic.
TITLE_STOPWORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "of", "on", "the", "to")


def normal_form(text: Column) -> Column:
    """Lower case; letters, marks and digits stay, the rest is single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{M}\\p{N}]+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(normal_form(text), 256)


def tokens(text: Column) -> Column:
    return F.filter(F.split(normal_form(text), " "), lambda w: w != "")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value as column `name`, computed once a row: the generator keeps Catalyst from writing the expression out
    wherever the column is used, in the worst case for each element within a lambda."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def shingles(words: Column, size: int) -> Column:
    """Distinct runs of `size` words; none if there are fewer. words should be a column of a table, not an expression (see once)."""
    n = F.greatest(F.size(words) - (size - 1), F.lit(0))
    runs = F.slice(words, 1, n)
    for k in range(1, size):
        runs = F.zip_with(runs, F.slice(words, k + 1, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(runs)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def headline_core(title: Column) -> Column:
    """The words of the title up to its first bar that say something, each once."""
    words = tokens(F.element_at(F.split(title, "\\|"), 1))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*TITLE_STOPWORDS) & (F.length(w) > 1)))


def title_similarity(a: Column, b: Column) -> Column:
    """1 where a title is missing or says nothing: then titles don't speak against a pair."""
    one, two = headline_core(F.coalesce(a, F.lit(""))), headline_core(F.coalesce(b, F.lit("")))
    return F.when((F.size(one) == 0) | (F.size(two) == 0), 1.0).otherwise(jaccard(one, two))


#: What counts as blank, beyond ASCII too, and a hashtag: ASCII word characters and the script that joins its suffixes.
BLANK = "\\x{09}-\\x{0D}\\x{20}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
HASHTAG = "#[A-Za-z0-9_\\x{0C00}-\\x{0C7F}]+"


_BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def without_trailing_hashtags(line: Column) -> Column:
    """The line, trimmed, without the two hashtags or more, each after a blank, that it ends in."""
    bare = F.regexp_replace(line, f"(?:[{BLANK}]+{HASHTAG}){{2,}}[{BLANK}]*\\z", "")
    return trimmed(F.when(F.contains(line, F.lit("#")), bare).otherwise(line))


def is_hashtag_noise(line: Column) -> Column:
    """A line with hashtags and, separators aside, next to nothing else."""
    whole = trimmed(line)
    rest = F.regexp_replace(F.regexp_replace(whole, HASHTAG, ""), f"[{BLANK}|,·-]", "")
    return line.contains("#") & (F.length(rest) <= F.greatest(F.lit(3.0), F.length(whole) * 0.15))


def is_keyword_stuffing(line: Column) -> Column:
    """Four commas or more, and more than four in five of the parts between them short; an empty part isn't."""
    parts = F.split(line, ",")
    short = F.filter(F.transform(parts, trimmed), lambda p: (p != "") & (F.size(F.split(p, f"[{BLANK}]+")) <= 6))
    return line.contains(",") & (F.size(parts) >= 5) & (F.size(short) / F.size(parts) > 0.8)


# Lines that begin a channel's own text, of which nothing after counts, and lines that are always promotion.
CUT_MARKERS = (
    "(?i)^\\s*for (the )?latest (news|updates)",
    "(?i)^\\s*subscribe\\b",
    "(?i)^\\s*watch .{0,40}\\blive\\b\\s*[-–:]",
    "(?i)^\\s*download .{0,30}\\bapp\\b",
    "(?i)^\\s*follow us\\b",
    "(?i)^\\s*like us\\b",
    "(?i)^\\s*visit us\\b",
    "(?i)^\\s*connect with us\\b",
    "(?i)^\\s*stay tuned\\b",
    "(?i)^\\s*about .{0,40}:\\s*$",
    "(?i)^\\s*-{3,}\\*+",
)
DROP_LINES = (
    "(?i)https?://",
    "(?i)^\\s*[-=*_~►▶👉•]+\\s*$",
    "(?i)\\b(subscribe|whatsapp channel|telegram|instagram|facebook|twitter)\\b",
    "(?i)^\\s*©",
    "^\\s*[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]",
    "(?i)\\b(download the app|tap away|press the bell|like \\| comment)\\b",
)


def cleaned_lines(docs: DataFrame, text: str = "text", cut: tuple[str, ...] = CUT_MARKERS, drop: tuple[str, ...] = DROP_LINES) -> DataFrame:
    """docs with `lines`: those before the first that matches one of `cut`, without those that match one of `drop` and noise,
    each without its trailing hashtags, and without empty ones and consecutive repeats. Null has none."""
    lines = once(docs, "all_lines", F.split(F.coalesce(text, F.lit("")), "\r?\n"))
    marks = F.array_position(F.transform("all_lines", lambda x: x.rlike("|".join(f"(?:{c})" for c in cut))), True)
    head = F.when(marks > 0, F.slice("all_lines", 1, (marks - 1).cast("int"))).otherwise(F.col("all_lines"))
    good = F.filter(head, lambda x: ~x.rlike("|".join(f"(?:{d})" for d in drop)) & ~is_hashtag_noise(x) & ~is_keyword_stuffing(x))
    kept = once(lines, "good", F.filter(F.transform(good, without_trailing_hashtags), lambda x: x != ""))
    fresh = F.filter("good", lambda x, i: (i == 0) | (F.get("good", i - 1) != x))
    return kept.withColumn("lines", fresh).drop("all_lines", "good")


# Entities and what they stand for; the ampersand last, so that nothing is decoded twice.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#0?39;", "'"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&#8217;", "'"), ("&#8216;", "'"),
    ("&#82[12]0;", '"'), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&"),
]


def html_text(html: Column) -> Column:
    """Visible text of markup: scripts and styles out, block ends as line breaks, the common entities decoded, by name or number."""
    text = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, "(?i)<br\\s*/?>|</(p|div|li|h[1-6]|tr|ul|ol|table|section|article)>", "\n")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, plain in ENTITIES:
        text = F.regexp_replace(text, f"(?i){entity}", plain)
    text = F.regexp_replace(text, "[ \\t\\r\\x{A0}]+", " ")
    return trimmed(F.regexp_replace(F.regexp_replace(text, " ?\n ?", "\n"), "\n{2,}", "\n"))


def term_pattern(variants: list[str]) -> str:
    """One pattern for all spellings of a term: Latin ones between non-letters, others anywhere."""
    latin = [v for v in variants if v.isascii()]
    other = [v for v in variants if not v.isascii()]
    parts = [f"(?:^|[^a-z])(?:{'|'.join(latin)})(?:[^a-z]|$)"] * bool(latin) + other
    return "(?i)" + "|".join(parts)


def matches_term(text: Column, variants: list[str], exclusions: list[str] = []) -> Column:  # noqa: B006
    """Whether a spelling of the term occurs and no exclusion does."""
    found = text.rlike(term_pattern(variants))
    return found & ~text.rlike(term_pattern(exclusions)) if exclusions else found


def script_share(text: Column, first: int, last: int) -> Column:
    """Share of a script's characters among the letters of the text; 0 without letters."""
    own = F.length(F.regexp_replace(text, f"[^\\x{{{first:04X}}}-\\x{{{last:04X}}}]", ""))
    letters = F.length(F.regexp_replace(text, "[^\\p{L}\\p{M}]", ""))
    return F.when(letters == 0, 0.0).otherwise(own / letters)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "\\s+", "-")


def letter_share(text: Column, script: str = "\\x{0C00}-\\x{0C7F}") -> Column:
    """Share of a script's characters among these and the letters a-z; 0 without either."""
    own = F.length(F.regexp_replace(text, f"[^{script}]", ""))
    latin = F.length(F.regexp_replace(text, "[^a-zA-Z]", ""))
    return F.when(own + latin == 0, 0.0).otherwise(own / (own + latin))


def language_class(text: Column, name: str = "te", script: str = "\\x{0C00}-\\x{0C7F}") -> Column:
    """The script's language above three quarters, `mixed` above 0.15, else `en` if there is a letter a-z, else `other`."""
    share = letter_share(text, script)
    return F.when(share > 0.75, name).when(share > 0.15, "mixed").when(text.rlike("[a-zA-Z]"), "en").otherwise("other")
