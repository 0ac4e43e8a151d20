"""Terms of a dictionary in texts: one hash join for all terms, whatever their number.

A spelling in an alphabet with a-z occurs between non-letters, in any case. Each of its runs of letters is then a whole
run of the text, so its longest run is a key that the text must have too; a spelling that is one run occurs where the
keys are equal. A spelling in a script that joins its suffixes occurs anywhere; its first one to three characters of that
script are its key. What equal keys don't prove is looked up in the text, once a text for all its spellings in doubt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The script whose spellings are looked for anywhere in a text, as a range of a pattern's character class.
SUBSTRING_SCRIPT = "\\x{0C00}-\\x{0C7F}"


def _keys(text: Column, script: str) -> Column:
    """All keys of a text: its runs of letters, the parts of one to three characters of its runs of the script, and ''."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(f"[{script}]+"), F.lit(0)))
    starts = lambda run: F.sequence(F.lit(1), F.length(run))
    parts = F.flatten(F.transform(runs, lambda run: F.flatten(F.transform(starts(run), lambda at: F.array(*[F.substring(run, at, n) for n in (1, 2, 3)])))))
    return F.array_distinct(F.concat(F.array(F.lit("")), words, parts))


def spellings(terms: DataFrame, script: str = SUBSTRING_SCRIPT) -> DataFrame:
    """terms (family, term, variant, exclusion) as the matcher needs them: key, whether an equal key is proof, pattern.

    Null and empty variants stand for nothing. A variant without a letter of either kind is looked for in every text.
    """
    low = F.lower("variant")
    anywhere = F.col("variant").rlike(f"[{script}]")
    runs = F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))
    longest = F.aggregate(runs, F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best))
    quoted = F.regexp_replace(low, "([^\\p{L}\\p{N}\\s])", "\\\\$1")
    key = F.when(anywhere, F.regexp_extract("variant", f"[{script}]{{1,3}}", 0)).otherwise(longest)
    proof = ~anywhere & low.rlike("^[a-z]+$")
    pattern = F.when(~anywhere, F.concat(F.lit("(^|[^a-z])"), quoted, F.lit("([^a-z]|$)")))
    kept = terms.where("variant IS NOT NULL AND variant <> ''")
    return kept.select("family", "term", "variant", F.coalesce("exclusion", F.lit(False)).alias("exclusion"), key.alias("key"), proof.alias("proof"), pattern.alias("pattern")).distinct()


def found_terms(texts: DataFrame, terms: DataFrame, ids: list[str], script: str = SUBSTRING_SCRIPT) -> DataFrame:
    """(*ids, family, term): the terms of which a variant and no exclusion occurs in a text.

    texts: ids, which name a row (no nulls), and text. Null and empty texts have no terms. Each row of the result is there
    once, however often the term occurs.
    """
    known = spellings(terms, script)
    texts = texts.select(*ids, "text").where("text IS NOT NULL AND text <> ''")
    keyed = texts.select(*ids, F.explode(_keys(F.col("text"), script)).alias("key"))
    met = keyed.join(known, "key")
    sure = met.where("proof").select(*ids, "family", "term", "exclusion")
    doubtful = met.where("NOT proof").groupBy(*ids).agg(F.collect_set(F.struct("family", "term", "exclusion", "variant", "pattern")).alias("spellings"))
    occurs = lambda text, low: lambda s: F.when(s["pattern"].isNull(), F.contains(text, s["variant"])).otherwise(F.contains(low, F.lower(s["variant"])) & F.rlike(low, s["pattern"]))
    # Few spellings in doubt occur at all, and a pattern, made anew for each, costs far more than a plain search.
    read = texts.join(doubtful, ids).withColumn("low", F.lower("text"))
    seen = read.select(*ids, F.explode(F.filter("spellings", occurs(F.col("text"), F.col("low")))).alias("s")).select(*ids, "s.family", "s.term", "s.exclusion")
    by_term = sure.union(seen).groupBy(*ids, "family", "term").agg(F.bool_or("exclusion").alias("excluded"))
    return by_term.where("NOT excluded").drop("excluded")


def matched_terms(texts: DataFrame, terms: DataFrame, ids: list[str], script: str = SUBSTRING_SCRIPT) -> DataFrame:
    """(*ids, terms): the ids of each text's terms in the dictionary's order (terms.place), of texts that have any."""
    places = terms.groupBy("family", "term").agg(F.min("place").alias("place"))
    placed = found_terms(texts, terms, ids, script).join(places, ["family", "term"])
    listed = F.array_sort(F.collect_set(F.struct("place", "family", "term")))
    return placed.groupBy(*ids).agg(F.transform(listed, lambda x: x["term"]).alias("terms"))
