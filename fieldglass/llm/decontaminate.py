"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

1. The corpus frequency of every benchmark term is counted over all documents.
2. Of each window of `width` item words the two rarest terms are its probes (of a window of one word, one).
3. The positions of all probe terms in all documents are the index, written to the shared folder.
4. A posting less the place of the probe in its item is an offset. Two lists meet where one document and item have two
   probes at one offset; only those go on.
5. There the words themselves are compared, window by window, beside the document's text.

The benchmark's terms are broadcast only while their measured size is within BROADCAST_BYTES; beyond it both sides are
dealt by term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.llm.shared import LOWER, UPPER, drop_stored, lower_ascii, once, row_packed, row_unpacked, stored

#: Separators of words of whatever case; the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the lower-cased text lie between.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
BROADCAST_BYTES = 16 << 20
PROBES = 2
#: Words by which the distance of two terms may differ from that in the item, in proximity matches of op1.
SLOP = 5


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its measured size is within the bound; else as it is, for a join by key."""
    width = F.lit(24)
    for c, kind in df.dtypes:
        text = F.aggregate(c, F.lit(16), lambda a, w: a + F.octet_length(w) + 16) if kind == "array<string>" else F.octet_length(c) if kind == "string" else F.size(c) * 8 if kind.startswith("array") else F.lit(0)
        width = width + F.coalesce(text, F.lit(0)) + 16
    size = df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def split_words(text: Column) -> Column:
    """Words in their own case; the first and the last may be empty, which no term is. Null counts as empty."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(ikey, item_id, terms, m, starts): each item once, with the places at which its windows begin. Written.

    Of equal windows of an item the first stands for all: what occurs in a document is found by it alike. m is the
    number of the item's words; an item of fewer words than width, but not none, is one window.
    """
    found = F.filter(split_words(lower_ascii(F.col("text"))), lambda w: w != "")
    rows = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), found.alias("terms")).where(F.size("terms") > 0).distinct()
    whole = rows.select(F.xxhash64("item_id", "terms").alias("ikey"), "item_id", "terms", F.size("terms").alias("m"))
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("m") - width, F.lit(0))))
    firsts = whole.withColumn("start", starts).groupBy("ikey", F.slice("terms", F.col("start") + 1, width).alias("window")).agg(F.min("start").alias("start"))
    return stored(whole.join(firsts.groupBy("ikey").agg(F.array_sort(F.collect_list("start")).alias("starts")), "ikey"), "items")


def _frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences of each of terms in all documents."""
    # Joined by the lower case of all letters, which is quick a word at a time; what differs in others than A-Z goes after.
    vocabulary = small(terms.select(F.lower("term").alias("folded")).distinct())
    said = docs.select(F.explode(split_words(F.col("text"))).alias("word"))
    counts = said.join(vocabulary, F.lower("word") == F.col("folded")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.groupBy(lower_ascii(F.col("word")).alias("term")).agg(F.sum("n").alias("n"))


def benchmark_probes(docs: DataFrame, whole: DataFrame, width: int = 10) -> DataFrame:
    """(ikey, item_id, start, length, place, term, need): the rarest terms of each window of item_windows. Written."""
    words = whole.select("ikey", "item_id", "m", "starts", F.posexplode("terms").alias("place", "term"))
    known = words.join(_frequencies(docs, words.select("term").distinct()), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    around = F.filter("starts", lambda s: (s <= F.col("place")) & (F.col("place") < s + width))
    inside = known.withColumn("start", F.explode(around))
    rank = F.row_number().over(Window.partitionBy("ikey", "start").orderBy("n", "place"))
    picked = inside.withColumn("rank", rank).where(F.col("rank") <= PROBES)
    length = F.least(F.col("m"), F.lit(width))
    return stored(picked.select("ikey", "item_id", "start", length.alias("length"), "place", "term", F.least(length, F.lit(PROBES)).alias("need")), "probes")


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, text_key, position) of every occurrence of terms in docs. Written.

    text_key tells apart rows that share a doc_id. Positions count the words of split_words from 0.
    """
    folded = small(terms.select("term", F.lower("term").alias("folded")).distinct())
    said = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(split_words(F.col("text"))).alias("position", "word"))
    found = said.join(folded, F.lower("word") == F.col("folded")).where(F.translate("word", UPPER, LOWER) == F.col("term"))
    return stored(found.select("term", "doc_id", "text_key", "position"), "postings")


def phrase_offsets(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(doc_id, text_key, ikey, offset) at which a document has as many of an item's probes as a window needs."""
    need = Window.partitionBy("ikey")
    at = small(probes.withColumn("need", F.min("need").over(need)).select("term", "ikey", "place", "need").distinct())
    lists = index.join(at, "term").select("doc_id", "text_key", "ikey", (F.col("position") - F.col("place")).alias("offset"), "need")
    return lists.groupBy("doc_id", "text_key", "ikey", "offset").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("doc_id", "text_key", "ikey", "offset")


def _near(index: DataFrame, probes: DataFrame, slop: int) -> DataFrame:
    """(doc_id, text_key, item_id, place, position, drift) of pairs of an item's probes that occur as near each other as there, but for slop."""
    pair = probes.where("need = 2").groupBy("ikey", "item_id", "start").agg(F.min(F.struct("place", "term")).alias("a"), F.max(F.struct("place", "term")).alias("b"))
    pair = pair.select("ikey", "item_id", "a", "b").distinct()  # neighbouring windows mostly have the same rarest terms
    sides = pair.select("ikey", "item_id", F.col("a.place").alias("first"), F.col("b.place").alias("second"), F.explode(F.array("a", "b")).alias("x"))
    at = small(sides.select("ikey", "item_id", "first", "second", "x.place", "x.term"))
    lists = index.join(at, "term").withColumn("offset", F.col("position") - F.col("place"))
    # Successive postings of a pair are compared, so the work is in proportion to the postings.
    by = Window.partitionBy("doc_id", "text_key", "ikey", "first", "second").orderBy("offset", "place", "position")
    other, drift = F.lag("place").over(by), F.col("offset") - F.lag("offset").over(by)
    near = lists.withColumn("other", other).withColumn("drift", drift).where((F.col("other") != F.col("place")) & (F.col("drift") <= slop))
    best = near.groupBy("doc_id", "text_key", "item_id", F.col("first").alias("place")).agg(F.min(F.struct("drift", "position")).alias("best"))
    return best.select("doc_id", "text_key", "item_id", "place", "best.position", "best.drift")


def near_phrases(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 5) -> DataFrame:
    """Proximity matches: (doc_id, item_id, place, position, drift), one for each word of an item that begins a pair of
    its rarest terms (the two of some window), where the pair occurs no more than `slop` words off its distance there.

    Windows of one word have none; nulls and empty texts have none.
    """
    probes = benchmark_probes(docs, item_windows(items, width), width)
    return _near(positional_index(docs, probes.select("term").distinct()), probes, slop).drop("text_key").distinct()


HITS = "array<struct<item_id:string,length:int,starts:array<int>>>"


def find_leaks(docs: DataFrame, items: DataFrame, width: int = 10, slop: int | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, text_key, n_words, n_hit, hits, and the text.

    hits: array of (item_id, length, starts), the items (item_id, text) of which windows occur, and where these windows
    begin by the word numbers of the document; n_hit: words in any of them. With slop, near as well: the item_ids of
    proximity matches (see near_phrases). Null, empty and wordless texts have n_words 0 and no hits; items without words
    or item_id match nothing; repeated items count once. Rows that share a doc_id are judged each by itself. Other
    columns are ignored; no rows give no rows.
    """
    docs = docs.select("doc_id", "text")
    whole = item_windows(items, width)
    probes = benchmark_probes(docs, whole, width)
    index = positional_index(docs, probes.select("term").distinct())
    offsets = phrase_offsets(index, probes).groupBy("doc_id", "text_key", "ikey").agg(F.collect_list("offset").alias("offsets"))
    found = offsets.join(small(whole), "ikey").select("doc_id", "text_key", F.struct("item_id", "offsets", "terms", "starts").alias("met"))
    if slop is not None:
        near = _near(index, probes, slop).select("doc_id", "text_key", "item_id").distinct()
        found = found.withColumn("near", F.lit(None).cast("string")).union(near.select("doc_id", "text_key", F.lit(None), "item_id"))
    more = [F.array_sort(F.collect_set("near")).alias("near")] * (slop is not None)
    lists = stored(found.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.collect_list("met").alias("met"), *more), "met")
    drop_stored(docs.sparkSession, index, probes, whole)
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    # Always by key: lists grow with the corpus, so a plan that broadcasts them while they are few says little of later.
    met = keyed.join(lists.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    met = once(met, "words", split_words(F.col("text")))
    edges = F.when(F.element_at("words", 1) == "", 1).otherwise(0) + F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)
    lead = F.when(F.element_at("words", 1) == "", 1).otherwise(0)

    def begun(c: Column, offset: Column) -> Column:
        """Where windows of the item begin in the document, if the item's first word were at offset."""
        m, first = F.size(c["terms"]), F.greatest(-offset, F.lit(0))
        length = F.least(m, F.lit(width))
        end = F.least(m, F.size("words") - offset)  # of the item's words beside the document's
        own = F.transform(F.slice("words", offset + first + 1, F.greatest(end - first, F.lit(0))), lower_ascii)
        possible = F.filter(c["starts"], lambda i: (i >= first) & (i <= end - length))
        same = F.filter(possible, lambda i: F.slice(c["terms"], i + 1, length) == F.slice(own, i - first + 1, length))
        return F.transform(same, lambda i: offset + i - lead)

    def hit(c: Column) -> Column:
        starts = F.array_sort(F.array_distinct(F.flatten(F.transform(c["offsets"], lambda o: begun(c, o)))))
        return F.struct(c["item_id"].alias("item_id"), F.least(F.size(c["terms"]), F.lit(width)).alias("length"), starts.alias("starts"))

    hits = F.filter(F.transform("met", hit), lambda h: F.size(h["starts"]) > 0)
    # A span is one number: its start in the upper half, its end in the lower.
    spans = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(h["starts"], lambda s: F.shiftleft(s.cast("long"), 32) + s + h["length"])))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def widened(acc: Column, span: Column) -> Column:
        start, end = F.shiftright(span, 32).cast("int"), span.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(start, acc["end"]), F.lit(0))).alias("n"))

    covered = F.aggregate(spans, zero, widened, lambda acc: acc["n"])
    found = once(met.withColumn("n_words", (F.size("words") - edges).cast("long")), "hits", F.when(F.col("met").isNotNull(), hits).otherwise(F.array().cast(HITS)))
    near = [F.coalesce("near", F.array().cast("array<string>")).alias("near")] * (slop is not None)
    return found.select("doc_id", "text_key", "text", "n_words", F.when(F.size("hits") > 0, covered).otherwise(0).cast("long").alias("n_hit"), "hits", *near)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    found = find_leaks(docs, items, slop=SLOP).withColumn("ids", ids)
    return found.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near_items"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window. Rows without a doc_id are judged by their text like others."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = find_leaks(docs, items).where("n_hit > 0").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    clean = row_packed(docs, "doc_id", "text").join(leaks.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("key")), "left_anti")
    return row_unpacked(clean, docs.columns, "doc_id", "text")
