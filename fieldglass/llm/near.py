"""MinHash near-duplicates.

1. Every text becomes its set of distinct word shingles (64-bit names), a digest of the set, and the minima of many
   universal hashes over it. Equal sets are one class, represented by its least doc_id, so exact copies cost one row.
2. Bands of the signature are keys. Each class is paired with the least class of every key that it has: as many pairs
   as rows. Pairs whose signatures agree too seldom go; the rest is confirmed on the full sets.
3. Components of the confirmed links, by alternating large-star and small-star.
4. Two classes that share a key but are in different components by then haven't been compared. A bound by the
   shingles that each class has in common with any other in question leaves few of these pairs (see _uncompared);
   they are confirmed likewise, and the components taken again. After this step no pair that shares a key and has the
   similarity asked for is unlinked.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from fieldglass.llm.components import connected_components
from fieldglass.llm.names import CHUNK, chunks, in_pieces, mixed, paired, word_names
from fieldglass.llm.shared import LOWER_BYTES, drop_stored, long_id, mapped, row_packed, row_unpacked, stored, text_bytes

HASHES, BAND = 128, 4
_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64)


def _grams(names: np.ndarray, width: int) -> np.ndarray:
    grams = names
    for k in range(1, width):
        grams = paired(grams[:-1], names[k:]) if len(names) > k else grams[:0]
    return grams


def _long_set(text: bytes, width: int) -> np.ndarray:
    """The shingles of one text, made from a part of it at a time; parts overlap by all but one word of a shingle."""
    tail, found = np.empty(0, np.uint64), []
    for chunk in chunks(text):
        names = np.concatenate([tail, word_names([chunk.translate(LOWER_BYTES)])[0][0]])
        found.append(np.unique(_grams(names, width)))
        tail = names[max(0, len(names) - width + 1) :]
    whole = np.unique(np.concatenate(found))
    return whole if len(whole) else _whole(tail, width)


def _whole(names: np.ndarray, width: int) -> np.ndarray:
    """The one shingle of a text of fewer words than a shingle has; none of a text without words."""
    if not len(names):
        return names
    out = mixed(np.array([width * 1000 + len(names)], np.uint64))
    for k in range(len(names)):
        out = paired(out, names[k : k + 1])
    return out


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit names made of its words' digests. Fewer words than width, but
    not none: the whole sequence. Sets are compared a pair of documents at a time, for which 64 bits suffice."""
    out = []
    for start, end in in_pieces(texts):
        if end - start == 1 and len(texts[start]) > 2 * CHUNK:
            out.append(_long_set(texts[start], width))
            continue
        lanes, bounds = word_names([t.translate(LOWER_BYTES) for t in texts[start:end]])
        names = lanes[0]
        grams = _grams(names, width)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out.append(np.unique(grams[s : e - width + 1]) if e - s >= width else _whole(names[s:e], width))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of the least values of each hash a * x + b (mod 2**64)."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        value = shingles[at : at + 512, None] * _A
        value += _B
        np.minimum(least, value.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), signature (array of HASHES ints, null for an empty set)."""
    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(text_bytes(batch.column(1)), width)
        sums = [(int(mixed(s).sum(dtype=np.uint64)), int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))) for s in sets]
        made = np.concatenate([minima(s) for s in sets if len(s)] or [np.empty(0, np.int32)])
        full = np.array([len(s) > 0 for s in sets], bool)
        offsets = np.concatenate([[0], np.cumsum(full * HASHES)]).astype(np.int32)
        column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made, pa.int32()), mask=pa.array(~full))
        digests = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), column], names=["doc_id", "n_shingles", "d1", "d2", "signature"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), sign, "doc_id long, n_shingles long, d1 long, d2 long, signature array<int>")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) of the documents whose ids are given."""
    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(text_bytes(batch.column(1)), width)
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        values = np.concatenate(sets or [np.empty(0, np.uint64)]).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "shingles"])

    # Always by key: ids grow with the corpus, so a plan that broadcasts them while they are few says little of later.
    wanted = docs.select(F.col("doc_id").cast("long"), "text").join(ids.hint("merge"), "doc_id", "left_semi")
    return mapped(wanted, build, "doc_id long, shingles array<long>", rows=256)


def _confirmed(pairs: DataFrame, sets: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v): those with 100 * intersection >= percent * union, confirmed on the full sets. Written."""
    share = percent / 100
    least = math.floor(HASHES * (share - 7 * math.sqrt(share * (1 - share) / HASHES)))  # seven standard deviations below
    sides = [signed.select(F.col("doc_id").alias(x), F.col("signature").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}")) for x in ("u", "v")]
    agree = F.aggregate(F.zip_with("su", "sv", lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda x, y: x + y)
    sized = 100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")  # else the union is too large
    likely = stored(pairs.join(sides[0], "u").join(sides[1], "v").where(sized & (agree >= least)).select("u", "v").distinct(), "likely")
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}")) for x in ("u", "v"))
    both = F.size(F.array_intersect("su", "sv"))
    links = stored(likely.join(b, "v").join(a, "u").withColumn("both", both).where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.size("su") + F.size("sv") - F.col("both"))).select("u", "v").distinct(), "links")
    drop_stored(pairs.sparkSession, likely)
    return links


def _uncompared(sets: DataFrame, tried: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different components that share a key's least class and can have the similarity asked for. Written.

    Shingles that no other class in question has can't be in an intersection, so with c the lesser count of the others
    no pair exceeds c / (n1 + n2 - c). Classes that this rules out for every partner go, twice, as the rest then has
    fewer partners. Documents with a passage in common, and copies too far from each other, so make no pairs at all.
    """
    groups = tried.select("u", "v").union(tried.select("u", F.col("u").alias("v")).distinct())
    placed = groups.join(found.withColumnRenamed("vertex", "v"), "v", "left").select("u", "v", F.coalesce("component", "v").alias("component"))
    several = placed.groupBy("u").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("u")
    doubtful = stored(placed.join(several, "u"), "doubtful")
    sets = sets.select(F.col("doc_id").alias("v"), F.size("shingles").alias("n"), "shingles")
    able, used = doubtful.select("v").distinct(), [doubtful]
    for _ in range(2):
        said = sets.join(able.select("v"), "v", "left_semi").select("v", "n", F.explode("shingles").alias("s"))
        both = said.groupBy("s").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("s")
        counted = said.join(both, "s").groupBy("v", "n").agg(F.count("*").alias("c"))
        able = stored(counted.where(F.lit(100) * F.col("c") >= F.lit(percent) * F.col("n")), "able")
        used.append(able)
    lists = doubtful.groupBy("v").agg(F.min("component").alias("component"), F.collect_set("u").alias("us"))  # a list has a class for each band at most
    rows = stored(lists.join(able, "v").withColumn("u", F.explode("us")), "able-rows")
    used.append(rows)
    one, two = (rows.select("u", *(F.col(c).alias(f"{c}{k}") for c in ("v", "component", "n", "c", "us"))) for k in (1, 2))
    c = F.least("c1", "c2")
    fits = (F.col("v1") < F.col("v2")) & (F.col("component1") != F.col("component2")) & (F.lit(100) * c >= F.lit(percent) * (F.col("n1") + F.col("n2") - c))
    once = F.col("u") == F.array_min(F.array_intersect("us1", "us2"))
    pairs = one.join(two, "u").where(fits & once).select(F.col("v1").alias("u"), F.col("v2").alias("v"))
    found = stored(pairs.join(tried, ["u", "v"], "left_anti"), "more")
    drop_stored(found.sparkSession, *used)
    return found


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id reachable by links of similarity >= percent / 100. Null, empty and blank texts
    have no shingles and link with nothing. Rows that share a doc_id are one vertex, linked by any of their texts; a
    null doc_id links with nothing and is kept. Other columns of docs are ignored; no rows give no rows.
    A link is missed only if no band agrees: (1 - s**BAND) ** (HASHES / BAND), under 1e-7 at s = 0.8.
    """
    docs = docs.select(long_id(docs), "text")
    signed = stored(signatures(docs, width), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL")
    reps = stored(classes, "classes")
    own = signed.join(reps.select("d1", "d2", "n_shingles", F.col("rep").alias("doc_id")), ["d1", "d2", "n_shingles", "doc_id"], "left_semi")
    one_each = own.dropDuplicates(["doc_id", "d1", "d2", "n_shingles"])  # an id has a row for each of its texts
    signed_reps = stored(one_each.select("doc_id", "n_shingles", "signature"), "reps")
    keys = F.transform(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * BAND + 1, BAND)))
    banded = signed_reps.select("doc_id", F.explode(keys).alias("key"))
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("u"), F.max("doc_id").alias("last")).where("u <> last").select("key", "u")
    tried = stored(banded.join(shared, "key").select("u", F.col("doc_id").alias("v")).where("u <> v").distinct(), "tried")
    sets = stored(_sets(docs, tried.select(F.col("u").alias("doc_id")).union(tried.select("v")).distinct(), width), "sets")
    links = direct = _confirmed(tried, sets, signed_reps, percent)
    text = F.struct("d1", "d2", "n_shingles")
    shared_ids = stored(signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").select("doc_id"), "shared-ids")
    several = not shared_ids.isEmpty()
    if several:  # the classes of the texts under one id are linked by it
        named = signed.join(shared_ids, "doc_id").join(reps, ["d1", "d2", "n_shingles"])
        links = links.union(named.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u <> v").distinct())
    found = stored(connected_components(links), "components")

    more = _uncompared(sets, tried, found, percent)
    if not more.isEmpty():
        new = _confirmed(more, sets, signed_reps, percent)
        if not new.isEmpty():
            found = stored(connected_components(links.union(new)), "components")
    drop_stored(docs.sparkSession, tried, more, signed_reps, sets, direct)
    at = reps.join(found.withColumnRenamed("vertex", "rep"), "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(at, ["d1", "d2", "n_shingles"], "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", whole.alias("component_id"))
    if several:  # a blank text goes where the others under its id are
        least = out.join(shared_ids, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        out = out.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near-duplicates (similarity of 0.8 or more): that with the least doc_id.

    Rows go by the group of their own text alone: different texts under one doc_id all stay, and of alike ones under
    the least doc_id that with the least hash. Rows equal in doc_id and text count once; rows without a doc_id all stay.
    """
    rows = row_packed(docs, "doc_id", "text")
    named = rows.where("doc_id IS NOT NULL").withColumn("vertex", F.xxhash64("doc_id", "text", F.col("text").isNull()))
    shared = named.groupBy("doc_id").agg(F.min("vertex").alias("a"), F.max("vertex").alias("b")).where("a <> b").select("doc_id", F.lit(True).alias("shared"))
    shared = stored(shared, "shared-texts")
    # A vertex is a text: by its doc_id, so that groups gather about their first document, or where an id has several or is no
    # number, by its hash.
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        vertex = F.col("doc_id").cast("long")
        if not shared.isEmpty():
            named, vertex = named.join(shared, "doc_id", "left"), F.when(F.col("shared"), F.col("vertex")).otherwise(vertex)
        named = named.withColumn("vertex", vertex)
    found = near_duplicates(named.select(F.col("vertex").alias("doc_id"), "text")).select(F.col("doc_id").alias("vertex"), "component_id").distinct()
    ids = named.select("vertex", "doc_id").distinct().join(found, "vertex")
    kept = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "vertex")).alias("least")).select("least.vertex")
    first = F.row_number().over(Window.partitionBy("vertex").orderBy(F.xxhash64(F.to_json("row"))))  # JSON: maps have no hash
    one = named.join(kept, "vertex", "left_semi").withColumn("first", first).where("first = 1")
    return row_unpacked(one.select(rows.columns).union(rows.where("doc_id IS NULL")), docs.columns, "doc_id", "text")
