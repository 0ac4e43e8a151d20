"""Mixing sources to target weights by entropy balancing.

The rates r of the documents are those nearest to 1 in relative entropy, none above MOST, for which every source's
tokens sum to its target. The convex dual has one multiplier a source, and the rates are exponential tilts:
r = min(MOST, exp(m * size / scale)). Safeguarded Newton iterations find the multipliers. Their sums need documents
by (source, size) only, so one aggregation precedes the iterations, and each iteration is a join and an aggregation of
that table; multipliers stay in a table of one row a source.

Rates become copies by carrying what rounding left over from one document to the next, the largest first, so that a
source's tokens come within about one small document of its target. Documents are dealt by source and a hash of their
doc_id, or of their text without one, into buckets of some BUCKET documents, whose number follows from the source alone. Sums of the iterations are
exact decimals, which don't depend on the order of rows: reruns on any cluster agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.llm.shared import drop_stored, own_id, row_packed, row_unpacked, stored

MOST = 3.0
BUCKET = 5_000
#: Relative error of a source's tokens at which the iterations end, and their number at most: a bracket halved so often
#: is as narrow as doubles allow.
TOLERANCE, ROUNDS = 1e-6, 120


def n_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def numbered(table: DataFrame, by: Column) -> DataFrame:
    """table with `number`, its place from 0 in the order of `by`, nulls last: sorted by ranges, never in one task.

    A count for each range comes to the driver, as many as there are shuffle partitions.
    """
    spark = table.sparkSession
    ranged = table.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), by.asc_nulls_last()).sortWithinPartitions(by.asc_nulls_last())
    placed = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33)
    counts = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for k in sorted(counts):
        before[k], total = total, total + counts[k]
    if not before:
        return placed.drop("at").withColumn("number", F.lit(0).cast("long"))
    first = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)), part)
    return placed.withColumn("number", first + F.col("at") - F.shiftleft(part, 33)).drop("at")


def cyclic_targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """(source, source_size, docs, scale, target): the sources by code point, null last, weigh 1, 2, 3 and again; together they
    keep all tokens; none gets more than `most` times its own, and what is above goes to the others by weight. Written.

    sizes: source, size, n (documents). Sources may be as many as hosts: they are numbered by ranges, and the level at
    which each gets its weight's share is found from below, two sums over all sources at a time.
    """
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("docs"))
    placed = numbered(by_source, F.col("source"))
    weighed = stored(placed.withColumn("weight", F.col("number") % 3 + 1), "sources")
    drop_stored(sizes.sparkSession, placed)
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, last = 0.0, None
    while True:
        # A source stops once its weight's share of the level is above its limit. Each level lets more of them stop.
        stops = F.col("weight") * level > most * F.col("source_size")
        found = weighed.agg(F.sum(F.when(stops, F.col("source_size")).otherwise(0)), F.sum(F.when(stops, 0).otherwise(F.col("weight"))), F.count_if(stops)).first()
        if found[2] == last or not found[1]:
            break
        last, level = found[2], (total - most * found[0]) / found[1]
    share = F.when(F.col("weight") * level > most * F.col("source_size"), most * F.col("source_size")).otherwise(F.col("weight") * level).cast("double")
    return weighed.select("source", "source_size", "docs", (F.col("source_size") / F.col("docs")).alias("scale"), share.alias("target"))


def exact_sum(value: Column) -> Column:
    """The sum of value to six decimals, the same in any order of rows."""
    return F.sum(value.cast("decimal(28,6)")).cast("double")


def multipliers(sizes: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """targets with m, the dual's solution by Newton steps within a bracket that shrinks. Written after each round."""
    spark = sizes.sparkSession
    top = math.log(most)
    # At m <= 0 rates fall with size; beyond `high` every document of a token or more has the largest rate.
    state = stored(targets.select("source", "docs", "scale", "target", "source_size", F.lit(0.0).alias("m"), F.lit(-1e3).alias("low"), (top * F.greatest("scale", F.lit(1.0)) + 1).alias("high"), F.lit(False).alias("done")), "multipliers")
    for _ in range(ROUNDS):
        tilt = F.col("m") * F.col("size") / F.col("scale")
        rate = F.least(F.exp(F.least(tilt, F.lit(top))), F.lit(most))
        tokens = F.col("n") * F.col("size") * rate
        slope = F.when(tilt < top, tokens * F.col("size") / F.col("scale")).otherwise(0.0)
        joined = sizes.where("size > 0").join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        sums = joined.groupBy("source").agg(exact_sum(tokens).alias("tokens"), exact_sum(slope).alias("slope")).withColumnRenamed("source", "s")
        now = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0.0)), "slope": F.coalesce("slope", F.lit(0.0))})
        gap = F.col("tokens") - F.col("target")
        low, high = F.when(gap < 0, F.col("m")).otherwise(F.col("low")), F.when(gap > 0, F.col("m")).otherwise(F.col("high"))
        step = F.col("m") - F.when(F.col("slope") > 0, gap / F.col("slope"))
        now = now.withColumns({"low": low, "high": high, "step": step, "done": F.abs(gap) <= TOLERANCE * F.greatest("target", F.lit(1.0))})
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        m = F.when(F.col("done"), F.col("m")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        was, state = state, stored(now.select("source", "docs", "scale", "target", "source_size", m.alias("m"), "low", "high", "done"), "multipliers")
        drop_stored(spark, was)
        if state.where("NOT done").isEmpty():
            break
    else:
        raise ArithmeticError("the multipliers of some sources did not converge")
    return state.select("source", "source_size", "docs", "scale", "target", "m")


def rounded(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text_key, source, size, rate, bucket, ...) with copies: floor or ceiling of the rate, whichever leaves less over.

    What is left over goes on to the next document of the source and bucket; rows without tokens have one copy.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = (), 0.0
        for batch in batches:
            get = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("source", "bucket", "size", "rate")}
            copies = []
            for source, bucket, size, rate in zip(*get.values(), strict=True):
                if (source, bucket) != now:
                    now, left = (source, bucket), 0.0
                if not size:
                    copies.append(1)
                    continue
                want = rate * size + left
                low = math.floor(rate + 1e-9)
                n = low + (rate > low + 1e-9 and want > (low + 0.5) * size)
                left = want - n * size
                copies.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copies, pa.int32())], names=[*batch.schema.names, "copies"])

    dealt = rows.repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.desc("size"), "doc_id", "text_key")
    return dealt.mapInArrow(run, f"{fields}, copies int")


def mix(docs: DataFrame, most: float = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of docs (doc_id, source, text): doc_id, source, size, source_size, target, rate, copies, taken.

    Null and blank texts have size 0, rate 1 and one copy. Null is a source of its own, the last. Rows that share a
    doc_id are documents of their own. Columns named in `keep` come along, others are ignored; no rows give no rows.
    """
    sized = stored(docs.select(*keep, own_id(docs), F.xxhash64("text").alias("text_key"), "source", n_words(F.col("text")).alias("size")), "sizes")
    sizes = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    targets = cyclic_targets(sizes, most)
    solved = multipliers(sizes, targets, most)
    drop_stored(docs.sparkSession, sizes, targets)
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.exp(F.least(F.col("m") * F.col("size") / F.col("scale"), F.lit(math.log(most)))), F.lit(most)))
    bucket = F.pmod(F.xxhash64(F.coalesce("doc_id", F.col("text_key").cast(sized.schema["doc_id"].dataType))), F.ceil(F.col("docs") / BUCKET)).cast("int")
    rows = sized.join(solved.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    out = rounded(rows.select(*keep, "doc_id", "text_key", "source", "size", "source_size", "target", rate.alias("rate"), bucket.alias("bucket"))).drop("bucket", "text_key")
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix takes them, with the number of the copy (from 1) as copy.

    A column `copy` that docs has is replaced. Every row is a document of its own, whether or not it has a doc_id or shares it: rows are numbered and written, so
    that both readings see the same numbers.
    """
    docs = docs.drop("copy")
    rows = stored(row_packed(docs, "doc_id", "source", "text").withColumn("number", F.monotonically_increasing_id()), "numbered")
    copies = mix(rows, keep=("number",)).where("copies > 0").select("number", "copies")
    taken = rows.join(copies, "number").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return row_unpacked(taken.withColumn("row", F.struct("row.*", "copy")), [*docs.columns, "copy"], "doc_id", "source", "text")
