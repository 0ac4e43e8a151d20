"""Structured Streaming over event mentions: deduplication, sliding windows, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.store import work_path


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; NTZ times become timestamps, which watermarks need."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """All that the stream has yielded once what is there now is read, as a table in the shared folder.

    folder: where result and checkpoint stay; called again with it, the stream goes on from there. Without one, a new
    folder is taken and the stream starts over. Mode complete is for aggregations: each batch writes the whole result so
    far under its number, and the last one is the table.
    """
    spark = stream.sparkSession
    folder = (folder or work_path(spark, "stream")).rstrip("/")
    out, state = f"{folder}/result", f"{folder}/checkpoint"

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    def last() -> str | None:
        at = spark._jvm.org.apache.hadoop.fs.Path(out)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [x.getPath() for x in files.listStatus(at)] if files.exists(at) else []
        whole = [int(p.getName()) for p in done if p.getName().isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return f"{out}/{max(whole)}" if whole else None

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    query = writer.foreachBatch(upsert).start() if mode == "complete" else writer.format("parquet").start(out)
    query.awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(last()) if last() else spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(out)


def deduplicated(events: DataFrame, delay: str | None = None) -> DataFrame:
    """One row of each event_id, however late a repeat comes; with a delay, ids are forgotten once the watermark is that far on."""
    if delay is None:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def sliding_counts(events: DataFrame, length: str = "1 day", step: str = "12 hours") -> DataFrame:
    """Rows of each window and type. Without a watermark, so that late rows always count; drain in mode complete."""
    found = events.groupBy(F.window("ts", length, step), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions of each user, open ones too. Without a watermark, so that late rows always count; drain in mode complete."""
    found = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
