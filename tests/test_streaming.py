from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldglass import registry
from fieldglass.streaming import mentions as stream

SF = "/root/testdata/sf0.001"


def counted(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name, plan", [("str04_sliding_window_stream", stream.sliding_counts), ("str08_session_stream", stream.sessions)])
def test_stream_is_the_batch(spark, name, plan):
    """The streamed table has all that the same grouping of the whole table has, the last windows and sessions too."""
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = counted(plan(events))
    assert want and counted(registry.queries()[name](spark, SF)) == want


@pytest.mark.parametrize("plan", [stream.sliding_counts, stream.sessions])
def test_late_files_count(spark, tmp_path, plan):
    """Batches of one file each, the newest events first."""
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").limit(600).cache()
    middle = events.agg(F.expr("percentile_approx(unix_timestamp(ts), 0.5)")).first()[0]
    late = F.unix_timestamp("ts") < middle
    for part in (~late, late):
        events.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert counted(stream.drained(plan(raw), "complete")) == counted(plan(events))
