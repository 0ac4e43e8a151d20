"""The alert stage, stories that end, and status changes: against plain versions, over restarts and failures."""

import datetime
import os
import shutil
from collections import defaultdict

import pandas as pd
import pytest

from fieldglass.plans import alerts as A
from fieldglass.sources.keyed import KeyedTable
from fieldglass.streaming import state as T
from fieldglass.streaming.mentions import drained

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 1, 1)


def candidates(spark, n=8):
    rows = [("live", t, t, None, f"topic {t}", t) for t in range(1, n + 1)]
    return spark.createDataFrame(rows, "data_origin string, topic int, rank long, strongest string, title string, place int")


def sent(table):
    return {r["topic"]: (r["cycle"], r["recipients"]) for r in table.read().collect()}


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "sent"), ["data_origin", "topic"], 4)


@pytest.fixture
def endpoints(spark):
    return spark.createDataFrame([("a",), ("b",), (None,)], "endpoint string")


def arrives(pushes):
    return pd.Series(201, pushes.index)


def test_candidates_put_urgent_first_then_the_worst_rank(spark):
    ranked = spark.createDataFrame([("live", 1, "concern", 1), ("live", 2, "positive", 2), ("live", 3, "escalating", 3), ("live", 4, "coverage", 4), ("demo_seed", 5, "concern", 1)], "data_origin string, topic int, signal string, rank long")
    urgent = spark.createDataFrame([("live", 2, "critical"), ("demo_seed", 5, "critical")], "data_origin string, topic int, strongest string")
    found = A.candidates(ranked, urgent).orderBy("place").collect()
    assert [(r["topic"], r["title"]) for r in found] == [(2, "CRITICAL: topic 2"), (3, "topic 3"), (1, "topic 1")]


def test_each_narrative_once_three_a_cycle(spark, table, endpoints):
    found = candidates(spark)
    said = [A.alert_stage(found, endpoints, table, arrives, c) for c in range(4)]
    assert [s["alerted"] for s in said] == [3, 3, 2, 0]
    assert [s["skipped"] for s in said] == [0, 3, 6, 8] and said[0]["recipients"] == 6
    assert sent(table) == {t: ((t - 1) // 3, 2) for t in range(1, 9)}
    assert A.alert_stage(candidates(spark, 20), endpoints, table, arrives, 3)["alerted"] == 0, "a cycle that is recorded isn't run again"


def test_what_reaches_nobody_is_tried_again_and_takes_no_place(spark, table, endpoints):
    def fails(pushes):
        return pd.Series(201, pushes.index).mask(pushes["key"].str.endswith(("-1", "-2")), 500)

    assert A.alert_stage(candidates(spark, 5), endpoints, table, fails, 0)["alerted"] == 3
    assert sorted(sent(table)) == [3, 4, 5]
    A.alert_stage(candidates(spark, 5), endpoints, table, arrives, 1)
    assert sent(table)[1] == (1, 2) and sent(table)[2] == (1, 2)


def test_without_endpoints_the_backlog_stays(spark, table, endpoints):
    assert A.alert_stage(candidates(spark), endpoints.where("endpoint IS NULL"), table, arrives, 0)["candidates"] == 0
    assert not table.versions()
    assert A.alert_stage(candidates(spark).limit(0), endpoints, table, arrives, 0)["alerted"] == 0
    assert A.alert_stage(candidates(spark), endpoints, table, arrives, 1)["alerted"] == 3


def test_an_endpoint_that_raises_fails_alone(spark, endpoints):
    def raises(pushes):
        if (pushes["endpoint"] == "a").any():
            raise OSError("out of reach")
        return pd.Series(404, pushes.index)

    told = A.delivered([{"key": "k", "title": "t"}], endpoints, raises)
    assert {(r["endpoint"], r["outcome"]) for r in told.collect()} == {("a", "failed"), ("b", "removed")}


def plain_stories(rows):
    by_key, out = defaultdict(list), set()
    for key, at in rows:
        if at is not None:
            by_key[key].append(at)
    newest = max(at for times in by_key.values() for at in times)
    for key, times in by_key.items():
        spans = []
        for at in sorted(times):
            if spans and at - spans[-1][1] <= DAY:
                spans[-1] = (spans[-1][0], at, spans[-1][2] + 1)
            else:
                spans.append((at, at, 1))
        for first, last, n in spans:
            out.add((key, "began", first, None, None))
            if last + DAY < newest:
                out.add((key, "ended", first, last, n))
    return out


def written(spark, folder, parts, schema):
    """A file for each part; the stream takes one a batch, the oldest first."""
    for i, part in enumerate(parts):
        to = folder / f"{i:03d}.parquet"
        if not to.exists():
            made = folder.parent / f"part-{i}"
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(made))
            shutil.copy(next(made.glob("part-*.parquet")), to)
            os.utime(to, (1_700_000_000 + i, 1_700_000_000 + i))


def as_stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(folder))


def test_stories_over_batches_and_a_restart(spark, tmp_path):
    """Hourly to daily rows of a few keys, a hot one, null keys and times; stopped after two batches and started again."""
    rows = [(i % 5 if i % 3 else 0, START + datetime.timedelta(hours=7 * i + i % 4)) for i in range(200)] + [(None, START + 3 * DAY), (9, None), (9, START), (9, START + DAY)]
    rows.sort(key=lambda r: (r[1] or START))
    schema, folder = "user long, at timestamp", tmp_path / "in"
    folder.mkdir()
    parts = [rows[i : i + 50] for i in range(0, len(rows), 50)]
    for some in (parts[:2], parts):
        written(spark, folder, some, schema)
        with T.rocks(spark):
            out = drained(T.stories(as_stream(spark, folder, schema), ["user"], "at", DAY), folder=str(tmp_path / "out"))
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(set(found)) and set(found) == plain_stories(rows)
    assert spark.conf.get(T.PROVIDER, None) != T.ROCKS


def test_state_of_quiet_keys_is_dropped(spark, tmp_path):
    """300 keys that are seen once each, on successive days: only those of the last day keep state."""
    schema, folder = "user long, at timestamp", tmp_path / "in"
    folder.mkdir()
    written(spark, folder, [[(100 * d + k, START + 3 * d * DAY) for k in range(100)] for d in range(3)], schema)
    with T.rocks(spark):
        query = T.stories(as_stream(spark, folder, schema), ["user"], "at", DAY).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    with T.rocks(spark):
        state = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "open").load()
        assert {r[0] for r in state.select("key.user").distinct().collect()} == set(range(200, 300))


def plain_changes(rows):
    last, out = {}, set()
    for item, at, tie, state in sorted((r for r in rows if None not in r), key=lambda r: r[:3]):
        if last.get(item) != state:
            out.add((item, at, tie, state, last.get(item)))
        last[item] = state
    return out


def test_status_log_over_batches_and_a_replay(spark, tmp_path):
    rows = [(i % 4, START + datetime.timedelta(minutes=i), i, ["live", "live", "ended", None, "upcoming"][(i * i + i // 7) % 5]) for i in range(120)] + [(None, START, 1, "live"), (2, None, 2, "live")]
    schema, folder = "item long, at timestamp, tie long, state string", tmp_path / "in"
    folder.mkdir()
    log = KeyedTable(spark, str(tmp_path / "log"), ["item", "at", "tie", "state"], 4)
    latest = KeyedTable(spark, str(tmp_path / "latest"), ["item"], 4)
    parts = [rows[:40] + rows[:3], rows[40:80], rows[80:]]
    for some in (parts[:1], parts):
        written(spark, folder, some, schema)
        T.status_log(as_stream(spark, folder, schema), log, latest, str(tmp_path / "c")).awaitTermination()
    want = plain_changes(rows)
    assert {tuple(r) for r in log.read().collect()} == want and log.read().count() == len(want)
    T.status_log(as_stream(spark, folder, schema), log, latest, str(tmp_path / "again")).awaitTermination()
    assert log.read().count() == len(want), "all batches delivered again change nothing"
    assert T.status_changes(spark.createDataFrame([], schema), None).count() == 0


def test_one_timer_a_key():
    """A key with many stories has one timer, and its firing ends all that the watermark has passed, read once."""
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    import pandas as pd

    handle, kept = MagicMock(), []
    handle.getListState.return_value = SimpleNamespace(get=lambda: iter(kept), exists=lambda: bool(kept), put=lambda rows: kept.__setitem__(slice(None), rows), clear=kept.clear)
    p = T.Stories(["user"], "at", DAY)
    p.init(handle)
    times = pd.DataFrame({"at": pd.to_datetime([START + 3 * i * DAY for i in range(50)])})
    assert sum(len(x) for x in p.handleInputRows((1,), iter([times]), None)) == 50
    assert handle.registerTimer.call_count == 1 and len(kept) == 50
    first = handle.registerTimer.call_args.args[0]
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: first + 10 * 3 * 86_400_000)
    ended = list(p.handleExpiredTimer((1,), clock, SimpleNamespace(getExpiryTimeInMs=lambda: first)))
    assert sum(map(len, ended)) == 10 and len(kept) == 40 and handle.registerTimer.call_count == 2
