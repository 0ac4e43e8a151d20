import datetime as dt
import json
from urllib.parse import quote

import pytest

from fieldglass.sources import search as S
from fieldglass.streaming import cycle as C

ITEMS = {f"v{k}": {"id": f"v{k}", "snippet": {"title": f"t{k}", "publishedAt": f"2024-01-{k + 1:02d}T06:00:00Z"}} for k in range(28)}


@pytest.fixture
def recorded(tmp_path):
    (tmp_path / "search").mkdir()
    (tmp_path / "items").mkdir()
    answers = {"rain": [f"v{k}" for k in range(27, -1, -1)], "పంట ధర": ["v3", "v3", None, "gone", "odd"], "none": [], "a/b": ["v1"], "rain.live": ["v2"]}
    for query, ids in answers.items():
        (tmp_path / "search" / f"{quote(query, safe='') if query != 'rain.live' else query}.json").write_text(json.dumps({"items": [{"id": {"videoId": x}} for x in ids]}))
    for k, v in (ITEMS | {"odd": {"id": "odd", "snippet": {"publishedAt": "yesterday"}}}).items():
        (tmp_path / "items" / f"{k}.json").write_text(json.dumps(v))
    return str(tmp_path)


def ids(df):
    return sorted((r["query"], r["external_id"]) for r in df.collect())


def test_search_and_look_up(spark, recorded):
    found = S.read_search(spark, recorded, ["rain", "పంట ధర", "none", "a/b", "rain", ""], batch="2")
    rows = found.collect()
    assert ids(found) == sorted([("rain", f"v{k}") for k in range(3, 28)] + [("పంట ధర", "v3"), ("పంట ధర", "odd"), ("a/b", "v1")])
    assert found.rdd.getNumPartitions() == 2
    one = next(r for r in rows if r["query"] == "a/b")
    assert one.published_at == dt.datetime(2024, 1, 2, 6) and json.loads(one.payload) == ITEMS["v1"] | {"searchQuery": "a/b"}


def test_since_limit_and_live(spark, recorded):
    since = dt.datetime(2024, 1, 27)
    assert ids(S.read_search(spark, recorded, ["rain", "పంట ధర"], since)) == [("rain", "v26"), ("rain", "v27")]
    assert ids(S.read_search(spark, recorded, ["rain"], limit="3")) == [("rain", f"v{k}") for k in (25, 26, 27)]
    assert ids(S.read_search(spark, recorded, ["rain"], event="live")) == [("rain", "v2")]


def test_filters_reach_the_reader(recorded):
    reader = S.SearchReader({"path": recorded, "queries": '["rain", "a/b", "none"]'})
    at = dt.datetime(2024, 1, 5, tzinfo=dt.UTC)
    kept = list(reader.pushFilters([S.In(("query",), ("rain", "a/b")), S.EqualTo(("query",), "rain"), S.GreaterThanOrEqual(("published_at",), at), S.EqualTo(("platform",), "x")]))
    assert reader.queries == ["rain"] and reader.since == at and [type(f) for f in kept] == [S.GreaterThanOrEqual, S.EqualTo]


def test_ids_are_looked_up_in_batches(recorded, monkeypatch):
    sizes, look_up = [], S.SearchReader.look_up
    monkeypatch.setattr(S, "IDS", 10)
    monkeypatch.setattr(S.SearchReader, "look_up", lambda self, ids: sizes.append(len(ids)) or look_up(self, ids))
    reader = S.SearchReader({"path": recorded, "queries": '["rain", "a/b"]'})
    assert len(list(reader.read(reader.partitions()[0]))) == 26 and sizes == [10, 10, 6]


def test_missing_answer_fails_only_its_connector(spark, recorded, tmp_path):
    tables = C.Tables.below(spark, f"file://{tmp_path}/tables", 4)
    plans = [("api", "rain", "a", 1, 30, True), ("live", "rain", "a", 1, 30, True), ("bad", "unknown", "a", 1, 30, True)]
    C.seed(tables, spark.createDataFrame(plans, "connector string, query string, tier string, priority int, frequency_minutes int, enabled boolean"))
    said = C.run_cycle(tables, {"api": S.connector(recorded), "live": S.connector(recorded, "live"), "bad": S.connector(recorded)}, dt.datetime(2024, 2, 1), 0)
    assert said["api"] == said["live"] == "ok" and "No such file" in said["bad"]
    assert tables.raw.read().count() == 26
    assert {r.connector: r.runs for r in tables.plans.read().collect()} == {"api": 1, "live": 1, "bad": 0}
    with pytest.raises(Exception, match="path"):
        spark.read.format("search").options(queries="[]").load().collect()
