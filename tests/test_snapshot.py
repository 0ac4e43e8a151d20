import datetime as dt
import shutil

import pytest

from fieldglass.plans import snapshot as S
from fieldglass.sources.keyed import KeyedTable

TABLES = (
    S.Table("events", (S.Ref("mention_id", "mentions", owner=True), S.Ref("author_id", "authors")), origin=False),
    S.Table("mentions", (S.Ref("author_id", "authors"), S.Ref("duplicate_of", "mentions"))),
    S.Table("authors"),
)
AT = dt.datetime(2024, 3, 5, 6, 7, 8, 123456)


def store(spark):
    authors = [("a1", "Ann", "live"), ("a2", "Bo", "demo_seed")]
    mentions = [("m1", "a1", None, AT, "live"), ("m2", "a1", "m1", None, "live"), ("m3", "a2", "m9", AT, "live"), ("m9", None, None, AT, "demo_seed")]
    events = [("e1", "m1", "a1"), ("e2", "m9", "a1"), ("e3", "m3", "a2")]
    return {
        "authors": spark.createDataFrame(authors, "id string, name string, data_origin string"),
        "mentions": spark.createDataFrame(mentions, "id string, author_id string, duplicate_of string, at timestamp, data_origin string"),
        "events": spark.createDataFrame(events, "id string, mention_id string, author_id string"),
    }


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_copy_replaces_the_one_before(spark):
    first = S.snapshot(store(spark), TABLES, "one")
    second = S.snapshot(first, TABLES, "two")
    again = S.snapshot(first, TABLES, "two")
    for state in (first, second):
        assert {k: v.count() for k, v in state.items()} == {"authors": 3, "mentions": 7, "events": 5}
        assert not S.dangling(state, TABLES).collect()
    own = S.belonging(second, TABLES, S.COPY)
    m = {r["at"]: r for r in own["mentions"].collect() if r.author_id} | {"m3": next(r for r in own["mentions"].collect() if not r.author_id)}
    ids = {r.id for r in own["mentions"].collect()}
    assert m[None].duplicate_of == m[AT].id and m["m3"].duplicate_of is None and m["m3"].author_id is None
    assert {r.mention_id for r in own["events"].collect()} <= ids and ids.isdisjoint({r.id for r in first["mentions"].collect()})
    assert all(rows(again[k]) == rows(second[k]) for k in second)
    said = S.manifest(second, TABLES, "two", S.manifest(first, TABLES, "one"))
    assert rows(said) == [("one", "replaced", '{"authors": 1, "events": 2, "mentions": 3}'), ("two", "active", '{"authors": 1, "events": 2, "mentions": 3}')]


def test_replaced_copy_is_not_made(spark):
    """What is left of a second copy's plan when the first is gone: nothing of the first. Stores put together by hand are right too."""
    first = S.snapshot(store(spark), TABLES, "label-one")
    second = S.snapshot(first, TABLES, "label-two")
    own = S.belonging(second, TABLES, S.COPY)
    for df in (*second.values(), *own.values()):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "label-one" not in plan
    by_hand = S.snapshot(dict(first), TABLES, "label-two")
    assert all(rows(by_hand[k]) == rows(second[k]) for k in second)
    changed = S.snapshot(store(spark), TABLES, "label-one")
    changed["events"] = changed["events"].where("false")
    assert not S.belonging(changed, TABLES, S.COPY)["events"].collect() and not S.snapshot(changed, TABLES, "label-two")["events"].collect()


def test_nothing_to_copy(spark):
    empty = {k: v.where("false") for k, v in store(spark).items()}
    assert all(not v.collect() for v in S.snapshot(empty, TABLES, "x").values())


def test_order():
    assert [t.name for t in S.in_order(TABLES)] == ["authors", "mentions", "events"]
    with pytest.raises(ValueError, match="circle"):
        S.in_order([S.Table("a", (S.Ref("x", "b"),)), S.Table("b", (S.Ref("x", "a"),))])
    with pytest.raises(ValueError, match="declared"):
        S.in_order([S.Table("a", (S.Ref("x", "z"),))])


def test_export_and_import(spark, tmp_path):
    state, path = store(spark), f"file://{tmp_path}"
    assert S.export(state, TABLES, f"{path}/out") == {"authors": 2, "mentions": 4, "events": 3}
    target = {t.name: KeyedTable(spark, f"{path}/{t.name}", ["id"], 2) for t in TABLES}
    assert S.imported(spark, f"{path}/out", TABLES, target) == {"authors": 2, "mentions": 4, "events": 3}
    assert all(rows(target[k].read()) == rows(v) and target[k].read().dtypes == v.dtypes for k, v in state.items())
    assert S.imported(spark, f"{path}/out", TABLES, target) == {"authors": 0, "mentions": 0, "events": 0}


def test_broken_exports(spark, tmp_path):
    state, path = store(spark), f"file://{tmp_path}"
    target = {t.name: KeyedTable(spark, f"{path}/{t.name}", ["id"], 2) for t in TABLES}
    S.export(state | {"authors": state["authors"].where("id = 'a1'")}, TABLES, f"{path}/lost")
    with pytest.raises(ValueError, match="author_id names rows"):
        S.imported(spark, f"{path}/lost", TABLES, target)
    S.export(state, TABLES, f"{path}/cut")
    shutil.rmtree(tmp_path / "cut/tables/authors")
    state["authors"].where("id = 'a1'").write.json(f"{path}/cut/tables/authors")
    with pytest.raises(ValueError, match="doesn't have the 2 rows"):
        S.imported(spark, f"{path}/cut", TABLES, target)
    S.export(state | {"authors": state["authors"].union(state["authors"])}, TABLES, f"{path}/twice")
    with pytest.raises(ValueError, match="several rows of one id"):
        S.imported(spark, f"{path}/twice", TABLES, target)


def test_import_parses_files_once(spark, tmp_path, monkeypatch):
    """When the checks are done and rows are inserted, a table's files aren't read again: they can be gone."""
    state, path = store(spark), f"file://{tmp_path}"
    S.export(state, TABLES, f"{path}/out")
    target = {t.name: KeyedTable(spark, f"{path}/{t.name}", ["id"], 2) for t in TABLES}
    insert = KeyedTable.insert_absent

    def insert_without_files(table, *args, **kwargs):
        shutil.rmtree(f"{tmp_path}/out/tables/{table.path.rsplit('/', 1)[1]}")
        return insert(table, *args, **kwargs)

    monkeypatch.setattr(KeyedTable, "insert_absent", insert_without_files)
    assert S.imported(spark, f"{path}/out", TABLES, target) == {"authors": 2, "mentions": 4, "events": 3}
    assert all(rows(target[k].read()) == rows(v) for k, v in state.items())


def test_import_adds_what_is_missing(spark, tmp_path):
    """Some keys are there with other values, some aren't; rows that refer to the table's older rows are right too."""
    state, path = store(spark), f"file://{tmp_path}"
    target = {t.name: KeyedTable(spark, f"{path}/{t.name}", ["id"], 2) for t in TABLES}
    other = spark.createDataFrame([("a1", "Other", "live"), ("a7", "Old", "live")], state["authors"].schema)
    assert target["authors"].insert_absent(other) == 2
    late = spark.createDataFrame([("m7", "a7", None, None, "live")], state["mentions"].schema)
    S.export(state | {"mentions": state["mentions"].union(late)}, TABLES, f"{path}/out")
    assert S.imported(spark, f"{path}/out", TABLES, target) == {"authors": 1, "mentions": 5, "events": 3}
    assert rows(target["authors"].read()) == [("a1", "Other", "live"), ("a2", "Bo", "demo_seed"), ("a7", "Old", "live")]
    # As many rows as keys that are there, yet one twice and one missing.
    S.export({"authors": spark.createDataFrame([("a1", "Ann", "live"), ("a1", "Ann", "live")], state["authors"].schema)} | {k: v.where("false") for k, v in state.items() if k != "authors"}, TABLES, f"{path}/twice")
    with pytest.raises(ValueError, match="several rows of one id"):
        S.imported(spark, f"{path}/twice", TABLES, target)
    # All keys there, but other columns.
    S.export({k: v.withColumn("more", v["id"]) if k == "authors" else v for k, v in state.items()}, TABLES, f"{path}/wide")
    with pytest.raises(ValueError, match="differ"):
        S.imported(spark, f"{path}/wide", TABLES, target)
