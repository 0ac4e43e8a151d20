import os

import pandas as pd
import pytest

from fieldglass.plans import adjudication as A
from fieldglass.plans import places as P
from fieldglass.sources.keyed import KeyedTable


def test_places(spark):
    rows = [("North", "Big Town", ["East", "West", None, "East"]), ("North", "Low", None), ("South", "Big Town", [])]
    nodes = P.place_nodes(spark.createDataFrame(rows, "region string, district string, mandals array<string>"))
    found = {r.id: (r.level, r.depth, r.path) for r in P.paths(nodes).collect()}
    assert found == {
        "north": ("region", 0, "North"), "south": ("region", 0, "South"), "north/big-town": ("district", 1, "North > Big Town"), "north/low": ("district", 1, "North > Low"), "south/big-town": ("district", 1, "South > Big Town"),
        "north/big-town/east": ("mandal", 2, "North > Big Town > East"), "north/big-town/west": ("mandal", 2, "North > Big Town > West"),
    }


def test_depth_and_circles(spark):
    chain = spark.createDataFrame([(str(k), str(k - 1) if k else None) for k in range(20)], "id string, parent string")
    found = {(r.id, r.ancestor): r.steps for r in P.ancestors(chain).collect()}
    assert found == {(str(a), str(b)): a - b for a in range(20) for b in range(a)}
    with pytest.raises(ValueError, match="within themselves"):
        P.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "id string, parent string"))
    assert not P.ancestors(chain.where("false")).collect()


def test_asked_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def ask(batch):
        for content in batch["content"]:
            with open(f"{calls}/{content}", "a") as f:
                f.write("x")
        if "boom" in set(batch["content"]) and len(os.listdir(calls)) < 99:
            raise ValueError("no")
        return pd.DataFrame({"title": [{"blank": " ", "long": "t" * 200}.get(c, f"T {c}") for c in batch["content"]], "explanation": ["e"] * len(batch)})

    def count():
        return {p: len((calls / p).read_text()) for p in os.listdir(calls)}

    schema = "narrative_key string, mentions long, title string, content string"
    rows = [("a", 5, "old", "one"), ("b", 5, None, "one"), ("c", 2, "old", "few"), ("d", 9, "old", "blank"), ("e", 9, "old", "long"), ("f", 9, "old", None), ("g", 9, "old", "")]
    cache = KeyedTable(spark, f"file://{tmp_path}/cache", ["content_key"], 2)
    found = {r.narrative_key: (r.title, r.failure) for r in A.adjudicated(spark.createDataFrame(rows, schema), ask, cache).collect()}
    assert found == {"a": ("T one", None), "b": ("T one", None), "c": ("old", None), "d": ("old", "contract"), "e": ("old", "contract"), "f": ("old", None), "g": ("old", None)}
    assert count() == {"one": 1, "blank": 1, "long": 1}
    again = A.adjudicated(spark.createDataFrame(rows[:2], schema), ask, cache)
    assert {r.title for r in again.collect()} == {"T one"} and count()["one"] == 1
    failed = A.adjudicated(spark.createDataFrame([("x", 5, "old", "boom")], schema), ask, cache).collect()
    assert [(r.title, r.failure) for r in failed] == [("old", "ValueError")]
