"""The pipeline's stages over tables whose own columns have awkward names and types."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldglass.llm import lattice, near, repeats

SF = "/root/testdata/sf0.001"
CLASHES = ["kept", "failed_rule", "n_rules_run", "n_words", "row", "number", "copies", "first", "vertex", "shared", "component_id", "id", "key", "text_key", "hits", "__id", "__key", "__first", "__text", "__row", "none"]


def tables(spark, ids):
    """Clean texts, one of them twice, with a column of each name, one with a dot and a quote, a map and a struct."""
    word = random.Random(3)
    texts = [" ".join("".join(word.choices("abcdefgh", k=5)) for _ in range(80)) for _ in range(5)]
    rows = [(ids(i), texts[i % 5], "one" if i % 2 else None) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string").withColumn("doc_id", F.col("doc_id").cast("long") if ids(0) == "0" else F.col("doc_id"))
    own = [F.concat(F.lit(c), "doc_id").alias(c) for c in CLASHES]
    made = docs.select(*own, "*", F.lit(1).alias("a.b`c"), F.create_map("text", F.lit(2)).alias("m"), F.struct(F.lit(3).alias("x.y")).alias("s"))
    return made.select("text", *(f"`{c.replace('`', '``')}`" for c in made.columns if c != "text"))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("ids", [str, lambda i: f"id-{i}"], ids=["whole", "words"])
def test_columns_stay(spark, name, stage, ids):
    docs = tables(spark, ids)
    want = {r.doc_id: r for r in docs.collect()}
    out = stage(spark, docs, SF)
    last = ["copy"] * (name == "mixing")
    assert out.columns == docs.columns + last
    found = [r[: len(docs.columns)] for r in out.collect()]
    at = docs.columns.index("doc_id")
    assert all(tuple(r) == tuple(want[r[at]]) for r in found)
    if name == "near-dedup":
        assert {r[at] for r in found} == {ids(i) if ids(0) != "0" else i for i in range(5)}
    elif name != "mixing":
        assert len(found) == 6
    assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_without_other_columns(spark, name, stage):
    docs = spark.createDataFrame([(1, "w " * 9, "s"), (None, None, None)], "doc_id int, text string, source string")
    out = stage(spark, docs, SF)
    assert out.columns[:3] == docs.columns and out.count() == (0 if name == "quality rules" else 2)


def test_ids_must_be_whole_numbers(spark):
    docs = spark.createDataFrame([("x", "a b c", False)], "doc_id string, text string, held_out boolean")
    for operator in (near.near_duplicates, repeats.cut_repeats, lattice.lattice_scores):
        with pytest.raises(TypeError, match="whole number"):
            operator(docs)
