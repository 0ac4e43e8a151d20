"""Rules and wording over nulls, empty texts and the edges of their ranges."""

import datetime

from pyspark.sql import functions as F

from fieldglass.functions import rules, wording
from fieldglass.plans.delivery import pushed
from fieldglass.plans.enrichment import enriched_by


def values(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def none(kind="string"):
    return F.lit(None).cast(kind)


def test_authors_and_listings(spark):
    no = F.lit(False)
    got = values(spark, rules.author_class(none(), none(), none("boolean")), rules.author_class(F.lit("Ravi"), F.lit(""), no), rules.author_class(F.lit("City News"), F.lit("farmer"), no), rules.author_class(F.lit("x"), none(), F.lit(True)))
    assert [tuple(x) for x in got] == [("unknown", None), ("citizen", 0.4), ("media_organisation", 0.85), ("government", 0.9)]
    listing = lambda text: rules.is_property_listing(F.lit(text).cast("string"), none())
    got = values(spark, *map(listing, (None, "", "Open plots here", "Regunta: selling price of cotton", "2 gunta, selling price low", "land reform", "వెంచర్")))
    assert got == (False, False, True, False, True, False, True)


def test_seasons_go_round_the_year(spark):
    day = lambda d: F.lit(datetime.date.fromisoformat(d))
    urgency = lambda topic, d: rules.calendar_urgency(F.array(F.lit(topic)), day(d))
    got = values(spark, urgency("procurement", "2024-01-31"), urgency("procurement", "2024-02-01"), urgency("procurement", "2024-02-23"), urgency("seeds", "2023-12-31"), urgency("irrigation", "2024-02-29"), urgency("none", "2024-06-01"), rules.calendar_urgency(F.array().cast("array<string>"), day("2024-06-01")))
    assert [x.multiplier for x in got] == [1.6, 1.0, 1.9, 1.6, 1.0, 1.0, 1.0]
    assert got[2].label == "Rabi procurement" and got[2].ahead


def test_transcripts_and_texts(spark):
    words = F.array(*[F.lit(f"w{i} ") for i in range(20)], F.lit(" [music] "))
    got = values(spark, rules.transcript(words), rules.transcript(F.slice(words, 2, 20)), rules.transcript(none("array<string>")))
    assert got == (" ".join(f"w{i}" for i in range(20)), None, None)
    rate = lambda x: rules.rate_text(F.lit(x))
    assert values(spark, rate(0.25), rate(2.0), rate(9.96), rate(10.5)) == ("0.3", "2", "10", "11")
    many = F.array(*map(F.lit, "abcde"))
    assert values(spark, wording.list_phrase(many), wording.list_phrase(F.slice(many, 1, 1))) == ("a, b, c and 2 more", "a")
    title = wording.bounded(F.lit("p" * 70), F.lit("h" * 30))
    assert values(spark, title, wording.grouped_number(F.lit(1234567)), wording.tolerant_time(F.lit("soon")), wording.tolerant_time(none())) == ("p" * 70 + "h" * 23 + "…", "12,34,567", None, None)


def test_functions_behind_contracts(spark):
    import pandas as pd

    docs = spark.createDataFrame([(1, "en"), (2, None), (3, "de")], "doc_id long, lang string").coalesce(1)
    made = enriched_by(docs, lambda b: pd.DataFrame({"label": b["lang"], "confidence": [0.5, 0.5, 2.0]}))
    assert sorted(map(tuple, made.collect())) == [(1, "en", 0.5, None), (2, None, None, "contract"), (3, None, None, "contract")]

    def fails(batch):
        raise ValueError("no")

    assert {r.failure for r in enriched_by(docs, fails).collect()} == {"ValueError"}
    assert {r.failure for r in enriched_by(docs, lambda b: pd.DataFrame({"label": ["en"], "confidence": [1.0]})).collect()} == {"ValueError"}
    assert not enriched_by(docs.where("doc_id < 0"), fails).collect()
    sent = pushed(spark.createDataFrame([(0,), (1,), (2,)], "endpoint long"), lambda e: (204, 410, 503)[e])
    assert sorted(r.outcome for r in sent.collect()) == ["failed", "removed", "sent"]
