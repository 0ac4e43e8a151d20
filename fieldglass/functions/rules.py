"""Ordered rules over text and dates: authors, listings, seasons, tone, captions, rates. Columns that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class, confidence and pattern of the author rules; the first that matches holds.
AUTHOR_RULES = [
    ("government", 0.9, "department|శాఖ|government|ప్రభుత్వ|university|విశ్వవిద్యాలయ"),
    ("fpo", 0.85, "producer company|fpo"),
    ("farmer_organisation", 0.85, "sangham|సంఘం|farmer organisation|union"),
    ("media_organisation", 0.85, "news|tv|chronicle|express|times|desk|媒体|పత్రిక|ఛానల్|channel.*news"),
    ("dealer", 0.8, "dealer|traders|agro (traders|centre)|డీలర్"),
    ("creator", 0.7, "creator|vlogs|guide|education channel|content"),
    ("farmer", 0.75, "రైతు|farmer|farming|వ్యవసాయం మా జీవితం|సాగు"),
    ("journalist", 0.75, "journalist|reporter"),
]

# The terms of property listings.
LISTING_PHRASES = ["land for sale", "lands for sale", "plot for sale", "plots for sale", "site for sale", "acre for sale", "acres for sale", "for sale in telangana", "open plot", "open plots", "sq yards", "sq.yards", "square yards", "sqyards", "అమ్మకానికి", "విక్రయానికి", "వెంచర్", "గజాల"]
LISTING_HINTS = ["gunta", "guntas", "real estate", "రియల్ ఎస్టేట్"]
LAND_NOUNS = ["land", "plot", "acre", "acres", "భూమి", "స్థలం", "ఎకరా", "ఎకరాల"]
SALE_OFFERS = ["for sale", "sale in", "selling price", "అమ్మకం", "అమ్ముతు", "విక్రయం"]

# Label, start and end (month * 100 + day, both inclusive) and critical topics of each season's window.
WINDOWS = [
    ("Kharif land preparation", 515, 615, ["seeds", "agricultural-credit", "farm-mechanisation"]),
    ("Kharif sowing", 601, 731, ["seeds", "fertilizer-availability", "rainfall", "agricultural-credit", "agricultural-power", "irrigation"]),
    ("Kharif crop growth", 801, 930, ["fertilizer-availability", "pest-outbreak", "irrigation", "agricultural-power", "rainfall"]),
    ("Kharif harvest", 1001, 1130, ["crop-damage", "rainfall", "farm-mechanisation", "market-price"]),
    ("Kharif procurement", 1015, 131, ["procurement", "market-price", "farmer-support-schemes"]),
    ("Rabi sowing", 1101, 1231, ["seeds", "fertilizer-availability", "irrigation", "agricultural-power", "agricultural-credit"]),
    ("Rabi crop growth", 101, 228, ["irrigation", "agricultural-power", "pest-outbreak", "fertilizer-availability"]),
    ("Rabi harvest", 301, 430, ["crop-damage", "farm-mechanisation", "market-price", "rainfall"]),
    ("Rabi procurement", 315, 630, ["procurement", "market-price", "farmer-support-schemes"]),
]
HORIZON_DAYS = 21


def author_class(name: Column, bio: Column, official: Column) -> Column:
    """struct(author_type, confidence): official accounts first, then the rules; any name is a citizen, none is unknown."""
    said = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(bio, F.lit(""))))
    kind = lambda k, c: F.struct(F.lit(k).alias("author_type"), F.lit(c).cast("double").alias("confidence"))
    out = F.when(F.coalesce(official, F.lit(False)), kind("government", 0.9))
    for k, c, pattern in AUTHOR_RULES:
        out = out.when(said.rlike(pattern), kind(k, c))
    return out.when(F.trim(said) != "", kind("citizen", 0.4)).otherwise(kind("unknown", None))


def any_term(terms: list[str], start: str = r"(?<![A-Za-z0-9_])", end: str = r"(?![A-Za-z0-9_])") -> str:
    """A pattern for any of the terms: Latin ones as whole words, others anywhere."""
    latin = "|".join(re.escape(t).replace("\\ ", " ") for t in terms if t.isascii())
    return "|".join([f"{start}(?:{latin}){end}", *(t for t in terms if not t.isascii())])


def is_property_listing(text: Column, title: Column) -> Column:
    """An advertisement's phrase, or an offer with a land noun or a hint beside it."""
    said = F.lower(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    return said.rlike(any_term(LISTING_PHRASES)) | (said.rlike(any_term(SALE_OFFERS)) & said.rlike(any_term(LAND_NOUNS + LISTING_HINTS)))


def season_windows(day: Column) -> Column:
    """The windows in calendar order, each as struct(place, label, topics, in_days): 0 for an open one, else days until it opens."""
    month_day = F.month(day) * 100 + F.dayofmonth(day)
    found = []
    for place, (label, start, end, topics) in enumerate(WINDOWS):
        is_open = month_day.between(start, end) if start <= end else (month_day >= start) | (month_day <= end)
        opens = lambda y: F.datediff(F.make_date(F.year(day) + y, F.lit(start // 100), F.lit(start % 100)), day)  # noqa: B023, E731
        days = F.when(is_open, 0).when(opens(0) >= 0, opens(0)).otherwise(opens(1))
        found.append(F.struct(F.lit(place).alias("place"), F.lit(label).alias("label"), F.array(*map(F.lit, topics)).alias("topics"), days.alias("in_days")))
    return F.array(*found)


def near_windows(day: Column) -> Column:
    """The windows that are open or open within the horizon: the soonest first, else in calendar order."""
    near = F.filter(season_windows(day), lambda w: w["in_days"] <= HORIZON_DAYS)
    return F.array_sort(F.transform(near, lambda w: F.struct(w["in_days"].alias("in_days"), w["place"].alias("place"), w["label"].alias("label"), w["topics"].alias("topics"))))


def calendar_urgency(topics: Column, day: Column) -> Column:
    """struct(multiplier, label, ahead): 1.6 for a topic critical to an open window, 1.9 to one about to open, else 1."""
    first = F.get(F.filter(near_windows(day), lambda w: F.arrays_overlap(w["topics"], topics)), F.lit(0))
    ahead = first["in_days"] > 0
    rate = F.when(first.isNull(), 1.0).when(ahead, 1.9).otherwise(1.6)
    return F.struct(rate.alias("multiplier"), first["label"].alias("label"), F.coalesce(ahead, F.lit(False)).alias("ahead"))


def location_confidence(districts: Column, places: Column) -> Column:
    """0.6 for a text that names several districts, 0.92 for one with a place in it, 0.85 for one alone, else null."""
    return F.when(F.size(districts) > 1, 0.6).when(F.size(districts) == 1, F.when(F.size(places) > 0, 0.92).otherwise(0.85))


def sentiment(negative: Column, reassuring: Column) -> Column:
    return F.when(negative & reassuring, "mixed").when(negative, "negative").when(reassuring, "positive").otherwise("neutral")


def stance(author: Column, negative: Column, demand: Column, reassuring: Column) -> Column:
    """Towards the authorities: what they say themselves is supportive or neutral; mixed reports of media stay mixed."""
    others = F.when(negative | demand, "critical").when(reassuring, "supportive").otherwise("neutral")
    own = F.when(reassuring, "supportive").otherwise("neutral")
    return F.when((author == "media_organisation") & negative & reassuring, "mixed").when(author == "government", own).otherwise(others)


def enrichment_confidence(topics: Column, district: Column, author: Column) -> Column:
    return F.least(F.lit(0.85), 0.4 + 0.15 * F.least(F.lit(2), topics) + F.when(district.isNotNull(), 0.1).otherwise(0.0) + 0.1 * F.coalesce(author, F.lit(0.0)))


def transcript(segments: Column, least: int = 20) -> Column:
    """Captions in order as one text, without those in brackets; null under `least` words."""
    spoken = F.filter(segments, lambda s: ~F.trim(s).rlike(r"^\[.*\]$"))
    text = F.trim(F.regexp_replace(F.array_join(spoken, " "), "[ \\t\\r\\n]+", " "))
    return F.when(F.size(F.split(text, " ")) >= least, text)


def rate_text(rate: Column) -> Column:
    """Whole from 10 on, else with one decimal unless that is 0."""
    tenths = F.floor(rate * 10 + 0.5)
    short = F.concat((F.floor(tenths / 10)).cast("string"), F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""))
    return F.when(rate >= 10, F.floor(rate + 0.5).cast("string")).otherwise(short)


def percent_text(share: Column) -> Column:
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def without(text: Column, phrases: list[str]) -> Column:
    """Lower case, with each phrase as one space."""
    out = F.lower(text)
    for phrase in phrases:
        out = F.replace(out, F.lit(phrase.lower()), F.lit(" "))
    return out


def count_markers(text: Column, markers: list[str]) -> Column:
    """How many of the markers occur, each counted once."""
    said = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.when(said.contains(m.lower()), 1).otherwise(0) for m in markers), F.lit(0))


def json_object(text: Column) -> Column:
    """From the first opening brace to the last closing one, however chatty the rest; null without them."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def error_of(envelope: Column) -> Column:
    """The result of an error envelope with its status; null for what is no such JSON."""
    found = F.from_json(F.trim(envelope), "result string, api_error_status int")
    status = F.when(found["api_error_status"].isNotNull(), F.concat(F.lit(" (HTTP "), found["api_error_status"].cast("string"), F.lit(")"))).otherwise("")
    return F.when(F.length(found["result"]) > 0, F.concat(found["result"], status))
