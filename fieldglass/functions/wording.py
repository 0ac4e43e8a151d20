"""Dates, numbers and bounded phrases as readers see them. Columns that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldglass.functions.text import trimmed


# The months as feeds write them, three letters each, and the named zones besides GMT.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
ZONES = {"EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00"}
_CLOCK, _ZONE = r"(\d\d?:\d\d)(:\d\d(?:\.\d{1,9})?)?", r" ?(Z|UTC?|GMT|[ECMP][SD]T|[+-]\d\d:?\d\d)?"
_ISO = rf"^(\d{{4}})-(\d\d)-(\d\d)(?:[T ]{_CLOCK}{_ZONE})?$"
_FEED = rf"^(?:[A-Za-z]{{3,9}},? +)?(\d\d?) ([A-Za-z]{{3}})[a-z]* (\d{{4}})(?: {_CLOCK}{_ZONE})?$"
_POST = rf"^[A-Za-z]{{3}} ([A-Za-z]{{3}}) (\d\d?) {_CLOCK} ([+-]\d{{4}}) (\d{{4}})$"


def _instant(year: Column, month: Column, day: Column, minutes: Column, seconds: Column, zone: Column) -> Column:
    """The time that the parts name; UTC without a zone, midnight without a clock time, null where there is no such day."""
    at = F.when(minutes == "", "00:00:00").otherwise(F.concat(F.lpad(minutes, 5, "0"), F.when(seconds == "", ":00").otherwise(seconds)))
    named = F.lit(None).cast("string")
    for name, offset in ZONES.items():
        named = F.when(zone == name, offset).otherwise(named)
    offset = F.coalesce(named, F.when(zone.rlike("^[+-]"), F.regexp_replace(zone, "^(...):?(..)$", "$1:$2")), F.lit("+00:00"))
    return F.concat(year, F.lit("-"), month, F.lit("-"), F.lpad(day, 2, "0"), F.lit(" "), at, offset).try_cast("timestamp")


def tolerant_time(text: Column) -> Column:
    """The time of an ISO date, a feed's or a post's (`Tue Mar 05 06:07:08 +0000 2024`), with or without weekday, clock time,
    seconds, fractions and zone (UTC then); null for what is none of these."""
    said = F.trim(text)
    part = lambda pattern, k: F.regexp_extract(said, pattern, k)
    month = lambda name: F.lpad(((F.instr(F.lit(MONTHS), F.lower(name)) - 1) / 3 + 1).cast("int").cast("string"), 2, "0")
    known = lambda name: F.instr(F.lit(MONTHS), F.lower(name)) % 3 == 1
    iso = _instant(part(_ISO, 1), part(_ISO, 2), part(_ISO, 3), part(_ISO, 4), part(_ISO, 5), part(_ISO, 6))
    feed = _instant(part(_FEED, 3), month(part(_FEED, 2)), part(_FEED, 1), part(_FEED, 4), part(_FEED, 5), part(_FEED, 6))
    post = _instant(part(_POST, 6), month(part(_POST, 1)), part(_POST, 2), part(_POST, 3), part(_POST, 4), part(_POST, 5))
    return F.when(said.rlike(_ISO), iso).when(said.rlike(_FEED) & known(part(_FEED, 2)), feed).when(said.rlike(_POST) & known(part(_POST, 1)), post)


def grouped_number(n: Column) -> Column:
    """Digits by Indian custom: the last three, then pairs."""
    return F.regexp_replace(n.cast("string"), r"(\d)(?=(\d\d)*\d{3}$)", "$1,")


def ago(then: Column, now: Column) -> Column:
    """Minutes below an hour, hours below two days, then days."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return F.when(minutes < 60, said(minutes, "min")).when(minutes < 2880, said(F.floor(minutes / 60), "h")).otherwise(said(F.floor(minutes / 1440), "d"))


def bounded(prefix: Column, headline: Column, most: int = 80, least: int = 24) -> Column:
    """Prefix and headline in `most` characters; the headline keeps `least` of them however long the prefix is."""
    room = F.greatest(F.lit(least), most - F.length(prefix))
    return F.concat(prefix, F.when(F.length(headline) > room, F.concat(F.rtrim(F.substring(headline, F.lit(1), room - 1)), F.lit("…"))).otherwise(headline))


def list_phrase(names: Column, most: int = 3) -> Column:
    """The first names and how many more there are."""
    shown = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) > most, F.concat(shown, F.lit(" and "), (F.size(names) - most).cast("string"), F.lit(" more"))).otherwise(shown)


def content_text(title: Column, stripped: Column, original: Column, least: int = 20) -> Column:
    """The stripped body, or the original where too little is left; the title before it unless the body starts with it."""
    body = F.when(F.length(stripped) >= least, stripped).otherwise(F.coalesce(original, F.lit("")))
    return trimmed(F.when(F.length(title) > 0, F.when(body.startswith(title), body).otherwise(F.concat(title, F.lit("\n\n"), body))).otherwise(body))


def cell(text: Column, most: int = 180) -> Column:
    """A cell of a Markdown table: bars escaped, on one line, cut to `most` characters; a dash for nothing."""
    line = F.trim(F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), "\n+", " "))
    return F.when(F.length(text) > 0, F.substring(line, 1, most)).otherwise("—")
