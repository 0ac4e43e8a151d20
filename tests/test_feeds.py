import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fieldglass.functions import text as T
from fieldglass.functions import wording
from fieldglass.plans.ledger import upserted
from fieldglass.plans.payloads import normalized
from fieldglass.sources import feeds
from fieldglass.streaming import mentions as stream

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="x" xmlns:media="y" xmlns:dc="z"><channel><title>Feed</title>
<item><title>Rain &amp;#8217;s back</title><link>https://a.example/1</link><guid isPermaLink="false">g1</guid><pubDate>Tue, 05 Mar 2024 06:07:08 GMT</pubDate><category>farm</category><category>rain</category>
<description><![CDATA[<p>short</p>]]></description><content:encoded><![CDATA[<p>Full &#8216;text&#8217;</p><img class="a" src='https://a.example/i.png'>]]></content:encoded></item>
<item><title>Two</title><link>https://a.example/2</link><dc:date>2024-03-06T06:07:08.123Z</dc:date><enclosure url="https://a.example/e.jpg" type="image/jpeg"/><media:content url="https://a.example/m.jpg"/></item>
<item><title>Three</title><link>https://a.example/3</link><pubDate>5 Mar 2024 06:07 EST</pubDate><media:thumbnail url="https://a.example/t.jpg"/></item>
<item><title>Undated</title><link>https://a.example/4</link></item><item><title>No link</title></item><item><link>https://a.example/5</link></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>F</title>
<entry><id>e1</id><title type="html">One</title><link rel="self" href="/x"/><link rel="alternate" href="https://b.example/1"/><updated>2024-03-05T06:07:08+05:30</updated><summary>&lt;p&gt;Sum&lt;/p&gt;</summary></entry>
<entry><title>Two</title><link href="https://b.example/2"/><published>2024-03-05T06:07Z</published><updated>2024-04-01</updated><content>Body</content></entry></feed>"""


def test_rss(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    rows = {r.title: r for r in feeds.read_rss(spark, f"file://{tmp_path}/a.xml").collect()}
    assert sorted(rows) == ["Rain 's back", "Three", "Two", "Undated"]
    one = rows["Rain 's back"]
    assert (one.external_id, one.body, one.published_at, one.section, one.image) == ("g1", "Full 'text'", dt.datetime(2024, 3, 5, 6, 7, 8), "farm", "https://a.example/i.png")
    assert (rows["Two"].published_at, rows["Two"].image, rows["Two"].external_id) == (dt.datetime(2024, 3, 6, 6, 7, 8, 123000), "https://a.example/e.jpg", "https://a.example/2")
    assert (rows["Three"].published_at, rows["Three"].image) == (dt.datetime(2024, 3, 5, 11, 7), "https://a.example/t.jpg")
    assert rows["Undated"].published_at is None
    assert sorted(r.title for r in feeds.read_rss(spark, f"file://{tmp_path}/a.xml", 2).collect()) == ["Three", "Two"]


def test_atom(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ATOM)
    rows = {r.title: r for r in feeds.CONNECTORS["atom"](spark, f"file://{tmp_path}/a.xml").collect()}
    assert (rows["One"].external_id, rows["One"].url, rows["One"].body, rows["One"].published_at) == ("e1", "https://b.example/1", "Sum", dt.datetime(2024, 3, 5, 0, 37, 8))
    assert (rows["Two"].external_id, rows["Two"].body, rows["Two"].published_at) == ("https://b.example/2", "Body", dt.datetime(2024, 3, 5, 6, 7))


def test_posts(spark, tmp_path):
    posts = [
        {"id": "1", "text": "a", "createdAt": "Tue Mar 05 06:07:08 +0000 2024", "author": {"userName": "Ann", "name": "Ann A", "followers": 3, "isVerified": True}, "likeCount": 5},
        {"id_str": "2", "full_text": "b", "created_at": "2024-03-05", "author": {"screen_name": "Bob"}, "favorite_count": 7, "retweet_count": 1},
        {"conversationId": "3", "fullText": "c", "username": "cy", "url": "https://x.example/3"}, {"id": "4", "text": " "}, {"text": "no id"},
    ]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, posts)))
    rows = {r.external_id: r for r in feeds.read_posts(spark, f"file://{tmp_path}/p.json").collect()}
    assert sorted(rows) == ["1", "2", "3"]
    assert (rows["1"].published_at, rows["1"].handle, rows["1"].author_name, rows["1"].verified, rows["1"].url) == (dt.datetime(2024, 3, 5, 6, 7, 8), "ann", "Ann A", True, "https://x.com/Ann/status/1")
    assert (rows["2"].text, rows["2"].author_name, rows["2"].engagement.likes, rows["2"].engagement.reposts, rows["3"].handle, rows["3"].url) == ("b", "Bob", 7, 1, "cy", "https://x.example/3")
    (tmp_path / "none.json").write_text('{"error": "no quota"}')
    for read in (feeds.read_posts, feeds.read_pictures):
        with pytest.raises(ValueError, match="no posts"):
            read(spark, f"file://{tmp_path}/none.json")


def test_pictures(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, [{"shortCode": "s", "caption": "x" * 150 + "\nmore", "timestamp": "2024-03-05T06:07:08.000Z", "likesCount": 2}, {"id": "1"}])))
    (row,) = feeds.read_pictures(spark, f"file://{tmp_path}/p.json").collect()
    assert (row.external_id, row.title, row.site, row.published_at, row.engagement.likes) == ("s", "x" * 140, "Instagram", dt.datetime(2024, 3, 5, 6, 7, 8), 2)


def test_times(spark):
    said = {
        "2024-03-05T06:07:08.123Z": "06:07:08.123", "2024-03-05T06:07:08+0530": "00:37:08", "2024-03-05 06:07": "06:07:00", "2024-03-05": "00:00:00", "5 Mar 2024 06:07 GMT": "06:07:00", "Tuesday, 05 March 2024 06:07:08 PDT": "13:07:08",
        "Tue Mar 05 06:07:08 +0000 2024": "06:07:08", "5 Mar 2024": "00:00:00", "Tue, 5 Mar 2024 6:07:08 GMT": "06:07:08", "2024-02-30": None, "5 Foo 2024": None, "soon": None, "": None, None: None, "2024-03-05T25:00:00Z": None,
    }
    df = spark.createDataFrame([(k,) for k in said], "t string").select("t", wording.tolerant_time(F.col("t")).alias("at"))
    for r in df.collect():
        want = said[r.t] and dt.datetime.fromisoformat(f"2024-03-05T{said[r.t]}")
        assert r["at"] == want, r


def test_line_rules(spark):
    cases = [
        # line, noise, stuffed, without trailing hashtags
        ("#a | #b | #c | #d", True, False, "#a | #b | #c | #d"), (",,,,,", False, False, ",,,,,"), ("Report on issue #12", False, False, "Report on issue #12"), ("word#tag #one", False, False, "word#tag #one"), ("Rain in the north #x #y ", False, False, "Rain in the north"),
        ("a, b, c, d, e", False, True, "a, b, c, d, e"), ("a, b, c, d, ", False, False, "a, b, c, d,"), ("a,b,c,d,e,f,", False, True, "a,b,c,d,e,f,"), ("#వరి #పంట", True, False, "#వరి #పంట"), ("plain", False, False, "plain"), ("", False, False, ""), ("  x　", False, False, "x"),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, l string")
    for r in df.select("k", T.is_hashtag_noise(F.col("l")), T.is_keyword_stuffing(F.col("l")), T.without_trailing_hashtags(F.col("l"))).collect():
        assert tuple(r)[1:] == cases[r.k][1:], cases[r.k]
    text = "Title\nTitle\nRain in the north #x #y\nhttps://a.example\nkept\n  Follow us on y\nnot this"
    (row,) = T.cleaned_lines(spark.createDataFrame([(text,)], "text string")).collect()
    assert row.lines == ["Title", "Rain in the north", "kept"]


def test_failure_rows_and_reasons(spark):
    items = spark.createDataFrame([("x", "1", None, "no json"), ("x", "2", None, None), ("x", "3", None, '{"text": "t"}'), ("radio", "4", None, "{}"), ("x", "5", None, "[1]")], "platform string, external_id string, published_at timestamp, payload string")
    found = {r.external_id: r.error for r in normalized(items).collect()}
    assert found == {"1": "payload is no JSON object", "2": "payload is no JSON object", "3": None, "4": "no projection for platform radio", "5": "payload is no JSON object"}
    prior = spark.createDataFrame([(1, "old", "told"), (2, "old", None)], "k int, title string, why string")
    new = spark.createDataFrame([(1, "new", "own"), (2, "new", "own"), (3, "new", "own")], "k int, title string, why string")
    assert sorted(map(tuple, upserted(prior, new, ["k"], "title", "why").collect())) == [(1, "old", "told"), (2, "new", "own"), (3, "new", "own")]


def test_drained_goes_on(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def run(mode):
        raw = spark.readStream.schema("k string").json(f"file://{source}")
        return sorted(map(tuple, stream.drained(raw.groupBy("k").count() if mode == "complete" else raw, mode, f"file://{tmp_path}/{mode}").collect()))

    (source / "1.json").write_text('{"k":"a"}\n{"k":"b"}')
    assert run("complete") == [("a", 1), ("b", 1)] and run("append") == [("a",), ("b",)]
    assert run("complete") == [("a", 1), ("b", 1)]
    (source / "2.json").write_text('{"k":"a"}')
    assert run("complete") == [("a", 2), ("b", 1)] and run("append") == [("a",), ("a",), ("b",)]
