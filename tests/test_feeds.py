"""Feeds in odd shapes: every entry becomes an article or a dead letter."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillflow.sources import feeds

ITEM = "<item><title>{}</title><link>http://a/{}</link><description>{}</description></item>"


def scanned(spark, *payloads):
    rows = spark.createDataFrame([(str(i), "s", p) for i, p in enumerate(payloads)], "payload_id string, source_id string, payload string")
    return feeds.feed_scan(rows.withColumn("fetched_at", F.lit(datetime(2024, 1, 2))), keep_empty=True)


def entries(spark, body):
    return [(r["title"], r["link"], r["description"], r["entry_error"])
            for r in scanned(spark, f"<rss><channel>{body}</channel></rss>").orderBy("item_pos").collect()]


@pytest.mark.parametrize("body, want", [
    ("<!-- a <![CDATA[ b -->" + ITEM.format("t", 1, "d"), [("t", "http://a/1", "d")]),
    ("<!-- <item> ]]> -->" + ITEM.format("<![CDATA[x <!-- y]]>", 1, "-->"), [("x <!-- y", "http://a/1", "-->")]),
    (ITEM.format("<![CDATA[a ]] > b]]>", 1, "d") + "<!-- open" + ITEM.format("u", 2, "e"), [("a ]] > b", "http://a/1", "d"), ("u", "http://a/2", "e")]),
    ("<ITEM><Title>t</Title><LINK>http://a/1</LINK><Description>d</Description></ITEM>", [("t", "http://a/1", "d")]),
    (ITEM.format("t", 1, "x <source src=a> <title>y</title> <link> <item-like> z"), [
        ("t", "http://a/1", "x <source src=a> <title>y</title> <link> <item-like> z")]),
    (ITEM.format("t", 1, "in <description>side</description> out <br/> <description/>"), [
        ("t", "http://a/1", "in <description>side</description> out <br/> <description/>")]),
    (ITEM.format("a\x00\x08b\ufffe&#x1F;&#11;c", 1, "&#65;&#x42;"), [("abc", "http://a/1", "AB")]),
    ("<item><title>t</title><link>http://a/1</link><source url='u'>Paper</source><description>d</description></item>", [("t", "http://a/1", "d")]),
    ("<item><author><name>N</name><email>e</email></author><title>1 < 2 & 3</title><link>http://a/1</link><description></description></item>", [
        ("1 < 2 & 3", "http://a/1", None)]),
])
def test_odd_shapes(spark, body, want):
    got = [(t, l, d or None) for t, l, d, error in entries(spark, body) if error is None]
    assert got == want


def test_entries_are_articles_or_dead_letters(spark):
    body = (ITEM.format("t", 1, "d") + "<item><title>cut" + "<ITEM><TITLE>no link</TITLE></ITEM>" + "<item></item>"
            + ITEM.format("x <media:bad>", 2, "d") + ITEM.format("</title>", 3, "d"))
    rows = scanned(spark, f"<rss><channel>{body}</channel></rss>")
    good = feeds.map_entry(rows.filter("entry_error is null")).count()
    lost = feeds.entry_failures(rows).count()
    assert rows.filter("item_pos is not null").count() == 6 == good + lost and good == 1


def test_a_long_feed_is_scanned_in_one_go(spark):
    many = "".join(ITEM.format(f"t{i}", i, "<p>" * 40 + "x" * 500) for i in range(2000))
    assert scanned(spark, f"<rss><channel><!-- <![CDATA[ -->{many}</channel></rss>").filter("entry_error is null").count() == 2000
    long = ITEM.format("t", 1, "<b>bold</b> " * 20_000)
    assert len(entries(spark, long)[0][2]) > 200_000
