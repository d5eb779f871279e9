import hashlib
import html
from datetime import datetime
from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from quillflow.functions import dates, text, urls
from quillflow.lexicons import TRACKING_PARAMS
from quillflow.operators import quality


def apply(spark, values, expression, columns="a string"):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)],
                                 f"i int, {columns}")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


REFERENCES = [
    "a &amp;amp; b", "&lt;b&gt; &#8217;s &#x1F600;", "&copy2024 &notit; &nosuch; &amp AT&T &", "&#150; &#0; &#129; &#xD800;",
    "&#99999999999; &rsquo;&nbsp;&mdash;", "plain", "", "&&amp;", "&#x; &#13;&#11;z", "&NotEqualTilde;", "&lta &amp;copy;"]


def test_unescape_equals_standard_library(spark):
    assert apply(spark, REFERENCES, text.unescape(F.col("a"))) == [html.unescape(r) for r in REFERENCES]


def canonical(url):
    p = urlparse(url.strip())
    path = p.path if p.path == "/" else p.path.rstrip("/")
    kept = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in TRACKING_PARAMS]
    return urlunparse((p.scheme.lower(), p.netloc.lower(), path, p.params, urlencode(kept), ""))


URLS = [
    "HTTPS://Ex.COM/A/b/?utm_source=x&B=1&a=%20z&c=&d#frag", "http://x.com/", "http://x.com", "  http://x.com/a//  ",
    "http://x.com/a;p=1/b;q?x=1", "/rel/path/?q=é&UTM_Source=1", "http://x.com/?a=100%&b=a+b&c=~*'", "http://x.com/a;",
    "mailto:bob@x.com", "http://x.com?", "http://x.com/p?&&a&=b&utm_term", "http://x.com:80/a?x=%ff", "abc",
    "http://x.com/a#?b", "//host/p/", "http://[::1]/a", "http://x.com/a?b=c=d&e=%3D"]


def test_normalize_url(spark):
    assert apply(spark, URLS, urls.normalize_url(F.col("a"))) == [canonical(u) for u in URLS]
    assert apply(spark, ["", None, " http://[bad "], urls.normalize_url(F.col("a"))) == ["", "", "http://[bad"]


def test_cleaning_twice_changes_nothing(spark):
    once = urls.normalize_url(F.col("a"))
    assert apply(spark, URLS, urls.normalize_url(once)) == apply(spark, URLS, once)
    titles = ["  A\t title   here ", "x" * 600, "é ü"]
    clean = text.clean_title(F.col("a"))
    assert apply(spark, titles, text.clean_title(clean)) == apply(spark, titles, clean)
    bodies = ["<p>a<b>c</b></p>", "1 < 2", "plain"]
    plain = text.html_to_text(F.col("a"))
    assert apply(spark, bodies, text.html_to_text(plain)) == apply(spark, bodies, plain)


def test_title(spark):
    assert apply(spark, ["  Test Title  ", " \n ", None, "y" * 600, "Tom &amp; Jerry"], text.clean_title(F.col("a"))) == [
        "Test Title", None, None, "y" * 512, "Tom & Jerry"]


@pytest.mark.parametrize("markup, shown", [
    ("<p>Test content</p><script>alert(1)</script>", "Test content"),
    ("a<b>c</b>", "a c"),
    ("x<!-- y <p> -->z", "x z"),
    ('<script>var t="</p>";</script>kept', "kept"),
    ("<style>p{}</style><NOSCRIPT>n</NOSCRIPT> q", "q"),
    ('<a title="x > y" href=\'z\'>link</a>', "link"),
    ("1 < 2 &amp;lt; 3", "1 < 2 &lt; 3"),
    ("open <script>never closed", "open"),
])
def test_html_to_text(spark, markup, shown):
    assert apply(spark, [markup], text.html_to_text(F.col("a"))) == [shown]


DATES = [
    ("Mon, 01 Jan 2024 10:00:00 +0530", "UTC", (4, 30)), ("Mon, 1 Jan 2024 10:00:00 GMT", "Asia/Kolkata", (10, 0)),
    ("2024-01-01T10:00:00Z", "Asia/Kolkata", (10, 0)), ("2024-01-01T10:00:00", "Asia/Kolkata", (4, 30)),
    ("2024-01-01 10:00:00+05:30", "UTC", (4, 30)), ("2024-01-01T10:00+05:30", "UTC", (4, 30)),
    ("garbage", "UTC", None), ("", "UTC", None), (None, "UTC", None), ("2024-13-45", "UTC", None),
    ("01 Jan 2024 10:00:00", "Bad/Zone", (10, 0)), ("Mon, 01 Jan 2024 10:00:00 IST", "Asia/Kolkata", (4, 30)),
    ("January 1, 2024 10:00 AM", "UTC", (10, 0)), ("Jan 1, 2024 1:30 PM", "Asia/Kolkata", (8, 0)),
    ("Jan 1, 2024", "UTC", (0, 0))]


def test_parse_published(spark):
    got = apply(spark, [d[:2] for d in DATES], dates.parse_published(F.col("a"), F.col("b")), "a string, b string")
    assert got == [d[2] and datetime(2024, 1, 1, *d[2]) for d in DATES]


def test_content_hash(spark):
    pairs = [("Title", "Content"), ("title!", " content"), ("Title", "Different"), ("Élan: x_1", None)]
    got = apply(spark, pairs, text.content_hash(F.col("a"), F.col("b")), "a string, b string")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == [digest("v2|title|content")] * 2 + [digest("v2|title|different"), digest("v2|élan x_1|")]


def test_quality_gate(spark):
    as_of = F.lit("2024-01-10 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([
        (1, "Good title", "s", "http://x", datetime(2024, 1, 9), None),
        (2, "Good title", " ", "http://x", None, None),
        (3, "abc", None, "ftp://x", datetime(2024, 1, 1), "a" * 300),
        (4, "t" * 600, "s", "https://x", datetime(2024, 1, 10, 2), "a"),
        (5, None, "s", None, datetime(2024, 1, 7), "a"),
    ], "id int, title string, summary string, url string, published_at timestamp, author string")
    got = {r.id: (list(r.violations), r.quality_score, r.is_valid) for r in quality.quality_gate(rows, as_of).collect()}
    assert got[1] == ([], 1.0, True)
    assert got[2] == (["SUMMARY_EMPTY"], 0.7, True)
    assert got[3] == (["TITLE_TOO_SHORT", "SUMMARY_EMPTY", "URL_INVALID", "TIMESTAMP_TOO_OLD", "AUTHOR_TOO_LONG"], 0.0, False)
    assert got[4] == (["TITLE_TOO_LONG", "TIMESTAMP_IN_FUTURE"], 1.0, False)
    assert got[5] == (["TITLE_TOO_SHORT", "URL_INVALID"], 0.5, False)


def test_dropped_rows_repeat_a_payload_once(spark):
    staged = spark.createDataFrame(
        [(3, "a", "NORMALIZATION", "p"), (1, "b", "NORMALIZATION", "p"), (2, "a", "NORMALIZATION", "q"),
         (4, "a", "VALIDATION", "p"), (5, "a", "PASSED", "p")],
        "seq long, source_id string, stage string, raw_payload string").withColumns({
            "violations": F.array(F.lit("URL_INVALID")), "quality_score": F.lit(1.0)})
    got = {(r.seq, r.error_type, r.error_message) for r in quality.route_failures(staged).collect()}
    assert got == {
        (1, "Drop", "Normalizer rejected article"), (2, "Drop", "Normalizer rejected article"),
        (4, "QualityGateRejected", "Violations: URL_INVALID (Score: 1.0)")}
