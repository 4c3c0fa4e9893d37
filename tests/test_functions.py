import hashlib
import random
import re
from datetime import datetime, timedelta, timezone
from html import unescape
from urllib.parse import urljoin

from pyspark.sql import functions as F

from rolesift.functions.dates import from_iso_text, from_mail_text, within_window
from rolesift.functions.html import anchors, decode_entities
from rolesift.functions.text import (
    contains_any,
    first_contained,
    contained_words,
    how_many,
    listed,
    normalize_text,
    posting_hash,
    strip,
)
from rolesift.functions.urls import resolve_url
from tests.helpers import values

WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def _random_texts(n, seed):
    rng = random.Random(seed)
    alphabet = WHITE + list("abcXYZÉß|.-09") * 4
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_normalize_and_strip_follow_unicode_white_space(spark):
    texts = _random_texts(400, 1) + ["", "  ", " A \tB　"]
    assert values(spark, normalize_text, texts) == [re.sub(r"\s+", " ", t.strip().lower()) for t in texts]
    assert values(spark, strip, texts) == [t.strip() for t in texts]


def test_hash_equals_plain_sha256(spark):
    def key(*parts):
        return hashlib.sha256(
            "|".join(re.sub(r"\s+", " ", p.strip().lower()) for p in parts).encode()
        ).hexdigest()

    rows = list(zip(_random_texts(100, 2), _random_texts(100, 3), _random_texts(100, 4)))
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = df.select("*", posting_hash(F.col("a"), F.col("b"), F.col("c")).alias("h")).collect()
    assert all(r.h == key(r.a, r.b, r.c) for r in got)


def test_null_location_hashes_like_a_blank_one(spark):
    df = spark.createDataFrame([("A", "t", None), ("a ", "T", "")], "a string, b string, c string")
    hashes = {r.h for r in df.select(posting_hash(F.col("a"), F.col("b"), F.col("c")).alias("h")).collect()}
    assert len(hashes) == 1


def test_substring_helpers(spark):
    texts = ["storage of gpt", "nothing", "python llm rag"]
    words = ("RAG", "python", "llm", "gpt")
    assert values(spark, lambda c: contains_any(c, words), texts) == [True, False, True]
    assert values(spark, lambda c: contains_any(c, ()), texts) == [False] * 3
    assert values(spark, lambda c: first_contained(c, words), texts) == ["RAG", None, "RAG"]
    assert values(spark, lambda c: listed(contained_words(c, words), 2), texts) == ["RAG, gpt", "", "RAG, python"]
    assert values(spark, lambda c: how_many(contained_words(c, words)), texts) == [len([w for w in words if w.lower() in t]) for t in texts]
    assert values(spark, lambda c: how_many(contained_words(c, ())), texts) == [0, 0, 0]


def test_iso_dates(spark):
    texts = [
        "2026-07-30T15:23:41Z", "2026-07-30", "20260730", "2026-07-30 15:23", "2026-07-30T15",
        "2026-07-30T15:23:41.5+05:30", "2026-07-30T15:23:41+0530", "2026-07-30T15:23:41-08", "2026",
        "2026-07-30 15:23:41 UTC", "2026-02-30", "soon", "", None, "2026-0730", "20260730T152341",
    ]

    def expected(text):
        try:
            at = datetime.fromisoformat(text.replace("Z", "+00:00"))
        except (ValueError, AttributeError):
            return None
        at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        return round(at.timestamp() * 1_000_000)

    got = values(spark, lambda c: F.unix_micros(from_iso_text(c)), texts)
    assert got == [expected(t) for t in texts]


def test_mail_dates(spark):
    texts = ["Thu, 30 Jul 2026 15:23:41 +0000", "30 Jul 2026 15:23:41 GMT", "Fri, 3 Jul 2026 15:23 EST", "junk", None]
    got = values(spark, lambda c: F.unix_seconds(from_mail_text(c)), texts)
    assert got == [1785425021, 1785425021, 1783110180, None, None]


def test_window_keeps_undatable_and_boundary(spark):
    since = F.lit("2026-07-30 00:00:00").cast("timestamp")
    texts = ["2026-07-29", "2026-07-30", "2026-07-31", "soon", None]
    test = lambda c: within_window(from_iso_text(c), since)
    assert values(spark, test, texts) == [False, True, True, True, True]
    assert values(spark, lambda c: within_window(from_iso_text(c), None), texts) == [True] * 5


def test_urls_resolve_like_the_standard_library(spark):
    bases = [
        "https://acme.com", "https://acme.com/", "https://acme.com/careers", "https://acme.com/a/b/",
        "https://acme.com/a/b?x=1#top", "http://acme.com:8080/a//b/c.html",
    ]
    hrefs = [
        "https://x.com/j?q=1#f", "//x.com/j", "/jobs/1", "jobs/1", "?page=2", "#frag", "", "../up",
        "../../../up/./x", "./same", "a//b", "/a/../b/./c", "mailto:x@y.z", "jobs/..", "..", ".", "/x/.",
        "jobs?a=b/../c", "/../../z",
    ]
    pairs = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(pairs, "b string, h string")
    got = df.select("*", resolve_url(F.col("b"), F.col("h")).alias("u")).collect()
    wrong = [(r.b, r.h, r.u, urljoin(r.b, r.h)) for r in got if r.u != urljoin(r.b, r.h)]
    assert wrong == []


def test_anchors(spark):
    html = """<html><!-- <a href="/hidden">no</a> --><script>var x='<a href="/js">no</a>'</script>
    <a class="x" href="/one">AI <b> Engineer </b></a><A HREF='/two'>&nbsp;ML &amp; AI&nbsp;</A>
    <a href=/three>Open<a href="/four?a=1&amp;b=2"><img alt="x > y"></a><a name="n">none</a>
    <a href="">blank</a><a data-href="/no">no</a>"""
    df = spark.createDataFrame([(1, html)], "page int, html string")
    got = [(r.href, r.link_text) for r in anchors(df).orderBy("item_no").collect()]
    assert got == [
        ("/one", "AIEngineer"),
        ("/two", "ML & AI"),
        ("/three", "Open"),
        ("/four?a=1&b=2", ""),
        ("", "blank"),
    ]


def test_character_references(spark):
    same = [
        "R&#38;D &eacute;", "a&b&&c&", "&;&#;&#x;", "&#xE9;&#XE9 &#0000233;", "&#128;&#x99;&#129;", "&#x1F600;",
        "&#0;&#xD800;&#99999999999999999999;&#1114112;", "&amp;lt;", "&hellip;&NotEqualTilde;", "&copy 2026",
        "&nosuch;", "plain", "", "&Eacute;&EACUTE;", "trail&amp", "\u00e9&lt;\U0001f600&gt;", "&nbsp;" * 3000,
    ]
    assert values(spark, decode_entities, same) == [unescape(t) for t in same]
    # a name without a semicolon stays where a link's query has a parameter of that name
    assert values(spark, decode_entities, ["?a=1&copy=2&lt;=3", None]) == ["?a=1&copy=2<=3", None]


def test_space_references_end_a_link_text(spark):
    html = "<a href='?x=1&#38;y=2'>&#160;<b>Caf&eacute;&#xa0;</b> &nbsp;R&amp;amp;D&#0160;</a>"
    rows = anchors(spark.createDataFrame([(html,)], "html string")).collect()
    assert [(r.href, r.link_text) for r in rows] == [("?x=1&y=2", "Caf\u00e9R&amp;D")]


def test_week_dates_like_the_standard_library(spark):
    texts = [f"{y:04}-W{k:02}-{n}T10:11:12Z" for y in (1, 2015, 2020, 2026, 9999) for k in (0, 1, 52, 53, 54) for n in (0, 1, 7, 8)]
    texts += ["2026W314", "2026-W31", "2026W31", "2026-W31-4", "2026-W314", "2026W31-4", "2026W314T101112+0530"]

    def micros(text):
        try:
            at = datetime.fromisoformat(text)
            at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
            return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
        except (ValueError, OverflowError):
            return None

    got = values(spark, lambda c: F.unix_micros(from_iso_text(c)), texts)
    assert got == [micros(t) for t in texts]


def test_mail_dates_of_all_shapes(spark):
    at = lambda text: spark.range(1).select(F.unix_seconds(from_mail_text(F.lit(text))).alias("s")).first().s
    expected = 1_785_425_021  # 2026-07-30 15:23:41 UTC
    for text in (
        "Thu, 30 Jul 2026 15:23:41 +0000", "Thu, 30 Jul 2026 15:23:41 GMT", "30 Jul 26 15:23:41 +0000", "Thu, 30 Jul 2026 15:23:41",
        "Thu, 30 July 2026 15:23:41 +0000 (UTC)", "30 jul 2026 11:23:41 EDT", "Thu,30 Jul 2026 17:23:41 +0200",
    ):
        assert at(text) == expected, text
    assert at("30 Jul 2026 15:23 +0000") == expected - 41
    assert at("1 Mar 99 0:00 +0000") == 920_246_400
    for text in ("", "soon", "30 Xyz 2026 15:23 +0000", "31 Feb 2026 15:23 +0000", "30 Jul 2026", "2026-07-30"):
        assert at(text) is None, text
