import json

import pytest
from pyspark.sql import functions as F

from rolesift.sources.normalize import normalize, normalize_provider
from rolesift.sources.pages import role_links
from rolesift.sources.registry import PROVIDERS, Provider, register
from tests.helpers import payloads

FEED_SINCE = "2026-07-20 00:00:00"


def run(spark, provider, body, since=None, **envelope):
    rows = payloads(spark, {"provider": provider, "body": body if isinstance(body, str) else json.dumps(body), **envelope})
    limit = F.lit(since).cast("timestamp") if since else None
    return normalize_provider(rows, provider, limit, ("engineer",)).orderBy("item_no").collect()


def test_greenhouse(spark):
    rows = run(spark, "greenhouse", {"jobs": [
        {"title": " AI Engineer ", "location": {"name": "Remote - EU"}, "absolute_url": "u1", "updated_at": "2026-07-01", "content": "<p>x</p>"},
        {"title": "  "}, {"title": None}, {"title": "No place", "absolute_url": "u2"},
    ]})
    assert [(r.title, r.location, r.remote, r.apply_url, r.posted_date, r.description) for r in rows] == [
        ("AI Engineer", "Remote - EU", True, "u1", "2026-07-01", "<p>x</p>"),
        ("No place", "", False, "u2", None, ""),
    ]
    assert {(r.source, r.ats_platform, r.company_name) for r in rows} == {("company_ats", "greenhouse", "Acme")}


def test_lever_is_a_top_level_array(spark):
    rows = run(spark, "lever", [
        {"text": "ML Engineer", "categories": {"location": "Oslo", "commitment": "Remote"}, "hostedUrl": "u", "createdAt": 1785000000000},
        {"text": "", "categories": None}, {"text": "Plain"},
    ])
    assert [(r.title, r.remote, r.posted_date) for r in rows] == [("ML Engineer", True, "1785000000000"), ("Plain", False, None)]


def test_ashby_flag_or_location(spark):
    rows = run(spark, "ashby", {"jobs": [
        {"title": "A", "location": "Oslo", "isRemote": True}, {"title": "B", "location": "Remote"}, {"title": "C", "isRemote": None},
    ]})
    assert [(r.title, r.remote) for r in rows] == [("A", True), ("B", True), ("C", False)]


def test_workday_identifier(spark):
    body = {"jobPostings": [{"title": "AI Engineer", "locationsText": "Remote", "externalPath": "/job/1", "postedOn": "Posted Today"}]}
    rows = run(spark, "workday", body, identifier="nv.wd5.myworkdayjobs.com/Site")
    assert rows[0].apply_url == "https://nv.wd5.myworkdayjobs.com/en-US/Site/job/1"
    assert run(spark, "workday", body, identifier="malformed") == []


def test_smartrecruiters(spark):
    rows = run(spark, "smartrecruiters", {"content": [
        {"id": "7", "name": "AI Engineer", "location": {"city": "Oslo", "country": "", "remote": True}},
        {"id": "8", "name": "Remote Engineer", "location": {"city": "Remote", "country": "no"}},
    ]})
    assert [(r.location, r.remote, r.apply_url) for r in rows] == [
        ("Oslo", True, "https://jobs.smartrecruiters.com/acme/7"),
        ("Remote, no", False, "https://jobs.smartrecruiters.com/acme/8"),
    ]


def test_bamboohr(spark):
    rows = run(spark, "bamboohr", {"result": [{"id": 12, "jobOpeningName": "AI Engineer", "locationLabel": "Remote", "departmentLabel": "R&D"}]})
    assert (rows[0].apply_url, rows[0].remote, rows[0].description, rows[0].posted_date) == (
        "https://acme.bamboohr.com/careers/12", True, "R&D", None)


def test_workable_and_recruitee_url_fallbacks(spark):
    rows = run(spark, "workable", {"jobs": [
        {"title": "A", "city": "Oslo", "country": "Norway", "url": "", "shortlink": "s", "telecommuting": True},
        {"title": "B", "country": "Norway", "url": "u", "shortlink": "s"},
    ]})
    assert [(r.location, r.apply_url, r.remote) for r in rows] == [("Oslo, Norway", "s", True), ("Norway", "u", False)]
    rows = run(spark, "recruitee", {"offers": [
        {"title": "A", "remote": True, "careers_url": "c", "careers_apply_url": "a", "published_at": "2026-07-01 10:00:00 UTC"},
        {"title": "B", "location": "Remote", "careers_url": "c"},
    ]})
    assert [(r.apply_url, r.remote) for r in rows] == [("a", True), ("c", False)]


def test_oracle_recruiting_reads_the_first_item_only(spark):
    body = {"items": [
        {"requisitionList": [{"Id": "9", "Title": "AI Engineer", "WorkplaceType": "REMOTE"}, {"Id": "1", "Title": ""}]},
        {"requisitionList": [{"Id": "2", "Title": "Other"}]},
    ]}
    rows = run(spark, "oracle_recruiting", body, identifier="h.example.com|CX_1")
    assert [(r.title, r.remote, r.apply_url) for r in rows] == [
        ("AI Engineer", True, "https://h.example.com/hcmUI/CandidateExperience/en/sites/CX_1/job/9")]
    assert run(spark, "oracle_recruiting", body, identifier="no separator") == []
    assert run(spark, "oracle_recruiting", {"items": []}, identifier="h|s") == []


def test_remoteok(spark):
    rows = run(spark, "remoteok", [
        {"legal": "notice"},
        {"id": "1", "position": "Plumber", "tags": ["Pipes"], "date": "2026-07-29"},
        {"id": "2", "position": "Maintenance", "tags": None, "date": "2026-07-29"},
        {"id": "3", "position": "Coder", "tags": ["NLP"], "company": " Beta ", "url": "", "apply_url": "a", "date": "2026-07-29T00:00:00+00:00"},
        {"id": "4", "position": "ML", "date": "2026-07-01"},
        {"id": "5", "position": "ML", "date": "yesterday"},
    ], since=FEED_SINCE)
    assert [(r.title, r.company_name, r.apply_url, r.remote, r.ats_platform) for r in rows] == [
        ("Maintenance", "", "", True, None), ("Coder", "Beta", "a", True, None), ("ML", "", "", True, None)]


def test_weworkremotely(spark):
    body = """<?xml version="1.0"?><rss><channel><title>t</title>
      <item><title>Acme: AI: Lead</title><link>l1</link><pubDate>Wed, 29 Jul 2026 10:00:00 +0000</pubDate><description><![CDATA[<b>x</b>]]></description></item>
      <item><title>No colon</title><link>l2</link></item>
      <item><title>Old: One</title><pubDate>Wed, 01 Jul 2026 10:00:00 +0000</pubDate></item>
      <item><title>Blank after:</title></item><item><title> </title></item></channel></rss>"""
    rows = run(spark, "weworkremotely", body, since=FEED_SINCE)
    assert [(r.company_name, r.title, r.location, r.description) for r in rows] == [
        ("Acme", "AI: Lead", "Remote", "<b>x</b>"), ("Unknown", "No colon", "Remote", ""), ("Blank after", "", "Remote", "")]


def test_himalayas_claims_guid_across_queries_before_other_tests(spark):
    old, new = 1782000000, 1785300000
    first = {"jobs": [
        {"guid": "g1", "title": " ", "pubDate": new},
        {"guid": "g2", "title": "Two", "companyName": " C ", "pubDate": new, "locationRestrictions": ["A", "B", "C", "D"], "excerpt": "e"},
        {"guid": "", "title": "No guid", "pubDate": new}, {"guid": "g3", "title": "Old", "pubDate": old},
    ]}
    second = {"jobs": [
        {"guid": "g1", "title": "Hidden by the blank one", "pubDate": new}, {"guid": "g2", "title": "Repeat", "pubDate": new},
        {"guid": "g3", "title": "Hidden by the old one", "pubDate": new}, {"guid": "g4", "title": "Four", "pubDate": None, "applicationLink": "a"},
    ]}
    rows = payloads(spark, {"provider": "himalayas", "ordinal": 1, "body": json.dumps(second)},
                    {"provider": "himalayas", "ordinal": 0, "body": json.dumps(first)})
    got = normalize_provider(rows, "himalayas", F.lit(FEED_SINCE).cast("timestamp")).orderBy("batch_no", "item_no").collect()
    assert [(r.title, r.company_name, r.location, r.apply_url, r.posted_date, r.description) for r in got] == [
        ("Two", "C", "A, B, C", "g2", str(new), "e"), ("Four", "", "Worldwide", "a", None, "")]


def test_jobicy(spark):
    rows = run(spark, "jobicy", {"jobs": [{"jobTitle": "AI Engineer", "companyName": "J", "jobGeo": "EU", "pubDate": "2026-07-25 10:00:00", "url": "u"}, {"jobTitle": ""}]}, since=FEED_SINCE)
    assert [(r.title, r.location, r.source) for r in rows] == [("AI Engineer", "EU", "jobicy")]


def test_teamtailor_blank_link_claims_its_url(spark):
    html = '<a href="/jobs/1"><img></a><a href="/jobs/1">Hidden</a><a href="https://x.com/jobs/22-ai">Remote AI</a><a href="/about">About</a>'
    rows = run(spark, "teamtailor", html)
    assert [(r.title, r.apply_url, r.remote) for r in rows] == [("Remote AI", "https://x.com/jobs/22-ai", True)]


def test_generic_page(spark):
    long = "engineer " * 20
    html = f'<a href="/j/1">AI Engineer (Remote)</a><a href="j/2">ML Engineer</a><a href="/about">About</a><a href="/j/1">Engineer again</a><a href="/l">{long}</a>'
    rows = run(spark, "generic", html, identifier="https://acme.com/careers/list")
    assert [(r.title, r.apply_url, r.remote, r.ats_platform) for r in rows] == [
        ("AI Engineer (Remote)", "https://acme.com/j/1", True, "generic"), ("ML Engineer", "https://acme.com/careers/j/2", False, "generic")]


def test_link_text_of_120_characters_is_kept(spark):
    df = spark.createDataFrame([(1, "https://a.com", f'<a href="/1">{"e" * 120}</a><a href="/2">{"e" * 121}</a>')], "page int, url string, html string")
    assert [r.link_url for r in role_links(df, "url", "html", ("e",)).collect()] == ["https://a.com/1"]


@pytest.mark.parametrize("provider", sorted(PROVIDERS))
def test_failed_or_broken_responses_give_no_rows(spark, provider):
    good = json.dumps({"jobs": [{"title": "x"}]})
    rows = payloads(
        spark,
        {"provider": provider, "http_status": 404, "body": good},
        {"provider": provider, "body": '{"jobs": [{"tit'},
        {"provider": provider, "body": '{"error": "gone"}'},
        {"provider": provider, "body": None},
        {"provider": provider, "body": ""},
    )
    assert normalize_provider(rows, provider).count() == 0


def test_normalize_all_and_registering_a_provider(spark):
    register(Provider(
        name="house_board", ddl="open array<struct<t:string>>", items=lambda p: p["open"],
        fields=lambda it, ident: {"title": it["t"], "apply_url": ident},
    ))
    try:
        rows = payloads(spark, {"provider": "house_board", "body": '{"open":[{"t":"AI Engineer"}]}'},
                        {"provider": "lever", "body": '[{"text":"ML Engineer"}]'}, {"provider": "unknown", "body": "{}"})
        got = {(r.ats_platform, r.title) for r in normalize(rows).collect()}
        assert got == {("house_board", "AI Engineer"), ("lever", "ML Engineer")}
    finally:
        del PROVIDERS["house_board"]
