import pytest
from pyspark.sql import functions as F

from rolesift.operators.identity import dedupe_and_mark, first_arrivals, with_hash
from rolesift.operators.relevance import relevant_postings
from rolesift.operators.reporting import OTHER, TOP, report_items
from rolesift.operators.scoring import score_postings, stars, years_points, years_required
from rolesift.operators.selection import (
    cap_per_company,
    not_recommended_reason,
    qualifies,
    recommendations,
    worth_looking_at,
)
from rolesift.operators.topk import first_k
from rolesift.plans.daily import rank_postings
from rolesift.settings import Limits, Roles, Settings
from tests.helpers import PROFILE, ROLES, postings, values


def titles(df):
    return [r.title for r in df.orderBy("item_no").collect()]


def test_role_filter(spark):
    rows = postings(spark, *[{"title": t} for t in (
        "Senior AI engineer", "Frontend AI Engineer", "AI Engineer Intern", "International AI Engineer",
        "Accountant", "Threat AI Engineer", "Machine Learning Engineer")])
    assert titles(relevant_postings(rows, ROLES)) == ["Senior AI engineer", "Machine Learning Engineer"]
    with_interns = Roles(ROLES.include, ROLES.exclude, True, ROLES.internship_words)
    assert "AI Engineer Intern" in titles(relevant_postings(rows, with_interns))
    assert relevant_postings(rows, Roles()).count() == 0


@pytest.mark.parametrize("text,expected", [
    ("Requires 3-5 years of experience", 3), ("5+ years in ML", 5), ("2 yrs", 2), ("2 yr", 2), ("3 YOE", 3),
    ("3-year plan", 3), ("10 to 12 years", 10), ("2 years", 2), ("3–5 years", 5), ("3.5 years", 5),
    ("founded 20 years ago, 1-2 years needed", 1), ("Series Y round", None), ("Python 3.9+ required", None),
    ("team of 25 engineers", None), ("7 yearsold", None), ("99999999999999 years", None), ("", None),
])
def test_years(spark, text, expected):
    assert values(spark, years_required, [text]) == [expected]


def test_points_and_stars_at_the_edges(spark):
    years = values(spark, lambda c: years_points(c, 3), [None, 3, 4], "v int")
    assert years == [5, 10, 2]
    assert values(spark, stars, [80.0, 79.9, 65.0, 50.0, 30.0, 29.9], "v double") == [5, 4, 4, 3, 2, 1]


# title, location, description, remote, remote preference; score (5 of it for unstated years), reason
SCORES = [
    ("AI Engineer", "", "", False, "strong", 45.0, 'title matches "AI Engineer"'),
    ("Cook", "Berlin", "storage", False, "strong", 10.0, "stack overlap: rag"),
    ("Cook", "Berlin", "nothing", False, "strong", 5.0, "General AI/ML role match"),
    ("Cook", "Berlin", "nothing", True, "strong", 25.0, "fully remote"),
    ("Cook", "Berlin", "nothing", True, "soft", 18.0, "remote"),
    ("Cook", "Berlin", "nothing", True, "none", 10.0, "General AI/ML role match"),
    ("Cook", "INDIA", "", False, "soft", 15.0, "location fits (INDIA)"),
    ("Lead Machine Learning Engineer", "Remote, India", "Python LLM", True, "strong", 80.0,
     'title matches "Machine Learning Engineer"; stack overlap: python, llm; fully remote; location fits (Remote, India)'),
    ("ai engineer and machine learning engineer", "Berlin", "PyTorch storage LLM Python", False, "none", 65.0,
     'title matches "AI Engineer"; stack overlap: python, llm, rag, pytorch'),
]


def test_scores_and_reasons(spark):
    for preference in ("strong", "soft", "none"):
        cases = [case for case in SCORES if case[4] == preference]
        rows = [dict(zip(("title", "location", "description", "remote"), case)) for case in cases]
        profile = type(PROFILE)(3, PROFILE.countries, preference, PROFILE.keywords)
        got = score_postings(postings(spark, *rows), profile, ROLES).orderBy("item_no").collect()
        assert [(r.rank_score, r.rank_reason) for r in got] == [case[5:] for case in cases]
        assert [r.has_stack_overlap for r in got] == ["stack overlap" in case[6] for case in cases]


def test_known_scores(spark):
    strong, weak = score_postings(postings(
        spark,
        {"location": "Remote, India", "remote": True, "description": "Python, LLM, RAG and PyTorch. 1-2 years."},
        {"location": "Germany", "description": "8+ years of obscure tools"},
    ), PROFILE, ROLES).orderBy("item_no").collect()
    assert (strong.rank_score, strong.rank_stars, strong.required_years_experience) == (95.0, 5, 1)
    assert "needs ~1 yrs experience (within your 3-yr preference)" in strong.rank_reason
    assert (weak.rank_score, weak.rank_stars, weak.has_stack_overlap) == (42.0, 2, False)


def test_first_arrival_wins_and_applied_go(spark):
    rows = with_hash(postings(
        spark,
        {"title": "A", "apply_url": "feed", "source_rank": 2},
        {"title": "  a", "apply_url": "board"},
        {"title": "B"}, {"title": "C"}, {"title": "A", "location": "Oslo", "apply_url": "other place"},
    ))
    pick = lambda *t: rows.filter(F.lower(F.trim("title")).isin(*t) & (F.col("location") == "")).select("job_hash")
    repeated = pick("b").union(pick("b"))
    got = {r.apply_url if r.title.strip().lower() == "a" else r.title: r.is_new
           for r in dedupe_and_mark(rows, pick("c"), repeated).collect()}
    assert got == {"board": True, "C": False, "other place": True}


def test_a_third_of_all_rows_under_one_hash(spark):
    rows = [{"title": "hot" if i % 3 == 0 else f"t{i}", "apply_url": str(i)} for i in range(3000)]
    df = with_hash(postings(spark, *rows).repartition(8))
    kept = first_arrivals(df)
    assert kept.count() == 2001
    assert kept.filter("title = 'hot'").first().apply_url == "0"
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()


def test_first_k_beyond_the_group_limit_is_exact(spark):
    rows = spark.range(6000).selectExpr("id", "if(id % 3 = 0, 0, id % 7) AS k")
    got = first_k(rows, ["k"], ["id"], 1200).groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")).collect()
    all_rows = [(i, 0 if i % 3 == 0 else i % 7) for i in range(6000)]
    for r in got:
        mine = [i for i, k in all_rows if k == r.k][:1200]
        assert (r.n, r.m) == (len(mine), mine[-1])


def _scored(spark, *rows):
    base = {"rank_score": 50.0, "rank_stars": 3, "required_years_experience": None, "has_stack_overlap": True, "is_new": True, "rank_reason": "r"}
    plain = postings(spark, *[{k: v for k, v in r.items() if k not in base} for r in rows])
    extra = spark.createDataFrame(
        [(i, *[{**base, **r}[k] for k in base]) for i, r in enumerate(rows)],
        "item_no int, rank_score double, rank_stars int, required_years_experience int, has_stack_overlap boolean, is_new boolean, rank_reason string")
    return with_hash(plain.join(extra, "item_no"))


def test_cap_keeps_the_best_and_breaks_ties_by_arrival(spark):
    rows = [{"company_name": " Big\t" if i % 2 else "BIG", "title": f"t{i}", "rank_score": float(i // 2)} for i in range(8)]
    rows += [{"company_name": "", "title": f"b{i}"} for i in range(4)] + [{"company_name": " ", "title": "b4"}, {"company_name": "Solo", "title": "s"}]
    got = titles(cap_per_company(_scored(spark, *rows), 3))
    assert got == ["t4", "t6", "t7", "b0", "b1", "b2", "s"]


def test_qualifying_and_reasons(spark):
    cases = [
        (dict(remote=True), True, "ranked below your top picks"),
        (dict(remote=True, required_years_experience=3), True, "ranked below your top picks"),
        (dict(remote=True, required_years_experience=4), False, "needs ~4+ yrs experience (above your 3-yr preference)"),
        (dict(remote=False), False, "on-site / not remote"),
        (dict(remote=True, has_stack_overlap=False), False, "no direct tech-stack overlap detected"),
        (dict(remote=False, has_stack_overlap=False, required_years_experience=9), False,
         "needs ~9+ yrs experience (above your 3-yr preference); on-site / not remote; no direct tech-stack overlap detected"),
    ]
    rows = _scored(spark, *[{**c, "title": f"t{i}"} for i, (c, _, _) in enumerate(cases)])
    got = rows.select("item_no", qualifies(3).alias("q"), not_recommended_reason(3).alias("n")).orderBy("item_no").collect()
    assert [(r.q, r.n) for r in got] == [(q, n) for _, q, n in cases]


def test_overflow_lands_in_the_remainder_and_report_numbers_both(spark):
    rows = _scored(spark, *[{"title": f"t{i}", "remote": True, "rank_score": 90.0 - (i // 2), "location": "" if i else "Oslo"} for i in range(5)],
                   {"title": "old", "remote": True, "is_new": False}, {"title": "site", "rank_stars": 2, "rank_score": 40.0})
    top = recommendations(rows, 3, 3, 3)
    others = worth_looking_at(rows, top, 3, 10)
    items = report_items(TOP, top).unionByName(report_items(OTHER, others)).orderBy("section", "position").collect()
    assert [(r.section, r.position, r.title) for r in items] == [
        (TOP, 1, "t0"), (TOP, 2, "t1"), (TOP, 3, "t2"), (OTHER, 1, "t3"), (OTHER, 2, "t4"), (OTHER, 3, "site")]
    assert [r.reason for r in items][3:] == ["ranked below your top picks"] * 2 + ["on-site / not remote"]
    assert (items[0].stars, items[0].stars_padded, items[0].location, items[1].location) == ("★★★", "★★★☆☆", "Oslo", "n/a")
    assert (items[0].mode, items[5].mode, items[0].score, items[0].posted_date) == ("Remote", "On-site", "90", "n/a")


def test_ranking_never_shuffles_descriptions(spark):
    empty = spark.createDataFrame([], "job_hash string")
    plan = rank_postings(postings(spark, {}), empty, empty, Settings(PROFILE, ROLES, Limits()))
    text = plan._jdf.queryExecution().sparkPlan().toString()
    above = text[: text.rindex("Window")]
    assert "description" not in above
