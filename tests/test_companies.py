import pytest
from pyspark.sql import functions as F

from rolesift.functions.html import anchors
from rolesift.operators.coverage import (
    coverage_counts,
    coverage_report,
    detection_summary,
    health_rows,
    health_sample,
    health_summary,
    provider_share,
    source_share,
    untested_providers,
    with_coverage,
)
from rolesift.operators import discovery
from rolesift.operators.detection import (
    BOARD_RULES,
    detect_along_links,
    detect_board,
    detection_results,
    job_links,
    route_companies,
    write_back_detection,
)
from rolesift.operators.discovery import (
    boards_from_payloads,
    candidates,
    career_url,
    merge_retry,
    resolve,
    resolve_summary,
    resolved_list,
    retry_rows,
    seed_identifiers,
    spread_join,
    stated_providers,
    slug_rows,
    tasks_of,
    unresolved_list,
)
from rolesift.plans.boards import company_list_rows, enriched_rows, write_csv
from rolesift.sources.companies import first_companies, read_companies, read_csv, read_sample_sheet
from tests.helpers import pages, payloads, postings, values

# One text per rule, in the order of the rules, and what the tenant t42 is called by it.
RULE_TEXTS = [
    ("greenhouse.io/embed/job_board?for={}", "t42"),
    ("boards.greenhouse.io/{}", "t42"),
    ("boards-api.greenhouse.io/v1/boards/{}", "t42"),
    ("my.greenhouse.io/users/sign_in?job_board={}", "t42"),
    ("jobs.lever.co/{}", "t42"),
    ("jobs.ashbyhq.com/{}", "t42"),
    ("careers.smartrecruiters.com/{}", "t42"),
    ("{}.wd7.myworkdayjobs.com/Openings", "t42.wd7.myworkdayjobs.com/Openings"),
    ("{}.teamtailor.com", "t42"),
    ("{}.bamboohr.com", "t42"),
    ("apply.workable.com/{}", "t42"),
    ("{}.recruitee.com", "t42"),
    ('data-apibaseurl="https://{}" data-sitenumber="S1"', "t42|S1"),
]


def _rule_cases():
    """Per rule a hit in the page, one in the URL, a near miss, and every blocked identifier; then the order."""
    for rule, (text, identifier) in zip(BOARD_RULES, RULE_TEXTS, strict=True):
        hit = (rule.provider, identifier)
        yield f"before {text.format('t42')} behind", "", hit
        yield None, text.format("t42"), hit
        yield f"before {text.format('')} behind", text.format(""), None
        for blocked in rule.blocked:
            yield text.format(blocked), "", None
            yield text.format(blocked) + " " + text.format("t42"), "", None  # only the first match counts
            yield text.format("t42"), text.format(blocked), hit  # the URL first, then the page
        yield text.format("other"), text.format("t42"), hit
    for (early, (text, identifier)), (late, _) in zip(zip(BOARD_RULES, RULE_TEXTS), RULE_TEXTS[1:]):
        yield text.format("t42"), late.format("t42"), (early.provider, identifier)  # the order of the rules first
    yield "no board here", "https://t42.example", None
    yield None, None, None


DETECTIONS = list(_rule_cases())


def test_detection(spark):
    df = spark.createDataFrame([(i, h, u) for i, (h, u, _) in enumerate(DETECTIONS)], "i int, h string, u string")
    got = df.select("i", detect_board(F.col("h"), F.col("u")).alias("b")).orderBy("i").collect()
    assert [tuple(r.b) if r.b else None for r in got] == [e for _, _, e in DETECTIONS]


def _companies(spark, *rows):
    base = dict(file_pos=0, name="", career_page="https://x.com", priority="", ats_provider=None, ats_identifier=None)
    return spark.createDataFrame(
        [tuple({**base, "file_pos": i, **r}.values()) for i, r in enumerate(rows)],
        "file_pos bigint, name string, career_page string, priority string, ats_provider string, ats_identifier string")


def test_routes(spark):
    listed = _companies(
        spark, {"name": "cached", "ats_provider": "lever", "ats_identifier": "c"}, {"name": "half", "ats_provider": "lever"},
        {"name": "odd", "ats_provider": "taleo", "ats_identifier": "t"}, {"name": "found"}, {"name": "gone"}, {"name": "down"}, {"name": "never"})
    landed = pages(
        spark, {"company_name": "cached", "http_status": 500}, {"company_name": "half", "html": "x"}, {"company_name": "odd", "html": "x"},
        {"company_name": "found", "html": "jobs.ashbyhq.com/f"}, {"company_name": "gone", "http_status": 404},
        {"company_name": "down", "http_status": None, "error": "timeout"})
    got = {r.name: (r.ats_provider, r.ats_identifier, r.last_status) for r in route_companies(listed, landed).collect()}
    assert got == {
        "cached": ("lever", "c", "ok:cached"), "half": ("generic", None, "ok:generic"), "odd": ("generic", None, "ok:generic"),
        "found": ("ashby", "f", "ok"), "gone": (None, None, "error: HTTP 404"), "down": (None, None, "error: timeout"),
        "never": (None, None, "error: not fetched")}


def test_detection_write_back_overwrites_with_blanks(spark):
    results = detection_results(pages(
        spark, {"company_name": "a", "html": "jobs.lever.co/a"}, {"company_name": "b", "html": "none"}, {"company_name": "c", "http_status": 403, "html": "jobs.lever.co/c"}))
    listed = _companies(spark, *[{"name": n, "ats_provider": "old", "ats_identifier": "old"} for n in "abcd"])
    got = {r.name: (r.ats_provider, r.ats_identifier) for r in write_back_detection(listed, results).collect()}
    assert got == {"a": ("lever", "a"), "b": ("", ""), "c": ("", ""), "d": ("old", "old")}
    assert detection_summary(results).first().asDict() == {"checked": 3, "matched": 1, "no_match": 2}


def test_detection_along_links(spark):
    signal = '{"greenhouseId": 7}'
    landed = pages(
        spark, {"company_name": "Two Hits", "html": "jobs.lever.co/late", "final_url": "u1"}, {"company_name": "Two Hits", "html": "jobs.lever.co/first"},
        {"company_name": "My Co.", "html": signal}, {"company_name": "Dead", "html": signal}, {"company_name": "Gone", "html": "jobs.lever.co/g", "http_status": 404},
        {"company_name": "Both", "html": signal + "jobs.ashbyhq.com/b"})
    landed = landed.withColumn("page_no", F.when(F.col("final_url") == "u1", 1).otherwise(0))
    boards = spark.createDataFrame([("greenhouse", "myco", 2), ("greenhouse", "dead", 0), ("greenhouse", "both", 2)], "provider string, identifier string, job_count int")
    got = {r.name: (r.ats_provider, r.ats_identifier, r.note) for r in detect_along_links(landed, boards).collect()}
    assert got == {
        "Two Hits": ("lever", "first", "found on landing page"), "My Co.": ("greenhouse", "myco", "found via verified guess"),
        "Both": ("ashby", "b", "found on landing page")}


def test_job_links(spark):
    html = "".join(f'<a href="{h}">x</a>' for h in (
        "", "https://a.com/careers/jobs", "/blog/jobs", "/team", "/careers/search", "/careers/search", "/positions", "/openings"))
    rows = anchors(spark.createDataFrame([(1, "https://a.com/careers/jobs", html)], "page int, page_url string, html string"))
    assert [r.href for r in job_links(rows, ["page"]).orderBy("item_no").collect()] == ["/careers/search", "/positions"]


# -- discovery -------------------------------------------------------------------------------

SLUGS = {
    "Acme AI Labs": "acmeailabs acme-ai-labs acme acmeai acme-ai acmeailabsai getacmeailabs getacme acmeailabshq "
    "tryacmeailabs acmeailabsinc acmeailabslabs acmeailabsapp theacmeailabs joinacmeailabs",
    "AT&T": "atandt atandtai getatandt atandthq tryatandt atandtinc atandtlabs atandtapp theatandt joinatandt",
    "Foo-Bar Inc": "foo-barinc foo-bar-inc foo-bar foo-barincai foo-barai getfoo-barinc getfoo-bar foo-barinchq "
    "tryfoo-barinc foo-barincinc foo-barinclabs foo-barincapp thefoo-barinc joinfoo-barinc",
    "AI Labs": "ailabs ai-labs ai ailabsai getailabs ailabshq tryailabs ailabsinc ailabslabs ailabsapp theailabs joinailabs",
    "\u00dcn\u00ef S\u00f6ft": "nsft n-sft n nsftai getnsft nsfthq trynsft nsftinc nsftlabs nsftapp thensft joinnsft",
    "": "ai get hq try inc labs app the join",
    "  one  ": "one oneai getone onehq tryone oneinc onelabs oneapp theone joinone",
    "Two Words": "twowords two-words two twowordsai gettwowords twowordshq trytwowords twowordsinc twowordslabs "
    "twowordsapp thetwowords jointwowords",
}


def test_slugs_and_stated_providers(spark):
    df = spark.createDataFrame(list(enumerate(SLUGS)), "i int, company string")
    got = {}
    for row in slug_rows(df, "company").orderBy("i", "place").collect():
        got.setdefault(row.i, []).append(row.identifier)
    assert [" ".join(got.get(i, [])) for i in range(len(SLUGS))] == list(SLUGS.values())
    assert values(spark, stated_providers, ["Workable / Greenhouse ", "custom", None]) == [["greenhouse", "workable"], [], []]


def test_resolving(spark):
    sheet = spark.createDataFrame(
        [(0, "Acme AI", "Greenhouse, Lever"), (1, "Beta", "Taleo"), (2, "Gamma", ""), (3, "Delta", "Workday"), (4, "Eps", "Ashby"), (5, "Acme AI", "Lever")],
        "row_no bigint, company string, ats_text string")
    seeds = seed_identifiers(_companies(
        spark, {"name": "GAMMA", "ats_provider": "workday", "ats_identifier": "h/s"}, {"name": "acme ai", "ats_provider": "lever", "ats_identifier": "dead"},
        {"name": "none", "ats_provider": "", "ats_identifier": "x"}))
    boards = spark.createDataFrame(
        [("greenhouse", "acmeaiai", 4), ("greenhouse", "acme", 3), ("lever", "acme", 7), ("workday", "h/s", 0), ("ashby", "eps", None), ("lever", "acme", 9)],
        "provider string, identifier string, job_count int")
    outcome = resolve(sheet, seeds, boards)
    got = {r.row_no: (r.provider, r.identifier, r.job_count, r.reason) for r in outcome.collect()}
    missing = "no live-verifiable identifier found"
    assert got == {
        0: ("greenhouse", "acme", 3, None), 1: (None, None, None, "unsupported ATS: Taleo"), 2: ("workday", "h/s", 0, None),
        3: (None, None, None, missing), 4: (None, None, None, missing), 5: ("lever", "acme", 9, None)}
    assert resolve_summary(outcome).first().asDict() == {"resolved": 3, "attempted": 5, "live_jobs": 12, "skipped": 1}
    assert [r.company for r in unresolved_list(outcome).collect()] == ["Delta", "Eps", "Beta"]
    assert [r.career_page for r in resolved_list(outcome).collect()] == [
        "https://boards.greenhouse.io/acme", "https://jobs.lever.co/acme", "https://h/s"]
    workday_guesses = candidates(tasks_of(sheet, seeds), seeds).filter("row_no = 3").count()
    assert workday_guesses == 0

    again = retry_rows(sheet, unresolved_list(outcome))
    assert sorted(r.row_no for r in again.collect()) == [3, 4]
    live = spark.createDataFrame([("ashby", "eps", 2)], "provider string, identifier string, job_count int")
    resolved, unresolved = merge_retry(resolved_list(outcome), unresolved_list(outcome), resolve(again, seeds, live))
    assert [(r.company, r.job_count) for r in resolved.collect()] == [("Acme AI", 0), ("Acme AI", 0), ("Eps", 2), ("Gamma", 0)]
    assert {(r.company, r.reason) for r in unresolved.collect()} == {("Delta", missing), ("Beta", "unsupported ATS: Taleo")}


def test_spread_join_equals_a_join_with_a_hot_key(spark):
    left = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 50)) AS k", "'p' AS p")
    right = spark.range(40).selectExpr("concat('k', id) AS k", "'p' AS p", "id AS v").union(spark.sql("SELECT 'hot', 'p', 99L"))
    pick = lambda df: sorted((r.id, r.v) for r in df.collect())
    plain = pick(left.join(right, ["k", "p"]))
    assert pick(spread_join(left, right, ["k", "p"], ["id"])) == plain
    # one key in five of the rows, all others in one of a hundred at most
    assert pick(spread_join(left, right, ["k", "p"], ["id"], salts=7, share=10, least=1)) == plain


def test_a_repeated_name_is_resolved_once(spark, monkeypatch):
    """A name with other stated platforms is another task; each row gets the outcome of its own."""
    texts = ["lever"] * 300 + ["ashby"] * 200 + ["none"]
    sheet = spark.createDataFrame([(i, "Acme", t) for i, t in enumerate(texts)], "row_no bigint, company string, ats_text string")
    sheet = sheet.union(spark.createDataFrame([(900, None, "lever"), (901, "", "lever")], sheet.schema))
    seeds = spark.createDataFrame([], "name_key string, provider string, identifier string, seed_pos bigint")
    boards = spark.createDataFrame([("lever", "acme", 4), ("ashby", "acmeai", 5)], "provider string, identifier string, job_count int")
    tried, real = [], discovery.first_live

    def counted(rows, live):
        tried.append(rows.count())
        return real(rows, live)

    monkeypatch.setattr(discovery, "first_live", counted)
    got = {r.row_no: (r.provider, r.identifier, r.job_count, r.attempt) for r in resolve(sheet, seeds, boards).collect()}
    assert len(got) == 503 and tried[0] < 40
    assert {got[i] for i in range(300)} == {("lever", "acme", 4, True)}
    assert {got[i] for i in range(300, 500)} == {("ashby", "acmeai", 5, True)}
    assert got[500] == (None, None, None, False) and got[900] == got[901] == (None, None, None, True)


def test_payload_counts(spark):
    cases = [
        ("greenhouse", '{"jobs": [{}, {}]}', 2), ("greenhouse", '{"jobs": {}}', None), ("ashby", '{"x": 1}', None), ("ashby", '{"jobs": []}', 0),
        ("lever", '[{"a": 1}]', 1), ("lever", '{"error": 1}', None), ("smartrecruiters", '{"content": []}', None),
        ("smartrecruiters", '{"content": [1]}', 1), ("workday", '{"jobPostings": [{}]}', 1), ("workable", "broken", None), ("taleo", "[]", None)]
    rows = payloads(spark, *[{"provider": p, "identifier": str(i), "body": b} for i, (p, b, _) in enumerate(cases)])
    got = {int(r.identifier): r.job_count for r in boards_from_payloads(rows).collect()}
    assert got == {i: n for i, (_, _, n) in enumerate(cases)}


@pytest.mark.parametrize("provider,url", [("lever", "https://jobs.lever.co/x"), ("workday", "https://x"), ("taleo", "")])
def test_career_url(spark, provider, url):
    assert values(spark, lambda c: career_url(c, F.lit("x")), [provider]) == [url]


# -- coverage and health ---------------------------------------------------------------------


def test_coverage(spark):
    listed = _companies(
        spark, {"name": "z", "priority": "Tier 2"}, {"name": "a", "priority": "Other"}, {"name": "b", "priority": "Tier 1", "ats_provider": ""},
        {"name": "u", "ats_provider": "taleo"}, {"name": "f", "ats_provider": "lever"}, {"name": "ok", "ats_provider": "lever"}, {"name": "new", "ats_provider": "ashby"})
    state = spark.createDataFrame([("f", "error: HTTP 500"), ("ok", "ok"), ("u", "error: x"), ("z", None)], "name string, last_status string")
    covered = with_coverage(listed, state)
    assert {r.bucket: r.companies for r in coverage_counts(covered).collect()} == {"no_ats": 3, "unsupported_ats": 1, "failing": 1, "covered": 2}
    assert [r.name for r in coverage_report(covered).collect()] == ["u", "f", "b", "z", "a"]
    share = {r.provider: (r.companies, r.percent) for r in provider_share(listed).collect()}
    assert share == {"lever": (2, 28.6), "ashby": (1, 14.3), "Total confirmed": (3, 42.9)}
    kinds = postings(spark, {}, {"ats_platform": "generic"}, {"source": "jobicy", "ats_platform": None}, {})
    assert {r.source_type: (r.jobs, r.percent) for r in source_share(kinds).collect()} == {"board": (2, 50.0), "generic page": (1, 25.0), "feed": (1, 25.0)}
    supported = spark.createDataFrame([("lever",), ("workday",)], "ats_provider string")
    assert [r.ats_provider for r in untested_providers(listed, supported).collect()] == ["workday"]


def test_health(spark):
    listed = _companies(
        spark, *[{"name": f"l{i}", "ats_provider": "lever", "ats_identifier": f"l{i}"} for i in range(4)],
        {"name": "w", "ats_provider": "workable", "ats_identifier": "w"}, {"name": "no", "ats_provider": "workable"}, {"name": "t", "ats_provider": "taleo", "ats_identifier": "t"})
    answers = spark.createDataFrame(
        [("lever", "l0", 4, None), ("lever", "l1", 0, None), ("lever", "l2", None, "KeyError: x"), ("workable", "w", None, "timeout")],
        "provider string, identifier string, job_count int, error string")
    rows = health_rows(health_sample(listed, 3), answers)
    got = {r.ats_provider: (r.tested, r.ok, r.failed, r.total_jobs, r.avg_jobs) for r in health_summary(rows).collect()}
    assert got == {"lever": (3, 2, 1, 4, 2.0), "workable": (1, 0, 1, 0, 0.0)}


# -- files -----------------------------------------------------------------------------------


def test_company_list_from_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(
        "Company,Careers / Job Board URL,Region,Tier,Notes,ATS\n"
        ' Acme ,https://a.com,EU,Tier 1,"two\nlines, ""quoted""",lever\nNoUrl,,,,,\n,https://b.com,,,,\nBeta,https://b.com,,,, \n',
        encoding="utf-8")
    rows = read_companies(spark, str(path)).orderBy("file_pos").collect()
    assert [(r.name, r.priority, r.notes, r.ats_provider, r.ats_identifier) for r in rows] == [
        ("Acme", "Tier 1", 'two\nlines, "quoted"', "lever", None), ("Beta", "", "", None, None)]
    assert [r.name for r in first_companies(read_companies(spark, str(path)), 1).collect()] == ["Acme"]

    enriched = enriched_rows(read_csv(spark, str(path)), pages(spark, {"company_name": "Beta", "html": "jobs.lever.co/beta"}))
    got = {r["Company"]: (r["ATS"], r["ATS Identifier"]) for r in enriched.collect() if r["Company"]}
    assert got["Beta"] == ("lever", "beta") and got[" Acme "][0] == "lever"


def test_sample_sheet_repeats_are_tasks(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("Company,ATS\nAcme,Lever\n Acme ,Ashby\n,Lever\n", encoding="utf-8")
    rows = read_sample_sheet(spark, str(path)).orderBy("row_no").collect()
    assert [(r.company, r.ats_text) for r in rows] == [("Acme", "Lever"), ("Acme", "Ashby")]


def test_resolved_list_is_a_company_list(spark, tmp_path):
    resolved = spark.createDataFrame([("Acme", "https://jobs.lever.co/a", "lever", "a", 3)],
                                     "company string, career_page string, ats_provider string, ats_identifier string, job_count int")
    write_csv(company_list_rows(resolved), str(tmp_path / "out"))
    row = read_companies(spark, str(tmp_path / "out")).first()
    assert (row.name, row.career_page, row.ats_provider, row.ats_identifier) == ("Acme", "https://jobs.lever.co/a", "lever", "a")


def test_rows_keep_their_place_over_files_of_any_size(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for part, n in (("b", 400), ("a", 2), ("c", 30)):
        lines = "".join(f"{part}{i:03d},https://x.com,\n" for i in range(n))
        (folder / f"part-{part}.csv").write_text("Company,Careers / Job Board URL,ATS\n" + lines, encoding="utf-8")
    names = [r.name for r in read_companies(spark, str(folder)).orderBy("file_pos").collect()]
    assert names == [f"{p}{i:03d}" for p, n in (("a", 2), ("b", 400), ("c", 30)) for i in range(n)]
    assert [r.name for r in first_companies(read_companies(spark, str(folder)), 3).collect()] == ["a000", "a001", "b000"]
    assert [r.company for r in read_sample_sheet(spark, str(folder)).orderBy("row_no").limit(3).collect()] == ["a000", "a001", "b000"]
