import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rolesift.operators.reporting import evolve_reports
from rolesift.operators.upsert import record_checks, upsert_companies, upsert_postings
from rolesift.operators.detection import route_companies
from rolesift.plans.daily import (
    DailyRun,
    company_postings,
    feed_postings,
    rank_postings,
    relevant_scored,
    score_items,
    scored_postings,
    window_start,
)
from rolesift.plans.state import AppendTable, KeyedTable, list_names, mark_applied, path_exists, stage
from rolesift.schema import APPLIED_DDL, COMPANY_DDL, PAGE_DDL, PAYLOAD_DDL, POSTING_STATE_DDL, REPORT_DDL, conform
from rolesift.settings import Limits, Settings
from rolesift.sources import normalize
from rolesift.streaming import ingest
from rolesift.streaming.ingest import ingest_payloads, payload_stream
from tests.helpers import PROFILE, ROLES, pages, payloads

SETTINGS = Settings(PROFILE, ROLES, Limits(per_company=2, top_n=2, min_stars=3, worth_looking=5))
DAY = datetime(2026, 7, 30, 12, tzinfo=timezone.utc)


def test_upsert_keeps_first_seen_and_insert_only_columns(spark):
    state = conform(
        spark.createDataFrame([("h1", "old title", "u", 10.0), ("h2", "stays", "u2", 20.0)], "job_hash string, title string, apply_url string, rank_score double")
        .withColumns({"first_seen_at": F.lit(DAY), "last_seen_at": F.lit(DAY), "posted_date": F.lit("p")}), POSTING_STATE_DDL)
    later = DAY + timedelta(days=1)
    batch = spark.createDataFrame(
        [("h1", "new title", "v", 11.0, None, later), ("h3", "fresh", "w", 12.0, "q", later)],
        "job_hash string, title string, apply_url string, rank_score double, posted_date string, seen_at timestamp")
    once = upsert_postings(state, batch)
    got = {r.job_hash: (r.title, r.apply_url, r.rank_score, r.posted_date, r.first_seen_at.day, r.last_seen_at.day) for r in once.collect()}
    assert got == {"h1": ("old title", "v", 11.0, None, 30, 31), "h2": ("stays", "u2", 20.0, "p", 30, 30), "h3": ("fresh", "w", 12.0, "q", 31, 31)}
    assert sorted(map(str, upsert_postings(once, batch).collect())) == sorted(map(str, once.collect()))


def test_company_upsert_and_checks(spark):
    state = conform(spark.createDataFrame([("a", "old", "lever", "x", "ok"), ("b", "keep", None, None, None)],
                                          "name string, career_page string, ats_provider string, ats_identifier string, last_status string"), COMPANY_DDL)
    listed = spark.createDataFrame([(0, "a", "first"), (1, "a", "last"), (2, "c", "new")], "file_pos bigint, name string, career_page string")
    listed = listed.withColumns({"region": F.lit("r"), "priority": F.lit("p"), "notes": F.lit("n")})
    merged = upsert_companies(state, listed)
    got = {r.name: (r.career_page, r.region, r.ats_provider, r.last_status) for r in merged.collect()}
    assert got == {"a": ("last", "r", "lever", "ok"), "b": ("keep", None, None, None), "c": ("new", "r", None, None)}
    checks = spark.createDataFrame([("a", None, None, "error: HTTP 404"), ("zz", "x", "y", "ok")],
                                   "name string, ats_provider string, ats_identifier string, last_status string").withColumn("last_checked_at", F.lit(DAY))
    got = {r.name: (r.ats_provider, r.last_status) for r in record_checks(merged, checks).collect()}
    assert got == {"a": (None, "error: HTTP 404"), "b": (None, None), "c": (None, None)}


def _applied_row(spark, name):
    return spark.createDataFrame([(name, DAY, "")], APPLIED_DDL)


def _hashes(table):
    return sorted(r.job_hash for r in table.read().collect())


def test_merges_tokens_and_broken_merges(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), APPLIED_DDL, "job_hash", buckets=3)
    add = lambda name: lambda now: now.union(_applied_row(spark, name))
    assert _hashes(table) == []
    table.merge(add("a"), "one")
    table.merge(add("b"), "two")
    table.merge(add("ignored"), "two")
    assert _hashes(table) == ["a", "b"] and table.tokens() == ["one", "two"]

    def fails(*_):
        raise RuntimeError("down")

    # broken while it is planned or staged: nothing has changed, and nobody waits
    with pytest.raises(RuntimeError):
        table.merge(fails, "three")
    (tmp_path / "t" / "pending" / "four" / "of=3" / "bucket=0").mkdir(parents=True)
    table.merge(add("c"), "five")
    assert _hashes(table) == ["a", "b", "c"] and list_names(spark, f"{table.root}/pending") == []
    # broken between staging and overwriting: the next writer finishes it
    with monkeypatch.context() as broken:
        broken.setattr(table, "_overwrite", fails)
        with pytest.raises(RuntimeError):
            table.merge(add("d"), "six")
    assert _hashes(table) == ["a", "b", "c"]
    table.merge(add("e"), "seven")
    assert _hashes(table) == ["a", "b", "c", "d", "e"]
    table.merge(add("d"), "six")  # its own replay
    assert _hashes(table) == ["a", "b", "c", "d", "e"] and sorted(table.tokens()) == ["five", "one", "seven", "six", "two"]


def test_a_merge_finished_twice_changes_nothing(spark, tmp_path, monkeypatch):
    """Broken between the overwrite and the mark that it is done."""
    table = KeyedTable(spark, str(tmp_path / "t"), APPLIED_DDL, "job_hash", buckets=2)
    table.merge(lambda now: now.union(_applied_row(spark, "a")), "one")
    whole = table._overwrite

    def overwrite_and_break(rows):
        whole(rows)
        raise RuntimeError("down")

    with monkeypatch.context() as broken:
        broken.setattr(table, "_overwrite", overwrite_and_break)
        with pytest.raises(RuntimeError):
            table.merge(lambda now: now.union(_applied_row(spark, "b")), "two")
    again = KeyedTable(spark, table.root, APPLIED_DDL, "job_hash", buckets=7)
    again.recover()
    assert _hashes(again) == ["a", "b"] and again.tokens() == ["one", "two"]
    assert again.buckets() == 2  # a table keeps its number of buckets
    again.merge(lambda now: now.union(_applied_row(spark, "c")), "three")
    assert _hashes(table) == ["a", "b", "c"]


def test_append_table_repeats_and_replays(spark, tmp_path):
    table = AppendTable(spark, str(tmp_path / "a"), APPLIED_DDL)
    assert table.read().count() == 0
    hashes = spark.createDataFrame([("h",)], "job_hash string")
    mark_applied(table, hashes, "x")
    mark_applied(table, hashes)
    assert table.read().count() == 2
    table.append(hashes, "t")
    table.append(hashes, "t")
    assert table.read().count() == 3
    table.append(spark.createDataFrame([("other",), ("rows",)], "job_hash string"), "t")  # is done
    assert table.read().count() == 3


def test_report_shapes(spark):
    new = conform(spark.createDataFrame([(3, 1)], "total_jobs_found bigint, sources_checked bigint"), REPORT_DDL)
    old = spark.createDataFrame([(1, 9)], "total_jobs_found bigint, companies_checked bigint")
    middle = spark.createDataFrame([(2, 4)], "total_jobs_found bigint, sources_checked bigint")
    got = sorted((r.total_jobs_found, r.companies_checked, r.sources_checked) for r in evolve_reports([old, middle], new).collect())
    assert got == [(1, 9, None), (2, None, 4), (3, None, 1)]


def test_window_start(spark):
    runs = spark.createDataFrame([(DAY,), (DAY - timedelta(days=4),)], "run_started_at timestamp")
    now = F.lit(DAY + timedelta(days=1))
    pick = lambda r: spark.range(1).select(F.unix_seconds(window_start(r, now, 3)).alias("s")).first().s
    assert pick(runs) == int(DAY.timestamp())
    assert pick(runs.limit(0)) == int((DAY - timedelta(days=2)).timestamp())


def test_stage_reads_back_the_same_rows(spark):
    df = spark.range(10).selectExpr("id", "named_struct('a', id) AS s")
    assert sorted(stage(df, "test").collect()) == df.collect()


# -- the whole run ---------------------------------------------------------------------------

LEVER = [
    {"text": "AI Engineer", "categories": {"location": "Remote, India"}, "hostedUrl": "a1", "descriptionPlain": "python llm 1-2 years"},
    {"text": "AI Engineer II", "categories": {"location": "Remote"}, "hostedUrl": "a2", "descriptionPlain": "python, 9+ years"},
    {"text": "Junior AI Engineer", "categories": {"location": "Oslo"}, "hostedUrl": "a3", "descriptionPlain": ""},
    {"text": "Frontend AI Engineer", "hostedUrl": "a4"},
]
FEED = {"jobs": [
    {"jobTitle": "AI Engineer", "companyName": "ACME", "jobGeo": "Remote,  India", "jobExcerpt": "copy", "pubDate": "2026-07-29", "url": "f1"},
    {"jobTitle": "Machine Learning Engineer", "companyName": "Feedco", "jobGeo": "EU", "jobExcerpt": "pytorch rag", "pubDate": "2026-07-29", "url": "f2"},
    {"jobTitle": "AI Engineer", "companyName": "Stale", "jobGeo": "EU", "pubDate": "2026-07-01", "url": "f3"},
]}


def _inputs(spark):
    companies = spark.createDataFrame(
        [(0, "Acme", "https://acme.com", "EU", "Tier 1", "", None, None), (1, "Page", "https://page.com/careers", "", "Tier 2", "", None, None),
         (2, "Gone", "https://gone.com", "", "", "", None, None)],
        "file_pos bigint, name string, career_page string, region string, priority string, notes string, ats_provider string, ats_identifier string")
    landed_pages = pages(
        spark, {"company_name": "Acme", "html": "https://jobs.lever.co/acme"},
        {"company_name": "Page", "html": '<a href="/j">AI Engineer, remote</a>'}, {"company_name": "Gone", "http_status": 410})
    landed = payloads(
        spark, {"provider": "lever", "body": json.dumps(LEVER), "company_name": None}, {"provider": "lever", "identifier": "other", "body": json.dumps(LEVER)},
        {"provider": "jobicy", "body": json.dumps(FEED)}, {"provider": "remoteok", "http_status": None, "error": "timeout", "body": None})
    return companies, landed_pages, landed


def test_two_runs(spark, tmp_path):
    run = DailyRun(spark, str(tmp_path), SETTINGS)
    inputs = _inputs(spark)
    first = run.run(*inputs, started_at=DAY)
    ranked = {(r.company_name, r.title): (r.apply_url, r.is_new, r.company_priority) for r in first.ranked.collect()}
    assert ranked == {
        ("Acme", "AI Engineer"): ("a1", True, "Tier 1"), ("Acme", "AI Engineer II"): ("a2", True, "Tier 1"),
        ("Feedco", "Machine Learning Engineer"): ("f2", True, ""), ("Page", "AI Engineer, remote"): ("https://page.com/j", True, "Tier 2")}
    assert [r.apply_url for r in first.recommended.collect()] == ["a1", "f2"]
    assert {r.apply_url: r.rank_reason for r in first.others.collect()} == {
        "a2": "needs ~9+ yrs experience (above your 3-yr preference)",
        "https://page.com/j": "no direct tech-stack overlap detected"}
    metrics = first.metrics.first()
    assert (metrics.total_jobs_found, metrics.new_jobs_found, metrics.companies_checked, metrics.companies_failed, metrics.sources_checked, metrics.sources_failed) == (4, 4, 3, 1, 2, 1)
    text = "\n".join(r.text for r in first.digest.collect())
    assert "## Top 2 Recommendations" in text and "### 1. AI Engineer — Acme ★★★★★" in text and "## Other jobs worth looking at (2)" in text
    published = [r.value for r in spark.read.text(run.report_path(DAY) + "/digest").collect()]
    assert published[0] == "# AI Job Digest — 2026-07-30" and "### 2. Machine Learning Engineer — Feedco ★★★★" in published
    stored = {r.apply_url: (r.first_seen_at, r.last_seen_at) for r in run.postings.read().collect()}

    again = run.run(*inputs, started_at=DAY)  # a replay changes nothing
    assert again.ranked.filter("is_new").count() == 4
    assert len(run.postings.tokens()) == 1 and run.reports.read().count() == 1

    mark_applied(run.applied, run.postings.read().filter("apply_url = 'f2'"))
    companies, landed_pages, landed = inputs
    moved = landed.withColumn("fetched_at", F.lit(DAY + timedelta(days=1)))
    second = run.run(companies, landed_pages, moved, started_at=DAY + timedelta(hours=20))
    assert second.ranked.filter("is_new").count() == 0
    assert "Feedco" not in {r.company_name for r in second.ranked.collect()}
    after = {r.apply_url: (r.first_seen_at, r.last_seen_at) for r in run.postings.read().collect()}
    assert {k: v[0] for k, v in after.items()} == {k: v[0] for k, v in stored.items()}
    assert after["a1"][1] > stored["a1"][1] and after["f2"] == stored["f2"]
    companies_state = {r.name: (r.ats_provider, r.last_status) for r in run.companies.read().collect()}
    assert companies_state == {"Acme": ("lever", "ok"), "Page": ("generic", "ok:generic"), "Gone": (None, "error: HTTP 410")}
    assert run.reports.read().count() == 2
    assert "_No new jobs met" in second.digest.first().text


def _everything(spark, run):
    tables = [run.companies.read(), run.postings.read(), run.reports.read()]
    return [sorted(map(str, t.collect())) for t in tables] + [[r.value for r in spark.read.text(run.report_path(DAY) + "/digest").collect()]]


def test_old_runs_done_again_change_nothing(spark, tmp_path):
    run = DailyRun(spark, str(tmp_path), SETTINGS)
    companies, landed_pages, landed = _inputs(spark)
    starts = [DAY + timedelta(hours=h) for h in range(3)]
    for n, start in enumerate(starts):
        fetched = landed.withColumn("fetched_at", F.lit(start - timedelta(minutes=5)))
        run.run(companies, landed_pages, fetched, started_at=start)
    before = _everything(spark, run)
    assert [r.new_jobs_found for r in run.reports.read().orderBy("run_started_at").collect()] == [4, 0, 0]
    again = run.run(companies, landed_pages, landed.withColumn("fetched_at", F.lit(DAY - timedelta(minutes=5))), started_at=DAY)
    assert again.ranked.filter("is_new").count() == 4
    assert _everything(spark, run) == before


def test_a_crashed_run_does_not_hold_up_the_next(spark, tmp_path, monkeypatch):
    run = DailyRun(spark, str(tmp_path), SETTINGS)
    companies, landed_pages, landed = _inputs(spark)

    def fails(*_):
        raise RuntimeError("down")

    for method in ("merge", "_overwrite"):
        with monkeypatch.context() as broken:
            broken.setattr(run.postings, method, fails)
            with pytest.raises(RuntimeError):
                run.run(companies, landed_pages, landed, started_at=DAY)
    later = DAY + timedelta(hours=1)
    run.run(companies, landed_pages, landed.withColumn("fetched_at", F.lit(later)), started_at=later)
    assert run.postings.read().count() == 4 and run.reports.read().count() == 1
    before = _everything(spark, run)
    run.run(companies, landed_pages, landed, started_at=DAY)  # the crashed one reports late, and takes nothing back
    after = _everything(spark, run)
    assert after[:2] == before[:2] and after[3] == before[3] and len(after[2]) == 2


def test_company_limit(spark, tmp_path):
    result = DailyRun(spark, str(tmp_path), SETTINGS).run(*_inputs(spark), started_at=DAY, company_limit=1)
    assert result.metrics.first().companies_checked == 1
    assert path_exists(spark, result.scratch)
    result.release()
    assert not path_exists(spark, result.scratch)


# -- stream ----------------------------------------------------------------------------------


def test_stream_equals_batch_and_replay_is_harmless(spark, tmp_path):
    landing, state_root = str(tmp_path / "landing"), str(tmp_path / "state")
    first = payloads(spark, {"provider": "lever", "body": json.dumps(LEVER)})
    second = payloads(
        spark, {"provider": "jobicy", "body": json.dumps(FEED), "fetched_at": DAY + timedelta(days=1)},
        {"provider": "lever", "body": json.dumps(LEVER[:1]), "fetched_at": DAY + timedelta(days=1)})
    state = KeyedTable(spark, state_root, POSTING_STATE_DDL, "job_hash")
    applied = AppendTable(spark, str(tmp_path / "applied"), APPLIED_DDL)
    source = lambda: spark.readStream.schema(PAYLOAD_DDL).option("maxFilesPerTrigger", 1).parquet(landing)

    def consume(offsets):
        ingest_payloads(source(), state, applied, str(tmp_path / offsets), SETTINGS)

    first.coalesce(1).write.mode("append").parquet(landing)
    consume("offsets")
    second.coalesce(1).write.mode("append").parquet(landing)
    consume("offsets")
    got = {(r.company_name, r.title): (r.apply_url, r.first_seen_at, r.last_seen_at) for r in state.read().collect()}
    seen = {k[1]: (v[1].day, v[2].day) for k, v in got.items() if k[0] in ("Acme", "ACME")}
    assert seen["AI Engineer"] == (30, 31) and seen["AI Engineer II"] == (30, 30)
    assert len(got) == 4 and got[("Feedco", "Machine Learning Engineer")][0] == "f2"

    before = sorted(map(str, state.read().collect()))
    consume("offsets-lost")  # all files come again, under a new query id: merged again, to the same rows
    assert len(state.tokens()) == 3
    assert sorted(map(str, state.read().collect())) == before
    consume("offsets-lost")  # nothing new, no version
    assert len(state.tokens()) == 3

    # all files in one micro-batch give what the batch plan gives
    landed = spark.read.schema(PAYLOAD_DDL).parquet(landing)
    whole = KeyedTable(spark, str(tmp_path / "whole"), POSTING_STATE_DDL, "job_hash")
    ingest_payloads(payload_stream(spark, landing), whole, applied, str(tmp_path / "offsets-whole"), SETTINGS)
    empty = spark.createDataFrame([], POSTING_STATE_DDL)
    ranked = rank_postings(normalize(landed), empty, applied.read(), SETTINGS).withColumn("seen_at", F.col("fetched_at"))
    expected = conform(upsert_postings(empty, ranked), POSTING_STATE_DDL)
    timeless = lambda df: sorted(map(str, df.drop("first_seen_at", "last_seen_at").collect()))
    assert timeless(whole.read()) == timeless(expected)
    times = {r.title: (r.first_seen_at.day, r.last_seen_at.day) for r in whole.read().filter("lower(company_name) = 'acme'").collect()}
    assert times["AI Engineer"] == (30, 31) and times["AI Engineer II"] == (30, 30)


def _capped(n, company, day):
    """A response with n postings of one company that all pass the filters."""
    items = [{"text": f"AI Engineer {i}", "hostedUrl": f"{company}{i}", "descriptionPlain": "python llm " * (i % 3)} for i in range(n)]
    return {"provider": "lever", "identifier": company, "company_name": company, "body": json.dumps(items), "fetched_at": DAY + timedelta(days=day)}


def test_state_does_not_depend_on_files_per_batch(spark, tmp_path):
    landing = str(tmp_path / "landing")
    for i in range(4):
        payloads(spark, _capped(3, "one", i), _capped(2, f"c{i}", i)).coalesce(1).write.mode("append").parquet(landing)
    applied = AppendTable(spark, str(tmp_path / "applied"), APPLIED_DDL)
    states = []
    for files in (1, 2, 1000):
        state = KeyedTable(spark, str(tmp_path / f"state{files}"), POSTING_STATE_DDL, "job_hash")
        ingest_payloads(payload_stream(spark, landing, files), state, applied, str(tmp_path / f"offsets{files}"), SETTINGS)
        assert len(state.tokens()) == 1
        states.append(sorted(map(str, state.read().collect())))
    assert states[0] == states[1] == states[2]
    assert sum("company_name='one'" in row for row in states[0]) == SETTINGS.limits.per_company


def test_second_stream_into_one_state_loses_nothing(spark, tmp_path):
    state = KeyedTable(spark, str(tmp_path / "state"), POSTING_STATE_DDL, "job_hash")
    applied = AppendTable(spark, str(tmp_path / "applied"), APPLIED_DDL)
    for name in ("a", "b"):
        payloads(spark, _capped(2, name, 0)).write.parquet(str(tmp_path / name))
        ingest_payloads(payload_stream(spark, str(tmp_path / name)), state, applied, str(tmp_path / f"offsets-{name}"), SETTINGS)
    assert sorted(r.apply_url for r in state.read().collect()) == ["a0", "a1", "b0", "b1"]


def _broken_stream(spark, tmp_path):
    """A stream of one file per batch, and what it has stored."""
    state = KeyedTable(spark, str(tmp_path / "state"), POSTING_STATE_DDL, "job_hash", buckets=2)
    applied = AppendTable(spark, str(tmp_path / "applied"), APPLIED_DDL)
    landing, offsets = str(tmp_path / "landing"), str(tmp_path / "offsets")
    for n, name in enumerate("ab"):
        payloads(spark, _capped(2, name, n)).coalesce(1).write.mode("append").parquet(landing)

    def consume():
        ingest_payloads(payload_stream(spark, landing, 1), state, applied, offsets, SETTINGS)

    def stored():
        assert list_names(spark, f"{offsets}-staged") == []
        return sorted(r.apply_url for r in state.read().collect())

    return state, consume, stored


def _break(*_):
    raise RuntimeError("down")


def test_a_batch_that_fails_while_it_is_staged_is_not_lost(spark, tmp_path, monkeypatch):
    """The folder of the failed batch is there, without rows or with some, and not marked as whole."""
    state, consume, stored = _broken_stream(spark, tmp_path)
    calls, real = [], ingest.relevant_scored

    def fail_once(postings, settings):
        calls.append(1)
        found = real(postings, settings)
        if len(calls) == 2:
            return found.withColumn("title", F.raise_error(F.lit("down")).cast("string"))
        return found

    with monkeypatch.context() as broken:
        broken.setattr(ingest, "relevant_scored", fail_once)
        with pytest.raises(Exception, match="down"):
            consume()
    assert state.read().count() == 0
    consume()
    assert stored() == ["a0", "a1", "b0", "b1"] and len(state.tokens()) == 2


def test_a_trigger_that_fails_between_staging_and_merge_is_merged_once(spark, tmp_path, monkeypatch):
    state, consume, stored = _broken_stream(spark, tmp_path)
    with monkeypatch.context() as broken:
        broken.setattr(state, "merge", _break)
        with pytest.raises(RuntimeError):
            consume()
    assert state.read().count() == 0
    consume()
    assert stored() == ["a0", "a1", "b0", "b1"] and len(state.tokens()) == 1


@pytest.mark.parametrize("kept", [0, 1])
def test_a_trigger_that_fails_before_its_folders_are_cleared_is_merged_once(spark, tmp_path, monkeypatch, kept):
    """All of its folders are still there, or only the last one."""
    state, consume, stored = _broken_stream(spark, tmp_path)
    real, dropped = ingest.drop_path, []

    def drop_some(spark, path):
        if len(dropped) == kept:
            raise RuntimeError("down")
        dropped.append(path)
        real(spark, path)

    with monkeypatch.context() as broken:
        broken.setattr(ingest, "drop_path", drop_some)
        with pytest.raises(RuntimeError):
            consume()
    before = sorted(map(str, state.read().collect()))
    consume()
    assert stored() == ["a0", "a1", "b0", "b1"] and len(state.tokens()) == 1
    assert sorted(map(str, state.read().collect())) == before


def test_repeated_names_do_not_multiply_companies(spark, tmp_path):
    run = DailyRun(spark, str(tmp_path), SETTINGS)
    companies, landed_pages, landed = _inputs(spark)
    again = companies.withColumn("file_pos", F.col("file_pos") + 10).withColumn("priority", F.lit("Tier 9"))
    for hours in range(3):
        run.run(companies.union(again), landed_pages.union(landed_pages), landed, started_at=DAY + timedelta(hours=hours))
        assert sorted((r.name, r.priority) for r in run.companies.read().collect()) == [("Acme", "Tier 9"), ("Gone", "Tier 9"), ("Page", "Tier 9")]


def test_runs_in_one_second_are_two_runs(spark, tmp_path):
    run = DailyRun(spark, str(tmp_path), SETTINGS)
    inputs = _inputs(spark)
    run.run(*inputs, started_at=DAY)
    run.run(*inputs, started_at=DAY + timedelta(milliseconds=1))
    assert run.reports.read().count() == 2 and len(run.postings.tokens()) == 2


def _files(spark, table):
    top = f"{table.rows}/of={table.buckets()}"
    return {b: set(list_names(spark, f"{top}/{b}")) for b in list_names(spark, top) if b.startswith("bucket=")}


def test_merge_leaves_untouched_buckets_where_they_are(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), POSTING_STATE_DDL, "job_hash", buckets=8)
    rows = lambda ids, url: conform(spark.createDataFrame([(f"h{i}", url) for i in ids], "job_hash string, apply_url string"), POSTING_STATE_DDL).withColumn("seen_at", F.lit(DAY))
    first = rows(range(60), "old")
    table.merge(lambda now: upsert_postings(now, first), "a", first)
    old = _files(spark, table)
    assert len(old) == 8
    second = rows([3, 100], "new")
    table.merge(lambda now: upsert_postings(now, second), "b", second)
    table.merge(lambda now: upsert_postings(now, second), "b", second)  # a replay
    new = _files(spark, table)
    assert 1 <= sum(old[b] != new[b] for b in old) <= 2
    got = {r.job_hash: r.apply_url for r in table.read().collect()}
    assert got == {**{f"h{i}": "old" for i in range(60)}, "h3": "new", "h100": "new"}
    empty = first.limit(0)
    table.merge(lambda now: upsert_postings(now, empty), "none", empty)
    assert table.read().count() == 61


def test_late_rows_change_nothing_of_known_postings(spark):
    row = lambda url, hours: conform(spark.createDataFrame([("h", url)], "job_hash string, apply_url string"), POSTING_STATE_DDL).withColumn("seen_at", F.lit(DAY + timedelta(hours=hours)))
    empty = spark.createDataFrame([], POSTING_STATE_DDL)
    stored = upsert_postings(empty, row("now", 5))
    assert [(r.apply_url, r.last_seen_at.hour) for r in upsert_postings(stored, row("late", 1)).collect()] == [("now", 17)]
    assert [(r.apply_url, r.last_seen_at.hour) for r in upsert_postings(stored, row("next", 6)).collect()] == [("next", 18)]


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), POSTING_STATE_DDL, "job_hash", buckets=1)
    rows = conform(spark.createDataFrame([(f"h{i}",) for i in range(400)], "job_hash string"), POSTING_STATE_DDL)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    files = []
    whole = table._overwrite
    table._overwrite = lambda parts: (files.extend(parts.inputFiles()), whole(parts))
    try:
        table.merge(lambda now: rows, "a", rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(files) > 1 and table.read().count() == 400


def _join_inputs(plan, typed=False):
    """Names of the columns that go into the joins of a plan."""
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    names = set()
    if plan.nodeName() == "Join":
        for column in (c.output().apply(i) for c in children for i in range(c.output().size())):
            names.add(f"{column.name()} {column.dataType().simpleString()}" if typed else column.name())
    return names.union(*(_join_inputs(c, typed) for c in children))


def test_no_page_goes_through_a_join(spark):
    html = "<a href='/jobs/1'>AI Engineer &amp; more</a><a href='x'>Imprint</a><a href='/jobs/1'>AI Engineer again</a>"
    places = [("Page", "https://p.com/c", 200, html), ("Gone", "https://g.com/", 410, html), ("Blank", "https://b.com/", 200, None)]
    landed = pages(spark, *[dict(company_name=n, page_url=u, final_url=u, http_status=s, html=h) for n, u, s, h in places])
    companies = spark.createDataFrame(
        [(i, place[0], place[1], "high") for i, place in enumerate(places)],
        "file_pos bigint, name string, career_page string, priority string",
    )
    companies = conform(companies, f"file_pos bigint, {COMPANY_DDL}")
    routes = route_companies(companies, landed)
    found = company_postings(spark.createDataFrame([], PAYLOAD_DDL), landed, routes, SETTINGS)
    assert [(r.company_name, r.title, r.apply_url) for r in found.collect()] == [
        ("Page", "AI Engineer & more", "https://p.com/jobs/1")
    ]
    carried = _join_inputs(found._jdf.queryExecution().optimizedPlan())
    assert "html" not in carried and "page_digest" in carried


def test_no_body_and_no_description_is_shuffled_in_a_run(spark):
    landed = payloads(spark, _capped(2, "a", 0))
    companies = conform(spark.createDataFrame([(0, "A")], "file_pos bigint, name string"), f"file_pos bigint, {COMPANY_DDL}")
    no_pages = spark.createDataFrame([], PAGE_DDL)
    routes, early = route_companies(companies, no_pages), score_items(SETTINGS)
    whole = company_postings(landed, no_pages, routes, SETTINGS)
    assert "body string" not in _join_inputs(whole._jdf.queryExecution().optimizedPlan(), True)
    feeds = feed_postings(landed, None, SETTINGS, early)
    found = relevant_scored(company_postings(landed, no_pages, routes, SETTINGS, early).unionByName(feeds), SETTINGS)
    carried = _exchanged(found._jdf.queryExecution().executedPlan())
    assert "claim" in carried and not carried & {"html", "description"}


def _exchanged(plan):
    """Names of the columns that go through the exchanges of a physical plan."""
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.initialPlan()
    names = set()
    if "Exchange" in plan.nodeName():
        names |= {plan.output().apply(i).name() for i in range(plan.output().size())}
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    return names.union(*map(_exchanged, children))


@pytest.mark.parametrize("provider", ["himalayas", "jobicy"])
def test_items_scored_early_are_the_postings_scored_late(spark, provider):
    """An item of no wanted role still claims its id."""
    role = SETTINGS.roles.include[0]
    titles = [f"{role} one", "Cook", f"{role} two", f"{role} last"]
    if provider == "himalayas":
        body = {"jobs": [{"guid": g, "title": t, "companyName": "C", "description": f"{i + 2} years python"}
                         for i, (g, t) in enumerate(zip("abbc", titles))]}
    else:
        body = {"jobs": [{"jobTitle": t, "companyName": "C", "jobExcerpt": f"{i + 2} years python"} for i, t in enumerate(titles)]}
    landed = payloads(spark, dict(provider=provider, identifier="x", http_status=200, body=json.dumps(body)))
    late = scored_postings(feed_postings(landed, None, SETTINGS), SETTINGS)
    early = relevant_scored(feed_postings(landed, None, SETTINGS, score_items(SETTINGS)), SETTINGS)
    columns = sorted(late.columns)
    assert sorted(early.columns) == columns
    rows = [sorted(map(repr, df.select(columns).collect())) for df in (early, late)]
    assert rows[0] == rows[1] and len(rows[0]) == (2 if provider == "himalayas" else 3)


def test_state_merge_exchanges_rows_of_the_tables(spark):
    """Texts and scores are made of first arrivals only, and no side is exchanged for its guessed size."""
    from catalog import QUERIES

    plan = QUERIES["upsert_postings"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    before, after = plan.split("Exchange hashpartitioning(job_hash", 1)
    assert "stack overlap" in before and "jobs.example.com" in before
    below = after.split("Project [coalesce", 1)[0].split("SortMergeJoin", 1)[0].split("Window [", 1)[0]
    assert "stack overlap" not in below.split("struct(company_name", 1)[0]
    assert "hashpartitioning(l_suppkey" not in plan
