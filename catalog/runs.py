"""Queries on windows, the high-water mark and streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.boards import (
    ANCHOR_SQL,
    BOARDS,
    JOBICY_SQL,
    JOBICY_WINDOW_SQL,
    PAGE_LINKS_SQL,
    SINCE,
    jobicy_item,
    responses,
    wrapped,
)
from catalog.registry import query
from catalog.views import HASH_SQL, RELEVANT, SCORED_SQL, SETTINGS, table
from rolesift.functions.dates import from_iso_text, within_window
from rolesift.functions.text import compact_slug
from rolesift.operators.detection import route_companies
from rolesift.operators.identity import with_hash
from rolesift.operators.topk import first_k
from rolesift.plans.daily import DailyRun, company_postings, feed_postings, window_start
from rolesift.plans.state import AppendTable, KeyedTable, scratch_path
from rolesift.schema import APPLIED_DDL, POSTING_STATE_DDL
from rolesift.streaming.ingest import first_seen_only, ingest_payloads, merge_stream, payload_stream

_SINCE = "2024-01-15 12:00:00"


@query(
    "since_window",
    f"""SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE epoch_us(ts) END AS posted_us
    FROM events WHERE event_type = 'error' OR ts >= TIMESTAMP '{_SINCE}'""",
)
def _since_window(spark, sf_dir):
    """Posted text in several shapes; what cannot be dated is kept."""
    kind = F.col("event_type")
    week = F.concat(
        F.expr("extract(YEAROFWEEK FROM ts)").cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear("ts").cast("string"), 2, "0"),
        F.lit("-"),
        (F.weekday("ts") + 1).cast("string"),
        F.date_format("ts", "'T'HH:mm:ss.SSSSSS'Z'"),
    )
    text = (
        F.when(kind == "error", F.concat(F.lit("about "), F.date_format("ts", "yyyy-MM-dd")))
        .when((kind == "view") & (F.col("event_id") % 2 == 0), week)
        .when(kind == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(kind == "click", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(
            kind == "signup",
            F.concat(F.date_format(F.expr("ts + INTERVAL '05:30' HOUR TO MINUTE"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+05:30")),
        )
        .otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss.SSSSSS"))
    )
    posted = table(spark, sf_dir, "events").select("event_id", from_iso_text(text).alias("posted_at"))
    since = F.lit(f"{_SINCE}+00:00").cast("timestamp")
    return posted.filter(within_window(F.col("posted_at"), since)).select(
        "event_id", F.unix_micros("posted_at").alias("posted_us")
    )


@query(
    "high_water",
    """SELECT event_id FROM events
    WHERE ts >= (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-20')""",
)
def _high_water(spark, sf_dir):
    """The mark is the start of the last recorded run."""
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    runs = events.filter(F.col("at") < F.lit("2024-01-20 00:00:00+00:00").cast("timestamp")).select(
        F.col("at").alias("run_started_at")
    )
    since = window_start(runs, F.lit("2024-02-01 00:00:00+00:00").cast("timestamp"), 3)
    return events.filter(within_window(F.col("at"), since)).select("event_id")


@query(
    "first_run_lookback",
    "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-29'",
)
def _lookback(spark, sf_dir):
    """No run recorded: some days before now."""
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    runs = events.filter(F.col("event_type") == "never").select(F.col("at").alias("run_started_at"))
    since = window_start(runs, F.lit("2024-02-01 00:00:00+00:00").cast("timestamp"), 3)
    return events.filter(within_window(F.col("at"), since)).select("event_id")


@query(
    "first_per_guid",
    """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events) WHERE nth = 1""",
)
def _first_per_guid(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return first_k(rows, ["user_id", "event_type"], ["event_id"], 1)


_ORDER = ("event_id",)


def _as_postings(events: DataFrame) -> DataFrame:
    rows = events.select(
        F.col("user_id").cast("string").alias("company_name"),
        F.col("event_type").alias("title"),
        F.lit("").alias("location"),
        F.concat(F.lit("https://e.example.com/"), "event_id").alias("apply_url"),
        F.lit("events").alias("source"),
        F.lit(True).alias("remote"),
        F.col("value").alias("rank_score"),
        F.col("ts").cast("timestamp").alias("seen_at"),
        "event_id",
    )
    return with_hash(rows)


@query(
    "stream_ingest",
    """SELECT company_name, title, apply_url, epoch_us(ts) AS first_seen, epoch_us(ts) AS last_seen FROM (
      SELECT CAST(user_id AS VARCHAR) AS company_name, event_type AS title, ts,
        'https://e.example.com/' || event_id AS apply_url,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events
    ) WHERE nth = 1""",
)
def _stream_ingest(spark, sf_dir):
    """The events file as a stream into a state table; same rows as the batch query."""
    schema = table(spark, sf_dir, "events").schema
    source = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    state = KeyedTable(spark, scratch_path(spark, "stream-state"), POSTING_STATE_DDL, "job_hash")
    applied = AppendTable(spark, scratch_path(spark, "stream-applied"), APPLIED_DDL)

    def rank(prepared: DataFrame, stored: DataFrame) -> DataFrame:
        return first_seen_only(prepared, stored, applied.read(), _ORDER)

    merge_stream(source, state, scratch_path(spark, "stream-offsets"), _as_postings, rank)
    return state.read().select(
        "company_name",
        "title",
        "apply_url",
        F.unix_micros("first_seen_at").alias("first_seen"),
        F.unix_micros("last_seen_at").alias("last_seen"),
    )


# -- the real flow on landed payloads ------------------------------------------------------------

_LANDED_AT = "2026-01-23 06:00:00"


def _landed(spark, sf_dir) -> DataFrame:
    """Responses of one board provider and of one feed, built from ``part``."""
    parts = table(spark, sf_dir, "part")
    item, wrap, identifier, _ = BOARDS["greenhouse"]
    boards = responses(parts, "greenhouse", item(), wrap, identifier())
    feed = responses(parts, "jobicy", jobicy_item(), wrapped("jobs"), identifier())
    return boards.unionByName(feed).withColumns(
        {
            "query": F.lit(None).cast("string"),
            "error": F.lit(None).cast("string"),
            "fetched_at": F.lit(f"{_LANDED_AT}+00:00").cast("timestamp"),
        }
    )


def _flow_sql(boards: str, feed: str, pages: bool) -> str:
    """Postings of all passes, scored, deduped in arrival order and capped per company."""
    page_sql = (
        f"""UNION ALL SELECT 0 AS source_rank, pos, page_id, 'page ' || page_id AS company_name, txt AS title,
        '' AS location, '' AS description, contains(lower(txt), 'remote') AS remote, link_url AS apply_url,
        'company_ats' AS source, 'Tier 2' AS company_priority FROM ({PAGE_LINKS_SQL})"""
        if pages
        else ""
    )
    pick = "company_name, title, location, description, remote, apply_url, source"
    return f"""WITH {ANCHOR_SQL}, passes AS (
      SELECT 0 AS source_rank, CAST(split_part(apply_url, '/', 4) AS BIGINT) AS pos, 0 AS page_id, {pick},
        'Tier 1' AS company_priority FROM ({boards})
      UNION ALL SELECT 4, CAST(split_part(apply_url, '/', 4) AS BIGINT), 0, {pick}, '' FROM ({feed})
      {page_sql}),
    hashed AS (SELECT *, {HASH_SQL} AS job_hash FROM passes), {SCORED_SQL},
    fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_hash ORDER BY source_rank, pos) AS nth
      FROM starred WHERE {RELEVANT}) WHERE nth = 1),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(company_name))
      ORDER BY rank_score DESC, source_rank, pos) AS place FROM fresh) WHERE place <= 5)"""


_STORED = ("company_name", "title", "location", "apply_url", "source", "rank_score", "rank_stars", "rank_reason")
_ALL_PASSES = _flow_sql(BOARDS["greenhouse"][3], JOBICY_SQL, False)
_WINDOWED_PASSES = _flow_sql(BOARDS["greenhouse"][3], JOBICY_WINDOW_SQL, True)


@query("stream_run", f"{_ALL_PASSES} SELECT {', '.join(_STORED)} FROM kept")
def _stream_run(spark, sf_dir):
    """Landed payloads as a stream in several micro-batches; the cap sees the whole trigger."""
    landing = scratch_path(spark, "landing")
    _landed(spark, sf_dir).repartition(7).write.parquet(landing)
    state = KeyedTable(spark, scratch_path(spark, "run-state"), POSTING_STATE_DDL, "job_hash")
    applied = AppendTable(spark, scratch_path(spark, "run-applied"), APPLIED_DDL)
    ingest_payloads(payload_stream(spark, landing, 3), state, applied, scratch_path(spark, "run-offsets"), SETTINGS)
    return state.read().select(*_STORED)


def _daily_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Brands with a known board and every page as the career page of a company of its own."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    blank = {c: F.lit("") for c in ("region", "notes")}
    listed = brands.select(
        "name",
        F.lit("https://x.example.com").alias("career_page"),
        F.lit("Tier 1").alias("priority"),
        F.lit("greenhouse").alias("ats_provider"),
        compact_slug(F.col("name")).alias("ats_identifier"),
    )
    rows = table(spark, sf_dir, "pages")
    name = F.concat(F.lit("page "), "page_id")
    paged = rows.select(
        name.alias("name"),
        F.col("url").alias("career_page"),
        F.lit("Tier 2").alias("priority"),
        F.lit(None).cast("string").alias("ats_provider"),
        F.lit(None).cast("string").alias("ats_identifier"),
    )
    companies = listed.unionByName(paged).withColumns({**blank, "file_pos": F.lit(0).cast("long")})
    landed_pages = rows.select(
        name.alias("company_name"),
        F.col("url").alias("page_url"),
        F.col("url").alias("final_url"),
        F.lit(200).alias("http_status"),
        F.lit(None).cast("string").alias("error"),
        "html",
    )
    return companies, landed_pages, _landed(spark, sf_dir)


def _daily_run(spark, sf_dir) -> DailyRun:
    run = DailyRun(spark, scratch_path(spark, "daily-state"), SETTINGS)
    started = datetime.fromisoformat(f"{_LANDED_AT}+00:00")
    run.run(*_daily_inputs(spark, sf_dir), started_at=started).release()
    return run


@query("daily_run", f"{_WINDOWED_PASSES} SELECT {', '.join(_STORED)} FROM kept")
def _daily_run_state(spark, sf_dir):
    """Stored postings after a whole run: boards, career pages and a windowed feed."""
    return _daily_run(spark, sf_dir).postings.read().select(*_STORED)


@query(
    "daily_run_report",
    f"""{_WINDOWED_PASSES} SELECT count(*) AS total_jobs_found, count(*) AS new_jobs_found,
      (SELECT count(DISTINCT p_brand) FROM part) + (SELECT count(*) FROM pages) AS companies_checked,
      CAST(0 AS BIGINT) AS companies_failed FROM kept""",
)
def _daily_run_report(spark, sf_dir):
    """The row that the run appends to the daily reports."""
    columns = ("total_jobs_found", "new_jobs_found", "companies_checked", "companies_failed")
    return _daily_run(spark, sf_dir).reports.read().select(*columns)


@query(
    "union_passes",
    f"{_WINDOWED_PASSES} SELECT source_rank, company_name, title, apply_url, company_priority FROM passes",
)
def _union_passes(spark, sf_dir):
    """What both passes of a run give before anything is filtered."""
    companies, pages, landed = _daily_inputs(spark, sf_dir)
    since = F.lit(f"{SINCE} 06:00:00+00:00").cast("timestamp")
    routes = route_companies(companies, pages)
    rows = company_postings(landed, pages, routes, SETTINGS).unionByName(feed_postings(landed, since, SETTINGS))
    return rows.select("source_rank", "company_name", "title", "apply_url", "company_priority")
