"""Queries on the posting view: filter, identity, scoring, selection, state, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import (
    FULL_SQL,
    HASHED_SQL,
    ORDER,
    ORDER_SQL,
    OTHERS_SQL,
    POSTS_SQL,
    RELEVANT,
    SCORED_SQL,
    SETTINGS,
    TOP_SQL,
    applied,
    hashed,
    known,
    posting_columns,
    posting_rows,
    postings,
    ranked,
    table,
    tier,
)
from rolesift.functions.text import (
    contained_words,
    how_many,
    listed,
    normalize_text,
    posting_hash,
    searchable_text,
)
from rolesift.operators.identity import (
    dedupe_and_mark,
    distinct_hashes,
    first_arrivals,
    with_hash,
)
from rolesift.operators.relevance import is_excluded, is_internship, names_role, relevant_postings
from rolesift.operators.reporting import (
    OTHER,
    TOP,
    company_counters,
    digest_lines,
    evolve_reports,
    one_row,
    posting_counters,
    report_items,
    source_checks,
    source_counters,
)
from rolesift.operators.scoring import score_postings, years_points, years_reason, years_required
from rolesift.operators.selection import (
    cap_per_company,
    rank_order,
    recommendations,
    remainder,
    worth_looking_at,
)
from rolesift.operators.topk import first_k
from rolesift.operators.upsert import record_checks, upsert_companies, upsert_postings
from rolesift.plans.state import stage
from rolesift.schema import COMPANY_DDL, POSTING_STATE_DDL, REPORT_DDL, conform
from rolesift.sources.companies import first_companies
from rolesift.sources.feeds import is_topical

P, R, L = SETTINGS.profile, SETTINGS.roles, SETTINGS.limits
POSTS = f"WITH {POSTS_SQL}"
HASHED = f"WITH {POSTS_SQL}, {HASHED_SQL}"
SCORED = f"WITH {POSTS_SQL}, {HASHED_SQL}, {SCORED_SQL}"


@query(
    "role_filter",
    f"{POSTS} SELECT {ORDER_SQL}, title FROM posts WHERE {RELEVANT}",
)
def _role_filter(spark, sf_dir):
    return relevant_postings(postings(spark, sf_dir), R).select(*ORDER, "title")


@query(
    "role_tests",
    """SELECT p_partkey,
      (p_name ILIKE '%old%' OR p_name ILIKE '%bolt%') AS excluded,
      p_name ILIKE '%small%' AS internship,
      (p_name ILIKE '%widget%' OR p_name ILIKE '%ring%' OR p_name ILIKE '%gear%'
        OR p_name ILIKE '%gizmo%') AS role
    FROM part""",
)
def _role_tests(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        is_excluded(name, R).alias("excluded"),
        is_internship(name, R).alias("internship"),
        names_role(name, R).alias("role"),
    )


@query(
    "topical_prefilter",
    """SELECT p_partkey FROM part
    WHERE list_has_any(list_transform(list_append(string_split(p_name, ' '), p_type), lambda t: lower(t)),
        ['gear', 'promo']) OR contains(lower(p_name), 'gear') OR contains(lower(p_name), 'promo')""",
)
def _topical(spark, sf_dir):
    tags = F.array_append(F.split("p_name", " "), F.col("p_type"))
    return (
        table(spark, sf_dir, "part")
        .filter(is_topical(tags, F.col("p_name"), ("gear", "promo")))
        .select("p_partkey")
    )


@query("posting_hash", f"{HASHED} SELECT {ORDER_SQL}, job_hash FROM hashed")
def _posting_hash(spark, sf_dir):
    return hashed(spark, sf_dir).select(*ORDER, "job_hash")


# The SQL side has no flag for Unicode white space, so its class lists the code points.
_SPACES = (
    "\\x{9}-\\x{D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
)
_NORM = f"trim(regexp_replace(lower(text), '[{_SPACES}]+', ' ', 'g'))"


@query(
    "document_hash",
    f"""SELECT doc_id, sha256(source || '|' || {_NORM} || '|' || lang) AS job_hash,
      CAST(length({_NORM}) AS INTEGER) AS n_norm,
      CAST(length(lower(source || chr(10) || lang || chr(10) || text)) AS INTEGER) AS n_search
    FROM documents""",
)
def _document_hash(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        posting_hash(F.col("source"), text, F.col("lang")).alias("job_hash"),
        F.length(normalize_text(text)).alias("n_norm"),
        F.length(searchable_text(F.col("source"), F.col("lang"), text)).alias("n_search"),
    )


@query(
    "first_wins_dedupe",
    f"""{HASHED} SELECT job_hash, {ORDER_SQL}, apply_url FROM (
      SELECT *, row_number() OVER (PARTITION BY job_hash ORDER BY {ORDER_SQL}) AS nth FROM hashed
    ) WHERE nth = 1""",
)
def _first_wins(spark, sf_dir):
    return first_arrivals(hashed(spark, sf_dir), ORDER).select("job_hash", *ORDER, "apply_url")


@query("distinct_hashes", f"{HASHED} SELECT DISTINCT job_hash FROM hashed")
def _distinct(spark, sf_dir):
    return distinct_hashes(hashed(spark, sf_dir))


@query(
    "drop_applied_mark_new",
    f"""{HASHED} SELECT job_hash, {ORDER_SQL}, job_hash NOT IN (SELECT job_hash FROM known) AS is_new
    FROM (SELECT *, row_number() OVER (PARTITION BY job_hash ORDER BY {ORDER_SQL}) AS nth FROM hashed)
    WHERE nth = 1 AND job_hash NOT IN (SELECT job_hash FROM applied)""",
)
def _drop_mark(spark, sf_dir):
    rows = hashed(spark, sf_dir).select("job_hash", *ORDER)
    return dedupe_and_mark(rows, known(spark, sf_dir), applied(spark, sf_dir), ORDER)


@query(
    "years_required",
    f"""{SCORED} SELECT {ORDER_SQL}, required_years_experience AS years,
      CASE WHEN required_years_experience IS NULL THEN 5
        WHEN required_years_experience <= 10 THEN 10 ELSE 2 END AS points,
      CASE WHEN required_years_experience <= 10 THEN 'needs ~' || required_years_experience
          || ' yrs experience (within your 10-yr preference)'
        WHEN required_years_experience > 10 THEN 'needs ~' || required_years_experience
          || '+ yrs experience (above your 10-yr preference)' END AS reason
    FROM scored""",
)
def _years(spark, sf_dir):
    rows = postings(spark, sf_dir).select(*ORDER, years_required(F.col("description")).alias("years"))
    years = F.col("years")
    return rows.select(
        *ORDER,
        "years",
        years_points(years, 10).alias("points"),
        years_reason(years, 10).alias("reason"),
    )


@query(
    "keyword_overlap",
    f"""{SCORED} SELECT {ORDER_SQL}, CAST(len(hits) AS INTEGER) AS n_hits,
      array_to_string(hits[1:5], ', ') AS shown FROM scored""",
)
def _keywords(spark, sf_dir):
    rows = postings(spark, sf_dir).select(
        *ORDER,
        searchable_text(F.col("title"), F.col("location"), F.col("description")).alias("_text"),
    )
    return rows.select(
        *ORDER,
        how_many(contained_words(F.col("_text"), P.keywords)).alias("n_hits"),
        listed(contained_words(F.col("_text"), P.keywords), 5).alias("shown"),
    )


@query(
    "score_and_stars",
    f"""{SCORED} SELECT {ORDER_SQL}, rank_score, rank_stars, rank_reason, required_years_experience,
      has_stack_overlap FROM starred""",
)
def _score(spark, sf_dir):
    return score_postings(postings(spark, sf_dir), P, R).select(
        *ORDER,
        "rank_score",
        "rank_stars",
        "rank_reason",
        "required_years_experience",
        "has_stack_overlap",
    )


@query(
    "cap_per_company",
    f"""{SCORED} SELECT {ORDER_SQL}, company_name, rank_score FROM (
      SELECT *, row_number() OVER (PARTITION BY lower(trim(company_name))
        ORDER BY rank_score DESC, {ORDER_SQL}) AS place FROM starred
    ) WHERE place <= 5""",
)
def _cap(spark, sf_dir):
    scored = score_postings(postings(spark, sf_dir), P, R).select(*ORDER, "company_name", "rank_score")
    return cap_per_company(scored, 5, ORDER)


_RANKED_COLUMNS = (
    "job_hash",
    "company_name",
    "title",
    "location",
    "remote",
    "apply_url",
    "rank_score",
    "rank_stars",
    "rank_reason",
    "required_years_experience",
    "has_stack_overlap",
    "is_new",
)
_RANKED_LIST = ", ".join(_RANKED_COLUMNS)


@query("daily_ranking", f"{FULL_SQL} SELECT {_RANKED_LIST} FROM ranked")
def _daily_ranking(spark, sf_dir):
    return ranked(spark, sf_dir).select(*_RANKED_COLUMNS)


@query("rank_sort", f"{FULL_SQL} SELECT job_hash, rank_score FROM ranked ORDER BY rank_score DESC, {ORDER_SQL}")
def _rank_sort(spark, sf_dir):
    return ranked(spark, sf_dir).orderBy(*rank_order(ORDER)).select("job_hash", "rank_score")


def _top(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Ranked rows, written once as the daily run does, and the top of them."""
    rows = stage(ranked(spark, sf_dir), "ranked")
    return rows, recommendations(rows, P.max_years, L.min_stars, L.top_n, ORDER)


@query("recommendations", f"{FULL_SQL}, {TOP_SQL} SELECT {_RANKED_LIST} FROM recommended")
def _recommendations(spark, sf_dir):
    return _top(spark, sf_dir)[1].select(*_RANKED_COLUMNS)


@query(
    "remainder",
    f"""{FULL_SQL}, {TOP_SQL} SELECT job_hash, title FROM ranked
    WHERE is_new AND job_hash NOT IN (SELECT job_hash FROM recommended)""",
)
def _remainder(spark, sf_dir):
    return remainder(*_top(spark, sf_dir)).select("job_hash", "title")


@query("worth_looking", f"{FULL_SQL}, {TOP_SQL}, {OTHERS_SQL} SELECT {_RANKED_LIST} FROM others")
def _worth(spark, sf_dir):
    rows, top = _top(spark, sf_dir)
    return worth_looking_at(rows, top, P.max_years, L.worth_looking, ORDER).select(*_RANKED_COLUMNS)


_ITEM_SQL = """'{section}' AS section,
  CAST(row_number() OVER (ORDER BY rank_score DESC, {order}) AS INTEGER) AS position, title, company_name,
  repeat('★', rank_stars) AS stars, repeat('★', rank_stars) || repeat('☆', 5 - rank_stars) AS stars_padded,
  coalesce(nullif(location, ''), 'n/a') AS location,
  CASE WHEN remote THEN 'Remote' ELSE 'On-site' END AS mode, apply_url, rank_reason AS reason,
  coalesce(ats_platform, 'n/a') AS ats_platform, coalesce(posted_date, 'n/a') AS posted_date,
  coalesce(nullif(company_priority, ''), 'n/a') AS priority, printf('%.0f', rank_score) AS score"""


def _items_sql(section: str, source: str) -> str:
    return f"SELECT {_ITEM_SQL.format(section=section, order=ORDER_SQL)} FROM {source}"


_ITEMS = f"{_items_sql(TOP, 'recommended')} UNION ALL {_items_sql(OTHER, 'others')}"


def _items(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows, top = _top(spark, sf_dir)
    others = worth_looking_at(rows, top, P.max_years, L.worth_looking, ORDER)
    items = report_items(TOP, top, ORDER).unionByName(report_items(OTHER, others, ORDER))
    return rows, stage(items, "items")


@query("report_items", f"{FULL_SQL}, {TOP_SQL}, {OTHERS_SQL} {_ITEMS}")
def _report_items(spark, sf_dir):
    return _items(spark, sf_dir)[1]


@query(
    "digest_lines",
    f"""{FULL_SQL}, {TOP_SQL}, {OTHERS_SQL}, items AS ({_ITEMS}),
    n AS (SELECT (SELECT count(*) FROM recommended) AS top_n, (SELECT count(*) FROM others) AS other_n,
      (SELECT count(*) FROM ranked) AS total, (SELECT count(*) FROM ranked WHERE is_new) AS fresh,
      (SELECT count(*) FROM supplier) AS checked,
      (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS failed)
    SELECT 0 AS part, 0 AS position, '# AI Job Digest — 2024-02-01' || chr(10) || chr(10)
      || '- **Total jobs found:** ' || total || chr(10) || '- **New jobs today:** ' || fresh || chr(10)
      || '- **Companies checked:** ' || checked || ' (' || failed || ' failed/unreachable)' || chr(10)
      || '- **Global sources checked:** 4 (0 failed/unreachable)' || chr(10) || chr(10)
      || '## Top ' || top_n || ' Recommendations' || chr(10)
      || CASE WHEN top_n = 0 THEN chr(10) || '_No new jobs met the ranking threshold today._' ELSE '' END
      AS text FROM n
    UNION ALL
    SELECT 1, position, '### ' || position || '. ' || title || ' — ' || company_name || ' ' || stars
      || chr(10) || '- **Location:** ' || location || ' (' || mode || ')' || chr(10) || '- **Apply:** '
      || apply_url || chr(10) || '- **Why it matches:** ' || reason || chr(10) || '- **ATS platform:** '
      || ats_platform || chr(10) || '- **Posted:** ' || posted_date || chr(10) || '- **Priority:** '
      || priority || ' (score ' || score || '/100)' || chr(10) FROM items WHERE section = '{TOP}'
    UNION ALL
    SELECT 2, 0, '## Other jobs worth looking at (' || other_n || ')' || chr(10) || chr(10)
      || 'New jobs that matched your target roles but didn''t qualify for the top picks above — '
      || 'over-experienced, on-site, no direct stack overlap, or just ranked lower. '
      || 'Reason noted per job:' || chr(10) FROM n WHERE other_n > 0
    UNION ALL
    SELECT 3, position, '- ' || title || ' — ' || company_name || ' ' || stars || ' — ' || apply_url
      || chr(10) || '  _' || reason || '_' FROM items WHERE section = '{OTHER}'""",
)
def _digest(spark, sf_dir):
    rows, items = _items(spark, sf_dir)
    checks = _supplier_checks(spark, sf_dir)
    counters = one_row([posting_counters(rows), company_counters(checks)])
    metrics = counters.withColumns(
        {
            "run_date": F.lit("2024-02-01").cast("date"),
            "sources_checked": F.lit(4),
            "sources_failed": F.lit(0),
        }
    )
    return digest_lines(metrics, items)


def _supplier_checks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") < 0, "error: timeout").otherwise("ok").alias("last_status"),
    )


@query(
    "run_counters",
    f"""{FULL_SQL} SELECT count(*) AS total_jobs_found,
      CAST(count(*) FILTER (is_new) AS BIGINT) AS new_jobs_found FROM ranked""",
)
def _run_counters(spark, sf_dir):
    return posting_counters(ranked(spark, sf_dir))


@query(
    "company_counters",
    """SELECT count(*) AS companies_checked, count(*) FILTER (s_acctbal < 0) AS companies_failed
    FROM supplier""",
)
def _company_counters(spark, sf_dir):
    return company_counters(_supplier_checks(spark, sf_dir))


@query(
    "source_counters",
    """WITH checks AS (SELECT event_type, max(CASE WHEN value > 400 AND event_type IN ('error', 'click')
        THEN 1 ELSE 0 END) AS failed FROM events WHERE event_type <> 'signup' GROUP BY event_type)
    SELECT count(*) AS sources_checked, CAST(sum(failed) AS BIGINT) AS sources_failed FROM checks""",
)
def _source_counters(spark, sf_dir):
    kind = F.col("event_type")
    failed = (F.col("value") > 400) & kind.isin("error", "click")
    asked = table(spark, sf_dir, "events").select(
        kind.alias("provider"), F.when(failed, F.lit("timeout")).alias("error")
    )
    return source_counters(source_checks(asked, ("error", "click", "view", "purchase")))


# -- state ---------------------------------------------------------------------------------

_STATE_UNTIL, _BATCH_FROM = "1999-01-01", "1998-01-01"


def _stamped(spark, sf_dir, keep, seen: str) -> DataFrame:
    """Scored first arrivals of a part of the view with a fetch time.

    Arrivals are sorted and exchanged as rows of the tables with their hash; columns of the view and scores, which
    are several times as wide, are made of the first ones only."""
    rows = posting_rows(spark, sf_dir)
    part = with_hash(rows.select("*", *posting_columns()).filter(keep)).select(*rows.columns, "job_hash")
    first = first_arrivals(part, ORDER).select(*posting_columns(), *ORDER, "job_hash")
    return score_postings(first, P, R).drop("description").withColumn("seen_at", F.lit(seen).cast("timestamp"))


_UPSERT_SQL = f"""{SCORED},
    old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_hash ORDER BY {ORDER_SQL}) AS nth
      FROM starred WHERE posted_date < '{_STATE_UNTIL}') WHERE nth = 1),
    new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_hash ORDER BY {ORDER_SQL}) AS nth
      FROM starred WHERE posted_date >= '{_BATCH_FROM}') WHERE nth = 1)
    SELECT coalesce(o.job_hash, n.job_hash) AS job_hash,
      coalesce(o.company_name, n.company_name) AS company_name, coalesce(o.title, n.title) AS title,
      coalesce(o.company_priority, n.company_priority) AS company_priority,
      coalesce(n.apply_url, o.apply_url) AS apply_url, coalesce(n.posted_date, o.posted_date) AS posted_date,
      coalesce(n.rank_score, o.rank_score) AS rank_score, coalesce(n.rank_stars, o.rank_stars) AS rank_stars,
      coalesce(n.rank_reason, o.rank_reason) AS rank_reason,
      CASE WHEN o.job_hash IS NULL THEN '2026-01-02' ELSE '2026-01-01' END AS first_seen,
      CASE WHEN n.job_hash IS NULL THEN '2026-01-01' ELSE '2026-01-02' END AS last_seen
    FROM old o FULL OUTER JOIN new n ON o.job_hash = n.job_hash"""


@query("upsert_postings", _UPSERT_SQL)
def _upsert_postings(spark, sf_dir):
    old = _stamped(spark, sf_dir, F.col("posted_date") < _STATE_UNTIL, "2026-01-01 00:00:00")
    new = _stamped(spark, sf_dir, F.col("posted_date") >= _BATCH_FROM, "2026-01-02 00:00:00")
    state = conform(
        old.withColumns({"first_seen_at": F.col("seen_at"), "last_seen_at": F.col("seen_at")}),
        POSTING_STATE_DDL,
    )
    return upsert_postings(state, new).select(
        "job_hash",
        "company_name",
        "title",
        "company_priority",
        "apply_url",
        "posted_date",
        "rank_score",
        "rank_stars",
        "rank_reason",
        F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen"),
        F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"),
    )


def _company_state(spark, sf_dir) -> DataFrame:
    stored = table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") >= 0)
    rows = stored.select(
        F.col("s_name").alias("name"),
        F.concat(F.lit("https://old.example.com/"), "s_suppkey").alias("career_page"),
        F.lit("old").alias("region"),
        F.lit("Tier 3").alias("priority"),
        F.lit("kept").alias("notes"),
        F.when(F.col("s_acctbal") > 5000, "lever").alias("ats_provider"),
        F.when(F.col("s_acctbal") > 5000, F.lower("s_name")).alias("ats_identifier"),
        F.lit("ok").alias("last_status"),
    )
    return conform(rows, COMPANY_DDL)


@query(
    "upsert_companies",
    """WITH old AS (SELECT s_name AS name, s_suppkey, s_acctbal FROM supplier WHERE s_acctbal >= 0),
    new AS (SELECT s_name AS name, s_suppkey, n_name, n_regionkey FROM supplier
      JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 5000)
    SELECT coalesce(o.name, n.name) AS name,
      CASE WHEN n.name IS NULL THEN 'https://old.example.com/' || o.s_suppkey
        ELSE 'https://new.example.com/' || n.s_suppkey END AS career_page,
      coalesce(n.n_name, 'old') AS region,
      CASE WHEN n.name IS NULL THEN 'Tier 3' ELSE 'Tier 1' END AS priority,
      CASE WHEN n.name IS NULL THEN 'kept' ELSE 'last' END AS notes,
      CASE WHEN o.s_acctbal > 5000 THEN 'lever' END AS ats_provider,
      CASE WHEN o.name IS NOT NULL THEN 'ok' END AS last_status
    FROM old o FULL OUTER JOIN new n ON o.name = n.name""",
)
def _upsert_companies(spark, sf_dir):
    rows = (
        table(spark, sf_dir, "supplier")
        .filter(F.col("s_acctbal") < 5000)
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )

    def listed(notes: str, offset: int, host: str) -> DataFrame:
        return rows.select(
            (F.col("s_suppkey") + offset).alias("file_pos"),
            F.col("s_name").alias("name"),
            F.concat(F.lit(f"https://{host}.example.com/"), "s_suppkey").alias("career_page"),
            F.col("n_name").alias("region"),
            F.lit("Tier 1").alias("priority"),
            F.lit(notes).alias("notes"),
        )

    # every name twice: the later row of the list wins
    batch = listed("first", 0, "early").unionByName(listed("last", 10_000_000_000, "new"))
    return upsert_companies(_company_state(spark, sf_dir), batch).select(
        "name", "career_page", "region", "priority", "notes", "ats_provider", "last_status"
    )


@query(
    "check_update",
    """SELECT s_name AS name,
      CASE WHEN n_regionkey >= 3 THEN CASE WHEN s_acctbal > 5000 THEN 'lever' END
        WHEN n_regionkey = 2 THEN 'ashby' END AS ats_provider,
      CASE WHEN n_regionkey >= 3 THEN 'ok' WHEN n_regionkey = 2 THEN 'ok:cached'
        ELSE 'error: HTTP 404' END AS last_status
    FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0""",
)
def _check_update(spark, sf_dir):
    hit = F.col("n_regionkey") == 2
    checks = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .filter(F.col("n_regionkey") < 3)
        .select(
            F.col("s_name").alias("name"),
            F.when(hit, "ashby").alias("ats_provider"),
            F.when(hit, F.lower("s_name")).alias("ats_identifier"),
            F.lit("2026-01-02 00:00:00").cast("timestamp").alias("last_checked_at"),
            F.when(hit, "ok:cached").otherwise("error: HTTP 404").alias("last_status"),
        )
    )
    return record_checks(_company_state(spark, sf_dir), checks).select(
        "name", "ats_provider", "last_status"
    )


@query(
    "report_evolution",
    """WITH d AS (SELECT CAST(ts AS DATE) AS run_date, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT run_date, n AS total_jobs_found, NULL::BIGINT AS companies_checked, n AS sources_checked
    FROM d WHERE event_type = 'view'
    UNION ALL SELECT run_date, n, n, NULL FROM d WHERE event_type = 'click'
    UNION ALL SELECT run_date, n, n, n FROM d WHERE event_type NOT IN ('view', 'click') OR event_type IS NULL""",
)
def _report_evolution(spark, sf_dir):
    daily = (
        table(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("run_date"), "event_type")
        .agg(F.count("*").alias("total_jobs_found"))
    )
    n, kind = F.col("total_jobs_found"), F.col("event_type")

    def shape(test: Column, *counters: str) -> DataFrame:
        return daily.filter(test).select("run_date", n, *[n.alias(c) for c in counters])

    rest = kind.isNull() | ~kind.isin("view", "click")
    current = conform(shape(rest, "companies_checked", "sources_checked"), REPORT_DDL)
    older = [shape(kind == "view", "sources_checked"), shape(kind == "click", "companies_checked")]
    return evolve_reports(older, current).select(
        "run_date", "total_jobs_found", "companies_checked", "sources_checked"
    )


@query(
    "first_companies",
    "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 20",
)
def _first_companies(spark, sf_dir):
    listed = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_suppkey").alias("file_pos"))
    return first_companies(listed, 20).drop("file_pos")


@query(
    "first_per_key_deep",
    f"""SELECT {ORDER_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag
      ORDER BY {ORDER_SQL}) AS nth FROM lineitem) WHERE nth <= 1500""",
)
def _first_deep(spark, sf_dir):
    """A cap beyond the group-limit rule, with three keys that hold a third of the rows each."""
    rows = table(spark, sf_dir, "lineitem").select(*ORDER, "l_returnflag")
    return first_k(rows, ["l_returnflag"], list(ORDER), 1500).select(*ORDER)

