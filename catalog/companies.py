"""Queries on company tables: coverage, health, discovery, lists as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.boards import BOARD_PAGES_SQL, DEALT_SQL, seller_pages
from catalog.registry import query
from catalog.views import POSTS_SQL, postings, table, tier
from rolesift.functions.text import posting_hash
from rolesift.operators.coverage import (
    checkable,
    coverage_counts,
    coverage_report,
    detection_summary,
    failed_boards,
    health_list,
    health_rows,
    health_sample,
    health_summary,
    provider_breakdown,
    provider_share,
    silent_boards,
    source_share,
    untested_providers,
    with_coverage,
)
from rolesift.operators.detection import detection_results, missing_board, write_back_detection
from rolesift.operators.discovery import (
    NOT_FOUND,
    UNSUPPORTED,
    candidates,
    merge_retry,
    resolve,
    resolve_summary,
    resolved_list,
    retry_rows,
    seed_identifiers,
    stated_providers,
    tasks_of,
    slug_rows,
    unresolved_list,
)
from rolesift.plans.boards import company_list_rows, write_csv
from rolesift.plans.state import AppendTable, mark_applied, scratch_path, stage
from rolesift.schema import APPLIED_DDL
from rolesift.sources.companies import read_companies, read_csv, read_sample_sheet

_PROVIDER_SQL = (
    "CASE WHEN s_nationkey < 5 THEN 'greenhouse' WHEN s_nationkey < 10 THEN 'lever' "
    "WHEN s_nationkey < 14 THEN 'ashby' WHEN s_nationkey < 17 THEN 'unheard_of' "
    "WHEN s_nationkey < 20 THEN '' END"
)
_TIER_SQL = (
    "CASE WHEN s_acctbal >= 5000 THEN 'Tier 1' WHEN s_acctbal >= 0 THEN 'Tier 2' ELSE 'Tier 3' END"
)


def companies(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("file_pos"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("https://c.example.com/"), "s_suppkey").alias("career_page"),
        tier().alias("priority"),
        F.expr(_PROVIDER_SQL).alias("ats_provider"),
        F.when(F.col("s_acctbal") > 1000, F.lower("s_name")).alias("ats_identifier"),
    )


_COMPANIES_SQL = f"""
companies AS (
  SELECT s_suppkey AS file_pos, s_name AS name, 'https://c.example.com/' || s_suppkey AS career_page,
    {_TIER_SQL} AS priority, {_PROVIDER_SQL} AS ats_provider,
    CASE WHEN s_acctbal > 1000 THEN lower(s_name) END AS ats_identifier, s_acctbal
  FROM supplier
)"""

_COVERED_SQL = f"""{_COMPANIES_SQL},
state AS (
  SELECT s_name AS name, CASE WHEN s_acctbal < 3000 THEN 'error: HTTP 403' ELSE 'ok:cached' END AS last_status
  FROM supplier WHERE s_acctbal >= 0
),
covered AS (
  SELECT c.name, c.priority, c.ats_provider, coalesce(s.last_status, '') AS last_status,
    CASE WHEN coalesce(c.ats_provider, '') = '' THEN 'no_ats'
      WHEN c.ats_provider = 'unheard_of' THEN 'unsupported_ats'
      WHEN s.last_status LIKE 'error%' THEN 'failing' ELSE 'covered' END AS bucket
  FROM companies c LEFT JOIN state s ON c.name = s.name
)"""


def _covered(spark, sf_dir) -> DataFrame:
    state = (
        table(spark, sf_dir, "supplier")
        .filter(F.col("s_acctbal") >= 0)
        .select(
            F.col("s_name").alias("name"),
            F.when(F.col("s_acctbal") < 3000, "error: HTTP 403").otherwise("ok:cached").alias("last_status"),
        )
    )
    return with_coverage(companies(spark, sf_dir), state)


@query(
    "coverage_buckets",
    f"WITH {_COVERED_SQL} SELECT bucket, count(*) AS companies FROM covered GROUP BY bucket",
)
def _coverage_buckets(spark, sf_dir):
    return coverage_counts(_covered(spark, sf_dir))


@query(
    "coverage_sorted",
    f"""WITH {_COVERED_SQL} SELECT CASE bucket WHEN 'unsupported_ats' THEN 0 WHEN 'failing' THEN 1 ELSE 2 END
      AS section, bucket, priority, name, last_status FROM covered
    WHERE bucket <> 'covered' ORDER BY bucket,
      CASE priority WHEN 'Tier 1' THEN 0 WHEN 'Tier 2' THEN 1 WHEN 'Tier 3' THEN 2 ELSE 9 END, name""",
)
def _coverage_sorted(spark, sf_dir):
    return coverage_report(_covered(spark, sf_dir)).select("section", "bucket", "priority", "name", "last_status")


@query(
    "provider_share",
    f"""WITH {_COMPANIES_SQL}
    SELECT coalesce(ats_provider, 'Total confirmed') AS provider, count(*) AS companies,
      round(100.0 * count(*) / (SELECT count(*) FROM companies), 1) AS percent
    FROM companies WHERE ats_provider IN ('greenhouse', 'lever', 'ashby') GROUP BY ROLLUP (ats_provider)""",
)
def _provider_share(spark, sf_dir):
    return provider_share(companies(spark, sf_dir))


@query(
    "source_share",
    f"""WITH {POSTS_SQL}
    SELECT CASE WHEN ats_platform = 'generic' THEN 'generic page' WHEN source = 'company_ats' THEN 'board'
        ELSE 'feed' END AS source_type, count(*) AS jobs,
      round(100.0 * count(*) / (SELECT count(*) FROM posts), 1) AS percent
    FROM posts GROUP BY 1""",
)
def _source_share(spark, sf_dir):
    return source_share(postings(spark, sf_dir))


@query(
    "checkable_companies",
    f"""WITH {_COMPANIES_SQL} SELECT name FROM companies
    WHERE ats_provider IN ('greenhouse', 'lever', 'ashby') AND ats_identifier IS NOT NULL""",
)
def _checkable(spark, sf_dir):
    return checkable(companies(spark, sf_dir)).select("name")


@query(
    "missing_board",
    f"WITH {_COMPANIES_SQL} SELECT name FROM companies WHERE coalesce(ats_provider, '') = ''",
)
def _missing(spark, sf_dir):
    return missing_board(companies(spark, sf_dir)).select("name")


_HEALTH_SQL = f"""{_COMPANIES_SQL},
sampled AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY ats_provider ORDER BY file_pos) AS nth FROM companies
  WHERE ats_provider IN ('greenhouse', 'lever', 'ashby') AND ats_identifier IS NOT NULL) WHERE nth <= 5),
answers AS (SELECT l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE count(*) END AS n, min(l_orderkey) AS first_order FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_suppkey),
health AS (
  SELECT ats_provider, name AS company_name, ats_identifier,
    CASE WHEN s_acctbal < 4000 THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN s_acctbal < 4000 THEN 0 ELSE coalesce(n, 0) END AS job_count,
    CASE WHEN s_acctbal < 4000 THEN 'timeout' ELSE '' END AS error,
    CASE WHEN s_acctbal < 4000 OR first_order IS NULL THEN '' ELSE 'order ' || first_order END AS sample_title
  FROM sampled LEFT JOIN answers ON l_suppkey = file_pos
)"""


def _health(spark, sf_dir) -> DataFrame:
    listed = companies(spark, sf_dir)
    counts = (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_returnflag") == "A")
        .groupBy(F.col("l_suppkey").alias("s_suppkey"))
        .agg(F.count("*").alias("job_count"), F.concat(F.lit("order "), F.min("l_orderkey")).alias("sample_title"))
    )
    answers = (
        table(spark, sf_dir, "supplier")
        .join(counts, "s_suppkey", "left")
        .select(
            F.expr(_PROVIDER_SQL).alias("provider"),
            F.lower("s_name").alias("identifier"),
            F.when(F.col("s_suppkey") % 3 == 0, 0).otherwise(F.col("job_count")).alias("job_count"),
            "sample_title",
            F.when(F.col("s_acctbal") < 4000, "timeout").alias("error"),
        )
    )
    return health_rows(health_sample(listed, 5), answers)


@query(
    "provider_health",
    f"""WITH {_HEALTH_SQL} SELECT ats_provider, count(*) AS tested,
      CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS ok,
      CAST(count(*) FILTER (status = 'error') AS BIGINT) AS failed,
      CAST(sum(CASE WHEN status = 'ok' THEN job_count ELSE 0 END) AS BIGINT) AS total_jobs,
      coalesce(avg(job_count) FILTER (status = 'ok'), 0.0) AS avg_jobs
    FROM health GROUP BY ats_provider""",
)
def _provider_health(spark, sf_dir):
    return health_summary(_health(spark, sf_dir))


@query("health_list", f"WITH {_HEALTH_SQL} SELECT * FROM health ORDER BY ats_provider, company_name")
def _health_list(spark, sf_dir):
    return health_list(_health(spark, sf_dir))


@query(
    "health_failures",
    f"""WITH {_HEALTH_SQL} SELECT ats_provider, company_name, ats_identifier, status, error
    FROM health WHERE status = 'error'""",
)
def _health_failures(spark, sf_dir):
    return failed_boards(_health(spark, sf_dir))


@query(
    "health_silent",
    f"""WITH {_HEALTH_SQL} SELECT ats_provider, company_name, ats_identifier, status, job_count
    FROM health WHERE status = 'ok' AND job_count = 0""",
)
def _health_silent(spark, sf_dir):
    return silent_boards(_health(spark, sf_dir))


@query(
    "untested_providers",
    f"""SELECT n_name AS ats_provider FROM nation EXCEPT
    SELECT 'NATION_' || s_nationkey FROM supplier WHERE s_acctbal > 8000""",
)
def _untested(spark, sf_dir):
    supported = table(spark, sf_dir, "nation").select(F.col("n_name").alias("ats_provider"))
    used = (
        table(spark, sf_dir, "supplier")
        .filter(F.col("s_acctbal") > 8000)
        .select(F.concat(F.lit("NATION_"), "s_nationkey").alias("ats_provider"))
    )
    return untested_providers(used, supported)


# -- detection results and their way back into the list --------------------------------------

_RESULTS_SQL = f"""{BOARD_PAGES_SQL}, {DEALT_SQL},
results AS (
  SELECT s_name AS name, CASE WHEN s_nationkey = 3 THEN '' ELSE coalesce(provider, '') END AS ats_provider,
    CASE WHEN s_nationkey = 3 THEN '' ELSE coalesce(identifier, '') END AS ats_identifier
  FROM dealt JOIN supplier USING (s_suppkey)
)"""


def _results(spark, sf_dir) -> DataFrame:
    pages = seller_pages(spark, sf_dir).select(
        F.col("s_name").alias("company_name"),
        "final_url",
        F.when(F.col("s_nationkey") == 3, 503).otherwise(200).alias("http_status"),
        F.lit(None).cast("string").alias("error"),
        "html",
    )
    return detection_results(pages)


@query(
    "detection_writeback",
    f"""WITH {_RESULTS_SQL}, {_COMPANIES_SQL}
    SELECT c.name, CASE WHEN r.name IS NULL THEN c.ats_provider ELSE r.ats_provider END AS ats_provider,
      CASE WHEN r.name IS NULL THEN c.ats_identifier ELSE r.ats_identifier END AS ats_identifier
    FROM companies c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name
      ORDER BY ats_provider = '', ats_provider, ats_identifier) AS nth FROM results) WHERE nth = 1) r ON c.name = r.name""",
)
def _writeback(spark, sf_dir):
    listed = companies(spark, sf_dir).select("name", "ats_provider", "ats_identifier")
    return write_back_detection(listed, _results(spark, sf_dir))


@query(
    "provider_breakdown",
    f"WITH {_RESULTS_SQL} SELECT ats_provider, count(*) AS companies FROM results GROUP BY 1",
)
def _breakdown(spark, sf_dir):
    return provider_breakdown(_results(spark, sf_dir))


@query(
    "detection_summary",
    f"""WITH {_RESULTS_SQL} SELECT count(*) AS checked,
      CAST(count(*) FILTER (ats_provider <> '') AS BIGINT) AS matched,
      CAST(count(*) FILTER (ats_provider = '') AS BIGINT) AS no_match FROM results""",
)
def _detection_summary(spark, sf_dir):
    return detection_summary(_results(spark, sf_dir))


# -- discovery -------------------------------------------------------------------------------

_SHEET_SQL = """
sheet AS (
  SELECT c_custkey AS row_no, c_mktsegment || ' AI & ' || c_custkey AS company, lower(c_mktsegment) AS seg,
    CAST(c_custkey AS VARCHAR) AS k, c_nationkey, c_acctbal,
    CASE WHEN c_nationkey < 6 THEN 'Greenhouse, or Lever' WHEN c_nationkey < 12 THEN 'ASHBY'
      WHEN c_nationkey < 16 THEN 'Workday' WHEN c_nationkey < 20 THEN 'In-House' ELSE '' END AS ats_text
  FROM customer
),
seeds AS (
  SELECT lower(company) AS name_key, 'workday' AS provider, 'h/' || k AS identifier, row_no AS seed_pos
  FROM sheet WHERE c_acctbal > 9000
  UNION ALL
  SELECT lower(company), 'lever', seg || '-' || k, row_no + 1000000000 FROM sheet WHERE c_acctbal > 8000
)"""
# The 18 variants of '<segment> AI & <key>'.
_VARIANT_SQL = """[seg || 'aiand' || k, seg || '-ai-and-' || k, seg || 'and' || k, seg || '-and-' || k,
  seg, seg || 'ai', seg || '-ai', seg || 'aiand' || k || 'ai', seg || 'and' || k || 'ai',
  'get' || seg || 'aiand' || k, 'get' || seg || 'and' || k, seg || 'aiand' || k || 'hq',
  'try' || seg || 'aiand' || k, seg || 'aiand' || k || 'inc', seg || 'aiand' || k || 'labs',
  seg || 'aiand' || k || 'app', 'the' || seg || 'aiand' || k, 'join' || seg || 'aiand' || k]"""
_STATED_SQL = """list_filter(['greenhouse','lever','ashby','workday','workable','smartrecruiters'],
  lambda p: contains(lower(ats_text), p))"""
_CANDIDATES_SQL = f"""
stated AS (SELECT *, {_STATED_SQL} AS providers FROM sheet),
offers AS (SELECT row_no, company, seg, k, unnest(providers) AS provider,
  generate_subscripts(providers, 1) AS p_pos FROM stated),
guesses AS (SELECT row_no, company, provider, unnest({_VARIANT_SQL}) AS identifier, 1 AS kind,
  p_pos AS major, generate_subscripts({_VARIANT_SQL}, 1) AS minor FROM offers WHERE provider <> 'workday'),
tried AS (
  SELECT row_no, company, provider, identifier, kind, major, minor FROM guesses
  UNION ALL
  SELECT row_no, company, provider, identifier, 0, seed_pos, 0 FROM stated JOIN seeds ON name_key = lower(company)
)"""
_BOARDS_SQL = """
boards AS (
  SELECT 'greenhouse' AS provider, lower(c_mktsegment) || 'and' || c_custkey AS identifier, c_nationkey AS job_count
  FROM customer WHERE c_acctbal < 2000
  UNION ALL SELECT 'ashby', 'join' || lower(c_mktsegment) || 'aiand' || c_custkey, c_nationkey
  FROM customer WHERE c_acctbal < 4000
  UNION ALL SELECT DISTINCT 'lever', lower(c_mktsegment), 77 FROM customer WHERE c_mktsegment <> 'BUILDING'
  UNION ALL SELECT 'workday', 'h/' || c_custkey, 5 FROM customer WHERE c_nationkey > 10
  UNION ALL SELECT 'ashby', lower(c_mktsegment) || 'aiand' || c_custkey, NULL FROM customer
)"""
_OUTCOME_SQL = f"""{_SHEET_SQL}, {_CANDIDATES_SQL}, {_BOARDS_SQL},
hits AS (SELECT * FROM (
  SELECT t.row_no, t.provider, t.identifier, b.job_count,
    row_number() OVER (PARTITION BY t.row_no ORDER BY kind, major, minor) AS nth
  FROM tried t JOIN boards b ON t.provider = b.provider AND t.identifier = b.identifier
  WHERE b.job_count IS NOT NULL) WHERE nth = 1),
outcome AS (
  SELECT s.row_no, s.company, h.provider, h.identifier, h.job_count,
    (len(s.providers) > 0 OR s.c_acctbal > 8000) AS attempt,
    CASE WHEN h.provider IS NOT NULL THEN NULL
      WHEN len(s.providers) > 0 OR s.c_acctbal > 8000 THEN '{NOT_FOUND}'
      ELSE '{UNSUPPORTED}' || CASE WHEN ats_text = '' THEN '(blank)' ELSE ats_text END END AS reason
  FROM stated s LEFT JOIN hits h ON s.row_no = h.row_no
)"""


def _sheet(spark, sf_dir) -> DataFrame:
    nation = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_no"),
        F.concat("c_mktsegment", F.lit(" AI & "), "c_custkey").alias("company"),
        F.when(nation < 6, "Greenhouse, or Lever")
        .when(nation < 12, "ASHBY")
        .when(nation < 16, "Workday")
        .when(nation < 20, "In-House")
        .otherwise("")
        .alias("ats_text"),
        "c_acctbal",
        F.lower("c_mktsegment").alias("_seg"),
    )


def _seeds(spark, sf_dir) -> DataFrame:
    rows = _sheet(spark, sf_dir)
    first = rows.filter(F.col("c_acctbal") > 9000).select(
        F.col("company").alias("name"),
        F.lit("workday").alias("ats_provider"),
        F.concat(F.lit("h/"), "row_no").alias("ats_identifier"),
        F.col("row_no").alias("file_pos"),
    )
    second = rows.filter(F.col("c_acctbal") > 8000).select(
        F.col("company").alias("name"),
        F.lit("lever").alias("ats_provider"),
        F.concat("_seg", F.lit("-"), "row_no").alias("ats_identifier"),
        (F.col("row_no") + 1_000_000_000).alias("file_pos"),
    )
    return seed_identifiers(first.unionByName(second))


def _boards(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("_seg", F.lower("c_mktsegment"))
    key, jobs = F.col("c_custkey"), F.col("c_nationkey")

    def board(keep, provider: str, identifier, count) -> DataFrame:
        return rows.filter(keep).select(
            F.lit(provider).alias("provider"), identifier.alias("identifier"), count.alias("job_count")
        )

    balance = F.col("c_acctbal")
    aiand = F.concat("_seg", F.lit("aiand"), key)
    parts = [
        board(balance < 2000, "greenhouse", F.concat("_seg", F.lit("and"), key), jobs),
        board(balance < 4000, "ashby", F.concat(F.lit("join"), aiand), jobs),
        board(F.col("c_mktsegment") != "BUILDING", "lever", F.col("_seg"), F.lit(77)).distinct(),
        board(jobs > 10, "workday", F.concat(F.lit("h/"), key), F.lit(5)),
        board(F.lit(True), "ashby", aiand, F.lit(None).cast("int")),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def _plain_sheet(spark, sf_dir) -> DataFrame:
    return _sheet(spark, sf_dir).select("row_no", "company", "ats_text")


@query(
    "slug_variants",
    f"""WITH {_SHEET_SQL} SELECT row_no, unnest({_VARIANT_SQL}) AS identifier,
      CAST(generate_subscripts({_VARIANT_SQL}, 1) AS INTEGER) AS place,
      array_to_string({_STATED_SQL}, ',') AS stated FROM sheet""",
)
def _slug_variants(spark, sf_dir):
    return slug_rows(_plain_sheet(spark, sf_dir), "company").select(
        "row_no",
        "identifier",
        (F.col("place") + 1).alias("place"),
        F.array_join(stated_providers(F.col("ats_text")), ",").alias("stated"),
    )


@query(
    "candidate_list",
    f"""WITH {_SHEET_SQL}, {_CANDIDATES_SQL}
    SELECT row_no, company, provider, identifier, kind FROM tried""",
)
def _candidates(spark, sf_dir):
    seeds = _seeds(spark, sf_dir)
    rows = candidates(tasks_of(_plain_sheet(spark, sf_dir), seeds), seeds)
    return rows.select("row_no", "company", "provider", "identifier", F.col("position.kind").alias("kind"))


def _outcome(spark, sf_dir) -> DataFrame:
    return resolve(_plain_sheet(spark, sf_dir), _seeds(spark, sf_dir), _boards(spark, sf_dir))


@query(
    "candidates_resolve",
    f"WITH {_OUTCOME_SQL} SELECT row_no, company, provider, identifier, job_count, attempt, reason FROM outcome",
)
def _resolve(spark, sf_dir):
    return _outcome(spark, sf_dir)


_URL_SQL = """CASE ats_provider WHEN 'greenhouse' THEN 'https://boards.greenhouse.io/'
  WHEN 'lever' THEN 'https://jobs.lever.co/' WHEN 'ashby' THEN 'https://jobs.ashbyhq.com/'
  WHEN 'workday' THEN 'https://' END || ats_identifier"""
_RESOLVED_SQL = f"""SELECT company, {_URL_SQL} AS career_page, ats_provider, ats_identifier, job_count
  FROM (SELECT company, provider AS ats_provider, identifier AS ats_identifier, job_count
    FROM outcome WHERE provider IS NOT NULL)"""


@query("resolved_list", f"WITH {_OUTCOME_SQL} {_RESOLVED_SQL} ORDER BY company")
def _resolved(spark, sf_dir):
    return resolved_list(_outcome(spark, sf_dir))


@query(
    "unresolved_list",
    f"WITH {_OUTCOME_SQL} SELECT company, reason FROM outcome WHERE reason IS NOT NULL",
)
def _unresolved(spark, sf_dir):
    return unresolved_list(_outcome(spark, sf_dir))


@query(
    "resolve_summary",
    f"""WITH {_OUTCOME_SQL} SELECT CAST(count(*) FILTER (provider IS NOT NULL) AS BIGINT) AS resolved,
      CAST(count(*) FILTER (attempt) AS BIGINT) AS attempted,
      CAST(coalesce(sum(job_count), 0) AS BIGINT) AS live_jobs,
      CAST(count(*) FILTER (NOT attempt) AS BIGINT) AS skipped FROM outcome""",
)
def _summary(spark, sf_dir):
    return resolve_summary(_outcome(spark, sf_dir))


@query(
    "retry_merge",
    f"""WITH {_OUTCOME_SQL}, again AS (
      SELECT s.row_no FROM outcome s WHERE reason = '{NOT_FOUND}'),
    rehits AS (SELECT * FROM (
      SELECT t.row_no, t.company, t.provider, t.identifier, 9 AS job_count,
        row_number() OVER (PARTITION BY t.row_no ORDER BY kind, major, minor) AS nth
      FROM tried t JOIN again USING (row_no)
      WHERE t.identifier LIKE 'the%' AND t.provider = 'ashby') WHERE nth = 1)
    SELECT company, provider AS ats_provider, identifier AS ats_identifier, 0 AS job_count
    FROM outcome WHERE provider IS NOT NULL
    UNION ALL SELECT company, provider, identifier, job_count FROM rehits""",
)
def _retry(spark, sf_dir):
    return _retried(spark, sf_dir)[0].select("company", "ats_provider", "ats_identifier", "job_count")


@query(
    "retry_unresolved",
    f"""WITH {_OUTCOME_SQL}, again AS (
      SELECT s.row_no, s.company FROM outcome s WHERE reason = '{NOT_FOUND}'),
    rehits AS (SELECT DISTINCT row_no FROM tried t JOIN again USING (row_no)
      WHERE t.identifier LIKE 'the%' AND t.provider = 'ashby')
    SELECT company, '{NOT_FOUND}' AS reason FROM again WHERE row_no NOT IN (SELECT row_no FROM rehits)
    UNION ALL SELECT company, reason FROM outcome WHERE reason <> '{NOT_FOUND}'""",
)
def _retry_unresolved(spark, sf_dir):
    return _retried(spark, sf_dir)[1].select("company", "reason")


def _retried(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Second pass over failed rows only, with boards that appeared since. Both lists and the retry
    read the first outcome, so it is written once."""
    outcome = stage(_outcome(spark, sf_dir), "outcome")
    sheet = retry_rows(_plain_sheet(spark, sf_dir), unresolved_list(outcome))
    later = table(spark, sf_dir, "customer").select(
        F.lit("ashby").alias("provider"),
        F.concat(F.lit("the"), F.lower("c_mktsegment"), F.lit("aiand"), "c_custkey").alias("identifier"),
        F.lit(9).alias("job_count"),
    )
    retried = resolve(sheet, _seeds(spark, sf_dir), later)
    return merge_retry(resolved_list(outcome), unresolved_list(outcome), stage(retried, "retried"))


# -- files and append-only tables --------------------------------------------------------------


@query(
    "company_csv",
    f"""WITH {_OUTCOME_SQL} SELECT company AS name, career_page, ats_provider, ats_identifier
    FROM ({_RESOLVED_SQL})""",
)
def _company_csv(spark, sf_dir):
    """The resolved list written as a company CSV and read back as companies."""
    path = scratch_path(spark, "companies-csv")
    write_csv(company_list_rows(resolved_list(_outcome(spark, sf_dir))), path)
    return read_companies(spark, path).select("name", "career_page", "ats_provider", "ats_identifier")


@query(
    "sample_sheet_csv",
    """SELECT trim(c_mktsegment || ' "AI", ' || c_custkey) AS company,
      CASE WHEN c_nationkey < 12 THEN 'Ashby' ELSE '' END AS ats_text FROM customer""",
)
def _sample_csv(spark, sf_dir):
    """A sheet with quotes, commas and padding in its cells."""
    path = scratch_path(spark, "sheet-csv")
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" "), "c_mktsegment", F.lit(' "AI", '), "c_custkey").alias("Company"),
        F.when(F.col("c_nationkey") < 12, "Ashby").alias("ATS"),
    )
    write_csv(rows, path)
    return read_sample_sheet(spark, path).select("company", "ats_text")


@query(
    "unresolved_csv",
    f"WITH {_OUTCOME_SQL} SELECT company AS Company, reason AS Reason FROM outcome WHERE reason IS NOT NULL",
)
def _unresolved_csv(spark, sf_dir):
    path = scratch_path(spark, "unresolved-csv")
    listed = unresolved_list(_outcome(spark, sf_dir))
    write_csv(listed.select(F.col("company").alias("Company"), F.col("reason").alias("Reason")), path)
    return read_csv(spark, path)


@query(
    "mark_applied",
    """SELECT sha256(lower(p_brand) || '|' || p_name || '|') AS job_hash, count(*) AS times, 'sent' AS notes
    FROM part GROUP BY 1""",
)
def _mark_applied(spark, sf_dir):
    """Two appends, one by hash and one by company and title; repeats stay."""
    applied = AppendTable(spark, scratch_path(spark, "applied"), APPLIED_DDL)
    parts = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("company_name"), F.col("p_name").alias("title"), "p_type"
    )
    by_hash = parts.filter(F.col("p_type") == "PROMO").select(
        posting_hash(F.col("company_name"), F.col("title"), F.lit("")).alias("job_hash")
    )
    mark_applied(applied, by_hash, "sent")
    mark_applied(applied, parts.filter(F.col("p_type") != "PROMO"), "sent")
    return applied.read().groupBy("job_hash", "notes").agg(F.count("*").alias("times"))
