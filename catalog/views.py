"""Posting-shaped views of the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.operators.identity import with_hash
from rolesift.plans.daily import rank_postings
from rolesift.settings import Limits, Profile, Roles, Settings

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

SETTINGS = Settings(
    profile=Profile(
        max_years=10,
        countries=("NATION_1", "Remote"),
        remote_preference="strong",
        keywords=("Red", "blue", "cold", "brand#1", "years", "rod", "economy"),
    ),
    roles=Roles(
        include=("widget", "Ring", "gear", "gizmo"),
        exclude=("OLD", " bolt "),
        include_internships=False,
        internship_words=("small",),
    ),
    limits=Limits(per_company=5, top_n=30, min_stars=3, worth_looking=30),
)

# Parts of the posting view that stand for stored and for handled postings.
KNOWN_BEFORE = "1997-01-01"
APPLIED_FROM = "2001-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tier() -> Column:
    balance = F.col("s_acctbal")
    return F.when(balance >= 5000, "Tier 1").when(balance >= 0, "Tier 2").otherwise("Tier 3")


def posting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with what their postings are made of; the dimension sides go by size, as Spark sees fit."""
    lines = table(spark, sf_dir, "lineitem").select(
        *ORDER, "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    sellers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # one by one: the size of a joined side is only guessed, as a product, and would keep it from being broadcast
    rows = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return rows.drop("p_partkey", "s_suppkey", "s_nationkey", "n_nationkey")


def posting_columns() -> list[Column]:
    """The view's columns over ``posting_rows``, but for the order."""
    flag, years = F.col("l_returnflag"), F.col("l_quantity").cast("int")
    return [
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("  "), F.upper("s_name")))
        .otherwise(F.col("s_name"))
        .alias("company_name"),
        F.concat_ws(" ", "p_name", "p_type").alias("title"),
        F.when(flag == "A", F.concat(F.lit("Remote, "), "n_name"))
        .when(flag == "N", F.col("n_name"))
        .otherwise("")
        .alias("location"),
        F.when(
            F.col("l_linestatus") == "O",
            F.concat(F.lit("Requires "), years, F.lit("-"), years + 2, F.lit(" years with "), "p_brand"),
        )
        .when(flag == "R", F.concat(years, F.lit("+ yrs of "), "p_brand"))
        .otherwise(F.concat("p_brand", F.lit(" only")))
        .alias("description"),
        ((flag == "A") | (F.col("l_linestatus") == "O")).alias("remote"),
        F.concat(
            F.lit("https://jobs.example.com/"), "l_orderkey", F.lit("/"), "l_linenumber"
        ).alias("apply_url"),
        F.when(flag == "R", "remoteok").otherwise("company_ats").alias("source"),
        F.when(flag == "A", "greenhouse").when(flag == "N", "generic").alias("ats_platform"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("posted_date"),
        tier().alias("company_priority"),
    ]


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per line item."""
    return posting_rows(spark, sf_dir).select(*posting_columns(), *ORDER)


POSTS_SQL = """
posts AS (
  SELECT CASE WHEN l_linenumber = 1 THEN '  ' || upper(s_name) ELSE s_name END AS company_name,
    p_name || ' ' || p_type AS title,
    CASE l_returnflag WHEN 'A' THEN 'Remote, ' || n_name WHEN 'N' THEN n_name ELSE '' END AS location,
    CASE WHEN l_linestatus = 'O' THEN 'Requires ' || CAST(l_quantity AS INTEGER) || '-'
           || (CAST(l_quantity AS INTEGER) + 2) || ' years with ' || p_brand
         WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INTEGER) || '+ yrs of ' || p_brand
         ELSE p_brand || ' only' END AS description,
    (l_returnflag = 'A' OR l_linestatus = 'O') AS remote,
    'https://jobs.example.com/' || l_orderkey || '/' || l_linenumber AS apply_url,
    CASE WHEN l_returnflag = 'R' THEN 'remoteok' ELSE 'company_ats' END AS source,
    CASE l_returnflag WHEN 'A' THEN 'greenhouse' WHEN 'N' THEN 'generic' END AS ats_platform,
    strftime(l_shipdate, '%Y-%m-%d') AS posted_date,
    CASE WHEN s_acctbal >= 5000 THEN 'Tier 1' WHEN s_acctbal >= 0 THEN 'Tier 2' ELSE 'Tier 3' END
      AS company_priority,
    l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""

HASH_SQL = (
    "sha256(lower(trim(regexp_replace(company_name, '\\s+', ' ', 'g'))) || '|' || "
    "lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) || '|' || "
    "lower(trim(regexp_replace(location, '\\s+', ' ', 'g'))))"
)

HASHED_SQL = f"""
hashed AS (SELECT *, {HASH_SQL} AS job_hash FROM posts),
known AS (SELECT DISTINCT job_hash FROM hashed WHERE posted_date < '{KNOWN_BEFORE}'),
applied AS (SELECT DISTINCT job_hash FROM hashed WHERE posted_date >= '{APPLIED_FROM}')"""

RELEVANT = """(title ILIKE '%widget%' OR title ILIKE '%ring%' OR title ILIKE '%gear%' OR title ILIKE '%gizmo%')
  AND NOT (title ILIKE '%old%' OR title ILIKE '%bolt%') AND NOT title ILIKE '%small%'"""

SCORED_SQL = """
texts AS (
  SELECT *, lower(title || chr(10) || location || chr(10) || description) AS txt,
    CASE WHEN title ILIKE '%widget%' THEN 'widget' WHEN title ILIKE '%ring%' THEN 'Ring'
         WHEN title ILIKE '%gear%' THEN 'gear' WHEN title ILIKE '%gizmo%' THEN 'gizmo' END AS role_hit
  FROM hashed
),
found AS (
  SELECT *, list_filter(['Red','blue','cold','brand#1','years','rod','economy'],
      lambda k: contains(txt, lower(k))) AS hits,
    CAST(coalesce(
      nullif(regexp_extract(txt, '(\\d+)\\s*(?:-|to)\\s*(\\d+)\\s*\\+?\\s*(?:years?|yrs?|yoe)\\b', 1), ''),
      nullif(regexp_extract(txt, '(\\d+)[\\s-]*\\+?\\s*(?:years?|yrs?|yoe)\\b', 1), '')) AS INTEGER)
      AS required_years_experience,
    (location ILIKE '%NATION_1%' OR location ILIKE '%remote%') AS fits
  FROM texts
),
scored AS (
  SELECT *, len(hits) > 0 AS has_stack_overlap,
    CAST(CASE WHEN role_hit IS NULL THEN 0 ELSE 40 END + least(25, 5 * len(hits))
      + CASE WHEN remote THEN 15 ELSE 0 END
      + CASE WHEN fits THEN 10 WHEN remote THEN 5 ELSE 0 END
      + CASE WHEN required_years_experience IS NULL THEN 5
             WHEN required_years_experience <= 10 THEN 10 ELSE 2 END AS DOUBLE) AS rank_score,
    coalesce(nullif(concat_ws('; ',
      CASE WHEN role_hit IS NOT NULL THEN 'title matches "' || role_hit || '"' END,
      CASE WHEN len(hits) > 0 THEN 'stack overlap: ' || array_to_string(hits[1:5], ', ') END,
      CASE WHEN remote THEN 'fully remote' END,
      CASE WHEN fits THEN 'location fits (' || location || ')' END,
      CASE WHEN required_years_experience <= 10 THEN 'needs ~' || required_years_experience
             || ' yrs experience (within your 10-yr preference)'
           WHEN required_years_experience > 10 THEN 'needs ~' || required_years_experience
             || '+ yrs experience (above your 10-yr preference)' END), ''),
      'General AI/ML role match') AS rank_reason
  FROM found
),
starred AS (
  SELECT *, CASE WHEN rank_score >= 80 THEN 5 WHEN rank_score >= 65 THEN 4
    WHEN rank_score >= 50 THEN 3 WHEN rank_score >= 30 THEN 2 ELSE 1 END AS rank_stars
  FROM scored
)"""

ORDER_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

RANKED_SQL = f"""
fresh AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY job_hash ORDER BY {ORDER_SQL}) AS nth
    FROM starred WHERE {RELEVANT}
  ) WHERE nth = 1 AND job_hash NOT IN (SELECT job_hash FROM applied)
),
ranked AS (
  SELECT *, job_hash NOT IN (SELECT job_hash FROM known) AS is_new FROM (
    SELECT *, row_number() OVER (PARTITION BY lower(trim(company_name))
      ORDER BY rank_score DESC, {ORDER_SQL}) AS place FROM fresh
  ) WHERE place <= 5
)"""

FULL_SQL = f"WITH {POSTS_SQL}, {HASHED_SQL}, {SCORED_SQL}, {RANKED_SQL}"

QUALIFIES_SQL = (
    "remote AND has_stack_overlap AND "
    "(required_years_experience IS NULL OR required_years_experience <= 10)"
)
TOP_SQL = f"""
recommended AS (
  SELECT * FROM ranked WHERE is_new AND rank_stars >= 3 AND {QUALIFIES_SQL}
  ORDER BY rank_score DESC, {ORDER_SQL} LIMIT 30
)"""
OTHERS_SQL = f"""
others AS (
  SELECT * EXCLUDE (rank_reason), coalesce(nullif(concat_ws('; ',
      CASE WHEN required_years_experience > 10 THEN 'needs ~' || required_years_experience
        || '+ yrs experience (above your 10-yr preference)' END,
      CASE WHEN NOT remote THEN 'on-site / not remote' END,
      CASE WHEN NOT has_stack_overlap THEN 'no direct tech-stack overlap detected' END), ''),
      'ranked below your top picks') AS rank_reason
  FROM ranked WHERE is_new AND job_hash NOT IN (SELECT job_hash FROM recommended)
  ORDER BY rank_score DESC, {ORDER_SQL} LIMIT 30
)"""


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_hash(postings(spark, sf_dir))


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(spark, sf_dir).filter(F.col("posted_date") < KNOWN_BEFORE).select("job_hash")


def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(spark, sf_dir).filter(F.col("posted_date") >= APPLIED_FROM).select("job_hash")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_postings(
        postings(spark, sf_dir), known(spark, sf_dir), applied(spark, sf_dir), SETTINGS, ORDER
    )
