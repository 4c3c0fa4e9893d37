"""Table schemas shared by sources, operators and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One row per response that was fetched; partition the landed table by provider.
PAYLOAD_DDL = (
    "provider string, identifier string, company_name string, query string, ordinal int, "
    "http_status int, error string, body string, fetched_at timestamp"
)

# One row per career page that was fetched.
PAGE_DDL = (
    "company_name string, page_url string, final_url string, http_status int, error string, html string"
)

COMPANY_DDL = (
    "name string, career_page string, region string, priority string, notes string, "
    "ats_provider string, ats_identifier string, last_checked_at timestamp, last_status string"
)

# Stored postings carry no description: it is only needed for scoring.
POSTING_STATE_DDL = (
    "job_hash string, company_name string, title string, location string, remote boolean, "
    "apply_url string, source string, ats_platform string, posted_date string, company_priority string, "
    "first_seen_at timestamp, last_seen_at timestamp, rank_score double, rank_stars int, rank_reason string"
)

APPLIED_DDL = "job_hash string, applied_at timestamp, notes string"

REPORT_DDL = (
    "run_date date, run_started_at timestamp, total_jobs_found bigint, new_jobs_found bigint, "
    "companies_checked bigint, companies_failed bigint, sources_checked bigint, sources_failed bigint, "
    "report_path string"
)

BOARD_DDL = "provider string, identifier string, job_count int"

# Columns that put postings in arrival order: boards before feeds, then company, response, item. The
# digest of the response comes last, so the order is the same however the input is read.
ARRIVAL = ("source_rank", "board_key", "batch_no", "item_no", "response_digest")

POSTING_COLUMNS = (
    "company_name",
    "title",
    "location",
    "description",
    "remote",
    "apply_url",
    "source",
    "ats_platform",
    "posted_date",
    "company_priority",
    "fetched_at",
) + ARRIVAL


def fields_of(ddl: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a flat DDL string."""
    return [tuple(part.strip().split(" ", 1)) for part in ddl.split(",")]


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Select exactly the columns of a flat DDL; absent ones become typed nulls."""
    present = set(df.columns)

    def pick(name: str, dtype: str) -> Column:
        return (F.col(name) if name in present else F.lit(None)).cast(dtype).alias(name)

    return df.select(*[pick(n, t) for n, t in fields_of(ddl)])
