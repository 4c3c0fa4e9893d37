"""Run counters and the rows of the daily report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesift.functions.text import blank_to_null
from rolesift.operators.selection import rank_order
from rolesift.schema import ARRIVAL


def posting_counters(ranked: DataFrame) -> DataFrame:
    """Totals after the cap."""
    return ranked.agg(
        F.count("*").alias("total_jobs_found"), F.count_if("is_new").alias("new_jobs_found")
    )


def company_counters(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count("*").alias("companies_checked"),
        F.count_if(F.col("last_status").startswith("error")).alias("companies_failed"),
    )


def source_checks(payloads: DataFrame, feeds: Sequence[str]) -> DataFrame:
    """One row per configured feed that was asked: 'ok', or the first error text."""
    return (
        payloads.filter(F.col("provider").isin(*feeds))
        .groupBy("provider")
        .agg(F.min("error").alias("_error"))
        .select(
            "provider",
            F.when(F.col("_error").isNotNull(), F.concat(F.lit("error: "), "_error"))
            .otherwise("ok")
            .alias("last_status"),
        )
    )


def source_counters(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count("*").alias("sources_checked"),
        F.count_if(F.col("last_status").startswith("error")).alias("sources_failed"),
    )


def one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """Put one-row results with different columns side by side: stack them, take each value."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def star_text(stars: Column, padded: bool = False) -> Column:
    full = F.repeat(F.lit("★"), stars)
    return F.concat(full, F.repeat(F.lit("☆"), F.lit(5) - stars)) if padded else full


def _or_na(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit("n/a"))


def report_items(section: str, listed: DataFrame, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """Display rows of one section, numbered from 1.

    ``listed`` is the output of a limit, so numbering it in one task is bound by a setting.
    """
    place = F.row_number().over(Window.partitionBy(F.lit(section)).orderBy(*rank_order(order)))
    return listed.select(
        F.lit(section).alias("section"),
        place.alias("position"),
        "title",
        "company_name",
        star_text(F.col("rank_stars")).alias("stars"),
        star_text(F.col("rank_stars"), padded=True).alias("stars_padded"),
        _or_na(F.col("location")).alias("location"),
        F.when(F.col("remote"), "Remote").otherwise("On-site").alias("mode"),
        "apply_url",
        F.col("rank_reason").alias("reason"),
        _or_na(F.col("ats_platform")).alias("ats_platform"),
        _or_na(F.col("posted_date")).alias("posted_date"),
        _or_na(F.col("company_priority")).alias("priority"),
        F.format_string("%.0f", F.bround("rank_score", 0)).alias("score"),
    )


# Section names and the texts of the digest.
TOP, OTHER = "recommendations", "worth_looking_at"
EMPTY_TOP = "_No new jobs met the ranking threshold today._"
OTHER_INTRO = (
    "New jobs that matched your target roles but didn't qualify for the top picks above — "
    "over-experienced, on-site, no direct stack overlap, or just ranked lower. "
    "Reason noted per job:"
)


def digest_lines(metrics: DataFrame, items: DataFrame) -> DataFrame:
    """The report as numbered text blocks: (part, position, text). Size is bound by the limits."""
    counts = items.agg(
        F.count_if(F.col("section") == TOP).alias("_top"),
        F.count_if(F.col("section") == OTHER).alias("_other"),
    )
    top_count = counts.select("_top").scalar()
    other_count = counts.select("_other").scalar()

    head = metrics.select(
        F.lit(0).alias("part"),
        F.lit(0).alias("position"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("# AI Job Digest — "), F.col("run_date").cast("string")),
            F.lit(""),
            F.concat(F.lit("- **Total jobs found:** "), "total_jobs_found"),
            F.concat(F.lit("- **New jobs today:** "), "new_jobs_found"),
            F.format_string(
                "- **Companies checked:** %d (%d failed/unreachable)", "companies_checked", "companies_failed"
            ),
            F.format_string(
                "- **Global sources checked:** %d (%d failed/unreachable)", "sources_checked", "sources_failed"
            ),
            F.lit(""),
            F.format_string("## Top %d Recommendations", top_count),
            F.lit(""),
            F.when(top_count == 0, F.lit(EMPTY_TOP)),
        ).alias("text"),
    )
    top = items.filter(F.col("section") == TOP).select(
        F.lit(1).alias("part"),
        "position",
        F.format_string(
            "### %d. %s — %s %s\n- **Location:** %s (%s)\n- **Apply:** %s\n"
            "- **Why it matches:** %s\n- **ATS platform:** %s\n- **Posted:** %s\n"
            "- **Priority:** %s (score %s/100)\n",
            "position",
            "title",
            "company_name",
            "stars",
            "location",
            "mode",
            "apply_url",
            "reason",
            "ats_platform",
            "posted_date",
            "priority",
            "score",
        ).alias("text"),
    )
    other_head = metrics.filter(other_count > 0).select(
        F.lit(2).alias("part"),
        F.lit(0).alias("position"),
        F.concat(
            F.format_string("## Other jobs worth looking at (%d)\n\n", other_count),
            F.lit(OTHER_INTRO + "\n"),
        ).alias("text"),
    )
    other = items.filter(F.col("section") == OTHER).select(
        F.lit(3).alias("part"),
        "position",
        F.format_string(
            "- %s — %s %s — %s\n  _%s_", "title", "company_name", "stars", "apply_url", "reason"
        ).alias("text"),
    )
    blocks = head.unionByName(top).unionByName(other_head).unionByName(other)
    return blocks.orderBy("part", "position")


def evolve_reports(older: Sequence[DataFrame], current: DataFrame) -> DataFrame:
    """Report rows of older shapes next to current ones; what a shape lacks is null."""
    for shape in older:
        current = current.unionByName(shape, allowMissingColumns=True)
    return current
