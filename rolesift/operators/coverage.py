"""Coverage of the company list and health of the boards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions.text import text_or_blank
from rolesift.operators.topk import first_k
from rolesift.sources.registry import board_names

# Tiers in order, and the classes of sources.
TIERS = ("Tier 1", "Tier 2", "Tier 3")
OTHER_TIER = 9
NO_BOARD, NO_READER, FAILING, COVERED = "no_ats", "unsupported_ats", "failing", "covered"


def tier_rank(priority: Column) -> Column:
    rank = F.lit(OTHER_TIER)
    for position, tier in reversed(list(enumerate(TIERS))):
        rank = F.when(priority == tier, position).otherwise(rank)
    return rank


def coverage_bucket(provider: Column, status: Column, supported: Sequence[str]) -> Column:
    provider = text_or_blank(provider)
    return (
        F.when(provider == "", NO_BOARD)
        .when(~provider.isin(*supported), NO_READER)
        .when(status.startswith("error"), FAILING)
        .otherwise(COVERED)
    )


def with_coverage(
    companies: DataFrame, state: DataFrame, supported: Sequence[str] | None = None
) -> DataFrame:
    """Companies with their last status ('' when never checked) and coverage bucket."""
    status = state.select("name", F.col("last_status").alias("_status"))
    joined = companies.join(status, "name", "left").withColumn(
        "last_status", F.coalesce("_status", F.lit(""))
    )
    names = board_names() if supported is None else supported
    return joined.drop("_status").withColumn(
        "bucket", coverage_bucket(F.col("ats_provider"), F.col("last_status"), names)
    )


def coverage_counts(covered: DataFrame) -> DataFrame:
    return covered.groupBy("bucket").agg(F.count("*").alias("companies"))


def coverage_report(covered: DataFrame) -> DataFrame:
    """Companies without reliable coverage, by ``section`` (no reader, failing, no board), tier, name."""
    section = F.when(F.col("bucket") == NO_READER, 0).when(F.col("bucket") == FAILING, 1).otherwise(2)
    open_ones = covered.filter(F.col("bucket") != COVERED).withColumn("section", section)
    return open_ones.orderBy("section", tier_rank(F.col("priority")), "name")


def provider_breakdown(results: DataFrame) -> DataFrame:
    """Checked companies per detected provider; the blank provider counts those without match."""
    return results.groupBy(text_or_blank(F.col("ats_provider")).alias("ats_provider")).agg(
        F.count("*").alias("companies")
    )


def detection_summary(results: DataFrame) -> DataFrame:
    found = text_or_blank(F.col("ats_provider")) != ""
    return results.agg(
        F.count("*").alias("checked"),
        F.count_if(found).alias("matched"),
        F.count_if(~found).alias("no_match"),
    )


def _share(count: Column, total: Column) -> Column:
    return F.round(F.lit(100.0) * count / total, 1)


def provider_share(companies: DataFrame) -> DataFrame:
    """Companies per supported provider with percent of all companies, and one total line.

    The grand total is a scalar subquery; the total line comes from the rollup.
    """
    total = companies.agg(F.count("*").alias("n")).scalar()
    confirmed = companies.filter(F.col("ats_provider").isin(board_names()))
    return (
        confirmed.rollup("ats_provider")
        .agg(F.count("*").alias("companies"), F.grouping("ats_provider").alias("_total"))
        .select(
            F.when(F.col("_total") == 1, F.lit("Total confirmed"))
            .otherwise(F.col("ats_provider"))
            .alias("provider"),
            "companies",
            _share(F.col("companies"), total).alias("percent"),
        )
    )


def source_class(source: Column, platform: Column) -> Column:
    return (
        F.when(platform == "generic", F.lit("generic page"))
        .when(source == "company_ats", F.lit("board"))
        .otherwise("feed")
    )


def source_share(postings: DataFrame) -> DataFrame:
    """Postings per class of source with percent of all postings."""
    total = postings.agg(F.count("*").alias("n")).scalar()
    return (
        postings.groupBy(source_class(F.col("source"), F.col("ats_platform")).alias("source_type"))
        .agg(F.count("*").alias("jobs"))
        .withColumn("percent", _share(F.col("jobs"), total))
    )


def checkable(companies: DataFrame, supported: Sequence[str] | None = None) -> DataFrame:
    """Companies with a board identifier on a supported provider."""
    names = board_names() if supported is None else supported
    return companies.filter(
        (text_or_blank(F.col("ats_provider")) != "")
        & (text_or_blank(F.col("ats_identifier")) != "")
        & F.col("ats_provider").isin(*names)
    )


def health_sample(companies: DataFrame, per_provider: int, supported: Sequence[str] | None = None) -> DataFrame:
    """First companies of the list per provider."""
    return first_k(checkable(companies, supported), ["ats_provider"], ["file_pos"], per_provider)


def health_rows(sample: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per sampled company: status, job count, error.

    ``answers`` has provider, identifier, job_count, error (null when the reader went through) and
    may have sample_title, once per board.
    """
    title = F.col("sample_title") if "sample_title" in answers.columns else F.lit(None).cast("string")
    answer = answers.select(
        F.col("provider").alias("ats_provider"),
        F.col("identifier").alias("ats_identifier"),
        "job_count",
        "error",
        title.alias("sample_title"),
    )
    failed = F.col("error").isNotNull()
    return sample.join(answer, ["ats_provider", "ats_identifier"], "left").select(
        "ats_provider",
        F.col("name").alias("company_name"),
        "ats_identifier",
        F.when(failed, "error").otherwise("ok").alias("status"),
        F.when(failed, 0).otherwise(F.coalesce("job_count", F.lit(0))).cast("bigint").alias("job_count"),
        F.coalesce("error", F.lit("")).alias("error"),
        F.when(failed, "").otherwise(F.coalesce("sample_title", F.lit(""))).alias("sample_title"),
    )


def health_summary(rows: DataFrame) -> DataFrame:
    ok = F.col("status") == "ok"
    return rows.groupBy("ats_provider").agg(
        F.count("*").alias("tested"),
        F.count_if(ok).alias("ok"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("job_count"))), F.lit(0)).cast("bigint").alias("total_jobs"),
        F.coalesce(F.avg(F.when(ok, F.col("job_count"))), F.lit(0.0)).alias("avg_jobs"),
    )


def health_list(rows: DataFrame) -> DataFrame:
    return rows.orderBy("ats_provider", "company_name", "ats_identifier")


def failed_boards(rows: DataFrame) -> DataFrame:
    """Sampled boards whose reader failed, with the error."""
    return health_list(rows.filter(F.col("status") != "ok")).drop("job_count", "sample_title")


def silent_boards(rows: DataFrame) -> DataFrame:
    """Sampled boards that answered without any job: perhaps a wrong identifier."""
    return health_list(rows.filter((F.col("status") == "ok") & (F.col("job_count") == 0))).drop("error", "sample_title")


def untested_providers(companies: DataFrame, supported: DataFrame) -> DataFrame:
    """Supported providers (one column, ``ats_provider``) no company is routed to."""
    return supported.join(companies.select("ats_provider").distinct(), "ats_provider", "left_anti")
