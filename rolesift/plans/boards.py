"""Board discovery: detect platforms behind pages, resolve names to boards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.operators.detection import detection_results, write_back_detection
from rolesift.operators.discovery import resolve, resolved_list, unresolved_list
from rolesift.sources.companies import LIST_COLUMNS, URL_COLUMN


def enriched_rows(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """The company list as read from CSV with its ATS columns set for the checked companies."""
    results = detection_results(pages)
    columns = [c for c in rows.columns if c not in ("ATS", "ATS Identifier")]
    keyed = rows.select(
        *[F.col(f"`{c}`") for c in columns],
        F.col("Company").alias("name"),
        (F.col("ATS") if "ATS" in rows.columns else F.lit("")).alias("ats_provider"),
        (F.col("`ATS Identifier`") if "ATS Identifier" in rows.columns else F.lit("")).alias(
            "ats_identifier"
        ),
    )
    written = write_back_detection(keyed, results)
    return written.select(
        *[F.col(f"`{c}`") for c in columns],
        F.col("ats_provider").alias("ATS"),
        F.col("ats_identifier").alias("ATS Identifier"),
    )


def resolve_lists(
    sheet: DataFrame, seeds: DataFrame, boards: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcome, resolved, unresolved) of one pass over the sheet."""
    outcome = resolve(sheet, seeds, boards)
    return outcome, resolved_list(outcome), unresolved_list(outcome)


def company_list_rows(resolved: DataFrame) -> DataFrame:
    """Resolved boards in the columns of the company list."""
    filled = {
        "Company": F.col("company"),
        URL_COLUMN: F.col("career_page"),
        "ATS": F.col("ats_provider"),
        "ATS Identifier": F.col("ats_identifier"),
        "Research Status": F.lit("Verified live"),
    }
    return resolved.select(*[filled.get(c, F.lit("")).alias(c) for c in LIST_COLUMNS])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')
