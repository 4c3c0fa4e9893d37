"""Company lists and sample sheets (CSV)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.functions.text import blank_to_null, strip_or_blank

# Headers of the company list.
LIST_COLUMNS = (
    "Company",
    "Region",
    "Category",
    "Careers / Job Board URL",
    "Remote Policy (typical)",
    "Est. Junior AI/ML Salary Range (1-3 YOE)",
    "Notes",
    "Tier",
    "Why Target This Company",
    "Research Status",
    "ATS",
    "ATS Identifier",
)
URL_COLUMN = "Careers / Job Board URL"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column text, no inference; quoted cells may span lines."""
    return spark.read.csv(
        path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8"
    )


def with_position(rows: DataFrame, name: str) -> DataFrame:
    """Number the rows of CSV files: files by name, rows as they stand in their file.

    A file with quoted line breaks is one task, and Spark deals files to tasks by size; so the
    place within a task gives the order within a file, and the sorted list of files the rest.
    """
    # the two ways to name a file differ in the slashes after the scheme
    files = sorted(re.sub(_SLASHES, r"\1:/", name) for name in rows.inputFiles())
    spark = rows.sparkSession
    order = spark.createDataFrame(list(zip(files, range(len(files)))), "_path string, _file_no long")
    placed = rows.withColumns(
        {"_path": F.regexp_replace("_metadata.file_path", _SLASHES, "$1:/"), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_MASK))}
    )
    numbered = placed.join(F.broadcast(order), "_path")
    return numbered.withColumn(name, F.shiftleft("_file_no", 33) + F.col("_place")).drop("_path", "_file_no", "_place")


# monotonically_increasing_id counts within a task in its low 33 bits.
_PLACE_MASK = (1 << 33) - 1
_SLASHES = "^([A-Za-z0-9+.-]+):/+"


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """The companies of a CSV file or a folder of them. A file is read by one task, so this is for
    lists that people keep; larger lists come as a table with ``file_pos``."""
    return companies_from_rows(with_position(read_csv(spark, path), "file_pos"))


def companies_from_rows(rows: DataFrame) -> DataFrame:
    """Company rows with name and URL; the ATS columns may be absent or blank.

    ``file_pos`` keeps the order of the list; without such a column it is the order of reading.
    """
    position = F.col("file_pos") if "file_pos" in rows.columns else F.monotonically_increasing_id()

    def cell(name: str) -> Column:
        value = F.col(f"`{name}`") if name in rows.columns else F.lit(None)
        return strip_or_blank(value)

    return rows.select(
        position.alias("file_pos"),
        cell("Company").alias("name"),
        cell(URL_COLUMN).alias("career_page"),
        cell("Region").alias("region"),
        cell("Tier").alias("priority"),
        cell("Notes").alias("notes"),
        blank_to_null(cell("ATS")).alias("ats_provider"),
        blank_to_null(cell("ATS Identifier")).alias("ats_identifier"),
    ).filter((F.col("name") != "") & (F.col("career_page") != ""))


def first_companies(companies: DataFrame, n: int | None) -> DataFrame:
    """The first n companies of the file."""
    return companies if n is None else companies.orderBy("file_pos").limit(n)


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, company, ats_text); every row with a name is a task, repeats included."""
    rows = with_position(read_csv(spark, path), "row_no")
    return rows.select(
        "row_no",
        strip_or_blank(F.col("Company")).alias("company"),
        strip_or_blank(F.col("ATS")).alias("ats_text"),
    ).filter(F.col("company") != "")
