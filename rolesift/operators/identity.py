"""Posting identity: hash, first arrival wins, applied and known postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.functions.text import posting_hash
from rolesift.operators.topk import first_k
from rolesift.schema import ARRIVAL

KEY = "job_hash"


def with_hash(postings: DataFrame) -> DataFrame:
    return postings.withColumn(KEY, posting_hash(F.col("company_name"), F.col("title"), F.col("location")))


def first_arrivals(hashed: DataFrame, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """One row per hash, the earliest. Copies are cut to one per task before the shuffle."""
    return first_k(hashed, [KEY], order, 1)


def distinct_hashes(table: DataFrame) -> DataFrame:
    """Only the key column is read from a stored table."""
    return table.select(KEY).distinct()


def drop_applied(hashed: DataFrame, applied: DataFrame) -> DataFrame:
    return hashed.join(distinct_hashes(applied), KEY, "left_anti")


def mark_new(hashed: DataFrame, known: DataFrame) -> DataFrame:
    """is_new against the state as it was before this run."""
    seen = distinct_hashes(known).withColumn("_seen", F.lit(True))
    return hashed.join(seen, KEY, "left").withColumn("is_new", F.col("_seen").isNull()).drop("_seen")


def dedupe_and_mark(
    hashed: DataFrame, known: DataFrame, applied: DataFrame, order: Sequence[str] = ARRIVAL
) -> DataFrame:
    """First arrival per hash without the applied ones, marked new or known.

    Dedupe comes first: afterwards every hash occurs once on both sides, so neither join can meet
    a hot key, and both reuse the partitioning by hash.
    """
    return mark_new(drop_applied(first_arrivals(hashed, order), applied), known)
