"""Merges of a batch into a keyed table, as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.operators.topk import first_k

POSTING_UPDATES = (
    "last_seen_at",
    "rank_score",
    "rank_stars",
    "rank_reason",
    "apply_url",
    "posted_date",
)
COMPANY_UPDATES = ("career_page", "region", "priority", "notes")
CHECK_UPDATES = ("ats_provider", "ats_identifier", "last_checked_at", "last_status")


def upsert(
    target: DataFrame,
    batch: DataFrame,
    key: str,
    update_columns: Sequence[str],
    never_back: str | None = None,
) -> DataFrame:
    """Insert new keys with all columns; on known keys take only ``update_columns`` of the batch.
    ``never_back`` names a column that only grows: a batch row with a smaller value in it is late, and changes
    nothing of a known key.

    The key must be unique in both. Columns missing in the batch stay null for inserts.
    """
    old = target.select(
        F.col(key), F.struct(*[c for c in target.columns if c != key]).alias("_old")
    )
    offered = [c for c in target.columns if c != key and c in batch.columns]
    new = batch.select(F.col(key), F.struct(*offered).alias("_new"))
    joined = old.join(new, key, "full_outer")
    taken = F.col("_new").isNotNull()
    if never_back in offered:
        late = F.col(f"_new.{never_back}").cast(target.schema[never_back].dataType) < F.col(f"_old.{never_back}")
        taken = taken & ~F.coalesce(late, F.lit(False))

    def value(name: str):
        stored = F.col(f"_old.{name}")
        if name not in offered:
            return stored.alias(name)
        given = F.col(f"_new.{name}").cast(target.schema[name].dataType)
        if name == never_back:
            return F.greatest(stored, given).alias(name)
        if name in update_columns:
            return F.when(taken, given).otherwise(stored).alias(name)
        return F.when(F.col("_old").isNull(), given).otherwise(stored).alias(name)

    return joined.select(*[F.col(key) if c == key else value(c) for c in target.columns])


def update_only(target: DataFrame, batch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Overwrite ``columns`` of the rows the batch names, nulls included; never insert.

    Of several batch rows with one key the least counts, so the target keeps its number of rows."""
    batch = first_k(batch, [key], list(columns), 1)
    new = batch.select(F.col(key), F.struct(*columns).alias("_new"))
    joined = target.join(new, key, "left")
    return joined.select(
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}").cast(target.schema[c].dataType))
            .otherwise(F.col(c))
            .alias(c)
            if c in columns
            else F.col(c)
            for c in target.columns
        ]
    )


def upsert_postings(state: DataFrame, batch: DataFrame, seen_at: str = "seen_at", first_seen: str | None = None) -> DataFrame:
    """first_seen_at stays, last_seen_at moves to the time the batch row was fetched, never back. A row that was
    fetched before the stored one was changes nothing.

    ``first_seen`` names the column with the first time, where it is not ``seen_at``."""
    times = {"first_seen_at": F.col(first_seen or seen_at), "last_seen_at": F.col(seen_at)}
    return upsert(state, batch.withColumns(times), "job_hash", POSTING_UPDATES, never_back="last_seen_at")


def upsert_companies(state: DataFrame, companies: DataFrame) -> DataFrame:
    """The list may repeat a name; its last row wins. Board and status columns are kept."""
    batch = first_k(companies, ["name"], [F.col("file_pos").desc(), "career_page"], 1)
    return upsert(state, batch.select("name", *COMPANY_UPDATES), "name", COMPANY_UPDATES)


def record_checks(state: DataFrame, checks: DataFrame) -> DataFrame:
    return update_only(state, checks, "name", CHECK_UPDATES)
