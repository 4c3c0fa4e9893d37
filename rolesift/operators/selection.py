"""Cap per company, recommendations and the remainder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions.text import strip
from rolesift.operators.scoring import above_text
from rolesift.operators.topk import first_k
from rolesift.schema import ARRIVAL


def rank_order(order: Sequence[str] = ARRIVAL) -> list[Column | str]:
    """Score descending, ties by arrival."""
    return [F.col("rank_score").desc(), *order]


def cap_per_company(scored: DataFrame, k: int, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """Best k of each company; known postings use up slots too, blank names share one key."""
    keyed = scored.withColumn("_company_key", F.lower(strip(F.col("company_name"))))
    return first_k(keyed, ["_company_key"], rank_order(order), k).drop("_company_key")


def qualifies(max_years: int) -> Column:
    years = F.col("required_years_experience")
    return F.col("remote") & F.col("has_stack_overlap") & (years.isNull() | (years <= max_years))


def recommendations(
    ranked: DataFrame, max_years: int, min_stars: int, top_n: int, order: Sequence[str] = ARRIVAL
) -> DataFrame:
    """Top N of the new rows with enough stars that qualify."""
    return (
        ranked.filter(F.col("is_new") & (F.col("rank_stars") >= min_stars) & qualifies(max_years))
        .orderBy(*rank_order(order))
        .limit(top_n)
    )


def not_recommended_reason(max_years: int) -> Column:
    years = F.col("required_years_experience")
    notes = F.concat_ws(
        "; ",
        F.when(years > max_years, above_text(years, max_years)),
        F.when(~F.col("remote"), F.lit("on-site / not remote")),
        F.when(~F.col("has_stack_overlap"), F.lit("no direct tech-stack overlap detected")),
    )
    return F.when(notes == "", F.lit("ranked below your top picks")).otherwise(notes)


def remainder(ranked: DataFrame, recommended: DataFrame) -> DataFrame:
    """New rows outside the recommended list.

    ``recommended`` is the output of a limit, so its size is bound by a setting and a broadcast
    is safe.
    """
    picked = F.broadcast(recommended.select("job_hash"))
    return ranked.filter("is_new").join(picked, "job_hash", "left_anti")


def worth_looking_at(
    ranked: DataFrame,
    recommended: DataFrame,
    max_years: int,
    limit: int,
    order: Sequence[str] = ARRIVAL,
) -> DataFrame:
    """Top M of the remainder; the reason shown says why a row was not recommended."""
    return (
        remainder(ranked, recommended)
        .orderBy(*rank_order(order))
        .limit(limit)
        .withColumn("rank_reason", not_recommended_reason(max_years))
    )
