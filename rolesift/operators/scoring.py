"""Relevance score, stars and reason of a posting as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions.text import (
    SPACE,
    blank_to_null,
    contained_words,
    contains_any,
    first_contained,
    how_many,
    listed,
    searchable_text,
)
from rolesift.settings import Profile, Roles

# Years-of-experience patterns (range first, then a single number), points and
# star thresholds.
YEARS_UNIT = r"(?:years?|yrs?|yoe)\b"
YEARS_RANGE = rf"(?iU)(\d+)[{SPACE}]*(?:-|to)[{SPACE}]*(\d+)[{SPACE}]*\+?[{SPACE}]*{YEARS_UNIT}"
YEARS_SINGLE = rf"(?iU)(\d+)[{SPACE}-]*\+?[{SPACE}]*{YEARS_UNIT}"
ROLE_POINTS = 40
KEYWORD_POINTS, KEYWORD_POINTS_MAX, KEYWORDS_SHOWN = 5, 25, 5
REMOTE_POINTS = {"strong": (15, "fully remote"), "soft": (8, "remote")}
COUNTRY_POINTS, REMOTE_ANYWHERE_POINTS = 10, 5
YEARS_UNKNOWN, YEARS_WITHIN, YEARS_ABOVE = 5, 10, 2
STARS = ((80, 5), (65, 4), (50, 3), (30, 2))
NO_REASON = "General AI/ML role match"


def years_required(text: Column) -> Column:
    """Lower bound of the first range anywhere, else the first single number; null if none.

    The cheap substring test keeps both patterns away from texts that cannot match.
    """
    lowered = F.lower(text)
    maybe = lowered.contains("yr") | lowered.contains("year") | lowered.contains("yoe")
    # A pattern that does not match extracts a blank, which casts to null.
    found = F.coalesce(
        F.regexp_extract(text, YEARS_RANGE, 1).try_cast("int"),
        F.regexp_extract(text, YEARS_SINGLE, 1).try_cast("int"),
    )
    return F.when(maybe, found)


def years_points(required: Column, max_years: int) -> Column:
    return (
        F.when(required.isNull(), YEARS_UNKNOWN)
        .when(required <= max_years, YEARS_WITHIN)
        .otherwise(YEARS_ABOVE)
    )


def above_text(required: Column, max_years: int) -> Column:
    return F.concat(
        F.lit("needs ~"),
        required.cast("string"),
        F.lit(f"+ yrs experience (above your {max_years}-yr preference)"),
    )


def years_reason(required: Column, max_years: int) -> Column:
    within = F.concat(
        F.lit("needs ~"),
        required.cast("string"),
        F.lit(f" yrs experience (within your {max_years}-yr preference)"),
    )
    return F.when(required <= max_years, within).when(
        required > max_years, above_text(required, max_years)
    )


def remote_points(remote: Column, preference: str) -> Column:
    points, _ = REMOTE_POINTS.get(preference, (0, None))
    return F.when(remote, points).otherwise(0)


def remote_reason(remote: Column, preference: str) -> Column:
    _, reason = REMOTE_POINTS.get(preference, (0, None))
    return F.when(remote, F.lit(reason).cast("string"))


def stars(score: Column) -> Column:
    rating = None
    for floor, value in STARS:
        rating = F.when(score >= floor, value) if rating is None else rating.when(score >= floor, value)
    return rating.otherwise(1)


def score_postings(postings: DataFrame, profile: Profile, roles: Roles) -> DataFrame:
    """Adds rank_score, rank_stars, rank_reason, required_years_experience, has_stack_overlap.

    The intermediate columns are separate projections so that each text is searched once.
    """
    title, location, remote = F.col("title"), F.col("location"), F.col("remote")
    base = postings.withColumns(
        {
            "_text": searchable_text(title, location, F.col("description")),
            "_role": first_contained(F.lower(title), roles.include),
        }
    )
    found = base.withColumns(
        {
            "_words": contained_words(F.col("_text"), profile.keywords),
            "required_years_experience": years_required(F.col("_text")),
            "_fits": contains_any(F.lower(location), profile.countries),
        }
    )
    found = found.withColumns({"_hits": how_many(F.col("_words")), "_shown": listed(F.col("_words"), KEYWORDS_SHOWN)})
    years = F.col("required_years_experience")
    score = (
        F.when(F.col("_role").isNotNull(), ROLE_POINTS).otherwise(0)
        + F.least(F.lit(KEYWORD_POINTS_MAX), F.col("_hits") * KEYWORD_POINTS)
        + remote_points(remote, profile.remote_preference)
        + F.when(F.col("_fits"), COUNTRY_POINTS).when(remote, REMOTE_ANYWHERE_POINTS).otherwise(0)
        + years_points(years, profile.max_years)
    ).cast("double")
    reason = F.concat_ws(
        "; ",
        F.when(
            F.col("_role").isNotNull(), F.concat(F.lit('title matches "'), F.col("_role"), F.lit('"'))
        ),
        F.when(F.col("_hits") > 0, F.concat(F.lit("stack overlap: "), F.col("_shown"))),
        remote_reason(remote, profile.remote_preference),
        F.when(F.col("_fits"), F.concat(F.lit("location fits ("), location, F.lit(")"))),
        years_reason(years, profile.max_years),
    )
    return (
        found.withColumns(
            {
                "rank_score": score,
                "has_stack_overlap": F.col("_hits") > 0,
                "rank_reason": F.coalesce(blank_to_null(reason), F.lit(NO_REASON)),
            }
        )
        .withColumn("rank_stars", stars(F.col("rank_score")))
        .drop("_text", "_role", "_words", "_hits", "_shown", "_fits")
    )
