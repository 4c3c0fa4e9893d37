"""Role filter on titles. All tests are plain substrings, not bounded by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions.text import contains_any
from rolesift.settings import Roles


def is_excluded(title: Column, roles: Roles) -> Column:
    """Exclude words are stripped, so a padded ' hr ' also hits 'threat'."""
    return contains_any(F.lower(title), [w.strip() for w in roles.exclude])


def is_internship(title: Column, roles: Roles) -> Column:
    """Internship words are taken as given; 'intern' also hits 'international'."""
    return contains_any(F.lower(title), roles.internship_words)


def names_role(title: Column, roles: Roles) -> Column:
    return contains_any(F.lower(title), roles.include)


def is_relevant(title: Column, roles: Roles) -> Column:
    test = names_role(title, roles) & ~is_excluded(title, roles)
    return test if roles.include_internships else test & ~is_internship(title, roles)


def relevant_postings(postings: DataFrame, roles: Roles) -> DataFrame:
    return postings.filter(is_relevant(F.col("title"), roles))
