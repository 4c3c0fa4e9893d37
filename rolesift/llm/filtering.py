"""Apply the decisions of an operator to whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(taken: list[str], stem: str) -> str:
    """A column name like ``stem`` that is not taken, whatever the case."""
    lower = {name.lower() for name in taken}
    while stem.lower() in lower:
        stem += "_"
    return stem


def text_digest(text: Column) -> Column:
    """xxhash64 of the text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _sides(
    docs: DataFrame, judged: DataFrame, id_col: str, digest: Column, digest_col: str
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the same two key columns: the id as text and the digest."""
    keys = [free_name(docs.columns, "__id_key"), free_name(docs.columns, "__text_key")]
    id_key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    left = docs.withColumns(dict(zip(keys, (id_key, digest))))
    right = judged.select(id_key.alias(keys[0]), F.col(digest_col).alias(keys[1]))
    return left, right, keys


def keep_one(docs: DataFrame, kept: DataFrame, id_col: str, digest: Column, digest_col: str) -> DataFrame:
    """The rows of ``docs`` whose id and digest are in ``kept``, one of each.

    Rows join by id first, so a text that very many rows have does not gather in one task."""
    left, right, keys = _sides(docs, kept, id_col, digest, digest_col)
    return left.join(right, keys, "left_semi").dropDuplicates(keys).drop(*keys)


def drop_all(docs: DataFrame, dropped: DataFrame, id_col: str, digest: Column, digest_col: str) -> DataFrame:
    """The rows of ``docs`` whose id and digest are not in ``dropped``; repeated rows stay."""
    left, right, keys = _sides(docs, dropped, id_col, digest, digest_col)
    return left.join(right, keys, "left_anti").drop(*keys)
