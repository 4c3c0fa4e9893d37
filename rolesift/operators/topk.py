"""First k rows per key without gathering a hot key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Above this k, or the session's limit for cutting below the shuffle, salted keys are cut first.
_DIRECT_K = 100
_PUSHED_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
_SALTS = 64


def first_k(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], k: int
) -> DataFrame:
    """Keep the first ``k`` rows of each key in the given (total) order.

    A row_number filter lets Spark push the limit below the shuffle, so each map task sends at
    most k rows of a key (up to spark.sql.optimizer.windowGroupLimitThreshold). With a large k
    that still adds up over many tasks, so the same cut is made on salted keys first: the first k
    of a key are among the first k of each of its salts.
    """
    if k > min(_DIRECT_K, int(df.sparkSession.conf.get(_PUSHED_LIMIT))):
        salt = F.pmod(F.xxhash64(*order_columns(order)), F.lit(_SALTS))
        df = _ranked_cut(df.withColumn("_salt", salt), [*keys, "_salt"], order, k).drop("_salt")
    return _ranked_cut(df, keys, order, k)


def _ranked_cut(df, keys, order, k):
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= k).drop("_rank")


def order_columns(order: Sequence[str | Column]) -> list[str]:
    """Plain names among the order columns; the salt only needs some spread."""
    names = [o for o in order if isinstance(o, str)]
    if not names:
        raise ValueError("the order needs at least one plain column name to spread rows by")
    return names
