"""Session settings the plans are tuned for; a caller's own session works as well."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "rolesift", master: str | None = None, **conf: object) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Split a hot join key at run time even where that costs one more shuffle downstream.
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()
