"""Structured Streaming ingest: micro-batches are staged, and the trigger is merged as a whole."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.operators.identity import drop_applied, first_arrivals, mark_new
from rolesift.operators.upsert import upsert_postings
from rolesift.plans.daily import rank_scored, relevant_scored, score_items
from rolesift.plans.state import AppendTable, KeyedTable, drop_path, list_names, path_exists
from rolesift.schema import ARRIVAL, PAYLOAD_DDL
from rolesift.settings import Settings
from rolesift.sources import normalize


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in a checkpoint; streams into one table differ by it."""
    text = spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0]
    return json.loads(text)["id"].replace("-", "")


def _upserted(stored: DataFrame, ranked: DataFrame) -> DataFrame:
    first = "first_seen" if "first_seen" in ranked.columns else None
    return upsert_postings(stored, ranked, first_seen=first)


def _staged_batches(spark: SparkSession, staging: str, checkpoint: str) -> list[int]:
    """Batches that are written whole and that Spark counts as done.

    Spark keeps the newest entries of its commit log only, and commits in order, so the last one tells."""
    commits = [int(name) for name in list_names(spark, f"{checkpoint}/commits") if name.isdigit()]
    last = max(commits, default=-1)
    numbers = [int(name[1:]) for name in list_names(spark, staging)]
    return [n for n in numbers if n <= last and path_exists(spark, f"{_batch_path(staging, n)}/_SUCCESS")]


def _batch_path(staging: str, number: int) -> str:
    return f"{staging}/b{number:09d}"


def merge_stream(
    source: DataFrame,
    state: KeyedTable,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame],
    rank: Callable[[DataFrame, DataFrame], DataFrame],
) -> None:
    """Run all available input through ``prepare(batch)`` and upsert ``rank(prepared, state)``.

    A micro-batch only writes its prepared rows beside the checkpoint, under its number, so one that
    is replayed replaces itself. Whatever looks across rows, the cap per company above all, sees the
    rows of the whole trigger at once; the result does not depend on how files fall into batches.
    Seen hashes are kept in the state without a time limit; a watermarked dedupe would forget them.

    Every batch is merged exactly once. A merge takes the batches that are written whole and in Spark's own
    commit log, and its token names them: the query's id, the first and the last. Batches are merged in order,
    so those up to the last one that a token of this query names are merged, and only wait to be
    deleted. A batch that failed while it was written, or that Spark will do again, is left to its replay.
    A second stream into the same table, or a new checkpoint, has another query id.
    """
    spark, checkpoint = state.spark, checkpoint.rstrip("/")
    staging = f"{checkpoint}-staged"

    def finish() -> None:
        if not list_names(spark, staging):
            return
        query_id = _query_id(spark, checkpoint)
        state.recover()
        merged = [int(t.split("-")[2]) for t in state.tokens() if t.startswith(f"{query_id}-")]
        batches = _staged_batches(spark, staging, checkpoint)
        fresh = [n for n in batches if n > max(merged, default=-1)]
        if fresh:
            prepared = spark.read.option("mergeSchema", "false").parquet(*[_batch_path(staging, n) for n in fresh])
            token = f"{query_id}-{fresh[0]:09d}-{fresh[-1]:09d}"
            state.merge(lambda stored: _upserted(stored, rank(prepared, stored)), token, prepared)
        for n in batches:
            drop_path(spark, _batch_path(staging, n))

    def stage_batch(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(_batch_path(staging, batch_id))

    finish()
    query = (
        source.writeStream.foreachBatch(stage_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    finish()


def payload_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(PAYLOAD_DDL).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def ingest_payloads(
    source: DataFrame,
    state: KeyedTable,
    applied: AppendTable,
    checkpoint: str,
    settings: Settings,
) -> None:
    """Landed payloads to ranked, stored postings."""

    def prepare(batch: DataFrame) -> DataFrame:
        postings = normalize(batch, role_words=settings.roles.include, early=score_items(settings))
        return relevant_scored(postings, settings).withColumn("seen_at", F.col("fetched_at"))

    def rank(prepared: DataFrame, stored: DataFrame) -> DataFrame:
        # copies of a posting may come from several fetches, of which the first and the last count
        times = prepared.groupBy("job_hash").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("seen_at"))
        ranked = rank_scored(prepared, stored, applied.read(), settings)
        return ranked.drop("seen_at").join(times, "job_hash")

    merge_stream(source, state, checkpoint, prepare, rank)


def first_seen_only(
    batch: DataFrame, stored: DataFrame, applied: DataFrame, order: tuple[str, ...] = ARRIVAL
) -> DataFrame:
    """Dedupe of hashed rows within themselves and against everything stored."""
    return mark_new(drop_applied(first_arrivals(batch, order), applied), stored)
