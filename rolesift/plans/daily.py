"""The daily run: payloads to ranked postings, state, counters and report."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.operators.detection import page_digest, route_companies
from rolesift.operators.identity import dedupe_and_mark, with_hash
from rolesift.operators.relevance import is_relevant, relevant_postings
from rolesift.operators.reporting import (
    OTHER,
    TOP,
    company_counters,
    digest_lines,
    one_row,
    posting_counters,
    report_items,
    source_checks,
    source_counters,
)
from rolesift.operators.scoring import score_postings
from rolesift.operators.selection import cap_per_company, recommendations, worth_looking_at
from rolesift.operators.upsert import record_checks, upsert_companies, upsert_postings
from rolesift.plans.state import AppendTable, KeyedTable, drop_path, scratch_path, stage
from rolesift.schema import APPLIED_DDL, ARRIVAL, COMPANY_DDL, POSTING_STATE_DDL, REPORT_DDL
from rolesift.settings import Settings
from rolesift.sources import normalize
from rolesift.sources.companies import first_companies
from rolesift.sources.normalize import Step
from rolesift.sources.pages import role_anchors
from rolesift.sources.registry import board_names


def rank_postings(
    postings: DataFrame,
    known: DataFrame,
    applied: DataFrame,
    settings: Settings,
    order: tuple[str, ...] = ARRIVAL,
) -> DataFrame:
    """Filter, score, dedupe, mark, cap."""
    return rank_scored(scored_postings(postings, settings), known, applied, settings, order)


def scored_postings(postings: DataFrame, settings: Settings) -> DataFrame:
    """Relevant postings with score and hash, without descriptions.

    Scoring looks at one row only, so it comes ahead of the dedupe: descriptions, the bulk of the
    bytes, end in the scan stage and never enter a shuffle.
    """
    scored = score_postings(relevant_postings(postings, settings.roles), settings.profile, settings.roles)
    return with_hash(scored.drop("description"))


def score_items(settings: Settings) -> Step:
    """The same scores on items, as the early step of ``normalize``: descriptions end ahead of its joins
    and claims too. Items of no wanted role wait for a claim to be settled, but are not searched."""

    def early(items: DataFrame) -> DataFrame:
        wanted = F.when(is_relevant(F.col("title"), settings.roles), F.col("description")).otherwise("")
        scored = score_postings(items.withColumn("description", wanted), settings.profile, settings.roles)
        return scored.drop("description")

    return early


def relevant_scored(postings: DataFrame, settings: Settings) -> DataFrame:
    """``scored_postings`` of postings that were scored as items."""
    return with_hash(relevant_postings(postings, settings.roles))


def rank_scored(
    scored: DataFrame,
    known: DataFrame,
    applied: DataFrame,
    settings: Settings,
    order: tuple[str, ...] = ARRIVAL,
) -> DataFrame:
    """Dedupe, mark and cap all scored postings of a run together."""
    marked = dedupe_and_mark(scored, known, applied, order)
    return cap_per_company(marked, settings.limits.per_company, order)


def company_postings(
    payloads: DataFrame,
    pages: DataFrame,
    routes: DataFrame,
    settings: Settings,
    early: Step | None = None,
) -> DataFrame:
    """Postings of all routed companies: boards by (provider, identifier), pages by name.

    Neither bodies nor pages go through a join; descriptions do unless ``early`` drops them."""
    names = board_names()
    boards = routes.filter(F.col("ats_provider").isin(names)).select(
        F.col("ats_provider").alias("provider"),
        F.col("ats_identifier").alias("identifier"),
        F.col("name").alias("company_name"),
        F.col("priority").alias("company_priority"),
    )
    answers = payloads.filter(F.col("provider").isin(names)).drop("company_name")
    from_boards = normalize(answers, providers=names, early=early, routes=boards)

    open_pages = routes.filter(F.col("ats_provider") == "generic").select(
        F.col("name").alias("company_name"),
        F.col("priority").alias("company_priority"),
        F.col("career_page").alias("identifier"),
        "page_digest",
    )
    # a page is reduced to its role anchors in the scan, so that no page goes through the join
    reduced = pages.filter(F.col("http_status") == 200).select(
        "company_name",
        "http_status",
        role_anchors(F.col("html"), settings.roles.include).alias("body"),
        page_digest().alias("page_digest"),
    )
    page_rows = reduced.join(open_pages, ["company_name", "page_digest"]).drop("page_digest")
    from_pages = normalize(
        page_rows.withColumn("provider", F.lit("generic")),
        providers=["generic"],
        role_words=settings.roles.include,
        early=early,
    )
    return from_boards.unionByName(from_pages)


def feed_postings(
    payloads: DataFrame, since: Column | None, settings: Settings, early: Step | None = None
) -> DataFrame:
    return normalize(payloads, providers=settings.feeds, since=since, early=early)


def window_start(reports: DataFrame, now: Column, lookback_days: int) -> Column:
    """Start of the last run; before the first run, some days back. A one-row subquery."""
    last = reports.agg(F.max("run_started_at").alias("_last")).scalar()
    return F.coalesce(last, now - F.make_dt_interval(days=F.lit(lookback_days)))


@dataclass(frozen=True)
class RunResult:
    """Results of a run; they read staged tables until ``release`` drops those."""

    ranked: DataFrame
    recommended: DataFrame
    others: DataFrame
    metrics: DataFrame
    items: DataFrame
    digest: DataFrame
    scratch: str

    def release(self) -> None:
        drop_path(self.ranked.sparkSession, self.scratch)


class DailyRun:
    """State tables under one root and the run that reads and advances them.

    One run at a time may write under a root. A run that broke off does not keep the next one waiting; done
    again, later, it finishes what it had not done and leaves alone what newer runs have written."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings) -> None:
        root = root.rstrip("/")
        self.spark, self.settings, self.root = spark, settings, root
        self.companies = KeyedTable(spark, f"{root}/companies", COMPANY_DDL, "name", buckets=1)
        self.postings = KeyedTable(spark, f"{root}/postings", f"{POSTING_STATE_DDL}, first_run_at timestamp", "job_hash")
        self.applied = AppendTable(spark, f"{root}/applied", APPLIED_DDL)
        self.reports = AppendTable(spark, f"{root}/daily_reports", REPORT_DDL)

    def run(
        self,
        companies: DataFrame,
        pages: DataFrame,
        payloads: DataFrame,
        started_at: datetime,
        company_limit: int | None = None,
    ) -> RunResult:
        """One run. ``started_at`` names the run: doing it again with the same inputs changes
        nothing that the first time wrote, whatever runs came in between. New is what no earlier run has stored,
        so a posting is new in the run that stored it, however often that is done again."""
        s = self.settings
        token = started_at.strftime("%Y%m%dT%H%M%S.%f")
        start = F.lit(started_at)
        scratch = scratch_path(self.spark, f"run-{token}")
        listed = first_companies(companies, company_limit)

        routes = stage(route_companies(listed, pages), "routes", scratch)
        earlier = self.reports.read().filter(F.col("run_started_at") < start)
        since = window_start(earlier, start, s.limits.first_run_lookback_days)
        early = score_items(s)
        postings = company_postings(payloads, pages, routes, s, early).unionByName(
            feed_postings(payloads, since, s, early)
        )
        for table in (self.companies, self.postings):
            table.recover()
        stored = self.postings.read().filter(F.col("first_run_at") < start)
        ranked = stage(
            rank_scored(relevant_scored(postings, s), stored, self.applied.read(), s).withColumn(
                "seen_at", F.coalesce("fetched_at", start)
            ),
            "ranked",
            scratch,
        )

        recommended = recommendations(
            ranked, s.profile.max_years, s.limits.min_stars, s.limits.top_n
        )
        others = worth_looking_at(ranked, recommended, s.profile.max_years, s.limits.worth_looking)
        items = stage(
            report_items(TOP, recommended).unionByName(report_items(OTHER, others)),
            "report",
            scratch,
        )
        metrics = self._metrics(ranked, routes, payloads, started_at)

        checks = routes.withColumn("last_checked_at", start)
        if max(self.companies.tokens(), default="") < token:  # lists and checks of newer runs stay
            self.companies.merge(lambda now: record_checks(upsert_companies(now, listed), checks), token)
        batch = ranked.withColumn("first_run_at", start)
        self.postings.merge(lambda now: upsert_postings(now, batch), token, ranked)
        metrics = stage(metrics, "metrics", scratch)
        digest = digest_lines(metrics, items)
        if not self.reports.has(token):
            same_day = self.reports.read().filter(F.col("run_date") == F.lit(started_at.date()))
            if same_day.filter(F.col("run_started_at") > start).isEmpty():
                self._publish(items, digest, started_at)
            self.reports.append(metrics, token)  # the run is done with this
        return RunResult(ranked, recommended, others, metrics, items, digest, scratch)

    def report_path(self, started_at: datetime) -> str:
        return f"{self.root}/reports/{started_at:%Y-%m-%d}"

    def _publish(self, items: DataFrame, digest: DataFrame, started_at: datetime) -> None:
        """Report rows and text; a later run of the same day replaces them. Their number is bound
        by two settings, so the text may go to one file."""
        path = self.report_path(started_at)
        items.write.mode("overwrite").parquet(f"{path}/items")
        lines = digest.repartition(1).sortWithinPartitions("part", "position").select("text")
        lines.write.mode("overwrite").text(f"{path}/digest")

    def _metrics(
        self, ranked: DataFrame, routes: DataFrame, payloads: DataFrame, started_at: datetime
    ) -> DataFrame:
        """One row with the counters of the run."""
        counters = one_row(
            [
                posting_counters(ranked),
                company_counters(routes),
                source_counters(source_checks(payloads, self.settings.feeds)),
            ]
        )
        return counters.withColumns(
            {
                "run_started_at": F.lit(started_at),
                "run_date": F.lit(started_at.date()),
                "report_path": F.lit(self.report_path(started_at)),
            }
        )
