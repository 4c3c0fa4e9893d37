"""Resolve company names to live boards by candidate identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions.text import SPACE, strip_or_blank, text_or_blank
from rolesift.operators.topk import first_k

# Platforms a sheet may state, words dropped from slugs, affixes tried on slugs.
GUESSABLE = ("greenhouse", "lever", "ashby", "workday", "workable", "smartrecruiters")
DROP_WORDS = (
    "ai",
    "labs",
    "inc",
    "technologies",
    "technology",
    "software",
    "systems",
    "india",
    "tech",
    "analytics",
    "solutions",
    "co",
)
CAREER_URL = {
    "greenhouse": "https://boards.greenhouse.io/",
    "lever": "https://jobs.lever.co/",
    "ashby": "https://jobs.ashbyhq.com/",
    "workable": "https://apply.workable.com/",
    "smartrecruiters": "https://careers.smartrecruiters.com/",
    "workday": "https://",
}
NOT_FOUND = "no live-verifiable identifier found"
RETRY_MARK = "no live-verifiable identifier"
UNSUPPORTED = "unsupported ATS: "


def stated_providers(ats_text: Column) -> Column:
    """Supported platforms named in free text, in the fixed order."""
    lowered = F.lower(strip_or_blank(ats_text))
    return F.filter(F.array(*[F.lit(p) for p in GUESSABLE]), lambda p: F.contains(lowered, p))


def slug_rows(rows: DataFrame, name: str) -> DataFrame:
    """One row per identifier a company might use, with its place: ordered, no repeats.

    Words and slugs are columns of their own, so that each is computed once and not again inside
    every variant. The variants are exploded as an expression: for a plain column Spark adds a
    filter on its size, which would compute all of it a second time, inlined.
    """
    lowered = F.replace(F.lower(name), F.lit("&"), F.lit("and"))
    bare = F.regexp_replace(lowered, rf"(?U)[^a-z0-9{SPACE}-]", "")
    words, kept, whole = F.col("_words"), F.col("_kept"), F.col("_whole")
    hyphen, trimmed = F.col("_hyphen"), F.col("_trimmed")
    two, trims = F.size(words) >= 2, F.size(kept) > 0

    def around(prefix: str, slug: Column, suffix: str) -> Column:
        return F.concat(F.lit(prefix), slug, F.lit(suffix))

    split = rows.withColumn(
        "_words", F.filter(F.split(bare, rf"(?U)[{SPACE}]+"), lambda w: w != "")
    ).withColumns(
        {
            "_kept": F.filter(words, lambda w: ~w.isin(*DROP_WORDS)),
            "_whole": F.array_join(words, ""),
            "_hyphen": F.array_join(words, "-"),
        }
    )
    joined = split.withColumn("_trimmed", F.when(trims, F.array_join(kept, "")).otherwise(whole))
    variants = F.array(
        whole,
        hyphen,
        trimmed,
        F.when(trims, F.array_join(kept, "-")).otherwise(hyphen),
        F.coalesce(F.get(words, F.lit(0)), whole),
        F.when(two, F.array_join(F.slice(words, 1, 2), "")).otherwise(whole),
        F.when(two, F.array_join(F.slice(words, 1, 2), "-")).otherwise(hyphen),
        around("", whole, "ai"),
        around("", trimmed, "ai"),
        around("get", whole, ""),
        around("get", trimmed, ""),
        around("", whole, "hq"),
        around("try", whole, ""),
        around("", whole, "inc"),
        around("", whole, "labs"),
        around("", whole, "app"),
        around("the", whole, ""),
        around("join", whole, ""),
    )
    distinct = F.array_distinct(F.filter(variants, lambda v: v != ""))
    return joined.select(*rows.columns, F.posexplode(distinct).alias("place", "identifier"))


def career_url(provider: Column, identifier: Column) -> Column:
    prefix = F.lit(None).cast("string")
    for name, value in CAREER_URL.items():
        prefix = F.when(provider == name, F.lit(value)).otherwise(prefix)
    return F.coalesce(F.concat(prefix, identifier), F.lit(""))


def seed_identifiers(companies: DataFrame) -> DataFrame:
    """(name_key, provider, identifier, seed_pos) from an earlier company list."""
    rows = companies.select(
        strip_or_blank(F.col("name")).alias("name"),
        strip_or_blank(F.col("ats_provider")).alias("provider"),
        strip_or_blank(F.col("ats_identifier")).alias("identifier"),
        F.col("file_pos").alias("seed_pos"),
    ).filter((F.col("name") != "") & (F.col("provider") != "") & (F.col("identifier") != ""))
    keyed = rows.select(F.lower("name").alias("name_key"), "provider", "identifier", "seed_pos")
    # a list that repeats a company must not multiply its candidates
    return keyed.groupBy("name_key", "provider", "identifier").agg(F.min("seed_pos").alias("seed_pos"))


def tasks_of(sheet: DataFrame, seeds: DataFrame) -> DataFrame:
    """The sheet with ``providers`` and ``attempt``: stated a platform, or has a seed."""
    seeded = seeds.select("name_key").distinct().withColumn("_seeded", F.lit(True))
    return (
        sheet.withColumns(
            {"providers": stated_providers(F.col("ats_text")), "name_key": F.lower("company")}
        )
        .join(seeded, "name_key", "left")
        .withColumn("attempt", (F.size("providers") > 0) | F.col("_seeded").isNotNull())
        .drop("_seeded")
    )


def candidates(tasks: DataFrame, seeds: DataFrame) -> DataFrame:
    """(row_no, company, provider, identifier, position): seeds first, then guesses.

    ``position`` orders the candidates of one task: kind, then place in the seed list or platform
    and variant.
    """
    tried = tasks.filter("attempt")
    reused = tried.join(seeds, "name_key").select(
        "row_no",
        "company",
        "provider",
        "identifier",
        F.struct(
            F.lit(0).alias("kind"), F.col("seed_pos").alias("major"), F.lit(0).alias("minor")
        ).alias("position"),
    )
    guessed = (
        slug_rows(tried.select("row_no", "company", "providers"), "company")
        .select("*", F.posexplode("providers").alias("_p", "provider"))
        .filter(F.col("provider") != "workday")  # host and site cannot be guessed
        .select(
            "row_no",
            "company",
            "provider",
            "identifier",
            F.struct(
                F.lit(1).alias("kind"), F.col("_p").cast("bigint").alias("major"), F.col("place").alias("minor")
            ).alias("position"),
        )
    )
    return reused.unionByName(guessed)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    salts: int = 64,
    share: int = 1000,
    least: int = 100_000,
) -> DataFrame:
    """Inner join where ``left`` may be hot on a key and ``right`` has each key once.

    The keys of ``left`` are counted first. A key is hot if it has more than one in ``share`` of all rows
    and more than ``least``; there are fewer than ``share`` such keys whatever the size, so their list
    is broadcast. Rows of a hot key go to ``salts`` tasks, picked by the columns in ``spread_by``,
    and its row of the right side is repeated that often. All other rows are left as they are.
    """
    counts = left.groupBy(*on).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows").alias("_total")).scalar()
    bar = F.greatest(total / F.lit(share), F.lit(float(least)))
    hot = F.broadcast(counts.filter(F.col("_rows") > bar).select(*on, F.lit(salts).alias("_salts")))
    ways = F.coalesce(F.col("_salts"), F.lit(1))
    salted = left.join(hot, list(on), "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), ways).cast("int"))
    repeated = right.join(hot, list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), ways - 1)))
    return salted.drop("_salts").join(repeated.drop("_salts"), [*on, "_salt"]).drop("_salt")


def live_boards(boards: DataFrame) -> DataFrame:
    """Boards that answered with a job count, once per (provider, identifier)."""
    return (
        boards.filter(F.col("job_count").isNotNull())
        .groupBy("provider", "identifier")
        .agg(F.max("job_count").alias("job_count"))
    )


def first_live(candidate_rows: DataFrame, boards: DataFrame) -> DataFrame:
    """The candidate with the smallest position per task that is a live board.

    Common words make some guesses hot (many companies may share one slug), hence the spread.
    """
    alive = spread_join(candidate_rows, live_boards(boards), ["provider", "identifier"], ["row_no"])
    return first_k(alive, ["row_no"], ["position"], 1)


def resolve(sheet: DataFrame, seeds: DataFrame, boards: DataFrame) -> DataFrame:
    """All sheet rows with provider, identifier, job_count or the reason why not.

    What is tried depends on the name and the stated platforms alone, so each such pair is resolved
    once, under the first of its rows, and the outcome goes back to all of them.
    """
    tasks = tasks_of(sheet, seeds)
    pair = ["company", "providers"]
    once = tasks.filter("attempt").groupBy(*pair, "name_key", "attempt").agg(F.min("row_no").alias("row_no"))
    hits = first_live(candidates(once, seeds), boards).select(
        "row_no", "provider", "identifier", "job_count"
    )
    hits = once.select("row_no", *pair).join(hits, "row_no").drop("row_no")
    blank = F.when(F.col("ats_text") == "", F.lit("(blank)")).otherwise(F.col("ats_text"))
    reason = (
        F.when(F.col("provider").isNotNull(), F.lit(None))
        .when(F.col("attempt"), F.lit(NOT_FOUND))
        .otherwise(F.concat(F.lit(UNSUPPORTED), blank))
    )
    return tasks.join(hits, pair, "left").select(
        "row_no", "company", "provider", "identifier", "job_count", "attempt", reason.alias("reason")
    )


def resolved_rows(outcome: DataFrame) -> DataFrame:
    """Rows of the new company list."""
    return outcome.filter(F.col("provider").isNotNull()).select(
        F.col("company"),
        career_url(F.col("provider"), F.col("identifier")).alias("career_page"),
        F.col("provider").alias("ats_provider"),
        F.col("identifier").alias("ats_identifier"),
        "job_count",
    )


def resolved_list(outcome: DataFrame) -> DataFrame:
    """Rows of the new company list, by name."""
    return resolved_rows(outcome).orderBy("company", "ats_provider", "ats_identifier")


def unresolved_list(outcome: DataFrame) -> DataFrame:
    """Tried rows first, then unsupported ones, each by name or sheet order."""
    return (
        outcome.filter(F.col("reason").isNotNull())
        .orderBy(
            (~F.col("attempt")).cast("int"),
            F.when(F.col("attempt"), F.col("company")),
            "row_no",
        )
        .select("company", "reason")
    )


def resolve_summary(outcome: DataFrame) -> DataFrame:
    return outcome.agg(
        F.count_if(F.col("provider").isNotNull()).alias("resolved"),
        F.count_if("attempt").alias("attempted"),
        F.coalesce(F.sum("job_count"), F.lit(0)).cast("bigint").alias("live_jobs"),
        F.count_if(~F.col("attempt")).alias("skipped"),
    )


def retry_rows(sheet: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Sheet rows whose earlier outcome was a failed lookup."""
    again = unresolved.filter(F.contains("reason", F.lit(RETRY_MARK))).select("company").distinct()
    return sheet.join(again, "company", "left_semi")


def merge_retry(
    resolved: DataFrame, unresolved: DataFrame, retried: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Earlier resolved rows stay (with 0 jobs, as they were not counted again), newly resolved
    ones join them; earlier unsupported rows stay in the list of reasons."""
    kept = resolved.select(
        "company", "career_page", "ats_provider", "ats_identifier", F.lit(0).alias("job_count")
    )
    new_resolved = kept.unionByName(resolved_rows(retried)).orderBy("company", "ats_provider", "ats_identifier")
    failed = retried.filter(F.col("attempt") & F.col("reason").isNotNull()).select("company", "reason")
    stays = unresolved.filter(F.startswith("reason", F.lit(UNSUPPORTED.rstrip()))).select("company", "reason")
    return new_resolved, failed.unionByName(stays)


def payload_job_count(provider: Column, body: Column) -> Column:
    """Items of a board response; null when the body has the wrong shape.

    An empty list proves nothing at smartrecruiters, which answers so for any name.
    """

    def size_of(path: str) -> Column:
        return F.array_size(F.from_json(body, f"{path} array<string>")[path])

    as_list = F.when(F.ltrim(body).startswith("["), F.array_size(F.from_json(body, "array<string>")))
    content = size_of("content")
    return (
        F.when(provider == "lever", as_list)
        .when(provider.isin("greenhouse", "ashby", "workable"), size_of("jobs"))
        .when(provider == "smartrecruiters", F.when(content > 0, content))
        .when(provider == "workday", size_of("jobPostings"))
    )


def boards_from_payloads(payloads: DataFrame) -> DataFrame:
    """The boards table of a landed payload table: job count per (provider, identifier)."""
    counted = payloads.filter(F.col("http_status") == 200).select(
        "provider",
        "identifier",
        payload_job_count(F.col("provider"), text_or_blank(F.col("body"))).alias("job_count"),
    )
    return counted.groupBy("provider", "identifier").agg(F.max("job_count").cast("int").alias("job_count"))
