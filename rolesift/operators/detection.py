"""Which board platform stands behind a page, and how a company is fetched."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesift.functions.text import compact_slug, strip_or_blank, text_or_blank
from rolesift.operators.topk import first_k
from rolesift.sources.registry import board_names


@dataclass(frozen=True)
class Rule:
    """One signature: ``needle`` is a literal part of every match, tested first because a
    substring search costs far less than the pattern."""

    provider: str
    needle: str
    pattern: str
    identifier: str = "$1"
    blocked: tuple[str, ...] = ()


# Platform signatures in order of preference.
_NOT_GREENHOUSE = ("embed", "job_board", "job-boards")
_NOT_TENANT = ("www", "app", "api")
BOARD_RULES = (
    Rule(
        "greenhouse",
        "greenhouse.io/embed/job_board",
        r"greenhouse\.io/embed/job_board(?:/js)?\?for=([a-zA-Z0-9_%-]+)",
        blocked=_NOT_GREENHOUSE,
    ),
    Rule(
        "greenhouse",
        "boards.greenhouse.io/",
        r"(?:boards|job-boards)\.greenhouse\.io/([a-zA-Z0-9_%-]+)",
        blocked=_NOT_GREENHOUSE,
    ),
    Rule(
        "greenhouse",
        "boards-api.greenhouse.io/v1/boards/",
        r"boards-api\.greenhouse\.io/v1/boards/([a-zA-Z0-9_%-]+)",
        blocked=_NOT_GREENHOUSE,
    ),
    Rule(
        "greenhouse",
        "my.greenhouse.io/users/sign_in?job_board=",
        r"my\.greenhouse\.io/users/sign_in\?job_board=([a-zA-Z0-9_%-]+)",
        blocked=_NOT_GREENHOUSE,
    ),
    Rule("lever", "jobs.lever.co/", r"jobs\.lever\.co/([a-zA-Z0-9_%-]+)"),
    Rule("ashby", "jobs.ashbyhq.com/", r"jobs\.ashbyhq\.com/([a-zA-Z0-9_%-]+)"),
    Rule(
        "smartrecruiters",
        "careers.smartrecruiters.com/",
        r"careers\.smartrecruiters\.com/([a-zA-Z0-9_%-]+)",
    ),
    Rule(
        "workday",
        ".myworkdayjobs.com/",
        r"([a-zA-Z0-9_-]+)\.(wd\d+)\.myworkdayjobs\.com/(?:[a-z]{2}-[A-Z]{2}/)?([a-zA-Z0-9_-]+)",
        identifier="$1.$2.myworkdayjobs.com/$3",
    ),
    Rule("teamtailor", ".teamtailor.com", r"([a-zA-Z0-9_-]+)\.teamtailor\.com", blocked=_NOT_TENANT),
    Rule("bamboohr", ".bamboohr.com", r"([a-zA-Z0-9_-]+)\.bamboohr\.com", blocked=_NOT_TENANT),
    Rule("workable", "apply.workable.com/", r"apply\.workable\.com/([a-zA-Z0-9_%-]+)"),
    Rule(
        "recruitee",
        ".recruitee.com",
        r"([a-zA-Z0-9_-]+)\.recruitee\.com",
        blocked=(*_NOT_TENANT, "careers-analytics", "docs", "support"),
    ),
    Rule(
        "oracle_recruiting",
        'data-apibaseurl="https://',
        r'data-apibaseurl="https://([a-zA-Z0-9.\-]+)(?::\d+)?"[^>]*data-sitenumber="([A-Za-z0-9_]+)"',
        identifier="$1|$2",
    ),
)

# Links worth following on a career page, and links that are not.
JOBS_LINK = r"(?i)/(jobs|careers?/(jobs|search|open)|positions|openings|opportunit|search-?jobs|hiring)"
SKIP_LINK = (
    r"(?i)(blog|about|contact|press|investor|privacy|legal|help|support|community|"
    r"academy|docs|facebook|twitter|linkedin|instagram|youtube|mailto:|tel:)"
)

# The mark of pages that embed board data without naming the board.
HEADLESS_PROVIDER = "greenhouse"
HEADLESS_SIGNAL = r'"greenhouseId"\s*:'


def _rule_hit(rule: Rule, text: Column) -> Column:
    """struct<provider,identifier> if the first match of a rule in a text names a tenant; else null."""
    whole = F.regexp_extract(text, rule.pattern, 0)
    # The matched piece matches again as a whole, so the groups are cut out of it alone.
    identifier = F.regexp_replace(whole, rule.pattern, rule.identifier)
    allowed = F.contains(text, F.lit(rule.needle)) & (identifier != "")
    if rule.blocked:
        allowed = allowed & ~identifier.isin(*rule.blocked)
    return F.when(allowed, F.struct(F.lit(rule.provider).alias("provider"), identifier.alias("identifier")))


def detect_board(html: Column, final_url: Column, rules: Sequence[Rule] = BOARD_RULES) -> Column:
    """struct<provider,identifier> of the first rule that matches, URL before page; else null.

    Of each text only the first match of a rule counts. The rules are a chain that ends at the first hit; their
    patterns are constants, so each is compiled once, and one runs only on texts that contain its needle.
    """
    url, page = text_or_blank(final_url), text_or_blank(html)
    return F.coalesce(*[_rule_hit(rule, text) for rule in rules for text in (url, page)])


def page_digest() -> Column:
    """What tells pages of one company apart."""
    return F.xxhash64("page_url", "final_url", "http_status", "error", "html")


def route_companies(
    companies: DataFrame, pages: DataFrame, rules: Sequence[Rule] = BOARD_RULES
) -> DataFrame:
    """(name, priority, career_page, ats_provider, ats_identifier, last_status, page_digest) of a run.

    A cached, supported board skips the page. Otherwise the page decides: error, detected board,
    or the generic reader. Pages of companies with a cached board are reduced like all others and find
    no company to join.

    One row per name: the last row of the list, and of several pages of a company the first by
    URL. ``page_digest`` tells which page that was; it is null where no page was looked at.
    """
    order = [F.col("file_pos").desc()] if "file_pos" in companies.columns else []
    rest = ("career_page", "priority", "ats_provider", "ats_identifier")
    companies = first_k(companies, ["name"], [*order, *rest], 1)
    supported = board_names()
    cached = F.col("ats_provider").isin(supported) & (strip_or_blank(F.col("ats_identifier")) != "")
    cached = F.coalesce(cached, F.lit(False))
    direct = companies.filter(cached).select(
        "name",
        "priority",
        "career_page",
        "ats_provider",
        "ats_identifier",
        F.lit("ok:cached").alias("last_status"),
        F.lit(None).cast("long").alias("page_digest"),
    )

    # Pages are wide: each is reduced to its outcome in the scan, and only outcomes are dealt out
    # by name. Keeping the wanted pages first would send all of them through that join.
    open_companies = companies.filter(~cached)
    failure = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error"))
        .when(F.col("http_status").isNull(), F.lit("error: not fetched"))
        .when(F.col("http_status") >= 400, F.concat(F.lit("error: HTTP "), F.col("http_status")))
    )
    outcomes = pages.select(
        F.col("company_name").alias("name"),
        "page_url",
        "final_url",
        page_digest().alias("page_digest"),
        F.coalesce(failure, F.lit("")).alias("_failure"),
        F.when(failure.isNull(), detect_board(F.col("html"), F.col("final_url"), rules)).alias("_board"),
    )
    outcomes = first_k(outcomes, ["name"], ["page_url", "final_url", "page_digest"], 1)
    judged = open_companies.join(outcomes, "name", "left").withColumn(
        "_failure", F.coalesce("_failure", F.lit("error: not fetched"))
    )
    hit = F.col("_board.provider").isin(supported)
    hit = F.coalesce(hit, F.lit(False))
    failed = F.col("_failure") != ""
    routed = judged.select(
        "name",
        "priority",
        "career_page",
        F.when(failed, F.lit(None))
        .when(hit, F.col("_board.provider"))
        .otherwise("generic")
        .alias("ats_provider"),
        F.when(hit, F.col("_board.identifier")).alias("ats_identifier"),
        F.when(failed, F.col("_failure"))
        .when(hit, F.lit("ok"))
        .otherwise("ok:generic")
        .alias("last_status"),
        "page_digest",
    )
    return direct.unionByName(routed)


def detection_results(pages: DataFrame, rules: Sequence[Rule] = BOARD_RULES) -> DataFrame:
    """(name, ats_provider, ats_identifier) per checked page; blanks on no match or failure."""
    ok = F.col("error").isNull() & (F.col("http_status") < 400)
    board = F.when(ok, detect_board(F.col("html"), F.col("final_url"), rules))
    return pages.select(F.col("company_name").alias("name"), board.alias("_board")).select(
        "name",
        text_or_blank(F.col("_board.provider")).alias("ats_provider"),
        text_or_blank(F.col("_board.identifier")).alias("ats_identifier"),
    )


def detect_along_links(
    pages: DataFrame, boards: DataFrame, rules: Sequence[Rule] = BOARD_RULES
) -> DataFrame:
    """(name, ats_provider, ats_identifier, note): a closer look at companies without a board.

    ``pages`` holds, per company, the landing page and the pages its job links led to, numbered by
    ``page_no``; the first page with a board counts. Failing that, a page that embeds board data
    without naming the board gives a guess, the compact company name, which is taken only if
    ``boards`` has it with open jobs.
    """
    ok = F.col("error").isNull() & (F.col("http_status") < 400)
    seen = pages.filter(ok).select(
        F.col("company_name").alias("name"),
        "page_no",
        "final_url",
        detect_board(F.col("html"), F.col("final_url"), rules).alias("_board"),
        F.col("html").rlike(HEADLESS_SIGNAL).alias("_signal"),
    )
    hit = F.struct("page_no", "final_url", F.col("_board.provider"), F.col("_board.identifier"))
    per_company = (
        seen.groupBy("name")
        .agg(
            F.min(F.when(F.col("_board").isNotNull(), hit)).alias("_hit"),
            F.bool_or(F.coalesce("_signal", F.lit(False))).alias("_signal"),
        )
        .filter(F.col("_hit").isNotNull() | F.col("_signal"))
        .withColumn("_guess", F.when(F.col("_hit").isNull(), compact_slug(F.col("name"))))
    )
    open_boards = (
        boards.filter((F.col("provider") == HEADLESS_PROVIDER) & (F.col("job_count") > 0))
        .select(F.col("identifier").alias("_guess"), F.lit(True).alias("_open"))
        .distinct()
    )
    guessed = F.col("_hit").isNull()
    where = F.when(F.col("_hit.page_no") == 0, "found on landing page").otherwise(
        F.concat(F.lit("found after following link "), "_hit.final_url")
    )
    return (
        per_company.join(open_boards, "_guess", "left")
        .filter(~guessed | (F.col("_open") & (F.col("_guess") != "")))
        .select(
            "name",
            F.when(guessed, HEADLESS_PROVIDER).otherwise(F.col("_hit.provider")).alias("ats_provider"),
            F.when(guessed, F.col("_guess")).otherwise(F.col("_hit.identifier")).alias("ats_identifier"),
            F.when(guessed, "found via verified guess").otherwise(where).alias("note"),
        )
    )


def write_back_detection(companies: DataFrame, results: DataFrame) -> DataFrame:
    """ATS columns of the checked companies; a blank result overwrites a cached value.

    Of several results of one name one that found a board counts."""
    blank = text_or_blank(F.col("ats_provider")) == ""
    results = first_k(results, ["name"], [blank, "ats_provider", "ats_identifier"], 1)
    found = results.select("name", F.struct("ats_provider", "ats_identifier").alias("_found"))
    joined = companies.join(found, "name", "left")
    return joined.select(
        *[
            F.when(F.col("_found").isNotNull(), F.col(f"_found.{c}")).otherwise(F.col(c)).alias(c)
            if c in ("ats_provider", "ats_identifier")
            else F.col(c)
            for c in companies.columns
        ]
    )


def missing_board(companies: DataFrame) -> DataFrame:
    return companies.filter(text_or_blank(F.col("ats_provider")) == "")


def job_links(
    links: DataFrame,
    page_key: Sequence[str],
    page_url: str = "page_url",
    per_page: int = 2,
    wanted_pattern: str = JOBS_LINK,
    skip_pattern: str = SKIP_LINK,
) -> DataFrame:
    """First jobs-like links of each page: no blanks, no self links, no repeats, no skip words.

    ``links`` has page_key, page_url, href, item_no (document order).
    """
    wanted = links.filter(
        (F.col("href") != "")
        & (F.col("href") != F.col(page_url))
        & ~F.col("href").rlike(skip_pattern)
        & F.col("href").rlike(wanted_pattern)
    )
    # both steps work on the rows of a page, so they share one exchange
    of_page = Window.partitionBy(*page_key).orderBy("href", "item_no")
    before = wanted.withColumn("_before", F.lag("href").over(of_page))
    once = before.filter(~F.col("_before").eqNullSafe(F.col("href"))).drop("_before")
    return first_k(once, list(page_key), ["item_no"], per_page)
