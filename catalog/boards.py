"""Queries on landed payloads and pages. Payloads are built from ``part`` by Spark: one response
per brand and key range, so a response holds a bounded number of items however large the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import table
from rolesift.functions.html import anchors
from rolesift.functions.text import compact_slug
from rolesift.operators.detection import (
    Rule,
    detect_along_links,
    detect_board,
    job_links,
    route_companies,
)
from rolesift.operators.discovery import boards_from_payloads
from rolesift.sources.normalize import normalize, normalize_provider
from rolesift.sources.pages import role_links

# Part keys are unique, so a range of this many keys bounds the items of one response.
ITEMS_PER_RESPONSE = 1000
FAILED_BRAND = "Brand#13"
SINCE = "2026-01-20"

POSTING = (
    "company_name",
    "title",
    "location",
    "remote",
    "apply_url",
    "source",
    "ats_platform",
    "posted_date",
    "description",
)


def _title() -> Column:
    """Blank for small sizes, padded otherwise."""
    return F.when(F.col("p_size") <= 5, "  ").otherwise(
        F.concat(F.lit(" "), F.concat_ws(" ", "p_name", "p_type"))
    )


def _city() -> Column:
    return F.when(F.col("p_size") > 40, "Remote - EU").when(F.col("p_size") > 20, F.col("p_brand"))


def _day() -> Column:
    """A date text that goes with the size."""
    return F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd")


_FLAG = "p_type = 'PROMO'"


def _flag() -> Column:
    return F.expr(_FLAG)


def responses(
    parts: DataFrame, provider: str, item: Column, wrap: Callable[[Column], Column], identifier: Column
) -> DataFrame:
    """One landed response per brand and key range, items in key order."""
    grouped = parts.groupBy("p_brand", F.expr(f"p_partkey div {ITEMS_PER_RESPONSE}").alias("ordinal")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("p_partkey"), item.alias("item")))).alias("items")
    )
    return grouped.select(
        F.lit(provider).alias("provider"),
        identifier.alias("identifier"),
        F.col("p_brand").alias("company_name"),
        F.col("ordinal").cast("int").alias("ordinal"),
        F.when(F.col("p_brand") == FAILED_BRAND, 404).otherwise(200).alias("http_status"),
        wrap(F.col("items.item")).alias("body"),
    )


def _slug() -> Column:
    return compact_slug(F.col("p_brand"))


def wrapped(name: str) -> Callable[[Column], Column]:
    return lambda items: F.to_json(F.struct(items.alias(name)))


def _s(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _bare(number: Column) -> Column:
    """Marks a text that shall stand in JSON as a number; see ``_unquoted``."""
    return F.concat(F.lit("#"), number, F.lit("#"))


def _unquoted(body: Column) -> Column:
    return F.regexp_replace(body, r'"#([^"#]*)#"', "$1")


def _key() -> Column:
    return F.col("p_partkey")


_SLUG_SQL = "lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g'))"
_TITLE_SQL = "p_name || ' ' || p_type"
_CITY_SQL = "CASE WHEN p_size > 40 THEN 'Remote - EU' WHEN p_size > 20 THEN p_brand ELSE '' END"
_DAY_SQL = "strftime(DATE '2026-01-01' + p_size, '%Y-%m-%d')"
_FAR_SQL = "p_size > 40"


def _board_sql(provider: str, where: str = "TRUE", **columns: str) -> str:
    values = {
        "company_name": "p_brand",
        "title": _TITLE_SQL,
        "location": _CITY_SQL,
        "remote": _FAR_SQL,
        "apply_url": "'https://x.example.com/' || p_partkey",
        "source": "'company_ats'",
        "ats_platform": f"'{provider}'",
        "posted_date": _DAY_SQL,
        "description": "''",
        **columns,
    }
    listed = ", ".join(f"{v} AS {k}" for k, v in values.items())
    return (
        f"SELECT {listed} FROM part WHERE p_brand <> '{FAILED_BRAND}' AND p_size > 5 AND {where}"
    )


def _url() -> Column:
    return F.concat(F.lit("https://x.example.com/"), _key())


# provider -> (item, wrapper, identifier, SQL)
BOARDS: dict[str, tuple[Callable[[], Column], Callable, Callable[[], Column], str]] = {
    "greenhouse": (
        lambda: _s(
            title=_title(),
            location=_s(name=_city()),
            absolute_url=_url(),
            updated_at=_day(),
            content=F.col("p_type"),
        ),
        wrapped("jobs"),
        _slug,
        _board_sql("greenhouse", description="p_type"),
    ),
    "lever": (
        lambda: _s(
            text=_title(),
            categories=_s(location=_city(), commitment=F.when(_flag(), "Full REMOTE")),
            hostedUrl=_url(),
            createdAt=F.when(_flag(), _day()).otherwise(
                _bare(F.concat((_key() * 1000).cast("string"), F.when(F.col("p_size") % 2 == 1, ".5").otherwise("")))
            ),
            descriptionPlain=F.col("p_type"),
        ),
        lambda items: _unquoted(F.to_json(items)),
        _slug,
        _board_sql(
            "lever",
            remote=f"{_FAR_SQL} OR {_FLAG}",
            posted_date=f"""CASE WHEN {_FLAG} THEN {_DAY_SQL} WHEN p_size % 2 = 1 THEN p_partkey * 1000 || '.5'
              WHEN p_partkey <> 0 THEN CAST(p_partkey * 1000 AS VARCHAR) END""",
            description="p_type",
        ),
    ),
    "ashby": (
        lambda: _s(
            title=_title(),
            location=_city(),
            isRemote=F.when(_flag(), True),
            jobUrl=_url(),
            publishedAt=_day(),
            descriptionHtml=F.col("p_type"),
        ),
        wrapped("jobs"),
        _slug,
        _board_sql("ashby", remote=f"{_FAR_SQL} OR {_FLAG}", description="p_type"),
    ),
    "workday": (
        lambda: _s(
            title=_title(),
            locationsText=_city(),
            externalPath=F.concat(F.lit("/job/"), _key()),
            postedOn=_day(),
        ),
        wrapped("jobPostings"),
        # one brand has an identifier without a site
        lambda: F.when(F.col("p_brand") == "Brand#1", _slug()).otherwise(
            F.concat(_slug(), F.lit(".wd5.myworkdayjobs.com/Site/A"))
        ),
        _board_sql(
            "workday",
            where="p_brand <> 'Brand#1'",
            apply_url=f"'https://' || {_SLUG_SQL} || '.wd5.myworkdayjobs.com/en-US/Site/A/job/' || p_partkey",
        ),
    ),
    "smartrecruiters": (
        lambda: _s(
            id=_key().cast("string"),
            name=_title(),
            releasedDate=_day(),
            location=_s(city=_city(), country=F.when(_flag(), "IN"), remote=_flag()),
        ),
        wrapped("content"),
        _slug,
        _board_sql(
            "smartrecruiters",
            location=f"concat_ws(', ', nullif({_CITY_SQL}, ''), CASE WHEN {_FLAG} THEN 'IN' END)",
            remote=_FLAG,
            apply_url=f"'https://jobs.smartrecruiters.com/' || {_SLUG_SQL} || '/' || p_partkey",
        ),
    ),
    "bamboohr": (
        lambda: _s(
            id=_key().cast("string"),
            jobOpeningName=_title(),
            locationLabel=_city(),
            departmentLabel=F.col("p_type"),
        ),
        wrapped("result"),
        _slug,
        _board_sql(
            "bamboohr",
            apply_url=f"'https://' || {_SLUG_SQL} || '.bamboohr.com/careers/' || p_partkey",
            posted_date="CAST(NULL AS VARCHAR)",
            description="p_type",
        ),
    ),
    "workable": (
        lambda: _s(
            title=_title(),
            city=_city(),
            country=F.when(_flag(), "IN"),
            url=F.when(_flag(), _url()).otherwise(""),
            shortlink=F.concat(F.lit("https://s.example.com/"), _key()),
            telecommuting=_flag(),
            published_on=_day(),
        ),
        wrapped("jobs"),
        _slug,
        _board_sql(
            "workable",
            location=f"concat_ws(', ', nullif({_CITY_SQL}, ''), CASE WHEN {_FLAG} THEN 'IN' END)",
            remote=_FLAG,
            apply_url=f"CASE WHEN {_FLAG} THEN 'https://x.example.com/' ELSE 'https://s.example.com/' END"
            " || p_partkey",
        ),
    ),
    "recruitee": (
        lambda: _s(
            title=_title(),
            location=_city(),
            remote=_flag(),
            published_at=F.concat(_day(), F.lit(" 10:00:00 UTC")),
            careers_url=F.concat(F.lit("https://s.example.com/"), _key()),
            careers_apply_url=F.when(_flag(), _url()),
            sharing_description=F.col("p_type"),
        ),
        wrapped("offers"),
        _slug,
        _board_sql(
            "recruitee",
            remote=_FLAG,
            apply_url=f"CASE WHEN {_FLAG} THEN 'https://x.example.com/' ELSE 'https://s.example.com/' END"
            " || p_partkey",
            posted_date=f"{_DAY_SQL} || ' 10:00:00 UTC'",
            description="p_type",
        ),
    ),
    "oracle_recruiting": (
        lambda: _s(
            Id=_key().cast("string"),
            Title=_title(),
            PostedDate=_day(),
            PrimaryLocation=_city(),
            WorkplaceType=F.when(_flag(), "Fully Remote"),
            ShortDescriptionStr=F.col("p_type"),
        ),
        lambda items: F.to_json(
            F.struct(F.array(F.struct(items.alias("requisitionList"))).alias("items"))
        ),
        lambda: F.when(F.col("p_brand") == "Brand#1", _slug()).otherwise(
            F.concat(_slug(), F.lit(".fa.example.com|CX_1"))
        ),
        _board_sql(
            "oracle_recruiting",
            where="p_brand <> 'Brand#1'",
            remote=f"{_FAR_SQL} OR {_FLAG}",
            apply_url=f"'https://' || {_SLUG_SQL} || "
            "'.fa.example.com/hcmUI/CandidateExperience/en/sites/CX_1/job/' || p_partkey",
            description="p_type",
        ),
    ),
}


def board_payloads(spark, sf_dir, provider: str) -> DataFrame:
    item, wrap, identifier, _ = BOARDS[provider]
    return responses(table(spark, sf_dir, "part"), provider, item(), wrap, identifier())


def _register_board(provider: str) -> None:
    def run(spark, sf_dir):
        return normalize_provider(board_payloads(spark, sf_dir, provider), provider).select(*POSTING)

    query(f"norm_{provider}", BOARDS[provider][3])(run)


for _provider in BOARDS:
    _register_board(_provider)


@query(
    "norm_all_boards",
    "SELECT ats_platform, count(*) AS postings, CAST(count(*) FILTER (remote) AS BIGINT) AS remote_postings FROM ("
    + " UNION ALL ".join(spec[3] for spec in BOARDS.values())
    + ") GROUP BY ats_platform",
)
def _norm_all(spark, sf_dir):
    """All board payloads as one landed table through one call."""
    landed = None
    for provider in BOARDS:
        rows = board_payloads(spark, sf_dir, provider)
        landed = rows if landed is None else landed.unionByName(rows)
    return (
        normalize(landed, providers=list(BOARDS))
        .groupBy("ats_platform")
        .agg(F.count("*").alias("postings"), F.count_if("remote").alias("remote_postings"))
    )


# -- feeds ---------------------------------------------------------------------------------


def _feed_sql(source: str, where: str = "TRUE", table_sql: str = "part", **columns: str) -> str:
    values = {
        "company_name": "p_brand",
        "title": _TITLE_SQL,
        "location": _CITY_SQL,
        "remote": "TRUE",
        "apply_url": "'https://x.example.com/' || p_partkey",
        "source": f"'{source}'",
        "ats_platform": "CAST(NULL AS VARCHAR)",
        "posted_date": _DAY_SQL,
        "description": "p_type",
        **columns,
    }
    listed = ", ".join(f"{v} AS {k}" for k, v in values.items())
    return f"SELECT {listed} FROM {table_sql} WHERE p_brand <> '{FAILED_BRAND}' AND {where}"


def _since() -> Column:
    return F.lit(f"{SINCE} 00:00:00+00:00").cast("timestamp")


_IN_WINDOW_SQL = f"({_DAY_SQL} >= '{SINCE}' OR p_type = 'SMALL')"
_TAGGED_SQL = "(p_name LIKE 'small %' OR p_name LIKE 'red %' OR contains(lower(p_name || ' ' || p_type), 'ml'))"


def _undatable() -> Column:
    """The date as text, but unreadable for one type."""
    return F.when(F.col("p_type") == "SMALL", F.concat(F.lit("about "), _day())).otherwise(_day())


_UNDATABLE_SQL = f"CASE WHEN p_type = 'SMALL' THEN 'about ' || {_DAY_SQL} ELSE {_DAY_SQL} END"


@query(
    "norm_remoteok",
    _feed_sql(
        "remoteok",
        where=f"p_size BETWEEN 6 AND 48 AND {_IN_WINDOW_SQL} AND {_TAGGED_SQL}",
        posted_date=_UNDATABLE_SQL,
    ),
)
def _norm_remoteok(spark, sf_dir):
    colour = F.substring_index("p_name", " ", 1)
    item = _s(
        id=F.when(F.col("p_size") <= 48, _key().cast("string")),  # without id: a notice
        position=_title(),
        company=F.concat(F.lit(" "), F.col("p_brand")),
        tags=F.when(
            colour.isin("small", "red"),
            F.array(F.when(colour == "small", "NLP").otherwise("LLM"), F.col("p_type")),
        ),
        location=_city(),
        url=_url(),
        date=_undatable(),
        description=F.col("p_type"),
    )
    landed = responses(table(spark, sf_dir, "part"), "remoteok", item, lambda i: F.to_json(i), _slug())
    return normalize_provider(landed, "remoteok", _since()).select(*POSTING)


_MAIL_DAY_SQL = "strftime(DATE '2026-01-01' + p_size, '%a, %d %b %Y 08:00:00 +0000')"


@query(
    "norm_weworkremotely",
    _feed_sql(
        "weworkremotely",
        where=f"{_DAY_SQL} >= '{SINCE}'",
        company_name="CASE WHEN p_size > 45 THEN 'Unknown' ELSE p_brand END",
        title="CASE WHEN p_size > 45 THEN p_name WHEN p_size > 40 THEN '' ELSE p_name || ': ' || p_type END",
        location="'Remote'",
        posted_date=_MAIL_DAY_SQL,
    ),
)
def _norm_wwr(spark, sf_dir):
    size = F.col("p_size")
    title = (
        F.when(size > 45, F.col("p_name"))
        .when(size > 40, F.concat(F.col("p_brand"), F.lit(": ")))
        .otherwise(F.concat(F.col("p_brand"), F.lit(": "), F.col("p_name"), F.lit(": "), F.col("p_type")))
    )
    day = F.date_add(F.lit("2026-01-01").cast("date"), size)
    mail_day = F.concat(F.date_format(day, "E, dd MMM yyyy"), F.lit(" 08:00:00 +0000"))
    item = F.concat(
        F.lit("<item><title>"),
        title,
        F.lit("</title><link>"),
        _url(),
        F.lit("</link><pubDate>"),
        mail_day,
        F.lit("</pubDate><description><![CDATA["),
        F.col("p_type"),
        F.lit("]]></description></item>"),
    )
    landed = responses(
        table(spark, sf_dir, "part"),
        "weworkremotely",
        item,
        lambda i: F.concat(
            F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>feed</title>'),
            F.array_join(i, ""),
            F.lit("</channel></rss>"),
        ),
        _slug(),
    )
    return normalize_provider(landed, "weworkremotely", _since()).select(*POSTING)


_EPOCH_SQL = "CAST(epoch(DATE '2026-01-01' + p_size) AS BIGINT)"
_GUID_SQL = "p_name || '/' || p_type || '/' || p_size"


@query(
    "norm_himalayas",
    _feed_sql(
        "himalayas",
        where=f"p_size > 5 AND ({_DAY_SQL} >= '{SINCE}' OR p_size % 5 = 3)",
        table_sql=f"""(SELECT *, row_number() OVER (PARTITION BY {_GUID_SQL}
          ORDER BY p_partkey) AS nth FROM part
          WHERE p_brand <> '{FAILED_BRAND}' AND p_type <> 'LARGE') AS p""",
        location="CASE WHEN p_size > 30 THEN 'Worldwide' ELSE 'A, B, ' || p_type END",
        posted_date=f"""CASE p_size % 5 WHEN 1 THEN {_DAY_SQL} WHEN 2 THEN {_EPOCH_SQL} || '.5'
          WHEN 3 THEN '99999999999999999999' ELSE CAST({_EPOCH_SQL} AS VARCHAR) END""",
        apply_url=f"CASE WHEN {_FLAG} THEN {_GUID_SQL} ELSE 'https://x.example.com/' || p_partkey END",
    )
    + " AND nth = 1",
)
def _norm_himalayas(spark, sf_dir):
    """Dates as epoch seconds, whole and with a fraction, as ISO text, and as a number that is no
    date; an undatable item is kept."""
    parts = table(spark, sf_dir, "part")
    size = F.col("p_size")
    guid = F.concat_ws("/", "p_name", "p_type", "p_size")
    epoch = (F.unix_date(F.date_add(F.lit("2026-01-01").cast("date"), size)).cast("long") * 86_400).cast("string")
    item = _s(
        guid=F.when(F.col("p_type") == "LARGE", "").otherwise(guid),
        title=_title(),
        companyName=F.col("p_brand"),
        locationRestrictions=F.when(
            size <= 30, F.array(F.lit("A"), F.lit("B"), F.col("p_type"), F.lit("D"))
        ),
        pubDate=F.when(size % 5 == 1, _day())
        .when(size % 5 == 2, _bare(F.concat(epoch, F.lit(".5"))))
        .when(size % 5 == 3, _bare(F.lit("99999999999999999999")))
        .otherwise(_bare(epoch)),
        applicationLink=F.when(_flag(), "").otherwise(_url()),
        description=F.when(_flag(), F.col("p_type")),
        excerpt=F.col("p_type"),
    )
    # Two searches return the same items; the first one claims them.
    item_brand = F.struct(F.col("p_partkey"), item.alias("item"))
    ranges = F.expr(f"p_partkey div {ITEMS_PER_RESPONSE}")
    kept_brand = parts.filter(F.col("p_brand") != FAILED_BRAND)
    one = (
        kept_brand.groupBy(ranges.alias("ordinal"))
        .agg(F.array_sort(F.collect_list(item_brand)).alias("items"))
        .select(
            F.lit("himalayas").alias("provider"),
            F.lit("search").alias("identifier"),
            F.lit(None).cast("string").alias("company_name"),
            F.col("ordinal").cast("int").alias("ordinal"),
            F.lit(200).alias("http_status"),
            _unquoted(F.to_json(F.struct(F.col("items.item").alias("jobs")))).alias("body"),
        )
    )
    two = one.withColumn("ordinal", F.col("ordinal") + 1_000_000_000)
    return normalize_provider(one.unionByName(two), "himalayas", _since()).select(*POSTING)


JOBICY_SQL = _feed_sql("jobicy", where="p_size > 5", posted_date=_UNDATABLE_SQL)
# from the day after SINCE on, or undatable: what a run that starts within that day keeps
JOBICY_WINDOW_SQL = _feed_sql(
    "jobicy", where=f"p_size > 5 AND ({_DAY_SQL} > '{SINCE}' OR p_type = 'SMALL')", posted_date=_UNDATABLE_SQL
)


def jobicy_item() -> Column:
    return _s(
        url=_url(),
        jobTitle=_title(),
        companyName=F.concat(F.col("p_brand"), F.lit(" ")),
        jobGeo=_city(),
        jobExcerpt=F.col("p_type"),
        pubDate=_undatable(),
    )


@query(
    "norm_jobicy",
    _feed_sql(
        "jobicy",
        where=f"p_size > 5 AND {_IN_WINDOW_SQL}",
        posted_date=_UNDATABLE_SQL,
    ),
)
def _norm_jobicy(spark, sf_dir):
    landed = responses(table(spark, sf_dir, "part"), "jobicy", jobicy_item(), wrapped("jobs"), _slug())
    return normalize_provider(landed, "jobicy", _since()).select(*POSTING)


@query(
    "payload_sizes",
    f"""SELECT CASE p_type WHEN 'ECONOMY' THEN 'greenhouse' WHEN 'LARGE' THEN 'lever'
        WHEN 'MEDIUM' THEN 'ashby' WHEN 'PROMO' THEN 'workable' WHEN 'SMALL' THEN 'smartrecruiters'
        ELSE 'workday' END AS provider, p_brand AS identifier,
      max(CASE WHEN p_type = 'SMALL' AND n = 0 THEN NULL ELSE n END) AS job_count
    FROM (SELECT p_type, p_brand, p_partkey // {ITEMS_PER_RESPONSE} AS r,
        CAST(count(*) FILTER (p_size > 40) AS INTEGER) AS n
      FROM part GROUP BY ALL) GROUP BY 1, 2""",
)
def _payload_sizes(spark, sf_dir):
    kind = F.col("p_type")
    provider = (
        F.when(kind == "ECONOMY", "greenhouse")
        .when(kind == "LARGE", "lever")
        .when(kind == "MEDIUM", "ashby")
        .when(kind == "PROMO", "workable")
        .when(kind == "SMALL", "smartrecruiters")
        .otherwise("workday")
    )
    listed = F.collect_list(F.when(F.col("p_size") > 40, F.struct(F.col("p_name").alias("title"))))
    bodies = (
        table(spark, sf_dir, "part")
        .groupBy(provider.alias("provider"), "p_brand", F.expr(f"p_partkey div {ITEMS_PER_RESPONSE}").alias("r"))
        .agg(listed.alias("items"))
    )
    items, name = F.col("items"), F.col("provider")
    body = (
        F.when(name == "lever", F.to_json(items))
        .when(name == "smartrecruiters", F.to_json(F.struct(items.alias("content"))))
        .when(name == "workday", F.to_json(F.struct(items.alias("jobPostings"))))
        .otherwise(F.to_json(F.struct(items.alias("jobs"))))
    )
    return boards_from_payloads(
        bodies.select("provider", F.col("p_brand").alias("identifier"), F.lit(200).alias("http_status"), body.alias("body"))
    )


# -- pages ---------------------------------------------------------------------------------

ANCHOR_SQL = """
links AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
    unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS txt,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) AS pos
  FROM pages
)"""
_ORIGIN_SQL = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"


# Anchors that name a role of the run's settings, first per URL of a page.
PAGE_LINKS_SQL = f"""SELECT page_id, pos, txt, link_url FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, link_url ORDER BY pos) AS nth FROM (
    SELECT page_id, pos, txt, {_ORIGIN_SQL} || href AS link_url FROM links WHERE length(txt) BETWEEN 1 AND 120
      AND (txt ILIKE '%widget%' OR txt ILIKE '%ring%' OR txt ILIKE '%gear%' OR txt ILIKE '%gizmo%'))) WHERE nth = 1"""


@query(
    "page_all_anchors",
    f"WITH {ANCHOR_SQL} SELECT page_id, CAST(pos AS INTEGER) AS item_no, href, txt AS link_text FROM links",
)
def _anchors(spark, sf_dir):
    return anchors(table(spark, sf_dir, "pages").select("page_id", "html"))


ROLE_LINK_WORDS = ("En", "the", "de", "ing")

# On every second page the link texts end in character references of all kinds.
_REFERENCES = " R&#38;D &eacute;&hellip;&#x2014;&#0160;"
_REFERENCES_READ = "CASE WHEN page_id % 2 = 0 THEN txt || ' R&D é…—' ELSE txt END"
_READ_LINKS_SQL = f"""{ANCHOR_SQL}, decoded AS (SELECT page_id, url, href, pos, {_REFERENCES_READ} AS txt FROM links)"""


def _with_references(html):
    return F.when(F.col("page_id") % 2 == 0, F.replace(html, F.lit("</a>"), F.lit(f"{_REFERENCES}</a>"))).otherwise(html)


@query(
    "page_anchors",
    f"""WITH {_READ_LINKS_SQL}, named AS (
      SELECT page_id, pos, txt, {_ORIGIN_SQL} || href AS link_url FROM decoded
      WHERE length(txt) BETWEEN 1 AND 120 AND (contains(lower(txt), 'en') OR contains(lower(txt), 'the')
        OR contains(lower(txt), 'de') OR contains(lower(txt), 'ing')))
    SELECT page_id, txt AS link_text, link_url FROM (
      SELECT *, row_number() OVER (PARTITION BY page_id, link_url ORDER BY pos) AS nth FROM named
    ) WHERE nth = 1""",
)
def _page_anchors(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", _with_references(F.col("html")).alias("html"))
    return role_links(pages, "url", "html", ROLE_LINK_WORDS).select("page_id", "link_text", "link_url")


@query(
    "norm_generic",
    f"""WITH {_READ_LINKS_SQL}, named AS (
      SELECT page_id, pos, txt, {_ORIGIN_SQL} || href AS link_url FROM decoded
      WHERE length(txt) BETWEEN 1 AND 120 AND contains(lower(txt), 'en'))
    SELECT 'page ' || page_id AS company_name, txt AS title, link_url AS apply_url, FALSE AS remote,
      'generic' AS ats_platform FROM (
      SELECT *, row_number() OVER (PARTITION BY page_id, link_url ORDER BY pos) AS nth FROM named
    ) WHERE nth = 1""",
)
def _norm_generic(spark, sf_dir):
    landed = table(spark, sf_dir, "pages").select(
        F.lit("generic").alias("provider"),
        F.col("url").alias("identifier"),
        F.concat(F.lit("page "), "page_id").alias("company_name"),
        F.lit(200).alias("http_status"),
        _with_references(F.col("html")).alias("body"),
    )
    return normalize_provider(landed, "generic", role_words=("en",)).select(
        "company_name", "title", "apply_url", "remote", "ats_platform"
    )


_TENANT_SQL = "regexp_extract(url, '^https?://([^./]*)', 1)"


@query(
    "norm_teamtailor",
    f"""WITH {ANCHOR_SQL}, jobs AS (
      SELECT page_id, url, pos, CASE WHEN contains(txt, 'de') THEN '' ELSE txt END AS txt,
        'https://' || {_TENANT_SQL} || '.teamtailor.com/jobs/7' || ltrim(href, '/') AS link_url FROM links)
    SELECT 'page ' || page_id AS company_name, txt AS title, link_url AS apply_url, FALSE AS remote,
      'teamtailor' AS ats_platform FROM (
      SELECT *, row_number() OVER (PARTITION BY page_id, link_url ORDER BY pos) AS nth FROM jobs
    ) WHERE nth = 1 AND txt <> ''""",
)
def _norm_teamtailor(spark, sf_dir):
    """Links become board links and the page is doubled; in its first half some links are images,
    which hide the titled link that comes later."""
    titled = F.regexp_replace("html", r'<a href="/([^"]*)">', r'<a href="/jobs/7$1">')
    imaged = F.regexp_replace(titled, r'(<a href="/jobs/7[^"]*">)([^<]*de[^<]*)</a>', r'$1<img alt="$2"></a>')
    html = F.concat(imaged, titled)
    landed = table(spark, sf_dir, "pages").select(
        F.lit("teamtailor").alias("provider"),
        F.regexp_extract("url", r"^https?://([^./]*)", 1).alias("identifier"),
        F.concat(F.lit("page "), "page_id").alias("company_name"),
        F.lit(200).alias("http_status"),
        html.alias("body"),
    )
    return normalize_provider(landed, "teamtailor").select(
        "company_name", "title", "apply_url", "remote", "ats_platform"
    )


_WANTED, _SKIPPED = r"(?i)^/(the|de|en|la|st)", r"(?i)(nicht|than|tion)"


@query(
    "page_job_links",
    f"""WITH {ANCHOR_SQL}, wanted AS (
      SELECT page_id, href, min(pos) AS pos FROM links
      WHERE href <> '' AND href <> url AND regexp_matches(href, '{_WANTED}')
        AND NOT regexp_matches(href, '{_SKIPPED}') GROUP BY page_id, href)
    SELECT page_id, href FROM (
      SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS nth FROM wanted
    ) WHERE nth <= 2""",
)
def _job_links(spark, sf_dir):
    links = anchors(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return job_links(
        links, ["page_id"], "url", 2, wanted_pattern=_WANTED, skip_pattern=_SKIPPED
    ).select("page_id", "href")


# Rules on the hosts that the pages have: order, both haystacks, blocked names, two groups.
HOST_RULES = (
    Rule("mobile", "m.", r"\bm\.([a-z-]+)\.example\.com"),
    Rule("blog", "blog.", r"blog\.([a-z-]+)\.example\.(?:com|net)", blocked=("ththan", "tiontion")),
    Rule("web", "www.", r"www\.([a-z-]+)\.example\.(com|net|org)", identifier="$1|$2"),
    Rule("plain", ".example.", r"([a-z-]+)\.example\.(org|net)", identifier="$1/$2", blocked=("spam-farm/org",)),
)


def _rules_sql(rules) -> str:
    """One CASE branch per rule and haystack."""
    branches_p, branches_i = [], []
    for rule in rules:
        template = rule.identifier.replace("$", "\\")
        for hay in ("url", "html"):
            whole = f"regexp_extract({hay}, '{rule.pattern}', 0)"
            ident = f"regexp_replace({whole}, '{rule.pattern}', '{template}')"
            test = f"{whole} <> ''"
            if rule.blocked:
                names = ", ".join(f"'{b}'" for b in rule.blocked)
                test += f" AND {ident} NOT IN ({names})"
            branches_p.append(f"WHEN {test} THEN '{rule.provider}'")
            branches_i.append(f"WHEN {test} THEN {ident}")
    return f"CASE {' '.join(branches_p)} END AS provider, CASE {' '.join(branches_i)} END AS identifier"


@query("detect_rules", f"SELECT page_id, {_rules_sql(HOST_RULES)} FROM pages")
def _detect_rules(spark, sf_dir):
    board = detect_board(F.col("html"), F.col("url"), HOST_RULES)
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", board.alias("b"))
        .select("page_id", "b.provider", "b.identifier")
    )


_REWRITES = (
    (r"blog\.([a-z-]+)\.example\.net", "{}.teamtailor.com"),
    (r"blog\.([a-z-]+)\.example\.com", "{}.recruitee.com"),
    (r"www\.([a-z-]+)\.example\.org", "{}.wd5.myworkdayjobs.com/en-US/Careers"),
    (r"www\.([a-z-]+)\.example\.com", "boards.greenhouse.io/{}"),
    (r"\bm\.([a-z-]+)\.example\.com", "jobs.lever.co/{}"),
    (r"\bm\.([a-z-]+)\.example\.net", "www.bamboohr.com/{}"),
)


def seller_pages(spark, sf_dir) -> DataFrame:
    """Every page with the supplier it is dealt to, page_id modulo their number; the keys count up
    from 0. A supplier has several pages when there are more of them than suppliers."""
    sellers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    number = sellers.agg(F.count("*").alias("n")).scalar()
    dealt = board_pages(spark, sf_dir).withColumn("s_suppkey", F.col("page_id") % number)
    return dealt.join(sellers, "s_suppkey")


DEALT_SQL = """dealt AS (SELECT boards.*, page_id % (SELECT count(*) FROM supplier) AS s_suppkey FROM boards)"""


def board_pages(spark, sf_dir) -> DataFrame:
    """The given pages with some hosts replaced by hosts of known platforms."""
    url, html = F.col("url"), F.col("html")
    for pattern, target in _REWRITES:
        url = F.regexp_replace(url, pattern, target.format("$1"))
        html = F.regexp_replace(html, pattern, target.format("$1"))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("final_url"), html.alias("html"))


_HOST_SQL = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
_KIND_SQL = f"""CASE
    WHEN regexp_matches(h, '^blog\\.[a-z-]+\\.example\\.net$') THEN 'teamtailor'
    WHEN regexp_matches(h, '^blog\\.[a-z-]+\\.example\\.com$') THEN 'recruitee'
    WHEN regexp_matches(h, '^www\\.[a-z-]+\\.example\\.org$') THEN 'workday'
    WHEN regexp_matches(h, '^www\\.[a-z-]+\\.example\\.com$') THEN 'greenhouse'
    WHEN regexp_matches(h, '^m\\.[a-z-]+\\.example\\.com$') THEN 'lever' END"""
BOARD_PAGES_SQL = f"""
hosts AS (SELECT page_id, url, {_HOST_SQL} AS h FROM pages),
kinds AS (SELECT page_id, {_KIND_SQL} AS provider, split_part(h, '.', 2) AS tenant FROM hosts),
boards AS (SELECT page_id, provider, CASE WHEN provider = 'workday'
    THEN tenant || '.wd5.myworkdayjobs.com/Careers' WHEN provider IS NOT NULL THEN tenant END AS identifier
  FROM kinds)"""


@query("detect_boards", f"WITH {BOARD_PAGES_SQL} SELECT page_id, provider, identifier FROM boards")
def _detect_boards(spark, sf_dir):
    """The platform rules themselves, on rewritten hosts."""
    board = detect_board(F.col("html"), F.col("final_url"))
    return (
        board_pages(spark, sf_dir)
        .select("page_id", board.alias("b"))
        .select("page_id", "b.provider", "b.identifier")
    )


@query(
    "route_status",
    f"""WITH {BOARD_PAGES_SQL}, {DEALT_SQL}, c AS (
      SELECT s_name AS name, s_suppkey, s_nationkey, CASE WHEN s_acctbal > 8000 THEN 'ashby'
        WHEN s_acctbal > 5000 THEN 'unheard_of' END AS cached FROM supplier),
    first_page AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY page_id) AS nth
      FROM dealt) WHERE nth = 1)
    SELECT name,
      CASE WHEN cached = 'ashby' THEN cached WHEN page_id IS NULL OR s_nationkey IN (3, 5) THEN NULL
        ELSE coalesce(provider, 'generic') END AS ats_provider,
      CASE WHEN cached = 'ashby' THEN lower(name) WHEN page_id IS NULL OR s_nationkey IN (3, 5) THEN NULL
        ELSE identifier END AS ats_identifier,
      CASE WHEN cached = 'ashby' THEN 'ok:cached' WHEN page_id IS NULL THEN 'error: not fetched'
        WHEN s_nationkey = 5 THEN 'error: timeout' WHEN s_nationkey = 3 THEN 'error: HTTP 404'
        WHEN provider IS NOT NULL THEN 'ok' ELSE 'ok:generic' END AS last_status
    FROM c LEFT JOIN first_page USING (s_suppkey)""",
)
def _route_status(spark, sf_dir):
    """The list gives each name twice, of which the last row counts; a blank identifier is none; and
    of several pages the first by URL counts."""
    sellers = table(spark, sf_dir, "supplier")
    balance = F.col("s_acctbal")
    companies = sellers.select(
        F.col("s_name").alias("name"),
        F.lit("").alias("priority"),
        F.lit("https://x.example.com").alias("career_page"),
        F.when(balance > 7000, "ashby").when(balance > 5000, "unheard_of").alias("ats_provider"),
        F.when(balance > 8000, F.lower("s_name")).when(balance > 7000, " ").when(balance > 5000, "x").alias("ats_identifier"),
        F.col("s_suppkey").alias("file_pos"),
    )
    earlier = companies.withColumns({"file_pos": F.col("file_pos") - 1_000_000_000_000, "ats_provider": F.lit("lever"), "ats_identifier": F.lit("old")})
    companies = companies.unionByName(earlier)
    pages = seller_pages(spark, sf_dir).select(
        F.col("s_name").alias("company_name"),
        F.format_string("https://x.example.com/%018d", "page_id").alias("page_url"),
        "final_url",
        F.when(F.col("s_nationkey") == 3, 404).otherwise(200).alias("http_status"),
        F.when(F.col("s_nationkey") == 5, "timeout").alias("error"),
        "html",
    )
    return route_companies(companies, pages).select("name", "ats_provider", "ats_identifier", "last_status")


_COMPANY_SQL = "regexp_extract(url, '^https?://(?:[a-z]+\\.)?([a-z-]+)\\.example\\.', 1)"


@query(
    "detect_along_links",
    f"""WITH seen AS (
      SELECT {_COMPANY_SQL} AS name, page_id, url, contains(url, '/fr/') AS signal,
        {_rules_sql(HOST_RULES[:3])} FROM pages WHERE NOT contains(url, '.html')),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) AS nth
      FROM seen WHERE provider IS NOT NULL) WHERE nth = 1),
    boards AS (SELECT DISTINCT {_COMPANY_SQL} AS identifier FROM pages WHERE NOT contains(url, '.org'))
    SELECT name, provider AS ats_provider, identifier AS ats_identifier,
      CASE WHEN page_id = 0 THEN 'found on landing page' ELSE 'found after following link ' || url END AS note
    FROM hits
    UNION ALL
    SELECT DISTINCT name, 'greenhouse', replace(name, '-', ''), 'found via verified guess' FROM seen
    WHERE signal AND replace(name, '-', '') IN (SELECT identifier FROM boards)
      AND name NOT IN (SELECT name FROM hits)""",
)
def _along_links(spark, sf_dir):
    """Pages of one domain as the landing page and followed links of one company."""
    company = F.regexp_extract("url", r"^https?://(?:[a-z]+\.)?([a-z-]+)\.example\.", 1)
    rows = table(spark, sf_dir, "pages").withColumn("company_name", company)
    signal = F.when(F.contains("url", F.lit("/fr/")), '"greenhouseId" : 1').otherwise("")
    pages = rows.select(
        "company_name",
        F.col("page_id").alias("page_no"),
        F.col("url").alias("final_url"),
        F.when(F.contains("url", F.lit(".html")), 404).otherwise(200).alias("http_status"),
        F.lit(None).cast("string").alias("error"),
        F.concat("html", signal).alias("html"),
    )
    boards = rows.select(
        F.lit("greenhouse").alias("provider"),
        F.col("company_name").alias("identifier"),
        F.when(F.contains("url", F.lit(".org")), 0).otherwise(3).alias("job_count"),
    )
    return detect_along_links(pages, boards, HOST_RULES[:3])
