"""Cross-company feeds. Source rank keeps the order in which a run reads them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift.functions.dates import from_iso_text, from_mail_text, from_number_or_iso, stated
from rolesift.functions.text import blank_to_null, contains_any, strip_or_blank, text_or_blank
from rolesift.sources.registry import Provider, register

# Topics that let an item of the all-disciplines feed through.
TOPIC_HINTS = (
    "ai",
    "ml",
    "machine-learning",
    "artificial-intelligence",
    "nlp",
    "llm",
    "genai",
    "data-science",
    "deep-learning",
)


def is_topical(tags: Column, title: Column, hints: tuple[str, ...] = TOPIC_HINTS) -> Column:
    """A tag equals a hint, or a hint is a substring of the title ('ai' hits 'maintenance')."""
    lowered = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    wanted = F.array(*[F.lit(h) for h in hints])
    return F.coalesce(F.arrays_overlap(lowered, wanted), F.lit(False)) | contains_any(
        F.lower(text_or_blank(title)), hints
    )


def split_company_title(raw: Column) -> tuple[Column, Column]:
    """('Acme: Engineer') to company and title at the first colon; no colon means 'Unknown'."""
    at = F.instr(raw, ":")
    company = F.when(at > 0, strip_or_blank(F.substring_index(raw, ":", 1))).otherwise("Unknown")
    title = F.when(at > 0, strip_or_blank(F.substr(raw, at + F.lit(1)))).otherwise(raw)
    return company, title


def _rss_item(it: Column) -> dict[str, Column]:
    raw = strip_or_blank(it["title"])
    company, title = split_company_title(raw)
    return {
        "title": title,
        "company_name": company,
        "location": F.lit("Remote"),
        "remote": F.lit(True),
        "apply_url": it["link"],
        "posted_date": it["pubDate"],
        "posted_at": from_mail_text(it["pubDate"]),
        "description": it["description"],
        # 'Acme:' has a blank title after the split and still passes this reader
        "keep": raw != "",
    }


register(
    Provider(
        name="weworkremotely",
        source="weworkremotely",
        source_rank=1,
        body="xml",
        blank_titles=True,
        ddl="channel struct<item:array<struct<title:string,link:string,pubDate:string,"
        "description:string>>>",
        items=lambda parsed: parsed["channel"]["item"],
        fields=lambda it, _: _rss_item(it),
    )
)

register(
    Provider(
        name="remoteok",
        source="remoteok",
        source_rank=2,
        ddl="array<struct<id:string,position:string,company:string,tags:array<string>,"
        "location:string,url:string,apply_url:string,date:string,description:string>>",
        items=lambda parsed: parsed,
        fields=lambda it, _: {
            "title": it["position"],
            "company_name": strip_or_blank(it["company"]),
            "location": it["location"],
            "remote": F.lit(True),
            "apply_url": F.coalesce(blank_to_null(it["url"]), it["apply_url"]),
            "posted_date": it["date"],
            "posted_at": from_iso_text(it["date"]),
            "description": it["description"],
            # the legal notice in front has no id
            "keep": it["id"].isNotNull() & is_topical(it["tags"], it["position"]),
        },
    )
)

register(
    Provider(
        name="himalayas",
        source="himalayas",
        source_rank=3,
        claims=True,
        ddl="jobs array<struct<guid:string,title:string,companyName:string,"
        "locationRestrictions:array<string>,pubDate:string,applicationLink:string,"
        "description:string,excerpt:string>>",
        items=lambda parsed: parsed["jobs"],
        fields=lambda it, _: {
            "title": it["title"],
            "company_name": strip_or_blank(it["companyName"]),
            "location": F.when(
                F.coalesce(F.array_size(it["locationRestrictions"]), F.lit(0)) > 0,
                F.array_join(F.slice(it["locationRestrictions"], 1, 3), ", "),
            ).otherwise("Worldwide"),
            "remote": F.lit(True),
            "apply_url": F.coalesce(blank_to_null(it["applicationLink"]), it["guid"]),
            "posted_date": stated(it["pubDate"]),
            "posted_at": from_number_or_iso(it["pubDate"]),
            "description": F.coalesce(blank_to_null(it["description"]), it["excerpt"]),
            "claim": text_or_blank(it["guid"]),
        },
    )
)

register(
    Provider(
        name="jobicy",
        source="jobicy",
        source_rank=4,
        ddl="jobs array<struct<url:string,jobTitle:string,companyName:string,jobGeo:string,"
        "jobExcerpt:string,pubDate:string>>",
        items=lambda parsed: parsed["jobs"],
        fields=lambda it, _: {
            "title": it["jobTitle"],
            "company_name": strip_or_blank(it["companyName"]),
            "location": it["jobGeo"],
            "remote": F.lit(True),
            "apply_url": it["url"],
            "posted_date": it["pubDate"],
            "posted_at": from_iso_text(it["pubDate"]),
            "description": it["jobExcerpt"],
        },
    )
)
