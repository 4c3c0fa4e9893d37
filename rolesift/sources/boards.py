"""Company boards: one declared schema and mapping per provider."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift.functions.dates import stated
from rolesift.functions.text import blank_to_null, join_parts, text_or_blank
from rolesift.sources.registry import Provider, register


def _says_remote(*texts: Column) -> Column:
    flag = F.lit(False)
    for text in texts:
        flag = flag | F.lower(text_or_blank(text)).contains("remote")
    return flag


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


register(
    Provider(
        name="greenhouse",
        ddl="jobs array<struct<title:string,location:struct<name:string>,absolute_url:string,"
        "updated_at:string,content:string>>",
        items=lambda parsed: parsed["jobs"],
        fields=lambda it, _: {
            "title": it["title"],
            "location": it["location"]["name"],
            "remote": _says_remote(it["location"]["name"]),
            "apply_url": it["absolute_url"],
            "posted_date": it["updated_at"],
            "description": it["content"],
        },
    )
)

register(
    Provider(
        name="lever",
        ddl="array<struct<text:string,categories:struct<location:string,commitment:string>,"
        "hostedUrl:string,createdAt:string,descriptionPlain:string>>",
        items=lambda parsed: parsed,
        fields=lambda it, _: {
            "title": it["text"],
            "location": it["categories"]["location"],
            "remote": _says_remote(it["categories"]["location"], it["categories"]["commitment"]),
            "apply_url": it["hostedUrl"],
            "posted_date": stated(it["createdAt"]),  # epoch ms, as text
            "description": it["descriptionPlain"],
        },
    )
)

register(
    Provider(
        name="ashby",
        ddl="jobs array<struct<title:string,location:string,isRemote:boolean,jobUrl:string,"
        "publishedAt:string,descriptionHtml:string>>",
        items=lambda parsed: parsed["jobs"],
        fields=lambda it, _: {
            "title": it["title"],
            "location": it["location"],
            "remote": _flag(it["isRemote"]) | _says_remote(it["location"]),
            "apply_url": it["jobUrl"],
            "posted_date": it["publishedAt"],
            "description": it["descriptionHtml"],
        },
    )
)

register(
    Provider(
        name="workday",
        ddl="jobPostings array<struct<title:string,locationsText:string,externalPath:string,"
        "postedOn:string>>",
        items=lambda parsed: parsed["jobPostings"],
        # identifier is host/site
        accepts=lambda identifier: identifier.contains("/"),
        fields=lambda it, identifier: {
            "title": it["title"],
            "location": it["locationsText"],
            "remote": _says_remote(it["locationsText"]),
            "apply_url": F.concat(
                F.lit("https://"),
                F.substring_index(identifier, "/", 1),
                F.lit("/en-US/"),
                F.regexp_extract(identifier, r"^[^/]*/(.*)$", 1),
                text_or_blank(it["externalPath"]),
            ),
            "posted_date": it["postedOn"],
        },
    )
)

register(
    Provider(
        name="smartrecruiters",
        ddl="content array<struct<id:string,name:string,releasedDate:string,"
        "location:struct<city:string,country:string,remote:boolean>>>",
        items=lambda parsed: parsed["content"],
        fields=lambda it, identifier: {
            "title": it["name"],
            "location": join_parts(", ", it["location"]["city"], it["location"]["country"]),
            "remote": _flag(it["location"]["remote"]),
            "apply_url": F.concat(
                F.lit("https://jobs.smartrecruiters.com/"),
                identifier,
                F.lit("/"),
                text_or_blank(it["id"]),
            ),
            "posted_date": it["releasedDate"],
        },
    )
)

register(
    Provider(
        name="bamboohr",
        ddl="result array<struct<id:string,jobOpeningName:string,locationLabel:string,"
        "departmentLabel:string>>",
        items=lambda parsed: parsed["result"],
        fields=lambda it, identifier: {
            "title": it["jobOpeningName"],
            "location": it["locationLabel"],
            "remote": _says_remote(it["locationLabel"]),
            "apply_url": F.concat(
                F.lit("https://"),
                identifier,
                F.lit(".bamboohr.com/careers/"),
                text_or_blank(it["id"]),
            ),
            "description": it["departmentLabel"],
        },
    )
)

register(
    Provider(
        name="workable",
        ddl="jobs array<struct<title:string,city:string,country:string,url:string,"
        "shortlink:string,telecommuting:boolean,published_on:string,description:string>>",
        items=lambda parsed: parsed["jobs"],
        fields=lambda it, _: {
            "title": it["title"],
            "location": join_parts(", ", it["city"], it["country"]),
            "remote": _flag(it["telecommuting"]),
            "apply_url": F.coalesce(blank_to_null(it["url"]), it["shortlink"]),
            "posted_date": it["published_on"],
            "description": it["description"],
        },
    )
)

register(
    Provider(
        name="recruitee",
        ddl="offers array<struct<title:string,location:string,remote:boolean,published_at:string,"
        "careers_url:string,careers_apply_url:string,sharing_description:string>>",
        items=lambda parsed: parsed["offers"],
        fields=lambda it, _: {
            "title": it["title"],
            "location": it["location"],
            "remote": _flag(it["remote"]),
            "apply_url": F.coalesce(blank_to_null(it["careers_apply_url"]), it["careers_url"]),
            "posted_date": it["published_at"],
            "description": it["sharing_description"],
        },
    )
)

register(
    Provider(
        name="oracle_recruiting",
        ddl="items array<struct<requisitionList:array<struct<Id:string,Title:string,"
        "PostedDate:string,PrimaryLocation:string,WorkplaceType:string,"
        "ShortDescriptionStr:string>>>>",
        # get() yields null on an empty list where [0] would raise
        items=lambda parsed: F.get(parsed["items"], F.lit(0))["requisitionList"],
        # identifier is host|site
        accepts=lambda identifier: identifier.contains("|"),
        fields=lambda it, identifier: {
            "title": it["Title"],
            "location": it["PrimaryLocation"],
            "remote": _says_remote(it["WorkplaceType"], it["PrimaryLocation"]),
            "apply_url": F.concat(
                F.lit("https://"),
                F.substring_index(identifier, "|", 1),
                F.lit("/hcmUI/CandidateExperience/en/sites/"),
                F.regexp_extract(identifier, r"^[^|]*\|(.*)$", 1),
                F.lit("/job/"),
                text_or_blank(it["Id"]),
            ),
            "posted_date": it["PostedDate"],
            "description": it["ShortDescriptionStr"],
        },
    )
)
