"""Builders of small inputs."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from rolesift.schema import PAGE_DDL, PAYLOAD_DDL
from rolesift.settings import Profile, Roles

PROFILE = Profile(3, ("India", "Remote"), "strong", ("python", "llm", "rag", "pytorch"))
ROLES = Roles(
    include=("AI Engineer", "Machine Learning Engineer"),
    exclude=("frontend", " hr "),
    internship_words=("intern",),
)
FETCHED = datetime(2026, 7, 30, 12, tzinfo=timezone.utc)

POSTING_DDL = (
    "company_name string, title string, location string, description string, remote boolean, "
    "apply_url string, source string, ats_platform string, posted_date string, "
    "company_priority string, fetched_at timestamp, source_rank int, board_key string, "
    "batch_no int, item_no int, response_digest bigint"
)


def postings(spark, *rows):
    """Rows are dicts; item_no counts up, so the list order is the arrival order."""
    base = dict(
        company_name="Acme",
        title="AI Engineer",
        location="",
        description="",
        remote=False,
        apply_url="u",
        source="company_ats",
        ats_platform="lever",
        posted_date=None,
        company_priority="",
        fetched_at=FETCHED,
        source_rank=0,
        board_key="b",
        batch_no=0,
        response_digest=0,
    )
    names = [part.split()[0] for part in POSTING_DDL.split(", ")]
    data = []
    for i, row in enumerate(rows):
        full = {**base, "item_no": i, **row}
        data.append(tuple(full[n] for n in names))
    return spark.createDataFrame(data, POSTING_DDL)


def payloads(spark, *rows):
    base = dict(
        identifier="acme", company_name="Acme", query=None, ordinal=0, http_status=200, error=None,
        body="", fetched_at=FETCHED,
    )
    names = [part.split()[0] for part in PAYLOAD_DDL.split(", ")]
    return spark.createDataFrame(
        [tuple({**base, **row}[n] for n in names) for row in rows], PAYLOAD_DDL
    )


def pages(spark, *rows):
    base = dict(
        company_name="Acme", page_url="https://acme.com/careers", final_url="https://acme.com/careers",
        http_status=200, error=None, html="",
    )
    names = [part.split()[0] for part in PAGE_DDL.split(", ")]
    return spark.createDataFrame([tuple({**base, **row}[n] for n in names) for row in rows], PAGE_DDL)


def values(spark, expression, inputs, ddl="v string"):
    """Evaluate expression(F.col('v')) over the inputs, in order."""
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, {ddl}").repartition(2)
    out = df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()
    return [r.o for r in out]
