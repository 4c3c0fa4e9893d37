"""Landed payloads to canonical postings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions.dates import within_window
from rolesift.functions.text import text_or_blank
from rolesift.operators.topk import first_k
from rolesift.schema import POSTING_COLUMNS
from rolesift.sources import boards, feeds  # noqa: F401  (fill the registry)
from rolesift.sources.pages import page_items
from rolesift.sources.registry import ITEM_FIELDS, PROVIDERS, RESPONSE_COLUMNS, Provider, item_columns

Step = Callable[[DataFrame], DataFrame]


def envelope(payloads: DataFrame) -> DataFrame:
    """The landed table with the optional columns filled in; failed responses give no rows."""
    absent = {
        "ordinal": F.lit(0),
        "company_name": F.lit(""),
        "company_priority": F.lit(""),
        "fetched_at": F.lit(None).cast("timestamp"),
    }
    for name, default in absent.items():
        if name not in payloads.columns:
            payloads = payloads.withColumn(name, default)
    landed = payloads.filter(F.col("http_status") == 200)
    return landed.select(
        "provider",
        "identifier",
        F.col("company_name").alias("response_company"),
        "company_priority",
        F.col("ordinal").alias("batch_no"),
        "fetched_at",
        F.xxhash64("provider", "identifier", "fetched_at", "body").alias("response_digest"),
        "body",
    )


def _mapped_items(provider: Provider) -> Column:
    """The items of one response as an array of canonical structs."""

    def mapped(item: Column, position: Column) -> Column:
        fields = provider.fields(item, F.col("identifier"))
        return F.struct(position.alias("item_no"), *item_columns(provider, fields))

    return F.transform(provider.items(provider.parse(F.col("body"))), mapped)


def parsed_items(landed: DataFrame, providers: Sequence[Provider]) -> DataFrame:
    """Items of JSON and XML providers, all of them in one scan.

    Each response is parsed and mapped by the branch of its provider, and the mapped items come
    out of one explode. However the landed table is laid out, a body is read once.
    """
    items = None
    for provider in providers:
        test = F.col("provider") == provider.name
        if provider.accepts is not None:
            test = test & provider.accepts(F.col("identifier"))
        array = _mapped_items(provider)
        items = F.when(test, array) if items is None else items.when(test, array)
    rows = landed.filter(F.col("provider").isin([p.name for p in providers]))
    return rows.select(*RESPONSE_COLUMNS, F.explode(items).alias("_item")).select(
        *RESPONSE_COLUMNS, "_item.*"
    )


def _fresh(since: Column | None) -> Column:
    """What a reader keeps of its items. Boards are not windowed."""
    return F.col("keep") & ((F.col("source_rank") == 0) | within_window(F.col("posted_at"), since))


def _canonical(items: DataFrame) -> DataFrame:
    """Name the columns of a posting; columns that an early step added go along."""
    is_feed = F.col("source_rank") > 0
    company = F.when(is_feed, F.col("company_name")).otherwise(F.col("response_company"))
    key = F.when(is_feed, "").otherwise(F.concat_ws("\x01", "response_company", "identifier"))
    named = items.withColumns(
        {
            "company_name": text_or_blank(company),
            "company_priority": text_or_blank(F.col("company_priority")),
            "board_key": key,
        }
    )
    carried = [c for c in POSTING_COLUMNS if c in named.columns]
    own = {*carried, *ITEM_FIELDS, *RESPONSE_COLUMNS, "_fresh"}
    return named.select(*carried, *[c for c in named.columns if c not in own])


def _routed(items: DataFrame, routes: DataFrame) -> DataFrame:
    """Items of the boards in ``routes``, each with the company that is fetched from there."""
    companies = routes.select(
        "provider", "identifier", F.col("company_name").alias("response_company"), "company_priority"
    )
    return items.drop("response_company", "company_priority").join(companies, ["provider", "identifier"])


def normalize(
    payloads: DataFrame,
    providers: Sequence[str] | None = None,
    since: Column | None = None,
    role_words: Sequence[str] = (),
    early: Step | None = None,
    routes: DataFrame | None = None,
) -> DataFrame:
    """Postings of the named providers (default: all that are registered).

    One branch for everything that is parsed, one for each provider that needs a first-wins step
    of its own. Every branch filters on ``provider``, so a table partitioned by it is pruned.

    ``early`` is a step on the items of one row each (the fields of an item and the columns of its
    response), ahead of every exchange: what it drops, say the descriptions once they are scored, is
    shuffled nowhere. It keeps all rows. ``routes`` (provider, identifier, company_name,
    company_priority) gives companies to the responses and drops those without one; responses
    become items in the scan, so the join carries items and no body.
    """
    chosen = [PROVIDERS[n] for n in (PROVIDERS if providers is None else providers)]
    landed = envelope(payloads)
    branches = []
    plain = [p for p in chosen if p.body != "html" and not p.claims]
    if plain:
        branches.append(parsed_items(landed, plain))
    branches += [page_items(landed, p, role_words) for p in chosen if p.body == "html"]
    settle = early or (lambda items: items)
    found = [settle(items.filter(_fresh(since))) for items in branches]
    for provider in chosen:
        if provider.body != "html" and provider.claims:
            # The claim spans all responses of a run and comes before the title and window tests.
            items = parsed_items(landed, [provider]).filter(F.col("claim") != "")
            tested = settle(items.withColumn("_fresh", F.coalesce(_fresh(since), F.lit(False))))
            found.append(first_k(tested, ["claim"], ["batch_no", "item_no", "response_digest"], 1).filter("_fresh"))
    if routes is not None:
        found = [_routed(items, routes) for items in found]
    return reduce(DataFrame.unionByName, [_canonical(items) for items in found])


def normalize_provider(
    payloads: DataFrame, name: str, since: Column | None = None, role_words: Sequence[str] = ()
) -> DataFrame:
    """Canonical postings of one provider."""
    return normalize(payloads, [name], since, role_words)
