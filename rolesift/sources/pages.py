"""Raw pages to items: links of a hosted board and role-named anchors of any career page."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from rolesift.functions.html import anchor_array
from rolesift.functions.text import contains_any
from rolesift.functions.urls import resolve_url
from rolesift.sources.registry import RESPONSE_COLUMNS, Provider, item_columns, register

_MAX_LINK_TEXT = 120
_JOB_PATH = r"/jobs/\d+"
_BOARD_HOST = ".teamtailor.com"


def _first_per_url(pages: DataFrame, kept: Sequence[str], links: Column) -> DataFrame:
    """Links of each page, the first one of each URL. ``links`` is an array of (link_url, item_no,
    link_text); repeats go inside the row, so pages are never shuffled."""
    sorted_links = pages.select(*kept, F.array_sort(links).alias("_links"))
    first = F.filter(
        "_links",
        lambda x, i: (i == 0) | ~F.get(F.col("_links"), i - 1)["link_url"].eqNullSafe(x["link_url"]),
    )
    return sorted_links.select(*kept, F.inline(first))


def _link(url: Column, anchor: Column) -> Column:
    return F.struct(url.alias("link_url"), anchor["item_no"], anchor["link_text"])


def role_anchors(html: Column, role_words: Sequence[str]) -> Column:
    """The anchors of a page whose text names a role, before their targets are resolved.

    All that is needed of a page, so joins can carry this instead of the page."""

    def named(a: Column) -> Column:
        text = a["link_text"]
        size = F.length(text)
        return (size > 0) & (size <= _MAX_LINK_TEXT) & contains_any(F.lower(text), role_words)

    return F.filter(anchor_array(html), named)


def role_links(pages: DataFrame, page_url: str, html: str, role_words: Sequence[str]) -> DataFrame:
    """Anchors of any page whose text names a role, first per resolved URL of a page.

    ``html`` is the page, or its ``role_anchors``. Adds item_no, link_text, link_url to the other
    columns of ``pages``.
    """
    kept = [c for c in pages.columns if c != html]
    reduced = isinstance(pages.schema[html].dataType, ArrayType)
    wanted = F.col(html) if reduced else role_anchors(F.col(html), role_words)
    links = F.transform(wanted, lambda a: _link(resolve_url(F.col(page_url), a["href"]), a))
    return _first_per_url(pages, kept, links)


def board_links(pages: DataFrame, identifier: str, html: str, host: str = _BOARD_HOST) -> DataFrame:
    """Job links of a hosted board page; a link claims its URL even when its text is blank."""
    kept = [c for c in pages.columns if c != html]

    def target(a: Column) -> Column:
        own = F.concat(F.lit("https://"), F.col(identifier), F.lit(host), a["href"])
        return F.when(a["href"].startswith("http"), a["href"]).otherwise(own)

    wanted = F.filter(anchor_array(F.col(html)), lambda a: a["href"].rlike(_JOB_PATH))
    links = F.transform(wanted, lambda a: _link(target(a), a))
    return _first_per_url(pages, kept, links).filter(F.col("link_text") != "")


def page_items(landed: DataFrame, provider: Provider, role_words: Sequence[str]) -> DataFrame:
    """Items, like those of parsed responses, from responses whose body is a page."""
    pages = landed.filter(F.col("provider") == provider.name).select(*RESPONSE_COLUMNS, "body")
    links = provider.links(pages, role_words)
    fields = {
        "title": F.col("link_text"),
        "apply_url": F.col("link_url"),
        "remote": F.lower("link_text").contains("remote"),
    }
    return links.select(*RESPONSE_COLUMNS, "item_no", *item_columns(provider, fields))


def _page_provider(name: str, links: Callable[[DataFrame, Sequence[str]], DataFrame]) -> Provider:
    return register(
        Provider(name=name, ddl="", items=lambda parsed: parsed, fields=lambda it, _: {}, body="html", links=links)
    )


_page_provider("teamtailor", lambda pages, _: board_links(pages, "identifier", "body"))
_page_provider("generic", lambda pages, words: role_links(pages, "identifier", "body", words))
