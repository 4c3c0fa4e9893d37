"""Provider registry: declared payload schema plus a column mapping per provider."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions.text import strip_or_blank, text_or_blank

# What a mapping yields for one item; absent keys get the default.
ITEM_FIELDS: dict[str, tuple[str, object]] = {
    "title": ("string", ""),
    "company_name": ("string", None),  # null: the company of the response
    "location": ("string", ""),
    "remote": ("boolean", False),
    "apply_url": ("string", ""),
    "posted_date": ("string", None),
    "posted_at": ("timestamp", None),
    "description": ("string", ""),
    "claim": ("string", None),  # first row per claim wins, before any other test
    "keep": ("boolean", True),
}


@dataclass(frozen=True)
class Provider:
    """How one provider's response becomes items.

    ``items`` takes the parsed body to an array; ``fields`` maps one item to canonical columns,
    given the identifier column of the response.
    """

    name: str
    ddl: str
    items: Callable[[Column], Column]
    fields: Callable[[Column, Column], dict[str, Column]]
    source: str = "company_ats"
    source_rank: int = 0
    body: str = "json"  # json | xml | html
    accepts: Callable[[Column], Column] | None = None  # test on the identifier
    claims: bool = False  # repeats of an item's claim are dropped across responses
    blank_titles: bool = False  # the mapping tests titles itself
    # html only: pages (RESPONSE_COLUMNS and body) and role words to item_no, link_text, link_url
    links: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None

    @property
    def is_feed(self) -> bool:
        return self.source_rank > 0

    @property
    def platform(self) -> str | None:
        return None if self.is_feed else self.name

    def parse(self, body: Column) -> Column:
        return F.from_xml(body, self.ddl) if self.body == "xml" else F.from_json(body, self.ddl)


PROVIDERS: dict[str, Provider] = {}

# Columns of the response that go with each item.
RESPONSE_COLUMNS = (
    "provider",
    "identifier",
    "response_company",
    "company_priority",
    "batch_no",
    "fetched_at",
    "response_digest",
)


def item_columns(provider: Provider, fields: dict[str, Column]) -> list[Column]:
    """The mapped fields of an item with types and defaults, plus the constants of its provider."""

    def value(name: str) -> Column:
        dtype, default = ITEM_FIELDS[name]
        column = fields.get(name, F.lit(default))
        if name == "title":
            column = strip_or_blank(column)
        elif dtype == "string" and default == "":
            column = text_or_blank(column)
        return column.cast(dtype)

    columns = {name: value(name) for name in ITEM_FIELDS}
    if not provider.blank_titles:
        columns["keep"] = columns["keep"] & (columns["title"] != "")
    columns["source"] = F.lit(provider.source)
    columns["ats_platform"] = F.lit(provider.platform).cast("string")
    columns["source_rank"] = F.lit(provider.source_rank)
    return [column.alias(name) for name, column in columns.items()]


def register(provider: Provider) -> Provider:
    """Add or replace a provider; normalize() and routing look it up by name."""
    PROVIDERS[provider.name] = provider
    return provider


def board_names() -> list[str]:
    """Providers a company can be routed to."""
    return [p.name for p in PROVIDERS.values() if not p.is_feed and p.name != "generic"]
