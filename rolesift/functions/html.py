"""Anchors of raw HTML text: one linear pass, no parser."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions.text import SPACE, strip

_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_HREF = r"""(?is)^[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
# The rest of a tag; quoted values may hold '>', an odd quote falls back to the next '>'.
_TAG_REST = r"""(?:(?:[^>"']++|"[^"]*"|'[^']*')*+>|[^>]*>)"""


_NBSP = r"&(?:nbsp|#0*160|#[xX]0*[aA]0);"
_REFERENCE = r"^(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*)"
_UNKNOWN = "\ufffd"


def _named_references() -> Column:
    """The names of HTML, with their semicolon where they need one, as a constant map. Lookups go
    through its keys in order, so the names that texts are full of come first."""
    common = {f"{name};": html5[f"{name};"] for name in ("amp", "nbsp", "quot", "lt", "gt", "apos")}
    entries = "\x01".join(f"{name}\x02{char}" for name, char in {**common, **html5}.items())
    return F.str_to_map(F.lit(entries), F.lit("\x01"), F.lit("\x02"))


def _numbered(ref: Column) -> Column:
    """The character of '#233' or '#xE9'; numbers of the C1 block are read as Windows code page 1252,
    and what is no character is the replacement character."""
    is_hex = ref.rlike("^#[xX]")
    digits = F.regexp_extract(ref, "^#[xX]?0*(.*)$", 1)
    short = F.concat(F.lit("0"), F.substring(digits, 1, 7))
    code = F.when(is_hex, F.conv(short, 16, 10)).otherwise(F.conv(short, 10, 10)).cast("int")
    utf32 = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
    remapped = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))
    broken = (F.length(digits) > 7) | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return (
        F.when(broken, _UNKNOWN)
        .when(code.between(0x80, 0x9F), F.substring(F.lit(remapped), code - 0x7F, F.lit(1)))
        .otherwise(utf32(code))
    )


def decode_entities(c: Column) -> Column:
    """Character references, decimal, hexadecimal and named, as their characters, each once.

    A missing semicolon is forgiven after numbers, and after the old names that HTML allows without
    one unless '=' follows, as in the query of a link. Other text stays as it is."""

    def decoded(piece: Column) -> Column:
        ref = F.regexp_extract(piece, _REFERENCE, 1)
        after = F.substring(piece, F.length(ref) + 1, F.lit(1))
        ended = after == ";"
        named = F.try_element_at(_named_references(), F.concat(ref, F.when(ended, ";").otherwise("")))
        char = (
            F.when(ref == "", F.lit(None).cast("string"))
            .when(ref.startswith("#"), _numbered(ref))
            .when(after != "=", named)
        )
        rest = F.substring(piece, F.length(ref) + F.when(ended, 2).otherwise(1), F.length(piece))
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), piece))

    pieces = F.split(c, "&")
    tail = F.transform(F.slice(pieces, 2, F.size(pieces)), decoded)
    return F.when(F.contains(c, F.lit("&")), F.concat(F.get(pieces, F.lit(0)), F.array_join(tail, ""))).otherwise(c)


def _inner_text(html: Column) -> Column:
    """Text nodes without tags, each stripped, put together without a separator."""
    nbsp = F.regexp_replace(html, _NBSP, "\u00a0")
    bare = F.regexp_replace(nbsp, rf"(?sU)[{SPACE}]*+<{_TAG_REST}[{SPACE}]*", "")
    return strip(decode_entities(bare))


def anchor_array(html: Column) -> Column:
    """All ``<a href>`` of a page in document order: array<struct<item_no,href,link_text>>.

    The text is cut at every anchor start and each piece ends at its closing tag or at the next
    anchor, so the work is linear in the page even when closing tags are missing.
    """

    def anchor(piece: Column, item_no: Column) -> Column:
        body = F.regexp_extract(F.regexp_replace(piece, f"(?s)^{_TAG_REST}", ""), r"(?is)^(.*?)(?:</a\s*>|$)", 1)
        href = F.regexp_replace(F.regexp_extract(piece, _HREF, 1), r"""^["']|["']$""", "")
        return F.struct(
            item_no.alias("item_no"),
            decode_entities(href).alias("href"),
            _inner_text(body).alias("link_text"),
        )

    pieces = F.split(F.regexp_replace(html, _HIDDEN, ""), r"(?i)<a(?=\s)")
    linked = F.filter(
        F.transform(pieces, lambda piece, i: F.struct(i.alias("i"), piece.alias("piece"))),
        lambda p: (p["i"] > 0) & (F.regexp_extract(p["piece"], _HREF, 1) != ""),
    )
    return F.transform(linked, lambda p: anchor(p["piece"], p["i"]))


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per anchor of a page: all columns but ``html``, plus item_no, href, link_text."""
    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, F.inline(anchor_array(F.col(html))))
