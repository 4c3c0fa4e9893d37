"""URL resolution of page links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift.functions.text import strip

_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"


def _drop_dots(path: Column) -> Column:
    """Remove '.' and '..' segments; runs only on paths that have a segment starting with a dot."""
    segments = F.split(path, "/")
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda kept, seg: F.when(seg == ".", kept)
        .when(seg == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(seg))),
    )
    tail = F.element_at(segments, -1).isin(".", "..")
    joined = F.array_join(F.when(tail, F.concat(walked, F.array(F.lit("")))).otherwise(walked), "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` as found on the page ``base``."""
    href = strip(href)
    origin = F.regexp_extract(base, _ORIGIN, 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    no_fragment = F.substring_index(base, "#", 1)
    no_query = F.substring_index(no_fragment, "?", 1)
    base_path = F.substr(no_query, F.length(origin) + F.lit(1))
    folder = F.coalesce(
        F.nullif(F.regexp_extract(base_path, r"^(.*/)[^/]*$", 1), F.lit("")), F.lit("/")
    )

    ref_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    ref_rest = F.substr(href, F.length(ref_path) + F.lit(1))
    # Blank segments inside a joined path go; a rooted path is used as it stands.
    rooted = href.startswith("/")
    joined = F.regexp_replace(F.concat(folder, ref_path), "/{2,}", "/")
    path = F.when(rooted, ref_path).otherwise(joined)
    path = F.when(path.contains("/."), _drop_dots(path)).otherwise(path)

    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("?"), F.concat(no_query, href))
        .when(href.startswith("#"), F.concat(no_fragment, href))
        .otherwise(F.concat(origin, path, ref_rest))
    )
