"""Boilerplate lines of a site, by their frequency relative to the site.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it, divided
by the number of the host's pages. Lines above a ratio are dropped from all pages of that host. The
pages that a ratio asks for grow with the host, so a number of pages can be set as well, above which
a line goes however large the host is.

A page gives each of its lines once, as a digest, so the counts are partial sums before they are
shuffled, however common a line is. A host's total is spread over salts for its join with the
host's lines. Texts meet the decisions about them in one join by page, where no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.filtering import free_name, text_digest
from rolesift.llm.shared import staged

WHITE = " \t\n\x0b\x0c\r"
SALTS = 32


def line_key(line: Column) -> Column:
    """A 128-bit digest of a line without white space at its ends; null for an empty line."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(bare != "", F.unhex(F.md5(bare)))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(lines: DataFrame, max_ratio: float, min_pages: int, max_pages: int | None = None) -> DataFrame:
    """host, line of what is above the ratio or ``max_pages``, from one row (host, lines) per page."""
    most = max_ratio * F.col("total")
    if max_pages is not None:
        most = F.least(most, F.lit(float(max_pages)))
    pages = lines.groupBy("host").agg(F.count("*").alias("total"))
    totals = pages.select("host", "total", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    counted = (
        lines.select("host", F.explode(F.array_distinct("lines")).alias("line"))
        .groupBy("host", "line").agg(F.count("*").alias("n"))
        .filter(F.col("line").isNotNull() & (F.col("n") >= min_pages))
        .withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(SALTS)).cast("int"))
    )
    return counted.join(totals, ["host", "salt"]).filter(F.col("n") > most).select("host", "line")


def drop_boilerplate(
    docs: DataFrame,
    host_col: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_ratio: float = 0.05,
    min_pages: int = 3,
    counts: tuple[str, str] = ("n_lines", "n_dropped"),
    max_pages: int | None = None,
) -> DataFrame:
    """``docs`` with boilerplate lines cut out of ``text_col``, and how many lines there were and went.

    Lines end at line feeds. They are compared without white space at their ends; a line on fewer
    than ``min_pages`` pages of its host is no boilerplate, so small hosts keep their texts. A line on
    more than ``max_pages`` pages of its host (None: no such bound) goes whatever its ratio.

    * Empty lines, and lines of white space, are neither counted nor dropped.
    * A null text stays null and has no lines, but counts as a page. A text all of whose lines go is
      empty.
    * Null hosts are one host. A null id is like any other; repeated rows each count as a page and
      are cut alike.
    * Columns named as in ``counts`` are replaced; all others stay. An empty table gives an empty one.
    """
    names = [free_name(docs.columns, f"__{n}") for n in ("id", "host", "digest", "bad")]
    id_key, host_key, digest, bad = names
    docs = docs.drop(*counts)
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))  # null is none of the others
    page_id = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    keys = [page_id, host, text_digest(F.col(text_col))]
    lines = staged(
        docs.select(
            *[k.alias(n) for k, n in zip(keys, ("id", "host", "digest"))],
            F.coalesce(F.transform(lines_of(F.col(text_col)), line_key), F.array().cast("array<binary>")).alias("lines"),
        ),
        "lines",
    )
    found = boilerplate(lines, max_ratio, min_pages, max_pages)
    hits = (
        lines.select("id", "host", "digest", F.explode(F.array_distinct("lines")).alias("line"))
        .join(found, ["host", "line"])
        .groupBy("id", "host", "digest").agg(F.collect_set("line").alias("bad"))
        .select(*[F.col(c).alias(n) for c, n in zip(("id", "host", "digest", "bad"), names)])
    )
    keyed = docs.withColumns(dict(zip(names, keys)))
    joined = keyed.join(hits, names[:3], "left")
    stays = lambda line: ~F.coalesce(F.array_contains(F.col(bad), line_key(line)), F.lit(False))
    own = lines_of(F.col(text_col))
    kept = F.when(F.col(bad).isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(own, stays), "\n"))
    some = lambda lines, test: F.coalesce(F.size(F.filter(lines, test)), F.lit(0)).cast("long")
    bare = lambda line: F.btrim(line, F.lit(WHITE)) != ""
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(some(own, bare))
    n_dropped = F.when(F.col(bad).isNull(), F.lit(0)).otherwise(some(own, lambda line: ~stays(line)))
    columns = [kept.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*columns, n_lines.cast("long").alias(counts[0]), n_dropped.cast("long").alias(counts[1]))
