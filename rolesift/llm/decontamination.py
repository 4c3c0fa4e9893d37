"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is ``size`` consecutive words of an item. A document contains it only if it contains each
of its words, so one word is a sufficient prefix: the rarest one over the whole corpus. The words of
the documents are joined with these prefix words alone; the place of the prefix in its window fixes
where the window would have to start; it must lie inside the text, and its words must be the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.filtering import text_digest
from rolesift.llm.shared import staged

#: On text as it stands: what would be a word once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows of the benchmark side that one broadcast holds: 30 MB or so. More rows go in several blocks.
BLOCK_ROWS = 200_000


def fold(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words_of(text: Column) -> Column:
    """The words of a text as they stand there; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """item_id, window (words joined by spaces), size: an item with fewer words is one window."""
    n = F.size("w")
    starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).when(n > 0, F.array(F.lit(1)))
    return (
        items.select(F.col(id_col).cast("string").alias("item_id"), words_of(fold(F.col(text_col))).alias("w"))
        .select("item_id", "w", F.explode(starts).alias("at"))
        .select(
            "item_id",
            F.array_join(F.slice("w", F.col("at"), F.lit(size)), " ").alias("window"),
            F.least(n, F.lit(size)).alias("size"),
        )
        .distinct()
    )


def _blocks(df: DataFrame, key: str) -> list[DataFrame]:
    """``df``, a written table, in parts that are small enough to broadcast."""
    n = -(-df.count() // BLOCK_ROWS)
    part = F.pmod(F.xxhash64(key), F.lit(n))
    return [F.broadcast(df.filter(part == i) if n > 1 else df) for i in range(max(1, n))]


def corpus_counts(docs: DataFrame, text_col: str, vocabulary: DataFrame) -> DataFrame:
    """word, n: how often each word of ``vocabulary`` stands in all documents."""
    words = docs.select(F.explode(words_of(F.col(text_col))).alias("w")).select(F.lower("w").alias("word"))
    counted = [words.join(part, "word").groupBy("word").agg(F.count("*").alias("n")) for part in _blocks(vocabulary, "word")]
    return reduce(DataFrame.unionAll, counted)


def prefix_index(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """word, offset, size, window: each window by the rarest of its words. A window with a word
    that no document has cannot occur and is left out."""
    places = windows.select("window", "size").distinct().select(
        "window", "size", F.posexplode(F.split("window", " ")).alias("offset", "w")
    ).withColumn("word", F.lower("w"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("p")
    chosen = places.join(counts, "word", "left").groupBy("window", "size").agg(rarest)
    return chosen.filter("p.n > 0").select("p.word", "p.offset", "size", "window")


def find_windows(docs: DataFrame, id_col: str, text_col: str, index: DataFrame) -> DataFrame:
    """row, id, digest (of the text), n_words and one row per occurrence of a window: start, size,
    window. Every document has one row more, whose start is null.

    Join keys are lower-cased by all of Unicode, which keeps the words apart where they were apart;
    the check of the whole window folds A-Z alone.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        text_digest(F.col(text_col)).alias("digest"),
        words_of(F.col(text_col)).alias("w"),
    ).withColumn("n_words", F.size("w"))
    end = F.array(F.lit(None).cast("string"))
    placed = rows.select(
        "row", "id", "digest", "w", "n_words", F.posexplode(F.concat("w", end)).alias("pos", "one")
    ).withColumn("word", F.lower("one"))
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    same = fold(F.array_join(F.slice("w", start + 1, F.col("size")), " ")) == F.col("window")
    is_end = F.col("one").isNull()
    found = []
    for i, part in enumerate(_blocks(index, "word")):
        joined = placed.join(part, "word", "left") if i == 0 else placed.join(part, "word")
        kept = (is_end | (inside & same)) if i == 0 else inside & same
        found.append(
            joined.filter(kept).select(
                "row", "id", "digest", "n_words", F.when(~is_end, start).alias("start"), "size", "window"
            )
        )
    return reduce(DataFrame.unionAll, found)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    size: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Which words of each document stand inside a benchmark window.

    Words are runs of letters and digits of ASCII and of all other characters, A-Z lower-cased.
    Returns one row per input row: ``<id_col>``, n_words, n_hit (words inside any occurrence of a
    window), n_items, items_sha256 (of the sorted ids of those items, comma-joined), contaminated,
    text_digest (xxhash64 of the text).

    * A null or empty text has no words and no hit; texts of any length are read whole.
    * An item without words, or a null one, has no window. An item with a null id marks words, but
      is neither counted nor named. Items repeated under one id count once.
    * A null document id stays null; repeated rows are judged one by one.
    * Other columns of either table are not read, so their names cannot clash.
    * No documents: an empty result. No items: every document is clean.
    """
    windows = staged(item_windows(items, item_id_col, item_text_col, size), "windows")
    vocabulary = staged(
        windows.select(F.explode(F.split("window", " ")).alias("w")).select(F.lower("w").alias("word")).distinct(),
        "vocabulary",
    )
    counts = corpus_counts(docs, text_col, vocabulary)
    index = staged(prefix_index(windows, counts), "prefixes")
    found = staged(find_windows(docs, id_col, text_col, index), "occurrences")

    hits = found.filter(F.col("start").isNotNull())
    covered = (
        hits.select("row", "start", "size").distinct()
        .select("row", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos"))
        .distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    )
    named = windows.filter(F.col("item_id").isNotNull()).select("window", "item_id")
    row_windows = hits.select("row", "window").distinct()
    pairs = reduce(DataFrame.unionAll, [row_windows.join(part, "window") for part in _blocks(named, "window")])
    of_row = pairs.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        found.filter(F.col("start").isNull())
        .select("row", "id", "digest", "n_words")
        .join(covered, "row", "left")
        .join(of_row, "row", "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n_words").cast("long").alias("n_words"),
            n_hit.alias("n_hit"),
            F.size(ids).cast("long").alias("n_items"),
            F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
            F.col("digest").alias("text_digest"),
        )
    )
