"""Bounded samples of labelled documents for fitting a model."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CLASSES = 1000
#: Bytes of text in a sample, shared evenly by its labels.
MAX_BYTES = 64 << 20


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds


def labelled_sample(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str,
    text_col: str,
    class_col: str,
    per_class: int,
    max_classes: int = MAX_CLASSES,
    max_bytes: int = MAX_BYTES,
) -> pa.Table:
    """text, label and n (rows of that label in all) of at most ``per_class`` documents of each label.

    ``labelled`` has an id and a label per row; rows with a null in either are left out, of several
    labels of one id the greatest counts. Of more than ``max_classes`` labels those with the most rows are
    taken (ties: the first by name). The ids with the least digests are taken, so the choice
    does not depend on the order of rows; of their texts, in that order, as many whole ones as fit into the
    label's share of ``max_bytes``, those left out that need more than a quarter of the share by themselves. The
    chosen ids are bounded in number, so that side may be broadcast.
    """
    rows = labelled.select(F.col(id_col).alias("_id"), F.col(class_col).alias("_label")).dropna()
    rows = rows.groupBy("_id").agg(F.max("_label").alias("_label"))
    sizes = rows.groupBy("_label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_label").limit(max_classes)
    sizes = sizes.collect()
    schema = pa.schema([("text", pa.string()), ("label", pa.string()), ("n", pa.int64())])
    if not sizes:
        return schema.empty_table()
    taken = docs.sparkSession.createDataFrame([tuple(s) for s in sizes], f"_label {rows.schema['_label'].dataType.simpleString()}, n long")
    digest = F.xxhash64(F.col("_id").cast("string"))
    by_digest = Window.partitionBy("_label").orderBy(digest, "_id")
    # row_number below a bound is cut in each task before the exchange
    first = rows.withColumn("_place", F.row_number().over(by_digest)).filter(F.col("_place") <= per_class)
    ids = first.join(F.broadcast(taken), "_label").select("_id", F.col("_label").cast("string").alias("label"), "n")
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    share = max_bytes // len(sizes)
    fitting = texts.join(F.broadcast(ids), "_id").filter(F.octet_length("text") * 4 <= share)
    once = fitting.groupBy("_id").agg(F.min(F.struct("text", "label", "n")).alias("r")).select("_id", "r.*")
    before = Window.partitionBy("label").orderBy(digest, "_id").rowsBetween(Window.unboundedPreceding, 0)
    once = once.withColumn("_bytes", F.sum(F.octet_length("text")).over(before)).filter(F.col("_bytes") <= share)
    return once.orderBy(digest, "_id").select("text", "label", "n").toArrow().cast(schema)
