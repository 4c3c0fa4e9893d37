"""The corpus pipeline: stages over documents, each written and read again by the next.

1. language ID: documents without a letter (or null) go, whatever profiles could be learned
2. exact dedup: of texts equal but for white space the smallest id stays
3. near dedup: of each component of near-duplicates one document stays
4. decontamination: documents with words of a benchmark window go
5. BPE: token ids, and the digest of what they decode to
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm.bpe import encode_and_decode
from rolesift.llm.decontamination import decontaminate
from rolesift.llm.exact_dedup import exact_duplicates, normal_text
from rolesift.llm.filtering import drop_all, free_name, keep_one, text_digest
from rolesift.llm.jaccard_join import near_duplicates
from rolesift.llm.language_id import UNDETERMINED, UNKNOWN, with_language
from rolesift.llm.shared import staged

RANKS = "byte_bpe_multi_50k.tiktoken"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every document that has a letter, and its columns as they are. Profiles reject nothing, and
    a corpus that none can be learned from loses no more than any other."""
    pred, score = free_name(docs.columns, "__lang_pred"), free_name(docs.columns, "__score")
    judged = with_language(docs, out=(pred, score), unlearned=UNKNOWN)
    return judged.filter(F.col(pred) != UNDETERMINED).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of equal texts; of rows with one id and equal texts any one."""
    kept = exact_duplicates(docs).filter("kept")
    digest = F.xxhash64(normal_text(F.col("text")))
    return keep_one(docs, kept, "doc_id", digest, "text_digest").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component; documents without words are components of their own."""
    kept = near_duplicates(docs).filter("kept")
    return keep_one(docs, kept, "doc_id", text_digest(F.col("text")), "text_digest").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a word inside an occurrence of a benchmark window."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontaminate(docs, items).filter("contaminated")
    return drop_all(docs, hit, "doc_id", text_digest(F.col("text")), "text_digest").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids, decoded_sha256 (of the bytes the ids stand for)."""
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    encoded = encode_and_decode(docs.select("doc_id", "lang", "source", "text"), ranks, pattern)
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        "decoded_sha256",
    )


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", without_benchmark),
    ("byte_bpe", tokens),
]

#: Learned profiles and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *firsts, (_, last) = STAGES
    for name, stage in firsts:
        docs = staged(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
