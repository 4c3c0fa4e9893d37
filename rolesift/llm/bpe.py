"""Byte-level BPE with the tiktoken library: encoding, and decoding of raw bytes.

The ranks come from a local file of ``base64 rank`` lines. Long texts are cut before a plain space
after a character that is not white space, if the pattern is one of ``CUTTABLE``. None of their
matches spans such a cut: a space that is not first in its match follows white space, what may end a
match after other characters is line breaks and slashes, and look-ahead only looks right. Pieces are
encoded one by one, so memory follows the piece. With any other pattern a text is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm.arrays import slices

PIECE_CHARS = 1 << 16
_CASED = r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]"
_UNCASED = r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]"
_ENDING = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
_GAPS = r"|\s*[\r\n]+|\s+(?!\S)|\s+"
#: Patterns of GPT-2, cl100k and o200k, which the cut is safe for.
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CL100K = (
    r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*" + _GAPS
)
O200K = (
    rf"[^\r\n\p{{L}}\p{{N}}]?{_CASED}*{_UNCASED}+{_ENDING}|[^\r\n\p{{L}}\p{{N}}]?{_CASED}+{_UNCASED}*{_ENDING}"
    r"|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*" + _GAPS
)
CUTTABLE = frozenset([GPT2, CL100K, O200K])


def read_ranks(path: str) -> bytes:
    """The rank file as it is; some hundred kilobytes, fixed by the vocabulary."""
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    lines = (line.split() for line in ranks.splitlines() if line.strip())
    table = {base64.b64decode(token): int(rank) for token, rank in lines}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_pieces(text: str, most: int = PIECE_CHARS) -> list[str]:
    """Cut a text after at least ``most`` characters, always before a plain space that follows a
    character that is not white space. A stretch without such a place stays whole."""
    pieces, start, n = [], 0, len(text)
    while n - start > most:
        at = start + most
        while at < n and not (text[at] == " " and not text[at - 1].isspace()):
            at += 1
        pieces.append(text[start:at])
        start = at
    if start < n:
        pieces.append(text[start:])
    return pieces


def encode(tokenizer: tiktoken.Encoding, text: str, most: int = PIECE_CHARS) -> np.ndarray:
    """Token ids as little-endian unsigned 32-bit integers; no special tokens."""
    if len(text) <= most or tokenizer._pat_str not in CUTTABLE:
        return np.array(tokenizer.encode_ordinary(text), dtype="<u4")
    parts = [tokenizer.encode_ordinary(piece) for piece in safe_pieces(text, most)]
    return np.array([i for part in parts for i in part], dtype="<u4")


def decode(tokenizer: tiktoken.Encoding, ids: np.ndarray) -> bytes:
    """Raw bytes of the ids; a cut inside a character stays as it is."""
    return tokenizer.decode_bytes(ids.tolist())


def _ranks_on_executors(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_ranks(path))


def encode_texts(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    text_col: str = "text",
    ids_col: str = "token_ids",
) -> DataFrame:
    """Add ``ids_col``, the token ids of every whole text, as array<int>, to the given columns.

    A null text counts as empty and has no ids; a text of any length is encoded whole; repeated
    rows stay. A column that already has the name ``ids_col`` is replaced. An empty table gives an
    empty result. The driver reads ``rank_file`` once and broadcasts it (its size is that of the
    vocabulary)."""
    shared = _ranks_on_executors(docs.sparkSession, rank_file)
    docs = docs.drop(ids_col)
    ddl = F.lit(None).cast("array<int>").alias(ids_col)
    schema = docs.withColumn(ids_col, ddl).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(shared.value, pattern)
        for batch in slices(batches, text_col):
            ids = [encode(tokenizer, t or "") for t in batch.column(text_col).to_pylist()]
            flat = np.concatenate([np.zeros(0, dtype="<u4"), *ids]).astype(np.int32)
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield batch.append_column(ids_col, pa.ListArray.from_arrays(offsets, flat))

    return docs.mapInArrow(run, schema)


def encode_and_decode(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    text_col: str = "text",
    ids_col: str = "token_ids",
    digest_col: str = "decoded_sha256",
) -> DataFrame:
    """Replace ``text_col`` by ``ids_col``, the token ids as array<int>, and ``digest_col``, the lowercase hex
    sha-256 of the bytes that they decode to. The same as ``encode_texts`` and the digest of ``decode_ids``
    (nulls, long texts, repeated rows and empty tables too), but by one Python worker a task and without
    sending ids or texts back for it. Columns that already have one of the two names are replaced."""
    shared = _ranks_on_executors(docs.sparkSession, rank_file)
    docs = docs.drop(*{ids_col, digest_col} - {text_col})
    added = {ids_col: F.lit(None).cast("array<int>"), digest_col: F.lit(None).cast("string")}
    schema = docs.drop(text_col).withColumns(added).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(shared.value, pattern)
        for batch in slices(batches, text_col):
            ids = [encode(tokenizer, t or "") for t in batch.column(text_col).to_pylist()]
            digests = [hashlib.sha256(decode(tokenizer, i)).hexdigest() for i in ids]
            flat = np.concatenate([np.zeros(0, dtype="<u4"), *ids]).astype(np.int32)
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            batch = batch.drop_columns([text_col])
            batch = batch.append_column(ids_col, pa.ListArray.from_arrays(offsets, flat))
            yield batch.append_column(digest_col, pa.array(digests, pa.string()))

    return docs.mapInArrow(run, schema)


def decode_ids(
    encoded: DataFrame,
    rank_file: str,
    pattern: str,
    ids_col: str = "token_ids",
    bytes_col: str = "decoded",
) -> DataFrame:
    """Add ``bytes_col``, the raw bytes (binary) that ``ids_col`` stands for; null ids give empty
    bytes. The other columns stay; a column named ``bytes_col`` is replaced."""
    shared = _ranks_on_executors(encoded.sparkSession, rank_file)
    encoded = encoded.drop(bytes_col)
    schema = encoded.withColumn(bytes_col, F.lit(None).cast("binary")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(shared.value, pattern)
        for batch in batches:
            lists = batch.column(ids_col)
            out = [
                b"" if not ids.is_valid else decode(tokenizer, ids.values.to_numpy())
                for ids in lists
            ]
            yield batch.append_column(bytes_col, pa.array(out, pa.binary()))

    return encoded.mapInArrow(run, schema)


def round_trip(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode and decode every whole text in one pass.

    Returns one row per input row: ``<id_col>``, n_tokens, ids_sha256 (ids as little-endian
    unsigned 32-bit integers), decoded_sha256. Null and empty texts have no tokens; a null id stays
    null; repeated rows stay; other columns are not read."""
    shared = _ranks_on_executors(docs.sparkSession, rank_file)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(shared.value, pattern)
        for batch in slices(batches):
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode(tokenizer, text or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(decode(tokenizer, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()),
                 pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    out = slim.mapInArrow(
        run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return out.withColumnRenamed("id", id_col)
