"""Exact dedup by a tree-merge of sorted digest runs.

Every source partition sorts the digests of its texts into runs. A run's *owner* is a number with
``rounds`` digits in base ``fan_in``. In round r the owners that differ in digit r only exchange
slices: each keeps the slice of the digest space that its digit names, and merges the ``fan_in``
sorted slices it receives. After the last round each owner holds one range of the digest space.
Runs shrink at every level, since equal digests become one entry with the smallest id and a count,
so a text that fills a third of the corpus is one entry per run from the first level on. No task
ever holds more than about ``fan_in`` runs.

A run is ordered by a 64-bit digest; an entry is merged with another only if the full sha-256 and
the length in bytes agree too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.shared import staged

#: One entry of a run; byte order is fixed, since runs travel as bytes.
ENTRY = np.dtype(
    [("digest", "<u8"), ("sha", "S32"), ("n_bytes", "<i8"), ("no_id", "?"), ("keep", "<i8"),
     ("row", "<i8"), ("rows", "<i8")]
)
_RUN_DDL = "owner long, entries binary"


def normal_text(text: Column) -> Column:
    """White space runs as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _same_text(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left["digest"] == right["digest"]) & (left["sha"] == right["sha"]) & (left["n_bytes"] == right["n_bytes"])


def _order(rows: np.ndarray) -> np.ndarray:
    return np.lexsort((rows["row"], rows["keep"], rows["no_id"], rows["n_bytes"], rows["sha"], rows["digest"]))


def _one_entry_a_text(rows: np.ndarray) -> np.ndarray:
    """Neighbours that are one text as one entry, the first of them, with the rows of all."""
    if len(rows) == 0:
        return rows
    firsts = np.flatnonzero(np.concatenate([[True], ~_same_text(rows[1:], rows[:-1])]))
    merged = rows[firsts]
    merged["rows"] = np.add.reduceat(rows["rows"], firsts)
    return merged


def sorted_run(rows: np.ndarray) -> np.ndarray:
    """A run: entries in order of digest, sha and length, one for each text."""
    return _one_entry_a_text(rows[_order(rows)])


def merge_two(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Two runs as one. A binary search says where the entries of the shorter run go in the longer;
    only stretches of one digest, of at most one entry per text and run, are put in order."""
    if len(left) < len(right):
        left, right = right, left
    rows = np.empty(len(left) + len(right), dtype=ENTRY)
    places = np.searchsorted(left["digest"], right["digest"], side="right") + np.arange(len(right))
    from_left = np.ones(len(rows), dtype=bool)
    from_left[places] = False
    rows[places] = right
    rows[from_left] = left
    tied = np.zeros(len(rows), dtype=bool)
    tied[1:] = rows["digest"][1:] == rows["digest"][:-1]
    tied[:-1] |= tied[1:]
    stretch = rows[tied]
    rows[tied] = stretch[_order(stretch)]
    return _one_entry_a_text(rows)


def merge_runs(runs: list[np.ndarray]) -> np.ndarray:
    """Multiway merge of runs, neighbours first: equal texts become one entry with the smallest id
    and all rows."""
    if not runs:
        return np.zeros(0, dtype=ENTRY)
    while len(runs) > 1:
        runs = [merge_two(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def slice_of(digests: np.ndarray, fan_in: int, level: int) -> np.ndarray:
    """Digit ``level`` of the digests, as fractions of 2**64 written in base ``fan_in``; so the
    slices of a sorted run are contiguous."""
    bits = fan_in.bit_length() - 1
    shift = np.uint64(64 - bits * (level + 1))
    return ((digests.astype(np.uint64) >> shift) & np.uint64(fan_in - 1)).astype(np.int64)


def send(owner: int, run: np.ndarray, fan_in: int, level: int) -> list[tuple[int, bytes]]:
    """The slices of a run with the partner that each goes to in this round."""
    unit = fan_in**level
    base = owner - owner // unit % fan_in * unit
    digits = slice_of(run["digest"], fan_in, level)
    cuts = np.searchsorted(digits, np.arange(fan_in + 1))
    return [
        (base + digit * unit, run[cuts[digit] : cuts[digit + 1]].tobytes())
        for digit in range(fan_in)
        if cuts[digit] < cuts[digit + 1]
    ]


def _first_runs(fan_in: int, owners: int, run_rows: int):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = TaskContext.get().partitionId()
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            nonlocal owner
            sent = send(owner % owners, sorted_run(np.concatenate(held)), fan_in, 0)
            owner += 1
            held.clear()
            return pa.RecordBatch.from_pydict(
                {"owner": [o for o, _ in sent], "entries": [e for _, e in sent]},
                schema=pa.schema([("owner", pa.int64()), ("entries", pa.binary())]),
            )

        for batch in batches:
            rows = np.zeros(batch.num_rows, dtype=ENTRY)
            rows["digest"] = batch.column("digest").to_numpy(zero_copy_only=False).view(np.uint64)
            rows["sha"] = batch.column("sha").to_numpy(zero_copy_only=False)
            rows["n_bytes"] = batch.column("n_bytes").to_numpy(zero_copy_only=False)
            ids = batch.column("id")
            rows["no_id"] = ids.is_null().to_numpy(zero_copy_only=False)
            rows["keep"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
            rows["row"] = batch.column("row").to_numpy(zero_copy_only=False)
            rows["rows"] = 1
            held.append(rows)
            if sum(map(len, held)) >= run_rows:
                yield out()
        if held:
            yield out()

    return emit


def _exchange(fan_in: int, level: int):
    """Merge what an owner received and send the slices of the next round."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        run = merge_runs([np.frombuffer(bytes(e), dtype=ENTRY) for e in pdf["entries"]])
        sent = send(int(pdf["owner"].iloc[0]), run, fan_in, level)
        return pd.DataFrame(sent, columns=["owner", "entries"])

    return merge


def _last(pdf: pd.DataFrame) -> pd.DataFrame:
    run = merge_runs([np.frombuffer(bytes(e), dtype=ENTRY) for e in pdf["entries"]])
    # numpy drops trailing zero bytes of fixed strings
    return pd.DataFrame(
        {
            "digest": run["digest"].astype(np.uint64).view(np.int64),
            "sha": [s.ljust(32, b"\0") for s in run["sha"].tolist()],
            "n_bytes": run["n_bytes"].astype(np.int64),
            "keep_id": pd.arrays.IntegerArray(run["keep"].astype(np.int64), run["no_id"].astype(bool)),
            "keep_row": run["row"].astype(np.int64),
            "group_size": run["rows"].astype(np.int64),
        }
    )


def merge_tree(
    slim: DataFrame, n_rows: int, fan_in: int = 8, run_rows: int = 25_000
) -> DataFrame:
    """digest, sha, n_bytes, keep_id, keep_row, group_size: one row per text of ``slim``."""
    if fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("fan_in must be a power of two")
    rounds = 1
    while fan_in**rounds * run_rows < n_rows:
        rounds += 1
    owners = fan_in**rounds
    runs = slim.select("id", "row", "digest", "sha", "n_bytes").mapInArrow(
        _first_runs(fan_in, owners, run_rows), _RUN_DDL
    )
    for level in range(1, rounds):
        runs = runs.groupBy("owner").applyInPandas(_exchange(fan_in, level), _RUN_DDL)
    return runs.groupBy("owner").applyInPandas(
        _last, "digest long, sha binary, n_bytes long, keep_id long, keep_row long, group_size long"
    )


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fan_in: int = 8,
    run_rows: int = 25_000,
) -> DataFrame:
    """Which row of each group of equal texts stays.

    Texts are equal when identical after each run of white space (space, tab to carriage return)
    has become one space. Of equal texts the row with the smallest id stays.

    Returns one row per input row: ``<id_col>``, keep_id, group_size, kept, text_sha256,
    text_digest (xxhash64 of the normal text).

    * A null text counts as empty; empty texts are equal to each other.
    * A null id counts as larger than every other id, so such a row stays only if all rows of its
      group have null ids; keep_id is then null.
    * Repeated rows, also rows with one id: exactly one row of a group stays.
    * Other columns of ``docs`` are not read, so their names cannot clash.
    * An empty table gives an empty result.
    * Ids are read as long integers; one that is none counts as null.
    * A text is digested whole in the scan; however long, it is never shuffled.

    ``fan_in`` (a power of two) runs meet in each merge; a first run has about ``run_rows``
    entries, and the number of owners grows until a last run has no more.
    """
    text = normal_text(F.col(text_col))
    slim = docs.select(
        F.col(id_col).cast("long").alias("id"), text.alias("t")
    ).select(
        "id",
        F.xxhash64("t").alias("digest"),
        F.unhex(F.sha2("t", 256)).alias("sha"),
        F.octet_length("t").cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    # a chunk is a stretch of one source partition: the hottest text has at most run_rows rows in it
    slim = staged(slim.withColumn("chunk", F.floor(F.col("row") / run_rows)), "digests")
    merged = merge_tree(slim, slim.count(), fan_in, run_rows)

    key = ["digest", "sha", "n_bytes"]
    answers = slim.select("chunk", *key).distinct().join(merged, key)
    found = slim.join(answers, ["chunk", *key])
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("digest").alias("text_digest"),
    )
