"""URL rules in a sorted array of digests.

A rule is a host and a path prefix. The keys, 64-bit xxhash digests of ``host + path``, stand sorted
in a file that every executor memory-maps, next to the full strings. A URL is cut into all keys that
a rule for it could have; they are probed with one vectorised binary search per batch, and a hit
counts only if the stored string is the same, so digests that collide do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm.shared import new_path

#: Rules that one digest array may hold: it goes to every executor as a file of about 100 MB then.
MAX_RULES = 1_000_000


@dataclass(frozen=True)
class UrlRule:
    """``host`` and its subdomains, paths that start with ``path``; lower-case host."""

    host: str
    path: str
    verdict: str  # allow or block

    @property
    def key(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode())


def pack_rules(rules: list[UrlRule]) -> bytes:
    """The array file: counts, sorted digests, host lengths, verdicts, offsets, strings.

    Of rules with one key the blocking one counts."""
    strictest = {(r.key, len(r.host)): r for r in sorted(rules, key=lambda r: r.verdict == "block")}
    rows = sorted(strictest.values(), key=lambda r: (_digest(r.key), r.key, len(r.host)))
    texts = [r.key.encode() for r in rows]
    lengths = np.unique([len(r.path) for r in rows]).astype("<i8")
    return b"".join(
        [
            np.array([len(rows), len(lengths)], dtype="<i8").tobytes(),
            np.array([_digest(r.key) for r in rows], dtype="<u8").tobytes(),
            np.array([len(r.host) for r in rows], dtype="<i8").tobytes(),
            np.array([r.verdict == "block" for r in rows], dtype="<i8").tobytes(),
            np.cumsum([0, *map(len, texts)]).astype("<i8").tobytes(),
            lengths.tobytes(),
            b"".join(texts),
        ]
    )


class DigestArray:
    """A memory-mapped array file."""

    def __init__(self, file: str) -> None:
        raw = np.memmap(file, dtype=np.uint8, mode="r")
        n, n_lengths = raw[:16].view("<i8")
        at = 16

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            part = raw[at : at + 8 * count].view(kind)
            at += 8 * count
            return part

        self.digests = take(n, "<u8")
        self.host_chars = take(n, "<i8")
        self.blocks = take(n, "<i8")
        self.offsets = take(n + 1, "<i8")
        self.path_lengths = [int(x) for x in take(n_lengths, "<i8")]
        self.text = raw[at:]

    def candidates(self, host: str, path: str) -> list[tuple[str, int]]:
        """Keys of all rules that could fit, each with the length of its host."""
        hosts = [host[i:] for i in range(len(host)) if i == 0 or host[i - 1] == "."]
        cuts = [n for n in self.path_lengths if n <= len(path)]
        return [(h + path[:n], len(h)) for h in hosts for n in cuts]

    def probe(self, keys: list[tuple[str, int]]) -> np.ndarray:
        """The place of each key in the array, -1 if no rule has exactly this host and path."""
        found = np.full(len(keys), -1, dtype=np.int64)
        if not keys or not len(self.digests):
            return found
        wanted = np.array([_digest(k) for k, _ in keys], dtype=np.uint64)
        low = np.searchsorted(self.digests, wanted, side="left")
        high = np.searchsorted(self.digests, wanted, side="right")
        for i in np.flatnonzero(low < high):
            key, host_chars = keys[i][0].encode(), keys[i][1]
            for at in range(low[i], high[i]):
                stored = self.text[self.offsets[at] : self.offsets[at + 1]].tobytes()
                if stored == key and self.host_chars[at] == host_chars:
                    found[i] = at
                    break
        return found

    def key(self, at: int) -> str:
        return self.text[self.offsets[at] : self.offsets[at + 1]].tobytes().decode()


def _publish(spark: SparkSession, content: bytes) -> str:
    """Put the array file into the shared folder and hand it to every executor; its name there."""
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    path = f"{new_path(spark, 'rules')}/{name}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(target)
    try:
        for start in range(0, len(content), 1 << 20):
            out.write(content[start : start + (1 << 20)])
    finally:
        out.close()
    spark.sparkContext.addFile(fs.makeQualified(target).toString())
    return name


def judge_urls(
    pages: DataFrame,
    rules: list[UrlRule],
    id_col: str = "page_id",
    url_col: str = "url",
    otherwise: str = "allow",
) -> DataFrame:
    """The verdict of the longest rule that fits each URL.

    Returns one row per input row: ``<id_col>``, host, path, rule (its host and path; null if none
    fits), verdict (``allow`` or ``block``; ``otherwise`` if no rule fits).

    * A null URL or one without ``://`` has an empty host and path, and no rule fits it.
    * Length is that of host and path together; of two fitting rules of one length the one with
      the longer host wins. Of rules given twice with different verdicts the blocking one counts.
    * A null id stays null, repeated rows stay, other columns are not read.
    * No rules or an empty table: everything gets ``otherwise``, or the result is empty.
    * More than ``MAX_RULES`` rules raise an error: join a table of keys then.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"a digest array holds {MAX_RULES} rules at most")
    spark = pages.sparkSession
    name = _publish(spark, pack_rules(rules))
    slim = pages.select(
        F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    )
    id_type = slim.schema["id"].dataType.simpleString()

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            keys, owner = [], []
            for row, (host, path) in enumerate(zip(hosts, paths)):
                own = array.candidates(host, path) if host else []
                keys += own
                owner += [row] * len(own)
            best: list[tuple[int, int, int] | None] = [None] * batch.num_rows
            places = array.probe(keys)
            for i in np.flatnonzero(places >= 0):
                fit = (len(keys[i][0]), keys[i][1], int(places[i]))
                best[owner[i]] = max(best[owner[i]] or fit, fit)
            said = [otherwise if b is None else ("allow", "block")[array.blocks[b[2]]] for b in best]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("host"),
                    batch.column("path"),
                    pa.array([None if b is None else array.key(b[2]) for b in best], pa.string()),
                    pa.array(said, pa.string()),
                ],
                names=["id", "host", "path", "rule", "verdict"],
            )

    out = slim.mapInArrow(judge, f"id {id_type}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
