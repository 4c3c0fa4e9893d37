"""Documents whose word shingles overlap, by an n-gram Jaccard join.

A document is its set of distinct shingles. Two sets are linked when their Jaccard similarity
reaches ``percent``. The join is exact up to 64-bit digests of shingles, and goes like this:

1. *Count.* Chunks of documents send their distinct shingles, each with the number of documents in
   the chunk that have it, to ranges of the digest space. A range sums these numbers and answers each
   chunk with the totals of the shared shingles alone: a shingle of one document can link nothing.
   Which documents have a shingle stays with the chunk, so a hot one is one entry per chunk in its
   range. A document too few of whose shingles are shared has no partner and leaves here. Equal sets
   are one class from here on; copies in a chunk send nothing.
2. *Index.* Shingles are ordered by rarity. Of n shingles a partner shares ``need`` at least, so the
   first two shared ones are among the first n - need + 2, the extended prefix. It is what a
   document is indexed under.
3. *Star rounds.* Under each shingle all members are held against one drawn leader (later against some, as
   far as their labels still differ), and those that verify are linked with it. A label is the component that the links so far make, so families of
   near-copies come under one label without their pairs ever being made. A shingle all of whose
   documents have one label has no new link to offer and leaves the index.
4. *Join.* What is left is joined in full, documents of one label excepted: under each shingle only those
   outside its largest label ask for partners. A shingle that would
   make few pairs is indexed by itself; a pair of sets that shares none of these in its first two
   shares two frequent ones, so those are indexed by their combinations of two. Two kinds of sets
   are joined by single frequent ones: large ones, whose combinations would be too many, and, up to 50 percent,
   those that need only one common shingle.
5. *Verify.* Pairs that pass the bounds on length and position are verified by intersecting both
   sets. Links make components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.arrays import (
    SLICE_ROWS, WHITE, chain_digests, mix, of_texts, slices, text_bytes, word_bounds, word_digests,
)
from rolesift.llm.components import components
from rolesift.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from rolesift.llm.shared import discard, staged

#: Shingles of a chunk, and of a range: what one task holds at a time.
CHUNK_SHINGLES = 800_000
CHUNK_DOCS = 1 << 16
#: Pairs that a shingle may make in the join by itself; beyond that it counts as frequent.
RARE_PAIRS = 1 << 20
#: Star rounds go on while the join would make more pairs than there are documents times this, and each
#: round after the second halves them at least.
PAIRS_PER_DOC = 20
STAR_ROUNDS = 6
#: Leaders that are drawn under a shingle from the second round on, for those that the first one left out.
LEADERS = 8
#: Sets with more shingles are joined by single frequent ones: combinations grow with the square of a prefix.
LARGE_SET = 1_000
#: Earlier keys that a row of the join carries, so that a pair is made under its first common key, not under all.
EARLIER = 48

_MESSAGE = "key long, chunk long, a binary, b binary, c binary, d binary, e binary, f binary"
_U = np.uint64


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle digests of each text, ascending, and where each text's begin.

    Fewer than ``size`` words are one shingle as a whole; no words, no shingle."""
    body, starts = text_bytes(texts)
    begins, ends = word_bounds(~WHITE[body], starts[:-1])
    words = word_digests(body, begins, ends)
    bounds = of_texts(begins, starts)
    lengths = np.diff(bounds)
    chains = chain_digests(words, size)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    inside = owner[: len(chains)] == owner[size - 1 :] if len(chains) else np.zeros(0, bool)
    digests, owners = [chains[inside]], [owner[: len(chains)][inside]]
    for text in np.flatnonzero((lengths > 0) & (lengths < size)):
        digests.append(chain_digests(words[bounds[text] : bounds[text + 1]], int(lengths[text])))
        owners.append(np.array([text]))
    digest, owner = np.concatenate(digests), np.concatenate(owners)
    order = np.lexsort((digest, owner))
    digest, owner = digest[order], owner[order]
    first = np.ones(len(digest), dtype=bool)
    first[1:] = (digest[1:] != digest[:-1]) | (owner[1:] != owner[:-1])
    digest, owner = digest[first], owner[first]
    return digest, np.searchsorted(owner, np.arange(len(lengths) + 1))


def set_prints(digests: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set; equal sets have equal ones."""
    out = []
    for salt in (0x51, 0xA7):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(digests + _U(salt)), dtype=_U)])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _range_of(digests: np.ndarray, ranges: int) -> np.ndarray:
    """Even stretches of the digest space, by the high 32 bits."""
    return ((digests >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)


def _send_shingles(size: int, ranges: int):
    """Rows to ranges (key: the range; a: distinct digests, b: documents of the chunk that have each,
    c: how many of the chunk's digests come before) and one row per chunk (negative key) that lists
    its documents (a to d), and by digest how many (e) and which (f) documents have it."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 20
        digests, places, docs, held = [], [], [], 0
        seen: set[tuple[int, int, int]] = set()

        def out() -> pa.RecordBatch:
            nonlocal chunk, held
            digest = np.concatenate([*digests, np.zeros(0, _U)])
            place = np.concatenate([*places, np.zeros(0, np.int32)]).astype(np.int32)
            order = np.argsort(digest, kind="stable")
            digest, place = digest[order], place[order]
            starts = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]])[: len(digest)])
            local = np.diff(starts, append=len(digest))
            digest = digest[starts]
            cuts = np.searchsorted(_range_of(digest, ranges), np.arange(ranges + 1)).tolist()
            rows = [
                (r, chunk, pack_sorted(digest[x:y]), pack(local[x:y]), pack(np.array([x])), None, None, None)
                for r, (x, y) in enumerate(zip(cuts[:-1], cuts[1:]))
                if y > x
            ]
            ids, *columns = zip(*docs)
            counts, one, two, raw, first = (np.concatenate(c) for c in columns)
            listed = np.stack([one, two, raw]).astype("<i8").tobytes()
            lists = _ids(ids), counts.astype("<i8").tobytes(), listed, first.astype(np.int8).tobytes()
            rows.append((-1 - chunk, chunk, *lists, pack(local), pack(place)))
            digests.clear(), places.clear(), docs.clear(), seen.clear()
            chunk, held = chunk + 1, 0
            names = [part.split()[0] for part in _MESSAGE.split(", ")]
            return pa.RecordBatch.from_pylist(
                [dict(zip(names, row)) for row in rows],
                schema=pa.schema([(n, pa.int64() if n in ("key", "chunk") else pa.binary()) for n in names]),
            )

        for batch in slices(batches):
            own, bounds = shingle_sets(batch.column("text"), size)
            counts = np.diff(bounds)
            one, two = set_prints(own, bounds)
            first = np.zeros(len(counts), dtype=bool)  # of equal sets in a chunk only the first sends
            for i, print_ in enumerate(zip(one.tolist(), two.tolist(), counts.tolist())):
                if print_[2] and print_ not in seen:
                    seen.add(print_)
                    first[i] = True
            base = sum(len(d[1]) for d in docs)
            keep = np.repeat(first, counts)
            digests.append(own[keep])
            places.append(np.repeat(np.arange(len(counts), dtype=np.int32) + base, counts)[keep])
            raw = [xxhash.xxh64_intdigest((t or "").encode(), 42) for t in batch.column("text").to_pylist()]
            docs.append((batch.column("id"), counts, one, two, np.array(raw, dtype=_U).view(np.int64), first))
            held += int(keep.sum())
            if held >= CHUNK_SHINGLES or base + len(counts) + SLICE_ROWS > CHUNK_DOCS:
                yield out()
        if docs:
            yield out()

    return emit


def _ids(ids: tuple[pa.Array, ...]) -> bytes:
    """Ids as bytes, then a flag each for null."""
    values = pa.concat_arrays(ids)
    null = values.is_null().to_numpy(zero_copy_only=False).astype(np.int8)
    return values.fill_null(0).to_numpy().astype("<i8").tobytes() + null.tobytes()


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """A range: answer every chunk with its shared shingles (a: number of the shingle in the range,
    b: place among the chunk's digests, c: documents that have it). Lists of documents pass through."""
    key = int(pdf["key"].iloc[0])
    if key < 0:
        return pdf
    digest = [unpack_sorted(a) for a in pdf["a"]]
    sizes = [len(d) for d in digest]
    digest = np.concatenate(digest)
    local = np.concatenate([unpack(b) for b in pdf["b"]]).astype(np.int64)
    order = np.argsort(digest, kind="stable")
    digest = digest[order]
    first = np.concatenate([[True], digest[1:] != digest[:-1]])
    total = np.add.reduceat(local[order], np.flatnonzero(first))
    shared = total >= 2
    number = np.cumsum(shared) - 1
    of = np.empty(len(order), dtype=np.int64)  # each entry's digest, in the order of the messages
    of[order] = np.cumsum(first) - 1
    rows = []
    ends = np.cumsum(sizes)
    for chunk, before, x, y in zip(pdf["chunk"].tolist(), pdf["c"], (ends - sizes).tolist(), ends.tolist()):
        own = of[x:y]
        at = np.flatnonzero(shared[own])
        if len(at):
            own, at = own[at], at + int(unpack(before)[0])
            rows.append((key, chunk, pack_sorted(number[own]), pack_sorted(at), pack(total[own]), None, None, None))
    return pd.DataFrame(rows, columns=list(pdf.columns))


def _gather(percent: int):
    """A chunk: one row per document; set and prefix of those with enough shared shingles."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        listed = pdf[pdf["key"] < 0].iloc[0]
        answers = pdf[pdf["key"] >= 0].sort_values("key")
        n = np.frombuffer(listed["b"], dtype="<i8")
        raw = listed["a"]
        ids = np.frombuffer(raw, dtype="<i8", count=len(n))
        null = np.frombuffer(raw, dtype=np.int8, offset=8 * len(n)) == 1
        prints = np.frombuffer(listed["c"], dtype="<i8").reshape(3, -1)
        sends = np.frombuffer(listed["d"], dtype=np.int8) == 1
        tokens = [unpack_sorted(a) + (_U(k) << _U(32)) for k, a in zip(answers["key"], answers["a"])]
        token = np.concatenate([*tokens, np.zeros(0, _U)])
        at = np.concatenate([*[unpack_sorted(b) for b in answers["b"]], np.zeros(0, _U)]).astype(np.int64)
        count = np.concatenate([*[unpack(c) for c in answers["c"]], np.zeros(0, _U)])
        # an answer stands for all documents of the chunk that have the shingle
        local = unpack(listed["e"]).astype(np.int64)
        holders = local[at]
        begins = (np.cumsum(local) - local)[at] - (np.cumsum(holders) - holders)
        place = unpack(listed["f"]).astype(np.int64)[np.repeat(begins, holders) + np.arange(holders.sum())]
        token, count = np.repeat(token, holders), np.repeat(count, holders)
        order = np.lexsort((token, count, place))
        token, place = token[order], place[order]
        cuts = np.searchsorted(place, np.arange(len(n) + 1))
        shared = np.diff(cuts)
        need = -(-percent * n // 100)
        sets, prefixes, maps = [None] * len(n), [None] * len(n), np.zeros((len(n), 4), dtype=np.int64)
        # above 50, sets of one shingle are linked only with equal ones
        least = np.maximum(need, 1 if percent <= 50 else 2)
        for i in np.flatnonzero(sends & (shared >= least)).tolist():
            own = token[cuts[i] : cuts[i + 1]]
            prefixes[i] = own[: max(0, shared[i] - need[i] + 2)].view(np.int64)
            sets[i] = pack_sorted(np.sort(own))
            odd = np.bincount((mix(own.astype(_U)) >> _U(56)).astype(np.int64), minlength=256) % 2
            maps[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")
        chunk = int(listed["chunk"])
        return pd.DataFrame(
            {
                "node": (chunk << 16) + np.arange(len(n)),
                "id": pd.arrays.IntegerArray(ids.copy(), null),
                "n": n,
                "print_1": prints[0],
                "print_2": prints[1],
                "digest": prints[2],
                "sends": sends,
                "unshared": n - shared,
                **{f"m{k}": maps[:, k] for k in range(4)},
                "tokens": sets,
                "prefix": prefixes,
            }
        )

    return gather


_NODES = (
    "node long, id long, n long, print_1 long, print_2 long, digest long, sends boolean, unshared long, "
    "m0 long, m1 long, m2 long, m3 long, tokens binary, prefix array<long>"
)


def shingle_nodes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """A written table with one row per document; see ``_NODES``."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_bytes = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(16, int(n_bytes / 6 / CHUNK_SHINGLES) + 1)
    sent = slim.mapInArrow(_send_shingles(size, ranges), _MESSAGE)
    counted = sent.groupBy("key").applyInPandas(_count, _MESSAGE)
    return staged(counted.groupBy("chunk").applyInPandas(_gather(percent), _NODES), "nodes")


def _possible(percent: int, a: str, b: str) -> Column:
    """The bounds on length, on position and on difference.

    What two sets that share this shingle can share at most must be enough; places count all shingles, the
    unshared ones first. And they must not differ too much: unshared shingles are in one of two sets, and
    a bit of their maps (the parity of the shared shingles that fall on it) differs only if a shingle does."""
    n_a, n_b, at_a, at_b = (F.col(f"{x}.{c}") for c in ("n", "at") for x in (a, b))
    most = F.least(at_a, at_b) + F.least(n_a - at_a, n_b - at_b)
    apart = F.col(f"{a}.bits.unshared") + F.col(f"{b}.bits.unshared")
    for k in range(4):
        apart = apart + F.bit_count(F.col(f"{a}.bits.m{k}").bitwiseXOR(F.col(f"{b}.bits.m{k}")))
    return (
        (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b))
        & ((100 + percent) * most >= percent * (n_a + n_b))
        & ((100 + percent) * apart <= (100 - percent) * (n_a + n_b))
    )


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = lru_cache(maxsize=1_024)(unpack_sorted)  # pairs of one document come together
        for batch in batches:
            n_a, n_b = (batch.column(c).to_pylist() for c in ("n_a", "n_b"))
            t_a, t_b = batch.column("t_a"), batch.column("t_b")
            keep = []
            for i in range(batch.num_rows):
                x, y = unpacked(t_a[i].as_py()), unpacked(t_b[i].as_py())
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (n_a[i] + n_b[i] - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "n_a", "n_b", "t_a", "t_b").mapInArrow(check, "a long, b long")


def _labels(sets: DataFrame, links: DataFrame) -> DataFrame:
    """node, comp: the component that the links so far put a document into."""
    found = components(links)
    every = sets.select("node").join(found, "node", "left")
    return staged(every.select("node", F.coalesce("component", "node").alias("comp")), "labels")


def _with_labels(index: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Refresh ``comp`` and drop shingles whose documents all have one label."""
    fresh = index if labels is None else index.drop("comp").join(labels, "node")
    fresh = fresh.select("token", "node", "n", "at", "bits", "comp")
    apart = fresh.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most"))
    apart = apart.filter("least <> most").select("token")
    return staged(fresh.join(apart, "token", "left_semi"), "index")


def _pairs_to_make(index: DataFrame) -> DataFrame:
    """token, pairs: pairs of documents of different labels under each shingle."""
    per = index.groupBy("token", "comp").agg(F.count("*").alias("k"))
    total = per.groupBy("token").agg(F.sum("k").alias("g"), F.sum(F.col("k") * F.col("k")).alias("s"))
    return total.select("token", ((F.col("g") * F.col("g") - F.col("s")) / 2).cast("long").alias("pairs"))


def _with_sides(index: DataFrame) -> DataFrame:
    """Add ``minor``: whether a document is outside the label that most documents of its shingle have.

    Of two documents with different labels one at least is minor, so a join may ask for minor ones only: members
    of a large family are held against outsiders, and never against each other."""
    sizes = index.groupBy("token", "comp").agg(F.count("*").alias("k"))
    major = sizes.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"))
    return index.join(major, "token").withColumn("minor", F.col("comp") != F.col("major")).drop("major")


def _with_earlier(index: DataFrame) -> DataFrame:
    """Add ``earlier``: the first ``EARLIER`` tokens of the document here that come before this one.

    Tokens are in the same order in all documents. Of two documents, the first token they share has no common
    earlier ones, so a pair is made there; where they share an earlier one, it need not be made again."""
    per_doc = index.groupBy("node", "n", "comp").agg(
        F.first("bits").alias("bits"), F.sort_array(F.collect_list(F.struct("at", "token", "minor"))).alias("f")
    )
    each = per_doc.select("node", "n", "comp", "bits", "f", F.posexplode("f").alias("i", "own"))
    earlier = F.slice("f.token", F.lit(1), F.least("i", F.lit(EARLIER))).alias("earlier")
    return each.select("own.token", "node", "n", "own.at", "bits", "comp", "own.minor", earlier)


def _joined(index: DataFrame, keys: list[str], percent: int, above: int = 0) -> DataFrame:
    """Pairs of documents of different labels that share a key and pass the bounds, one of them with more
    than ``above`` shingles."""
    x, y = index.filter("minor").alias("x"), index.alias("y")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
    once = ~F.col("y.minor") | (F.col("x.node") < F.col("y.node"))
    apart = F.col("x.comp") != F.col("y.comp")
    large = F.greatest("x.n", "y.n") > above
    on += [~F.arrays_overlap("x.earlier", "y.earlier")] if "earlier" in index.columns else []
    pairs = x.join(y, [*on, once, apart, large, _possible(percent, "x", "y")])
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def find_links(
    nodes: DataFrame,
    percent: int,
    rare_pairs: int = RARE_PAIRS,
    star_rounds: int | None = None,
    large_set: int = LARGE_SET,
) -> DataFrame:
    """Links (a, b) between class representatives, enough to connect whatever is connected. With no
    star rounds every representative has a label of its own, no pair is skipped, and it is all links."""
    cand = nodes.filter(F.col("tokens").isNotNull())
    rep = cand.groupBy("print_1", "print_2", "n").agg(F.min("node").alias("node"))
    sets = staged(
        cand.join(rep.select("node"), "node", "left_semi").select("node", "n", "unshared", "m0", "m1", "m2", "m3", "tokens", "prefix"),
        "sets",
    )
    bits = F.struct("unshared", "m0", "m1", "m2", "m3").alias("bits")
    places = sets.select("node", "n", bits, F.posexplode("prefix").alias("i", "token"))
    at = (F.col("bits.unshared") + F.col("i")).alias("at")
    index = places.select("token", "node", "n", at, "bits", F.col("node").alias("comp"))
    spark = nodes.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    labels = sets.select("node", F.col("node").alias("comp"))
    index = _with_labels(index, None)
    n_docs = sets.count()
    before = None
    for turn in range(STAR_ROUNDS if star_rounds is None else star_rounds):
        to_make = _pairs_to_make(index).agg(F.sum("pairs")).first()[0] or 0
        if to_make == 0 or (turn and to_make <= PAIRS_PER_DOC * n_docs) or (turn > 1 and 2 * to_make > before):
            break
        before = to_make
        draws = [F.struct(F.xxhash64("node", F.lit(turn), F.lit(k)), "node") for k in range(LEADERS if turn else 1)]
        drawn = F.array(*(F.min_by(F.struct("node", "n", "at", "bits", "comp"), d) for d in draws))
        leaders = index.groupBy("token").agg(F.array_distinct(drawn).alias("ys")).select("token", F.explode("ys").alias("y"))
        members = index.select("token", F.struct("node", "n", "at", "bits", "comp").alias("x"))
        pairs = members.join(leaders, "token").filter(
            (F.col("x.comp") != F.col("y.comp")) & _possible(percent, "x", "y")
        )
        pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        new = staged(_verify(pairs, sets, percent), "star-links")
        if new.isEmpty():
            break
        links = links.union(new)
        old = index, labels
        labels = _labels(sets, links)
        index = _with_labels(index, labels)
        for table in old:
            discard(table)
    costs = _pairs_to_make(index)
    index = _with_sides(index)
    rare = index.join(costs.filter(F.col("pairs") <= rare_pairs).select("token"), "token", "left_semi")
    frequent = index.join(costs.filter(F.col("pairs") > rare_pairs).select("token"), "token", "left_semi")
    own = F.sort_array(F.collect_list(F.struct("at", "token", "minor")))
    per_doc = frequent.filter(F.col("n") <= large_set).groupBy("node", "n", "comp").agg(F.first("bits").alias("bits"), own.alias("f"))
    combos = (
        per_doc.select("node", "n", "bits", "comp", "f", F.posexplode("f").alias("i", "one"))
        .select("node", "n", "bits", "comp", "one", F.explode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("two"))
        .select("one.token", F.col("two.token").alias("second"), "node", "n", "bits", "one.at", "comp", "one.minor")
    )
    # two similar sets, one of them large, have both more shingles than this
    large = frequent.filter(F.col("n") * 100 > percent * large_set)
    pairs = _joined(_with_earlier(rare), ["token"], percent).union(_joined(combos, ["token", "second"], percent))
    pairs = pairs.union(_joined(large, ["token"], percent, above=large_set))
    if percent <= 50:  # two sets that need no more than one common shingle may have no second one
        pairs = pairs.union(_joined(frequent.filter(F.col("n") * percent <= 100), ["token"], percent))
    pairs = pairs.distinct()
    return links.union(staged(_verify(pairs, sets, percent), "join-links"))


def _checked_nodes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    return shingle_nodes(docs, id_col, text_col, size, percent)


def similar_pairs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 75,
) -> DataFrame:
    """All pairs of the Jaccard join between different sets of shingles: ``<id_col>_a``, ``<id_col>_b``.

    Every set is stood for by one of the documents that have it, so copies make no pairs. Each pair of
    sets comes once, in any order of its ids. Texts and sets are as in ``near_duplicates``. The result,
    and the pairs held against each other, grow with the square of a family of near-copies; no pair
    is skipped."""
    nodes = _checked_nodes(docs, id_col, text_col, shingle_words, percent)
    links = find_links(nodes, percent, star_rounds=0)
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("id").alias(f"{id_col}_{x}"))
    return links.join(side("a"), "a").join(side("b"), "b").select(f"{id_col}_a", f"{id_col}_b")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 75,
) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of ``percent`` (1 to 100) hundredths or more.

    Words are runs without white space (space, tab to carriage return), A-Z lower-cased. Returns one
    row per input row: ``<id_col>``, n_shingles, component_id (the smallest id in the component),
    kept (of each component one row stays: that with the smallest id, and of several rows with it
    the first) and text_digest (xxhash64 of the text).

    * A null or empty text, or one of white space, has no shingles and is linked with nothing.
    * Fewer words than ``shingle_words`` are one shingle; texts of any length are read whole.
    * Repeated rows are linked like any equal texts. A null id is no smallest id unless its whole
      component has none; component_id is null then.
    * Other columns are not read, so their names cannot clash. An empty table: an empty result.

    ``docs`` should be a table that is read the same way twice, as files are: after the loss of an
    executor a chunk is made again, and must have its documents in the same order.
    """
    nodes = _checked_nodes(docs, id_col, text_col, shingle_words, percent)
    known = components(find_links(nodes, percent))
    full = nodes.filter(F.col("n") > 0)
    key = ["print_1", "print_2", "n"]
    # copies without a set of their own take the component of the row of their class that has one
    of_class = (
        full.filter(F.col("tokens").isNotNull()).join(known, "node").groupBy(*key).agg(F.min("component").alias("component"))
    )
    first = full.groupBy(*key).agg(F.min("node").alias("first"))
    classes = first.join(of_class, key, "left").select(*key, F.coalesce("component", "first").alias("component"))
    placed = staged(
        nodes.select("node", "id", "digest", *key).join(classes, key, "left")
        .select("node", "id", "digest", "n", F.coalesce("component", "node").alias("component")),
        "placed",
    )
    heads = placed.groupBy("component").agg(
        F.min("id").alias("component_id"),
        F.min_by("node", F.struct(F.coalesce("id", F.lit((1 << 63) - 1)), "node")).alias("head"),
    )
    return placed.join(heads, "component").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        (F.col("node") == F.col("head")).alias("kept"),
        F.col("digest").alias("text_digest"),
    )
