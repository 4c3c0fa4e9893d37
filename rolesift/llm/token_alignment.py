"""Align the tokens of two tokenizers over the same bytes, and count which ids overlap.

A text becomes two ascending lists of byte offsets at which tokens end. Merging them tells everything: between
two neighbouring ends lies one overlapping pair of tokens, a *link*, and where both lists have the same end a
*group* closes. The merge is cut by the merge path: the lists of a whole slice of texts are one merge, its
diagonals at equal distances are found by binary search, all at once, and the pieces between them have equal
work whatever the texts look like. Pieces know what lies before them from the lists alone, so they are merged side by
side, each emitting its links; only the numbers of groups are stitched, by a running sum over the pieces.

Counts of id pairs are those of the corpus. Slices keep their pairs as packed columns by stripes of the second
id; summed counts are laid out in intervals of that id, each of at most ``TABLE_PAIRS`` pairs, and broadcast
one interval at a time to the stripes it concerns. Pairs are never joined row by row.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm.arrays import slices
from rolesift.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from rolesift.llm.shared import staged

#: Ends that one piece of the merge takes.
PIECE = 256
#: Pieces merged in step with each other.
BLOCK_PIECES = 4_096
SLICE_TEXT_BYTES = 1 << 20
#: Words whose ids a worker keeps from one slice to the next.
CACHED_WORDS = 1 << 18
CACHED_CHARS = 64
#: The second id is striped into columns; a stripe has so many ids.
STRIPES = 4
#: Pairs of ids whose counts are broadcast at a time (17 bytes each), one second id at least.
TABLE_PAIRS = 2_000_000
ID_BITS = 17

_SPLIT = re.compile(r"(?<=\S) (?=\S)")


class Vocabulary(NamedTuple):
    """Bytes, text form and length of each id."""

    entries: list[bytes]
    lengths: np.ndarray
    names: np.ndarray


def _vocabulary(entries: list[bytes]) -> Vocabulary:
    lengths = np.array([len(e) for e in entries], dtype=np.int64)
    names = np.array([str(i) for i in range(len(entries))], dtype=object)
    return Vocabulary(entries, lengths, names)


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, the other bytes for 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder(NamedTuple):
    """Ids of pieces of text, and whether pieces between single spaces may be encoded one by one."""

    encode: Callable[[list[str]], list[list[int]]]
    vocabulary: Vocabulary
    by_words: bool


@lru_cache(maxsize=2)
def byte_level(definition: bytes) -> Encoder:
    """A byte-level BPE from the JSON of the tokenizers library. The strings of special tokens are plain text."""
    tokenizer = tokenizers.Tokenizer.from_str(definition.decode())
    tokenizer.encode_special_tokens = True
    symbols = _byte_symbols()
    entries = []
    for i in range(tokenizer.get_vocab_size(with_added_tokens=True)):
        entry = tokenizer.id_to_token(i) or ""
        entries.append(bytes(symbols[c] for c in entry) if all(c in symbols for c in entry) else b"")
    # with the GPT-2 split no match spans a space between two characters that are not white space
    spec = json.loads(definition)
    plain = (spec.get("pre_tokenizer") or {}) == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return Encoder(encode, _vocabulary(entries), plain and spec.get("normalizer") is None)


_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


@lru_cache(maxsize=2)
def sentence_pieces(model: bytes) -> Encoder:
    """A sentencepiece model; it adds a space before the text."""
    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    entries, spans_words = [], False
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        as_byte = _BYTE_PIECE.fullmatch(piece) if processor.is_byte(i) else None
        entries.append(bytes([int(as_byte[1], 16)]) if as_byte else piece.replace("▁", " ").encode())
        spans_words |= re.search("[^▁]▁", piece) is not None
    # a normalizer that changes or drops something would have to see the whole text
    probe = " aﬁ ½  b①\n c "
    kept = processor.decode(processor.encode(probe)) == probe
    return Encoder(lambda texts: processor.encode(texts, num_threads=1), _vocabulary(entries), kept and not spans_words)


class WordCache:
    """Ids of the words of texts, as bytes; those of a slice that are not known yet are encoded together.

    A text is cut at single spaces between characters that are not white space. The space belongs to the word behind
    it, which both tokenizers see: A gets it, B adds it. A word that the tokenizer does not give back byte by byte,
    with its space, is known as None, as its text has no tokens then."""

    def __init__(self, encoder: Encoder, prefix: str):
        self.encoder, self.prefix = encoder, prefix
        self.known: dict[str, bytes | None] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = list(words - self.known.keys())
        if not new:
            return
        found = self.encoder.encode([self.prefix + word for word in new])
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        raw, cuts = flat.tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
        parts = [raw[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
        for n in np.flatnonzero(~self._given_back(new, counts, flat)).tolist():
            parts[n] = None
        self.known.update(zip(new, parts))

    def _given_back(self, words: list[str], counts: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Of which words the ids stand for a space and the word, byte by byte; all words are compared at once."""
        vocabulary = self.encoder.vocabulary
        spaced = [b" " + word.encode() for word in words]
        wanted = np.fromiter(map(len, spaced), np.int64, len(spaced))
        total = np.concatenate([[0], np.cumsum(vocabulary.lengths[flat])])
        ends = np.cumsum(counts)
        same = total[ends] - total[ends - counts] == wanted
        # words of the right length line up
        own = b"".join([vocabulary.entries[i] for i in flat[np.repeat(same, counts)].tolist()])
        other = b"".join(spaced if same.all() else [word for word, ok in zip(spaced, same.tolist()) if ok])
        if own != other:
            differs = np.frombuffer(own, np.uint8) != np.frombuffer(other, np.uint8)
            starts = np.cumsum(wanted[same]) - wanted[same]
            same[np.flatnonzero(same)[np.add.reduceat(differs.astype(np.int64), starts) > 0]] = False
        return same

    def forget(self, words: list[str]) -> None:
        for word in words:
            del self.known[word]

    def ids(self, words: list[str]) -> np.ndarray | None:
        parts = list(map(self.known.__getitem__, words))
        return None if None in parts else np.frombuffer(b"".join(parts), dtype=np.int32)


class Encoded(NamedTuple):
    """Ids of the texts that both tokenizers give back whole, one after the other; ``kept`` tells which these are."""

    kept: np.ndarray
    a: np.ndarray
    b: np.ndarray
    a_counts: np.ndarray
    b_counts: np.ndarray


def encode_both(texts: list[str | None], a: WordCache, b: WordCache) -> Encoded:
    """Texts that are null, empty, or that a tokenizer does not give back byte by byte have no tokens."""
    by_words = a.encoder.by_words and b.encoder.by_words
    kept, ids_a, ids_b, counts = [], [], [], []
    cut = [(_SPLIT.split(text) if by_words else [text]) if text else [] for text in texts]
    every = set(chain.from_iterable(cut))
    for cache in (a, b):
        cache.learn(every)
    for place, words in enumerate(cut):
        own_a, own_b = a.ids(words), b.ids(words)
        if words and own_a is not None and own_b is not None:
            kept.append(place)
            counts.append((len(own_a), len(own_b)))
            ids_a.append(own_a)
            ids_b.append(own_b)
    long = [word for word in every if len(word) > CACHED_CHARS]
    for cache in (a, b):
        cache.forget(long)
    none = np.zeros(0, np.int32)
    sizes = np.array(counts, dtype=np.int64).reshape(-1, 2)
    return Encoded(np.array(kept, np.int64), np.concatenate([none, *ids_a]), np.concatenate([none, *ids_b]), sizes[:, 0], sizes[:, 1])


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where diagonals at multiples of ``piece`` cross the merge of two ascending lists, ties taking ``a`` first:
    how many of ``a`` and of ``b`` lie before each. All binary searches run together."""
    diagonal = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while True:
        open_ = low < high
        if not open_.any():
            return low, diagonal - low
        middle = (low + high) // 2
        at = np.where(open_, middle, 0)
        other = np.where(open_, diagonal - middle - 1, 0)
        taken = open_ & (a[at] <= b[other])  # a[middle] comes before b[diagonal - middle - 1]
        low = np.where(taken, middle + 1, low)
        high = np.where(open_ & ~taken, middle, high)


class Alignment(NamedTuple):
    """Links as places in a and b, ascending, and the group of every token."""

    link_a: np.ndarray
    link_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    n_groups: int


def align(ends_a: np.ndarray, ends_b: np.ndarray, piece: int = PIECE) -> Alignment:
    """Merge two ascending lists of ends, the last of which is the same in both.

    Every piece takes one end per step, all pieces in step. The end that is taken closes a link, unless
    it repeats the end before it, which ``a`` had: then it closes a group."""
    if not len(ends_a):
        none = np.zeros(0, np.int64)
        return Alignment(none, none, none, none, 0)
    starts_a, starts_b = merge_path(ends_a, ends_b, piece)
    work = np.diff(starts_a + starts_b)
    # beyond the lists lies what is never taken before the other list's last end
    a = np.append(ends_a, np.iinfo(np.int64).max)
    b = np.append(ends_b, np.iinfo(np.int64).max)
    parts, closed = [], 0
    for x in range(0, len(work), BLOCK_PIECES):
        part = slice(x, x + BLOCK_PIECES)
        parts.append(_merge(a, b, starts_a[:-1][part], starts_b[:-1][part], work[part], closed))
        closed = parts[-1].n_groups
    return Alignment(*(np.concatenate(column) for column in list(zip(*parts))[:4]), closed)


def _merge(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, work: np.ndarray, closed: int) -> Alignment:
    """Merge pieces that begin at ``i`` and ``j`` and take ``work`` ends, after ``closed`` groups."""
    shape = len(work), int(work.max())
    at_a, at_b, took_a, closes = (np.zeros(shape, kind) for kind in (np.int64, np.int64, bool, bool))
    for step in range(shape[1]):
        busy = step < work
        first = busy & (a[i] <= b[j])
        second = busy & ~first
        at_a[:, step], at_b[:, step], took_a[:, step] = i, j, first
        closes[:, step] = second & (i > 0) & (b[j] == a[np.maximum(i, 1) - 1])
        i, j = i + first, j + second
    done = np.arange(shape[1]) < work[:, None]
    link = done & ~closes
    # stitch: a piece's groups start with what the pieces before it have closed
    ends = closed + np.cumsum(closes.sum(axis=1))
    before = (ends - closes.sum(axis=1))[:, None] + np.cumsum(closes, axis=1) - closes
    return Alignment(at_a[link], at_b[link], before[took_a], before[done & ~took_a], int(ends[-1]))


def _group_texts(ids_a: np.ndarray, ids_b: np.ndarray, found: Alignment, voc_a: Vocabulary, voc_b: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``a1,a2|b1;a3|b2,b3`` in order, and of each group how many tokens lie before it."""
    per_a = np.bincount(found.group_a, minlength=found.n_groups)
    per_b = np.bincount(found.group_b, minlength=found.n_groups)
    until_a, until_b = np.cumsum(per_a), np.cumsum(per_b)
    out = np.empty(2 * (len(ids_a) + len(ids_b)), dtype=object)
    at_a = np.arange(len(ids_a)) + (until_b - per_b)[found.group_a]
    at_b = np.arange(len(ids_b)) + until_a[found.group_b]
    out[2 * at_a], out[2 * at_b] = voc_a.names[ids_a], voc_b.names[ids_b]
    marks_a, marks_b = np.full(len(ids_a), ",", object), np.full(len(ids_b), ",", object)
    marks_a[until_a - 1], marks_b[until_b - 1] = "|", ";"
    out[2 * at_a + 1], out[2 * at_b + 1] = marks_a, marks_b
    return out, np.concatenate([[0], until_a + until_b])


_DOC = "slot long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_PAIRS = "ids binary, docs binary, in_docs binary, times binary"
_SLICE = f"docs array<struct<{_DOC}>>, " + ", ".join(f"s{k} struct<{_PAIRS}>" for k in range(STRIPES))
_DOC_TYPE = pa.struct([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in _DOC.split(", ")])
_PAIRS_TYPE = pa.struct([(f.split()[0], pa.binary()) for f in _PAIRS.split(", ")])
_SLICE_SCHEMA = pa.schema([("docs", pa.list_(_DOC_TYPE)), *((f"s{k}", _PAIRS_TYPE) for k in range(STRIPES))])


def _stripe_width(n_ids: int) -> int:
    return -(-n_ids // STRIPES)


def _pack_pairs(pair: np.ndarray, doc: np.ndarray) -> dict | None:
    """Links as distinct pairs of ids, and of each the documents and how often it is in these."""
    if not len(pair):
        return None
    order = np.lexsort((doc, pair))
    pair, doc = pair[order], doc[order]
    new_pair = np.concatenate([[True], pair[1:] != pair[:-1]])
    first = np.flatnonzero(new_pair | np.concatenate([[True], doc[1:] != doc[:-1]]))
    heads = np.flatnonzero(new_pair[first])
    return {
        "ids": pack_sorted(pair[first][heads]),
        "in_docs": pack(np.diff(heads, append=len(first))),
        "docs": pack(doc[first]),
        "times": pack(np.diff(first, append=len(pair))),
    }


def _slice_row(slot: int, ids: list[int | None], texts: list[str | None], a: WordCache, b: WordCache) -> dict:
    voc_a, voc_b = a.encoder.vocabulary, b.encoder.vocabulary
    enc = encode_both(texts, a, b)
    found = align(np.cumsum(voc_a.lengths[enc.a]), np.cumsum(voc_b.lengths[enc.b]))
    docs = [dict(slot=slot + n, id=i, n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256="") for n, i in enumerate(ids)]
    row: dict = {"docs": docs}
    if len(enc.kept):
        last_a = np.cumsum(enc.a_counts)
        doc_of_a = np.repeat(np.arange(len(enc.kept)), enc.a_counts)
        last_group = np.concatenate([[0], found.group_a[last_a - 1] + 1])
        links = np.bincount(doc_of_a[found.link_a], minlength=len(enc.kept))
        texts_out, until = _group_texts(enc.a, enc.b, found, voc_a, voc_b)
        for n, place in enumerate(enc.kept.tolist()):
            x, y = 2 * until[last_group[n]], 2 * until[last_group[n + 1]]
            sha = hashlib.sha256("".join(texts_out[x : y - 1].tolist()).encode()).hexdigest()
            docs[place].update(
                n_a=int(enc.a_counts[n]), n_b=int(enc.b_counts[n]), n_groups=int(last_group[n + 1] - last_group[n]),
                n_links=int(links[n]), groups_sha256=sha,
            )
        id_a, id_b = enc.a[found.link_a].astype(np.int64), enc.b[found.link_b].astype(np.int64)
        pair, doc = id_b << ID_BITS | id_a, enc.kept[doc_of_a[found.link_a]]
        stripe = id_b // _stripe_width(len(voc_b.entries))
        for k in range(STRIPES):
            row[f"s{k}"] = _pack_pairs(pair[stripe == k], doc[stripe == k])
    return row


def _slices(docs: DataFrame, id_col: str, text_col: str, a_file: str, b_file: str) -> tuple[DataFrame, int]:
    """A written table with one row per slice of texts, and how many ids B has."""
    context = docs.sparkSession.sparkContext
    files = []
    for path in (a_file, b_file):
        with open(path, "rb") as file:
            files.append(file.read())
    n_ids = len(sentence_pieces(files[1]).vocabulary.entries)
    if len(byte_level(files[0]).vocabulary.entries) > 1 << ID_BITS:
        raise ValueError(f"the first vocabulary has more than {1 << ID_BITS} ids")
    shared = context.broadcast(tuple(files))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = WordCache(byte_level(shared.value[0]), " "), WordCache(sentence_pieces(shared.value[1]), "")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        slot = TaskContext.get().partitionId() << 40  # numbers the rows once and for all
        for batch in slices(batches, most=SLICE_TEXT_BYTES):
            row = _slice_row(slot, batch.column("id").to_pylist(), batch.column("text").to_pylist(), a, b)
            slot += batch.num_rows
            yield pa.RecordBatch.from_pylist([row], schema=_SLICE_SCHEMA)

    return staged(slim.mapInArrow(run, _SLICE), "alignments"), n_ids


def _packed(batch: pa.RecordBatch, stripe: int) -> Iterator[tuple[int, dict]]:
    """Row and pairs of the slices that have any in this stripe."""
    for row, pairs in enumerate(batch.column(f"s{stripe}").to_pylist()):
        if pairs is not None:
            yield row, pairs


def _count_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of id pairs, summed within a task."""
    total_ids, total_times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(ids: list[np.ndarray], times: list[np.ndarray]) -> None:
        nonlocal total_ids, total_times
        total_ids, place = np.unique(np.concatenate([total_ids, *ids]), return_inverse=True)
        total_times = np.bincount(place, np.concatenate([total_times, *times]), len(total_ids)).astype(np.int64)

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total_ids), pa.array(total_times)], names=["pair", "n"])

    for batch in batches:
        ids, times = [], []
        for stripe in range(STRIPES):
            for _, pairs in _packed(batch, stripe):
                heads = unpack(pairs["in_docs"]).astype(np.int64)
                ids.append(unpack_sorted(pairs["ids"]).astype(np.int64))
                times.append(np.add.reduceat(unpack(pairs["times"]).astype(np.int64), np.cumsum(heads) - heads))
        add(ids, times)
        if len(total_ids) > TABLE_PAIRS:
            yield rows()
            total_ids, total_times = total_ids[:0], total_times[:0]
    yield rows()


_SUMS = "slot long, n_best long, count_sum long"


class Interval(NamedTuple):
    """Second ids from ``low`` up to, without, ``high``."""

    low: int
    high: int


def _intervals(sizes: dict[int, int], n_ids: int, most: int) -> list[Interval]:
    """Neighbouring second ids together, as long as they have at most ``most`` pairs."""
    out, low, held = [], 0, 0
    for i in sorted(sizes):
        if held and held + sizes[i] > most:
            out.append(Interval(low, i))
            low, held = i, 0
        held += sizes[i]
    return [*out, Interval(low, n_ids)]


def _sums(slices_: DataFrame, counts: DataFrame, interval: Interval, n_ids: int) -> DataFrame:
    """slot, n_best and count_sum of every document over its links with second ids in an interval."""
    low, high = interval.low << ID_BITS, interval.high << ID_BITS
    table = counts.filter((F.col("pair") >= low) & (F.col("pair") < high)).sort("pair").toArrow()
    pair, count = (table.column(c).to_numpy() for c in ("pair", "n"))
    second = pair >> ID_BITS
    starts = np.flatnonzero(np.diff(second, prepend=-1))
    most = np.repeat(np.maximum.reduceat(count, starts), np.diff(starts, append=len(second)))
    shared = slices_.sparkSession.sparkContext.broadcast((pair, count, count == most))
    width = _stripe_width(n_ids)
    stripes = [k for k in range(STRIPES) if k * width < interval.high and (k + 1) * width > interval.low]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = shared.value
        for batch in batches:
            slots = [np.array(s, dtype=np.int64) for s in batch.column("slots").to_pylist()]
            bests, sums = ([np.zeros(len(s), np.int64) for s in slots] for _ in range(2))
            for stripe in stripes:
                for row, pairs in _packed(batch, stripe):
                    ids = unpack_sorted(pairs["ids"]).astype(np.int64)
                    inside = (ids >= low) & (ids < high)
                    at = np.where(inside, np.searchsorted(pair, ids), 0)
                    heads = unpack(pairs["in_docs"]).astype(np.int64)
                    doc, times = (unpack(pairs[c]).astype(np.int64) for c in ("docs", "times"))
                    np.add.at(bests[row], doc, np.repeat(inside & best[at], heads) * times)
                    np.add.at(sums[row], doc, np.repeat(np.where(inside, count[at], 0), heads) * times)
            columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in (slots, bests, sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "n_best", "count_sum"])

    wanted = slices_.select(F.col("docs.slot").alias("slots"), *(f"s{k}" for k in stripes))
    out = staged(wanted.mapInArrow(run, _SUMS), "pair-sums")
    shared.destroy()
    return out


def align_tokens(
    docs: DataFrame,
    a_file: str,
    b_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    table_pairs: int = TABLE_PAIRS,
) -> DataFrame:
    """Tokens of every text by a byte-level BPE (``a_file``, JSON of the tokenizers library, given a space and the
    text) and by a sentencepiece model (``b_file``, which adds the space), and how they overlap.

    Returns one row per input row: ``<id_col>`` (as long), n_a, n_b (tokens), n_groups (stretches between offsets
    where both end), n_links (overlapping pairs of tokens), n_best (links whose pair of ids has the corpus-wide
    greatest count of its B id, ties included), count_sum (over links, the corpus-wide count of their pair of
    ids) and groups_sha256 (of ``a1,a2|b1;a3|b2,b3``).

    * Null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens:
      zeros, and an empty groups_sha256. They add nothing to the counts.
    * Strings of special tokens inside a text are plain text.
    * Texts of any length are aligned whole. They are encoded word by word, cut at single spaces between characters
      that are not white space, where both tokenizers allow it (else whole); a task holds one slice of texts.
    * Repeated rows stay, and count as often as they come. A null id stays null.
    * Other columns are not read, so names cannot clash. An empty table gives an empty result.

    The driver reads both files and broadcasts them, and broadcasts at most ``table_pairs`` counts at a time (one B id
    at least, which has at most as many pairs as A has ids)."""
    slices_, n_ids = _slices(docs, id_col, text_col, a_file, b_file)
    counts = slices_.select(*(f"s{k}" for k in range(STRIPES))).mapInArrow(_count_pairs, "pair long, n long")
    counts = staged(counts.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    second = F.shiftright("pair", ID_BITS)
    sizes = {r[0]: r[1] for r in counts.groupBy(second.alias("b")).count().collect()}  # as many rows as B has ids
    sums = docs.sparkSession.createDataFrame([], _SUMS)
    for interval in _intervals(sizes, n_ids, table_pairs) if sizes else []:
        sums = sums.union(_sums(slices_, counts, interval, n_ids))
    sums = sums.groupBy("slot").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = slices_.select(F.inline("docs")).join(sums, "slot", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
