"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent n-grams of a language by rank. A document's own most frequent
n-grams are held against each profile: an n-gram costs the distance of its two ranks, one that the
profile lacks costs the profile's length. The language with the least sum wins.

N-grams are runs of 1 to ``MAX_N`` bytes of UTF-8, of lower-cased words with a space at both ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm.arrays import slices, text_bytes
from rolesift.llm.sample import fold_of, labelled_sample

UNDETERMINED = "und"
#: For texts with letters while no profile exists, where these should not be ``und``.
UNKNOWN = "mis"
MAX_N = 4
PROFILE_GRAMS = 400
#: Learn from so many documents of each language at most.
DOCS_PER_LANGUAGE = 1_000
#: Learn the languages that most documents have.
MOST_LANGUAGES = 1_000
#: Text held at a time; longer texts are counted in pieces of ``PIECE_CHARS``.
SLICE_TEXT_BYTES = 256 << 10
PIECE_CHARS = 256 << 10

_SPACE = 32
#: What a profile sees: ASCII letters and all bytes of other characters; the rest is space.
_SEEN = np.full(256, _SPACE, dtype=np.uint8)
_SEEN[65:91] = np.arange(97, 123)
_SEEN[97:123] = np.arange(97, 123)
_SEEN[128:] = np.arange(128, 256)


def gram_codes(texts: pa.Array) -> Iterator[np.ndarray]:
    """Codes of all n-grams of each text, one array per text.

    A code is the bytes of the n-gram with zeros before them, so codes of all lengths differ. The texts lie in
    one array with a space before, between and behind them; of several spaces in a row one is left. A space may
    only begin or end an n-gram, so none spans two texts, and the place where it begins tells whose it is."""
    body, starts = text_bytes(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    n_texts = len(starts) - 1
    seen = np.full(len(body) + n_texts + 1, _SPACE, dtype=np.uint8)
    between = starts + np.arange(n_texts + 1)  # the spaces around the texts
    inside = np.ones(len(seen), dtype=bool)
    inside[between] = False
    seen[inside] = _SEEN[body]
    del inside, body
    space = seen == _SPACE
    keep = ~space
    keep[0] = True
    keep[1:] |= ~space[:-1]
    between = np.cumsum(keep, dtype=np.int32)[between] - 1
    seen = seen[keep]
    space = seen == _SPACE
    codes, cuts, code = [], [], np.zeros(len(seen), dtype=np.uint32)
    for n in range(1, MAX_N + 1):
        if len(seen) < n:
            break
        code = code[: len(seen) - n + 1] << np.uint32(8) | seen[n - 1 :]
        valid = ~space[: len(code)] if n <= 2 else np.ones(len(code), dtype=bool)
        if n == 2:  # one of the two
            valid |= ~space[1:]
        for k in range(1, n - 1):
            valid &= ~space[k : k + len(code)]
        at = np.flatnonzero(valid)
        cuts.append(np.searchsorted(at, between))
        codes.append(code[at])
    for text in range(n_texts):
        yield np.concatenate([own[cut[text] : cut[text + 1]] for own, cut in zip(codes, cuts)])


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a text before the first space after each ``most`` characters; n-grams of the pieces are its own."""
    start = 0
    while len(text) - start > most:
        end = text.find(" ", start + most)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of a long text and their counts, piece by piece."""
    totals = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    for piece in pieces(text):
        totals = _added(totals, runs(next(gram_codes(pa.array([piece], pa.large_string())))))
    return totals


def _added(totals: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(np.concatenate([totals[0], more[0]]), return_inverse=True)
    sums = np.bincount(place, np.concatenate([totals[1], more[1]]), len(distinct))
    return distinct, sums.astype(np.int64)


def most_frequent(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most frequent codes, the lower code first among equals; codes are ascending."""
    if len(codes) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")[:most]]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts."""
    values = np.sort(values)
    first = np.flatnonzero(np.diff(values, prepend=values[:1] ^ 1 if len(values) else 0))
    return values[first], np.diff(first, append=len(values))


@dataclass(frozen=True)
class Profiles:
    """``ranks[i, l]`` is the rank of ``codes[i]`` in language l, ``length`` if it has none."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    length: int

    def judge(self, distinct: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        """The language of a text with these n-grams, and how near it is: 1 less the part of the
        greatest distance. Equally near languages: the first by name."""
        top = most_frequent(distinct, counts, self.length)
        if not len(top) or not len(self.codes):
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        known = self.codes[at] == top
        own = np.arange(len(top))[:, None]
        ranks = self.ranks[at]
        ranked = known[:, None] & (ranks < self.length)
        apart = np.where(ranked, np.abs(ranks - own), self.length)
        sums = apart.sum(axis=0)
        best = int(np.argmin(sums))
        return self.languages[best], 1.0 - float(sums[best]) / (self.length * len(top))


def learn_profiles(sample: pa.Table, length: int = PROFILE_GRAMS) -> Profiles:
    """Profiles from the texts and labels of a sample."""
    labels = np.array(sample.column("label").to_pylist(), dtype=object)
    texts = sample.column("text").combine_chunks()
    languages = sorted(set(labels.tolist()))
    tops = []
    for language in languages:
        totals: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        own = pa.record_batch([texts.filter(pa.array(labels == language))], names=["text"])
        for piece in slices([own], most=SLICE_TEXT_BYTES):
            totals = _added(totals, runs(np.concatenate(list(gram_codes(piece.column("text"))))))
        tops.append(most_frequent(*totals, length))
    codes = np.unique(np.concatenate([*tops, np.zeros(0, np.uint32)]))
    ranks = np.full((len(codes), len(languages)), length, dtype=np.int64)
    for column, top in enumerate(tops):
        ranks[np.searchsorted(codes, top), column] = np.arange(len(top))
    return Profiles(languages, codes, ranks, length)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def with_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_language: int = DOCS_PER_LANGUAGE,
    most_languages: int = MOST_LANGUAGES,
    out: tuple[str, str] = ("lang_pred", "score"),
    unlearned: str = UNDETERMINED,
) -> DataFrame:
    """Add the predicted language of every whole text and its score (0 to 1) to the given columns.

    Profiles are learned from text and ``lang_col`` of at most ``docs_per_language`` documents of
    each language, those with the least digests of their id, among documents whose crc32(id) mod 3
    is not 1. If there are more than ``most_languages``, those with the most documents are learned; ``sample``
    says how the bytes of the sample are bounded. Labels, ids and all other columns are no input of a prediction.

    * A text that is null or has no letter (by Unicode) is ``und`` with score 0.
    * A null language is not learned from; if nothing can be learned, all texts with a letter are
      ``unlearned``, with score 0.
    * Texts of any length are judged whole, with all their n-grams; long ones are counted in pieces.
    * Equally near languages: the first by name. Repeated rows stay and get the same answer.
    * Columns that have the names in ``out`` are replaced; all others stay as they are.
    * An empty table gives an empty result.
    """
    learnable = docs.filter(fold_of(id_col, 3) != 1)
    sample = labelled_sample(learnable, learnable, id_col, text_col, lang_col, docs_per_language, most_languages)
    profiles = docs.sparkSession.sparkContext.broadcast(learn_profiles(sample))
    pred, score = out
    docs = docs.drop(*out)
    schema = docs.withColumns({pred: F.lit("").cast("string"), score: F.lit(0.0)}).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = profiles.value
        for batch in slices(batches, text_col, SLICE_TEXT_BYTES):
            texts = batch.column(text_col)
            said = []
            if (pc.max(pc.binary_length(texts)).as_py() or 0) > PIECE_CHARS:
                counted = (gram_counts(text or "") for text in texts.to_pylist())
            else:
                counted = map(runs, gram_codes(texts))
            for codes, counts in counted:
                if not len(codes):
                    said.append((UNDETERMINED, 0.0))
                else:
                    said.append(model.judge(codes, counts) if len(model.codes) else (unlearned, 0.0))
            # bytes above 127 need not be letters: look where no ASCII letter is
            plain = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_pylist()
            for row, ascii_letter in enumerate(plain):
                if not ascii_letter and not _has_letter(texts[row].as_py()):
                    said[row] = (UNDETERMINED, 0.0)
            batch = batch.append_column(pred, pa.array([s[0] for s in said], pa.string()))
            yield batch.append_column(score, pa.array([s[1] for s in said], pa.float64()))

    return docs.mapInArrow(run, schema)


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``<id_col>``, held_out (crc32(id) mod 3 is 1: not learned from), lang_pred, score; one row per
    input row. See ``with_language``."""
    slim = docs.select(id_col, text_col, lang_col)
    judged = with_language(slim, id_col, text_col, lang_col)
    return judged.select(id_col, (fold_of(id_col, 3) == 1).alias("held_out"), "lang_pred", "score")
