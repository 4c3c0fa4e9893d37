"""Toxic spans by a linear-chain conditional random field.

Every word of a document gets a tag, plain or toxic. The field has a weight per hashed feature (the
word, its first 4, 5 and 6 bytes) and one per pair of tags in a row. Forward-backward gives the
probability of the toxic tag at every word. The words that are likelier toxic than not are the
offending spans; the sum and the maximum of the probabilities make the document's score.

Labels say only which documents are toxic, so words are labelled first: in a toxic document a word
is toxic if it has a feature that stands in toxic documents far more often than chance allows,
given how many features there are.

Few documents, or words that are merely more frequent in toxic ones, give no such feature. So the
score has one more input, the evidence of all words together: a ridge-penalised logistic regression
on the document's features, weighed by rarity. How much it counts is learned from documents that the
regression was not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm.arrays import mix, of_texts, slices, text_bytes, word_bounds, word_digests
from rolesift.llm.sample import fold_of, labelled_sample

BUCKETS = 1 << 18
PREFIX_BYTES = (4, 5, 6)
#: Learn from so many documents of each label at most.
DOCS_PER_LABEL = 2_500
#: Words of a stretch that the field is trained on, and of a block in scoring.
STRETCH, BLOCK = 128, 64
EPOCHS, RATE, DECAY = 60, 0.5, 1e-5
#: Penalty and steps of the regression behind the evidence, and parts that hold out documents in turn.
RIDGE, STEPS, PARTS = 0.1, 100, 4
_NONE = BUCKETS  # the bucket of a feature that a word does not have; its weight is 0

#: Words are letters and digits of ASCII, and all other characters.
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


@dataclass(frozen=True)
class Words:
    """Words of a slice: byte places, feature digests (one row each) and where texts start."""

    begins: np.ndarray
    ends: np.ndarray
    features: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray

    @property
    def buckets(self) -> np.ndarray:
        found = (self.features % np.uint64(BUCKETS)).astype(np.int32)
        return np.where(self.features == 0, _NONE, found)


def words_of(texts: pa.Array) -> Words:
    body, starts = text_bytes(texts)
    begins, ends = word_bounds(_WORD[body], starts[:-1])
    features = np.zeros((1 + len(PREFIX_BYTES), len(begins)), dtype=np.uint64)
    features[0] = word_digests(body, begins, ends) | np.uint64(1)
    for row, size in enumerate(PREFIX_BYTES, 1):
        long = np.flatnonzero(ends - begins >= size)
        at = begins[long]
        features[row, long] = mix(word_digests(body, at, at + size) + np.uint64(row)) | np.uint64(1)
    return Words(begins, ends, features, of_texts(begins, starts), starts)


@dataclass(frozen=True)
class Evidence:
    """A regression on whole documents: rarity (0: not known) and weight of every feature, its bias and
    what a text without known features gets, the mean of plain ones."""

    rarity: np.ndarray
    weights: np.ndarray
    bias: float
    plain: float

    def of(self, words: Words) -> np.ndarray:
        n = len(words.bounds) - 1
        doc, bucket, value = _terms(words, self.rarity)
        found = np.bincount(doc, value * self.weights[bucket], n) + self.bias
        return np.where(np.bincount(doc, minlength=n) > 0, found, self.plain)


def _terms(words: Words, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and value of each known feature a document has; values have unit length."""
    buckets = words.buckets
    known = rarity[buckets] > 0
    owner = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    key = np.broadcast_to(owner, buckets.shape)[known] * (BUCKETS + 1) + buckets[known]
    key, times = np.unique(key, return_counts=True)
    doc, bucket = np.divmod(key, BUCKETS + 1)
    value = np.log1p(times) * rarity[bucket]
    length = np.sqrt(np.bincount(doc, value**2, len(words.bounds) - 1))
    return doc, bucket, value / length[doc]


@dataclass(frozen=True)
class Field:
    """Feature weights (one more for absent features), bias, tag pair weights, the evidence of whole
    documents and the weights that make a document's score of its inputs."""

    weights: np.ndarray
    bias: float
    pairs: np.ndarray  # [from, to], tag 1 is toxic
    evidence: Evidence
    document: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        """Log weight of the toxic tag over the plain one, per word."""
        return self.weights[words.buckets].sum(axis=0) + self.bias

    def scores(self, words: Words, p: np.ndarray) -> np.ndarray:
        """Scores of documents whose words are toxic with probabilities ``p``."""
        inputs = np.column_stack([document_inputs(p, words.bounds), self.evidence.of(words)])
        return _logistic(inputs @ self.document)


def _blocks(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut each text into blocks: first word, number of words and text of every block."""
    lengths = np.diff(bounds)
    counts = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = bounds[:-1][text] + nth * size
    return first, np.minimum(size, bounds[1:][text] - first), text


def marginals(emissions: np.ndarray, bounds: np.ndarray, pairs: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """P(toxic) of every word, by forward-backward over each whole text.

    A text is cut into blocks. The products of the step matrices of all blocks are made side by side,
    the vectors that enter the blocks run through the texts block by block, and the steps inside
    all blocks are again made side by side; the result is that of one run over the whole text.
    """
    total = np.zeros(len(emissions))
    if not len(emissions):
        return total
    first, length, text = _blocks(bounds, size)
    n = len(first)
    at = first[:, None] + np.arange(size)
    live = np.arange(size) < length[:, None]
    e = np.where(live, np.exp(np.clip(emissions[np.minimum(at, len(emissions) - 1)], -40, 40)), 0.0)
    t = np.exp(pairs)

    def step(v0, v1, j):
        """Row vectors times the step matrix of word j; past the end they stay as they are."""
        on = live[:, j]
        w0 = v0 * t[0, 0] + v1 * t[1, 0]
        w1 = (v0 * t[0, 1] + v1 * t[1, 1]) * e[:, j]
        scale = np.where(on, w0 + w1, 1.0)
        return np.where(on, w0 / scale, v0), np.where(on, w1 / scale, v1), scale

    # products: rows of the matrix of each block, each with its own scale in logs
    rows, logs = [], []
    for start in ((1.0, 0.0), (0.0, 1.0)):
        v0, v1, log = np.full(n, start[0]), np.full(n, start[1]), np.zeros(n)
        for j in range(size):
            v0, v1, scale = step(v0, v1, j)
            log += np.log(scale)
        rows.append((v0, v1))
        logs.append(log)
    top = np.maximum(*logs)
    m = np.array([[rows[r][c] * np.exp(logs[r] - top) for c in (0, 1)] for r in (0, 1)])

    # vectors that enter each block from the left and from the right
    nth = np.arange(n) - np.searchsorted(text, text)
    of_nth = np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[of_nth], np.arange(nth.max() + 2))
    left0, left1 = np.ones(n), np.zeros(n)  # as if a plain word stood before the text
    right0, right1 = np.ones(n), np.ones(n)
    for k in range(1, len(cuts) - 1):
        b = of_nth[cuts[k] : cuts[k + 1]]
        a = b - 1
        x0 = left0[a] * m[0, 0, a] + left1[a] * m[1, 0, a]
        x1 = left0[a] * m[0, 1, a] + left1[a] * m[1, 1, a]
        left0[b], left1[b] = x0 / (x0 + x1), x1 / (x0 + x1)
    for k in range(len(cuts) - 2, 0, -1):
        b = of_nth[cuts[k] : cuts[k + 1]]
        x0 = m[0, 0, b] * right0[b] + m[0, 1, b] * right1[b]
        x1 = m[1, 0, b] * right0[b] + m[1, 1, b] * right1[b]
        right0[b - 1], right1[b - 1] = x0 / (x0 + x1), x1 / (x0 + x1)

    f0, f1 = np.zeros((size, n)), np.zeros((size, n))
    v0, v1 = left0, left1
    for j in range(size):
        v0, v1, _ = step(v0, v1, j)
        f0[j], f1[j] = v0, v1
    v0, v1 = right0, right1
    for j in range(size - 1, -1, -1):
        on = live[:, j]
        toxic = f1[j] * v1
        total[at[on, j]] = (toxic / (f0[j] * v0 + toxic))[on]
        x0 = t[0, 0] * v0 + t[0, 1] * e[:, j] * v1
        x1 = t[1, 0] * v0 + t[1, 1] * e[:, j] * v1
        scale = np.where(on, x0 + x1, 1.0)
        v0, v1 = np.where(on, x0 / scale, v0), np.where(on, x1 / scale, v1)
    return total


def toxic_features(words: list[Words], toxic: list[np.ndarray], priors: float) -> np.ndarray:
    """Digests of features that toxic documents have far beyond chance, ascending.

    A feature that k of n toxic and m other documents have, is kept if chance alone would make such
    a share of toxic ones less often than once in e**3 over all features."""
    seen = {True: [], False: []}
    for part, flags in zip(words, toxic):
        owner = np.repeat(np.arange(len(flags)), np.diff(part.bounds))
        for row in part.features:
            has = row != 0
            both = np.stack([row[has], owner[has].astype(np.uint64)])
            both = np.unique(both, axis=1) if both.shape[1] else both
            for flag in (True, False):
                seen[flag].append(both[0][flags[both[1].astype(np.int64)] == flag])
    gathered = [np.concatenate([*seen[flag], np.zeros(0, np.uint64)]) for flag in (True, False)]
    digests, place = np.unique(np.concatenate(gathered), return_inverse=True)
    k = np.bincount(place[: len(gathered[0])], minlength=len(digests)).astype(float)
    m = np.bincount(place[len(gathered[0]) :], minlength=len(digests)).astype(float)
    share = k / np.maximum(k + m, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = k * np.log(share / priors) + np.where(m > 0, m * np.log((1 - share) / (1 - priors)), 0.0)
    keep = (share > priors) & (share >= 0.8) & (surprise > np.log(max(len(digests), 1)) + 3.0)
    return digests[keep]


def _pair_expectations(e, live, pairs):
    """Marginals and expected tag pairs of stretches of one length, side by side."""
    n, size = e.shape
    t = np.exp(pairs)
    f = np.zeros((size, 2, n))
    v = np.stack([np.ones(n), np.zeros(n)])
    for j in range(size):
        w = np.stack([v[0] * t[0, 0] + v[1] * t[1, 0], (v[0] * t[0, 1] + v[1] * t[1, 1]) * e[:, j]])
        v = np.where(live[:, j], w / w.sum(axis=0), v)
        f[j] = v
    p, expected = np.zeros((n, size)), np.zeros((2, 2))
    b = np.ones((2, n))
    for j in range(size - 1, -1, -1):
        on = live[:, j]
        both = f[j] * b
        p[:, j] = np.where(on, both[1] / both.sum(axis=0), 0.0)
        before = f[j - 1] if j else np.stack([np.ones(n), np.zeros(n)])
        emit = np.stack([np.ones(n), e[:, j]])
        joint = before[:, None, :] * t[:, :, None] * (emit * b)[None, :, :]
        expected += np.where(on, joint / joint.sum(axis=(0, 1)), 0.0).sum(axis=2)
        back = (t[:, :, None] * (emit * b)[None, :, :]).sum(axis=1)
        b = np.where(on, back / back.sum(axis=0), b)
    return p, expected


def document_inputs(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """1, log odds of the likeliest word and log of the sum of probabilities, per text."""
    n = len(bounds) - 1
    likeliest, sums = np.full(n, 1e-6), np.zeros(n)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        likeliest[full] = np.clip(np.maximum.reduceat(p, bounds[:-1][full]), 1e-6, 1 - 1e-6)
        # words that are all but surely plain add nothing, however many there are
        sums[full] = np.add.reduceat(np.where(p >= 0.05, p, 0.0), bounds[:-1][full])
    return np.stack([np.ones(n), np.log(likeliest / (1 - likeliest)) / 4, np.log1p(sums)], axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _fit_field(parts: list[Words], flags: list[np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray]:
    """Feature weights, bias and tag pair weights, fitted on stretches of labelled words."""
    toxic = toxic_features(parts, flags, float(np.concatenate(flags).mean()))
    buckets, tags, lives = [], [], []
    for part, flag in zip(parts, flags):
        if not len(part.begins):
            continue
        hit = np.zeros(len(part.begins), dtype=bool)
        if len(toxic):
            for row in part.features:
                place = np.minimum(np.searchsorted(toxic, row), len(toxic) - 1)
                hit |= toxic[place] == row
        hit &= np.repeat(flag, np.diff(part.bounds))
        first, length, _ = _blocks(part.bounds, STRETCH)
        places = np.minimum(first[:, None] + np.arange(STRETCH), len(hit) - 1)
        live = np.arange(STRETCH) < length[:, None]
        tag = hit[places] & live
        # all stretches with a toxic word, and about as many others
        has = tag.any(axis=1)
        chosen = has | (rng.random(len(has)) < max(has.sum(), 8) / max(len(has), 1))
        buckets.append(np.where(live[chosen][None], part.buckets[:, places[chosen]], _NONE))
        tags.append(tag[chosen])
        lives.append(live[chosen])
    if not tags or not any(tag.any() for tag in tags):
        return np.zeros(BUCKETS + 1), -10.0, np.zeros((2, 2))
    bucket, tag, live = np.concatenate(buckets, axis=1), np.concatenate(tags), np.concatenate(lives)

    weights, squares = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    bias, bias_square, pairs, pair_squares = -2.0, 1e-6, np.zeros((2, 2)), np.full((2, 2), 1e-6)
    batch_size = 256
    n_steps = max(EPOCHS, EPOCHS * len(tag) // batch_size // 4)
    for _ in range(min(n_steps, 400)):
        own = rng.choice(len(tag), min(batch_size, len(tag)), replace=False)
        b, y, on = bucket[:, own], tag[own], live[own]
        e = np.exp(np.clip(weights[b].sum(axis=0) + bias, -40, 40))
        p, expected = _pair_expectations(e, on, pairs)
        wrong = np.where(on, p - y, 0.0) / len(own)
        slope = np.bincount(b.ravel(), np.broadcast_to(wrong, b.shape).ravel(), BUCKETS + 1)
        slope += DECAY * weights
        slope[_NONE] = 0.0
        before = np.concatenate([np.zeros((len(own), 1), bool), y[:, :-1]], axis=1)
        seen = np.array([[((before == r) & (y == c) & on).sum() for c in (0, 1)] for r in (0, 1)])
        pair_slope = (expected - seen) / len(own) + DECAY * pairs
        squares += slope**2
        bias_square += wrong.sum() ** 2
        pair_squares += pair_slope**2
        weights -= RATE * slope / np.sqrt(squares)
        bias -= RATE * wrong.sum() / np.sqrt(bias_square)
        pairs -= RATE * pair_slope / np.sqrt(pair_squares)
    weights[_NONE] = 0.0
    return weights, float(bias), pairs


def _regression(doc, bucket, value, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps; both labels weigh the same in all."""
    n = len(toxic)
    share = toxic.mean()
    weight = np.where(toxic, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    # weights sum to n at most and rows are no longer than sqrt(2), so this bounds the curvature
    rate = 1.0 / (0.5 * n + RIDGE)
    w, at = np.zeros((2, BUCKETS + 1))
    bias = at_bias = 0.0
    pace = 1.0
    for _ in range(STEPS):
        wrong = weight * (_logistic(np.bincount(doc, value * at[bucket], n) + at_bias) - toxic)
        new = at - rate * (np.bincount(bucket, value * wrong[doc], BUCKETS + 1) + RIDGE * at)
        new_bias = at_bias - rate * wrong.sum()
        faster = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        at, at_bias = new + (pace - 1) / faster * (new - w), new_bias + (pace - 1) / faster * (new_bias - bias)
        w, bias, pace = new, new_bias, faster
    return w, bias


def fit_evidence(words: list[Words], toxic: np.ndarray) -> tuple[Evidence, np.ndarray]:
    """The evidence, and that of each learned document by a regression that did not see it."""
    n_docs = np.zeros(BUCKETS + 1)
    everything = np.ones(BUCKETS + 1)
    everything[_NONE] = 0.0
    for part in words:
        n_docs += np.bincount(_terms(part, everything)[1], minlength=BUCKETS + 1)
    # a feature of one document tells nothing of others
    rarity = np.where(n_docs >= 2, np.log((len(toxic) + 1) / (n_docs + 0.5)), 0.0).clip(0)
    terms, base = [], 0
    for part in words:
        doc, bucket, value = _terms(part, rarity)
        terms.append((doc + base, bucket, value))
        base += len(part.bounds) - 1
    doc, bucket, value = (np.concatenate(c) for c in zip(*terms))
    own_part = np.zeros(len(toxic), dtype=np.int64)
    for label in (True, False):
        own_part[toxic == label] = np.arange((toxic == label).sum()) % PARTS
    unseen = np.zeros(len(toxic))
    for k in range(PARTS):
        learn = own_part != k
        if not learn.any():
            continue
        place, own = np.cumsum(learn) - 1, learn[doc]
        w, bias = _regression(place[doc[own]], bucket[own], value[own], toxic[learn])
        unseen[~learn] = (np.bincount(doc, value * w[bucket], len(toxic)) + bias)[~learn]
    known = np.bincount(doc, minlength=len(toxic)) > 0
    plain = float(unseen[known & ~toxic].mean()) if (known & ~toxic).any() else 0.0
    w, bias = _regression(doc, bucket, value, toxic)
    return Evidence(rarity, w, bias, plain), np.where(known, unseen, plain)


def train(sample: pa.Table, seed: int = 5) -> Field:
    """Label words, fit the field on stretches of labelled words, then fit the documents' score.

    Without toxic documents, or without others, nothing is a toxic word, and every score is the
    share of toxic documents."""
    labels = np.array([int(x) for x in sample.column("label").to_pylist()], dtype=np.int64)
    rows = np.array(sample.column("n").to_pylist(), dtype=np.float64)
    size = [float(rows[labels == c].max()) if (labels == c).any() else 0.0 for c in (0, 1)]
    nothing = np.zeros(BUCKETS + 1, dtype=np.float32)
    prior = (size[1] + 0.5) / (size[0] + size[1] + 1.0)
    start = np.array([np.log(prior / (1 - prior)), 0.0, 0.0, 0.0])
    if not all(size):
        return Field(nothing, -10.0, np.zeros((2, 2)), Evidence(nothing, nothing, 0.0, 0.0), start)

    batch = pa.record_batch([sample.column("text").combine_chunks()], names=["text"])
    parts, flags, at = [], [], 0
    for piece in slices([batch]):
        parts.append(words_of(piece.column("text")))
        flags.append(labels[at : at + piece.num_rows] == 1)
        at += piece.num_rows
    weights, bias, pairs = _fit_field(parts, flags, np.random.default_rng(seed))
    evidence, unseen = fit_evidence(parts, labels == 1)
    field = Field(weights.astype(np.float32), bias, pairs, evidence, start)

    inputs = np.concatenate(
        [document_inputs(marginals(field.emissions(p), p.bounds, pairs), p.bounds) for p in parts]
    )
    inputs = np.column_stack([inputs, unseen])
    # each label weighs as much as all its rows do, not only the sampled ones
    weight = np.where(labels == 1, size[1] / (labels == 1).sum(), size[0] / (labels == 0).sum())
    weight /= weight.sum()
    document = start.copy()
    for _ in range(60):  # Newton's method with a small ridge
        p = _logistic(inputs @ document)
        slope = inputs.T @ (weight * (p - labels)) + 1e-4 * document
        curve = (inputs * (weight * p * (1 - p))[:, None]).T @ inputs + 1e-4 * np.eye(len(document))
        document -= np.linalg.solve(curve, slope)
    return Field(field.weights, field.bias, pairs, evidence, document)


def _spans(words: Words, p: np.ndarray, texts: pa.Array, row: int) -> list[dict]:
    """Offending stretches of a text, in characters; toxic words in a row are one stretch."""
    a, b = words.bounds[row], words.bounds[row + 1]
    bad = np.flatnonzero(p[a:b] >= 0.5)
    if not len(bad):
        return []
    raw = np.frombuffer(texts[row].as_py().encode(), dtype=np.uint8)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    groups = np.split(bad, np.flatnonzero(np.diff(bad) > 1) + 1)
    base = words.starts[row]
    return [
        {
            "start": int(chars[words.begins[a + g[0]] - base]),
            "end": int(chars[words.ends[a + g[-1]] - base]),
            "probability": float(p[a + g].max()),
        }
        for g in groups
    ]


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    docs_per_label: int = DOCS_PER_LABEL,
) -> DataFrame:
    """``<id_col>``, held_out, score (0 to 1), predicted (score >= 0.5), spans.

    ``spans`` lists the offending stretches: start and end in characters, and the probability.
    Learns from at most ``docs_per_label`` labelled documents of each label whose crc32(id) mod 5 is
    not 0; the rest is held out. A score depends on the text alone.

    * A null text counts as empty; an empty one gets the score of a text without toxic words.
    * Null labels and labels of unknown ids are not learned from; of two labels of one id the
      greater counts. Without labels nothing is a toxic word.
    * Repeated rows stay, with equal scores; a null id stays null.
    * Only the id, text and label columns are read, so other names cannot clash.
    * An empty table gives an empty result.
    """
    learnable = labels.filter(fold_of(id_col, 5) != 0)
    sample = labelled_sample(docs, learnable, id_col, text_col, label_col, docs_per_label)
    shared = docs.sparkSession.sparkContext.broadcast(train(sample))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in slices(batches):
            texts = batch.column("text")
            words = words_of(texts)
            p = marginals(field.emissions(words), words.bounds, field.pairs)
            scores = field.scores(words, p)
            spans = [_spans(words, p, texts, row) for row in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))],
                names=["id", "score", "spans"],
            )

    ddl = f"id {id_type}, score double, spans array<struct<start:int,end:int,probability:double>>"
    scored = slim.mapInArrow(run, ddl).withColumnRenamed("id", id_col)
    return scored.select(
        id_col,
        (fold_of(id_col, 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )
