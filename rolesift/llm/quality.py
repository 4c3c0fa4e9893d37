"""Quality classifier with supervised subword embeddings.

Words, word pairs and runs of 3 and 4 bytes are hashed to rows of an embedding table. A document is
the mean of its rows, and a softmax layer says how likely each class is. Table and layer are learned
together by stochastic gradient descent in numpy.

A pair of equal words, next to each other or one apart, is hashed to one row whatever the word is,
so repetition shows in words that no learned document had.

For two classes the softmax of a mean is the logistic of a mean, so scoring gathers one number per
feature: the difference of the class scores of its row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm.arrays import (
    WHITE, mix, of_texts, slices, text_bytes, word_bounds, word_digests,
)
from rolesift.llm.sample import fold_of, labelled_sample

BUCKETS = 1 << 17
#: Learn from so many documents of each class at most.
DOCS_PER_CLASS = 2_000
DIMENSIONS = 8
EPOCHS = 12
RATE = 0.5
_SAME, _SAME_BUT_ONE = 0, 1
_CASED = np.arange(256, dtype=np.uint8)


@dataclass(frozen=True)
class Features:
    """Buckets of one kind of feature in text order, and where each text's begin and end."""

    buckets: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


def _bucket(digests: np.ndarray) -> np.ndarray:
    return (digests % np.uint64(BUCKETS - 2) + np.uint64(2)).astype(np.int32)


def features(texts: pa.Array) -> list[Features]:
    """Words, word pairs, repeats, 3 bytes, 4 bytes; of each whole text."""
    body, starts = text_bytes(texts)
    begins, ends = word_bounds(~WHITE[body], starts[:-1])
    words = word_digests(body, begins, ends, fold=_CASED)
    bounds = of_texts(begins, starts)
    first, last = bounds[:-1], bounds[1:]
    found = [Features(_bucket(words), first, last)]
    for apart, same in ((1, _SAME), (2, _SAME_BUT_ONE)):
        left, right = words[:-apart], words[apart:]
        equal = left == right
        pairs = _bucket(mix(left * np.uint64(3) + right)) if apart == 1 else np.full(len(left), same, np.int32)
        pairs[equal] = same
        if apart == 2:  # only repeats count here
            places = np.flatnonzero(equal)
            cut = lambda x: np.searchsorted(places, x)
            found.append(Features(pairs[places], cut(first), np.maximum(cut(last - apart), cut(first))))
        else:
            found.append(Features(pairs, first, np.maximum(last - apart, first)))
    code = body.astype(np.uint64)
    for size in (3, 4):
        whole = code[: max(len(body) - size + 1, 0)].copy()
        for k in range(1, size):
            whole = whole << np.uint64(8) | code[k : k + len(whole)]
        grams = _bucket(mix(whole + np.uint64(size << 40)))
        found.append(Features(grams, starts[:-1], np.maximum(starts[1:] - size + 1, starts[:-1])))
    return found


def means(found: list[Features], per_bucket: np.ndarray) -> np.ndarray:
    """The mean of a number per bucket over all features of each text; 0 where there are none."""
    sums, counts = 0.0, 0
    for kind in found:
        running = np.concatenate([[0.0], np.cumsum(per_bucket[kind.buckets], dtype=np.float64)])
        sums = sums + running[np.minimum(kind.ends, len(running) - 1)] - running[np.minimum(kind.begins, len(running) - 1)]
        counts = counts + (kind.ends - kind.begins)
    return np.where(counts > 0, sums / np.maximum(counts, 1), 0.0)


@dataclass(frozen=True)
class Model:
    """``per_bucket``: what a feature adds towards class 1 over class 0, before the mean."""

    per_bucket: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        logits = means(features(texts), self.per_bucket) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -30, 30)))


def _counted(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their part of all features, per text."""
    found = features(texts)
    out = []
    for i in range(len(texts)):
        own = np.concatenate([kind.buckets[kind.begins[i] : kind.ends[i]] for kind in found])
        buckets, counts = np.unique(own, return_counts=True)
        out.append((buckets, (counts / max(1, len(own))).astype(np.float32)))
    return out


def train(sample: pa.Table, seed: int = 7) -> Model:
    """Stochastic gradient descent over the documents of a sample with labels 0 and 1.

    Each class weighs as much as all its labelled rows do, not only the sampled ones. Without any
    labelled row every score is one half; with one class, it is that class's prior."""
    labels = np.array([int(x) for x in sample.column("label").to_pylist()], dtype=np.int64)
    totals = np.array(sample.column("n").to_pylist(), dtype=np.float64)
    counts = [int((labels == c).sum()) for c in (0, 1)]
    sizes = [float(totals[labels == c].max()) if counts[c] else 0.0 for c in (0, 1)]
    prior = np.log((sizes[1] + 0.5) / (sizes[0] + 0.5)) if len(labels) else 0.0
    if not all(counts):
        return Model(np.zeros(BUCKETS, dtype=np.float32), float(prior))

    data: list[tuple[np.ndarray, np.ndarray]] = []
    batch = pa.record_batch([sample.column("text").combine_chunks()], names=["text"])
    for piece in slices([batch]):
        data += _counted(piece.column("text"))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    layer = np.zeros((DIMENSIONS, 2), dtype=np.float32)
    bias = np.array([0.0, 0.0])
    # both classes are seen equally often; the prior is put back into the bias at the end
    weight = np.array([max(counts) / c for c in counts])
    weight = weight / weight.mean()
    steps, done = EPOCHS * len(data), 0
    gain = 60.0  # of the mean, as a document's mean of many rows is small
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            rate = RATE * (1.0 - done / steps)
            done += 1
            buckets, part = data[i]
            if not len(buckets):
                continue
            rows = table[buckets]
            hidden = gain * (part @ rows)
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            error = (p * weight[labels[i]] * rate).astype(np.float32)
            back = layer @ error
            layer -= np.outer(hidden, error) * 0.1
            bias -= error * 0.1
            table[buckets] = rows - np.outer(part * gain, back).astype(np.float32)
    per_bucket = gain * (table @ (layer[:, 1] - layer[:, 0]))
    # weights evened the classes out, so the log odds of the labelled rows are added
    return Model(per_bucket.astype(np.float32), float(bias[1] - bias[0] + prior))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    docs_per_class: int = DOCS_PER_CLASS,
    threshold: float = 0.7,
) -> DataFrame:
    """``<id_col>``, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold).

    Learns from at most ``docs_per_class`` labelled documents of each class whose crc32(id) mod 4 is
    not 2; the rest is held out. A score depends on the text alone.

    * A null text counts as empty, and an empty one gets what the classes' sizes say.
    * Null labels and labels of unknown ids are not learned from; of two labels of one id the
      greater counts. Without labels every score is one half.
    * Repeated rows stay, with equal scores; a null id stays null.
    * Only the id, text and label columns are read, so other names cannot clash.
    * An empty table gives an empty result.
    """
    learnable = labels.filter(fold_of(id_col, 4) != 2)
    sample = labelled_sample(docs, learnable, id_col, text_col, label_col, docs_per_class)
    shared = docs.sparkSession.sparkContext.broadcast(train(sample))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = shared.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(scores, pa.float64())], names=["id", "score"]
            )

    scored = slim.mapInArrow(run, f"id {id_type}, score double").withColumnRenamed("id", id_col)
    return scored.select(
        id_col,
        (fold_of(id_col, 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
