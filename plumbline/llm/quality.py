"""Operator 1. Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its features: the hashes of its words, of
pairs of neighbouring words, and of the words' character n-grams. A softmax over the mean gives two classes. Training is
stochastic gradient descent in numpy over a sample of labelled rows that is bounded in rows and bytes.

Because the mean and the last layer are both linear, the trained model folds
into one number a bucket; scoring then needs a sum and a count for each distinct
word, which a task keeps while it runs, and a number for each pair.

Edge cases: a null text counts as empty; an empty text scores the model's bias;
rows with a null label or id aren't learnt from; several labels of a document
count as its largest; equal rows stay equal rows; without labels of both classes
the model is flat (0.5 everywhere). Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rows, held_out, mix64, only, parts

#: Labelled rows that are learnt from, at most, for each class; bytes of all their texts. Texts aren't cut: the sample ends before the bound.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 2000, 64 << 20
BUCKETS = 1 << 17
DIM = 8
NGRAMS = (3, 4, 5)
EPOCHS = 6
RATE = 0.4
SEED = 7
#: Distinct words whose sums a task keeps before it starts anew.
CACHE = 400_000

#: Stands for a word that follows itself.
AGAIN = np.uint64(0xA6A1)
#: Features without a direction that each mean starts with, so that a few words alone don't decide.
PRIOR = 20


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all the words and their n-grams, one after the other by kind, the place of each one's word, and the words' hashes."""
    raw = [f"<{w}>".encode() for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    text = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(raw)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(text))  # bytes of the word from here on
    power = np.full(int(size.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64).cumprod()
    start = np.cumsum(size) - size
    hashes = mix64(np.add.reduceat((text + np.uint64(1)) * power[np.arange(len(text)) - start[word]], start))
    found, places = [hashes], [np.arange(len(raw))]
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = h * np.uint64(1000003) + text[at + i]
        found.append(mix64(h))
        places.append(word[at])
    return (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(places), hashes


def pairs(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, by the words' hashes. A word and the same again are one feature for all words."""
    one, two = hashes[:-1], hashes[1:]
    return (mix64(np.where(one == two, AGAIN, one * np.uint64(3) + two)) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    """weight: a bucket's share in the log odds of class 1; bias: theirs without words."""

    weight: np.ndarray
    bias: float
    cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"weight": self.weight, "bias": self.bias, "cache": {}}

    def score(self, texts: list[str | None]) -> np.ndarray:
        split = [(t or "").split() for t in texts]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        if new := list({w for words in split for w in words if w not in cache}):
            bucket, word, hashes = features(new)
            sums = np.bincount(word, weights=self.weight[bucket], minlength=len(new)).tolist()
            cache.update(zip(new, zip(sums, np.bincount(word, minlength=len(new)).tolist(), hashes.tolist())))
        out = np.empty(len(texts))
        for i, words in enumerate(split):
            total, n = 0.0, PRIOR
            if words:
                sums, sizes, hashes = zip(*map(cache.__getitem__, words))
                pair = pairs(np.array(hashes, np.uint64))
                total, n = sum(sums) + float(self.weight[pair].sum(dtype=np.float64)), n + sum(sizes) + len(pair)
            out[i] = self.bias + total / n
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def shares(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's features, and the share of each."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    counts = Counter(words)
    number = {w: i for i, w in enumerate(counts)}
    bucket, word, hashes = features(list(counts))
    pair = pairs(hashes[[number[w] for w in words]])
    times = np.concatenate([np.fromiter(counts.values(), np.int64, len(counts))[word], np.ones(len(pair), np.int64)])
    bucket, at = np.unique(np.concatenate([bucket, pair]), return_inverse=True)
    share = np.bincount(at, weights=times, minlength=len(bucket))
    return bucket, (share / (share.sum() + PRIOR)).astype(np.float32)


def train(texts: list[str | None], labels: list[int], seed: int = SEED) -> Model:
    """SGD over documents in a shuffled order; classes weigh the same."""
    y = np.asarray(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    rows = Rows()
    for t in texts:
        rows.add(*shares(t))
    vectors = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    weigh = len(y) / (2 * np.bincount(y, minlength=2))
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for i in rng.permutation(len(y)):
            bucket, share = rows[i]
            mean = share @ vectors[bucket]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            step = (rate * weigh[y[i]] * p).astype(np.float32)
            back = step @ out
            out -= np.outer(step, mean)
            bias -= step
            # Shares are about 1/n, so each bucket moves by its part of the gradient times n.
            vectors[bucket] -= np.outer(share * min(len(bucket), 200), back)
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = SAMPLE_PER_CLASS) -> pd.DataFrame:
    """Whole texts and labels of at most ``per_class`` documents a class and ``SAMPLE_BYTES`` in all, in the order of a hash.

    Only ids and labels are sorted; the texts of the ids
    chosen are then fetched by a join with that bounded list.
    """
    marked = (
        only(labels, doc_id="doc_id", y=label)
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("y").cast("int").alias("y"))
        .withColumn("h", F.xxhash64("doc_id", F.lit(SEED)))
    )
    chosen = None
    for y in (0, 1):
        part = marked.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    found = only(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y", "h").agg(F.min("text").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    found = found.where(size <= SAMPLE_BYTES).withColumn("_bytes", F.sum(size.cast("long")).over(Window.orderBy("h", "doc_id")))
    return found.where(F.col("_bytes") <= SAMPLE_BYTES).select("doc_id", "y", "text").toPandas().sort_values("doc_id", ignore_index=True)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model:
    rows = sample(docs, labels, label, per_class)
    return train(rows.text.tolist(), rows.y.tolist())


def score(docs: DataFrame, model, column: str = "score", text: str = "text") -> DataFrame:
    """All columns and rows of ``docs``, and the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.concatenate([np.empty(0), *(shared.value.score(part) for part in parts(list(texts)))]))
        shared.value.cache.clear()  # the worker lives on, and other steps need its memory

    return docs.withColumn(column, scored(F.col(f"`{text}`")))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""
    scored = score(only(docs, doc_id="doc_id", text="text"), fit(docs, labels, label))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
