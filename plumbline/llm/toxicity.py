"""Operator 6. Toxicity: a counterfactual-regularised classifier.

A logistic model over lower-cased words and their beginnings of four to eight
letters. Each feature has two weights: one for the logarithm of its count in
the document, one for its share of the words; so a rare stem that turns up once
in a long text weighs little, and an insult weighs much wherever it stands.

Words that name groups of people have weights whether or not the sample uses them. At each step of the gradient descent a labelled
text is also taken in two versions that differ in such a word: one with the word it has or one that is put in, the other with
another word in its place, or without the one put in. Both keep the label, which the first version is learnt with, and the squared
difference of their scores is a penalty. The text is a sentence of a civil document, where a few words weigh most, or a whole toxic
document, as not each of its sentences is toxic. So a neutral mention of a group doesn't move the score,
also where the sample's toxic documents mention that group more often than others do.

Edge cases: as for the quality classifier: null text is empty, empty text scores
the bias, null labels aren't learnt from, several labels count as the largest,
without both classes the score is 0.5, extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, held_out, only
from .quality import sample, score

#: Labelled rows that are learnt from, at most, for each class.
SAMPLE_PER_CLASS = 2500
PREFIXES = range(4, 9)
EPOCHS = 5
RATE = 0.1
#: Documents of the sample that a feature must be in.
LEAST_DOCUMENTS = 5
#: Places in which documents of features are counted; two that share one count together, and may be taken a little earlier.
SEEN = 1 << 24
#: Pull of each step's weights towards 0, and what a counterfactual difference costs.
L1 = 0.02
COUNTERFACTUAL = 1.0
SEED = 11
CACHE = 600_000

# Words that name groups of people in English, German, French and Spanish, swapped for one another.
IDENTITY = (
    "women men girls boys muslims christians jews hindus buddhists atheists immigrants refugees foreigners natives "
    "gay lesbian bisexual transgender queer straight black white asian african european american latino arab indian chinese "
    "disabled deaf blind elderly young old poor rich "
    "frauen männer mädchen jungen muslime christen juden hindus buddhisten atheisten einwanderer flüchtlinge ausländer schwule lesben "
    "afrikaner asiaten europäer türken araber behinderte gehörlose blinde alte junge arme reiche "
    "femmes hommes filles garçons musulmans chrétiens juifs hindous bouddhistes athées immigrés réfugiés étrangers gays lesbiennes "
    "africains asiatiques européens arabes handicapés sourds aveugles vieux jeunes pauvres riches "
    "mujeres hombres chicas chicos musulmanes cristianos judíos hindúes budistas ateos inmigrantes refugiados extranjeros gais lesbianas "
    "africanos asiáticos europeos árabes gitanos discapacitados sordos ciegos ancianos jóvenes pobres ricos"
).split()
_IDENTITY = frozenset(IDENTITY)

_WORD = re.compile(r"[^\W\d_]+")
_ENDS = ".!?\n"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features(word: str) -> list[str]:
    """The word, marked as whole, and each of its beginnings."""
    return [word + ">", *(word[:n] for n in PREFIXES if n < len(word))]


def counted(words: list[str], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the known features, and how often the words have each."""
    counts: Counter = Counter()
    for word, k in Counter(words).items():
        for f in features(word):
            if (at := index.get(f)) is not None:
                counts[at] += k
    return np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))


def weighed(n: np.ndarray, words: int) -> np.ndarray:
    """For features that n of the words have: the logarithms of their counts, and their shares in hundredths."""
    return np.stack([np.log1p(n), np.minimum(100 * n / (words + 100), 5)])


def changed(places: np.ndarray, n: np.ndarray, out: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts after one word (the places of its features) is taken out and another one is put in."""
    every, at = np.unique(np.concatenate([places, out, into]), return_inverse=True)
    n = np.bincount(at, np.concatenate([n, np.full(len(out), -1.0), np.ones(len(into))]), len(every))
    return every[n > 0], n[n > 0]


@dataclass
class Model:
    """index: the features that have weights; weight: two rows, for logarithms and shares."""

    index: dict[str, int]
    weight: np.ndarray
    bias: float
    cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def score(self, texts: list[str | None]) -> np.ndarray:
        out, index, cache = np.full(len(texts), self.bias), self.index, self.cache
        for i, text in enumerate(texts):
            if len(cache) > CACHE:
                cache.clear()
            words, counts = words_of(text), {}
            for word, k in Counter(words).items():
                got = cache.get(word)
                if got is None:
                    got = cache[word] = tuple(index[f] for f in features(word) if f in index)
                for f in got:
                    counts[f] = counts.get(f, 0) + k
            if counts:
                f, n = np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))
                out[i] += (self.weight[:, f] * weighed(n, len(words))).sum()
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def sentence_at(text: str, at: int) -> str:
    """The sentence around a place of the text."""
    begin = max(text.rfind(c, 0, at) for c in _ENDS) + 1
    end = min((k for c in _ENDS if (k := text.find(c, at)) >= 0), default=len(text))
    return text[begin:end]


def pair_gradient(weight: np.ndarray, one: tuple, two: tuple, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Features of either version (places, values), and the gradient of the penalty on the squared difference of their scores."""
    both, at = np.unique(np.concatenate([one[0], two[0]]), return_inverse=True)
    value = np.concatenate([one[1], -two[1]], axis=1)
    change = np.stack([np.bincount(at, value[k], len(both)) for k in (0, 1)])
    return both, 2 * penalty * (weight[:, both] * change).sum() * change


def residual(z: float, y: float, weigh: float) -> float:
    """The gradient of the logistic loss by the score."""
    return weigh * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)


def train(texts: list[str | None], labels: list[int], seed: int = SEED, penalty: float = COUNTERFACTUAL) -> Model:
    """SGD with steps scaled by each weight's past gradients. Without a penalty no second versions are learnt from."""
    y = np.asarray(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        return Model({}, np.zeros((2, 0)), 0.0)
    rng = np.random.default_rng(seed)
    # Documents are counted by a feature's hash in one array; words of one text at a time, so that the driver holds texts and numbers only.
    seen = np.zeros(SEEN, np.uint8)
    for t in texts:
        at = np.fromiter({crc32(f.encode()) % SEEN for w in set(words_of(t)) for f in features(w)}, np.int64)
        seen[at] += seen[at] < 255
    often = {f for t in texts for w in set(words_of(t)) for f in features(w) if seen[crc32(f.encode()) % SEEN] >= LEAST_DOCUMENTS}
    index = {f: i for i, f in enumerate(sorted(often | {w + ">" for w in IDENTITY}))}
    term = {w: np.array([index[f] for f in features(w) if f in index], np.int64) for w in IDENTITY}
    rows, sizes, mentions = Rows(), [], []
    for t in texts:
        words = words_of(t)
        rows.add(*counted(words, index))
        sizes.append(len(words))
        mentions.append([w for w in words if w in _IDENTITY])
    weight, past, bias, past_bias = np.zeros((2, len(index))), np.full((2, len(index)), 1e-2), 0.0, 1e-2
    weigh = np.where(y == 1, min(4.0, len(y) / (2 * y.sum())), 1.0)

    def move(f: np.ndarray, gradient: np.ndarray) -> None:
        past[:, f] += gradient**2
        rate = RATE / np.sqrt(past[:, f])
        w = weight[:, f] - rate * gradient
        weight[:, f] = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)

    def learn(f: np.ndarray, value: np.ndarray, i: int) -> None:
        nonlocal bias, past_bias
        g = residual(bias + (weight[:, f] * value).sum(), y[i], weigh[i])
        past_bias += g * g
        bias -= RATE / np.sqrt(past_bias) * g
        move(f, g * value)

    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            (f, n), size = rows[i], sizes[i]
            learn(f, weighed(n, size), i)
            if not penalty or not size:
                continue
            own = mentions[i]
            if y[i] == 0:
                words = words_of(sentence_at(texts[i], int(rng.integers(len(texts[i])))))
                (f, n), size, own = counted(words, index), len(words), [w for w in words if w in _IDENTITY]
            old, new = (IDENTITY[k] for k in rng.choice(len(IDENTITY), 2, replace=False))
            none = np.empty(0, np.int64)
            if own:  # the word it has, and another one in its place
                old = own[int(rng.integers(len(own)))]
                versions = ((f, n), size), (changed(f, n, term[old], term[new]), size)
            else:  # a word put in, and another one or none
                without = rng.random() < 0.5
                versions = (changed(f, n, none, term[old]), size + 1), ((f, n), size) if without else (changed(f, n, none, term[new]), size + 1)
            one, two = ((at, weighed(k, words)) for (at, k), words in versions)
            learn(*one, i)
            move(*pair_gradient(weight, one, two, penalty))
    used = np.flatnonzero(np.abs(weight).max(axis=0, initial=0) >= 1e-2)
    names = list(index)
    return Model({names[i]: k for k, i in enumerate(used)}, weight[:, used], float(bias))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Model:
    rows = sample(docs, labels, label, per_class)
    return train(rows.text.tolist(), rows.y.tolist())


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""
    scored = score(only(docs, doc_id="doc_id", text="text"), fit(docs, labels, label))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
