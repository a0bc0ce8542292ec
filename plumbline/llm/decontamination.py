"""Operator 8. Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

Benchmark items and documents are sequences of words (lower case, signs at their
ends taken off). An item is found in a document where some run of its words is within
``EDITS`` word edits per word of the item.

Windows as long as an item are taken wherever a document shares a run of words with it, of two or three by the item's
length, at the alignment of that run. That loses nothing: k edits of n words leave n - k words in at most k + 1 pieces, so one
of ceil((n - k) / (k + 1)) words stays whole. (Embedding every window of every item length instead costs six walks
of twice the length for each; see the README.) Each window is
embedded by CGK random walks: at step j the walk writes the word it stands on, and a
random bit of (j, word) says whether it moves on; sequences at a small edit distance
then agree at most steps. Sampled steps of the embedding are the keys of
``TABLES`` hash tables of the items; windows and items that share a key are verified first, and
the exact edit distance decides. Walks of long items with many edits drift apart, so each other
item with a shared run is verified too, where a count of shared words leaves fewer edits possible
than are found so far: k edits of n words leave n - k of them, so nothing is lost at any length.

The items' tables are broadcast for at most ``BLOCK_ITEMS`` items and ``BLOCK_WORDS`` words at a
time; a larger benchmark is a query set that runs against all documents in blocks.

Edge cases: a null or empty text or item matches nothing; items of up to three words
need an exact match; equal items are each reported; repeated documents give a row each;
null ids stay null; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, only, parts

#: Word edits per word of an item, at most.
EDITS = 0.3
#: Independent walks, hash tables of each, and sampled steps of a table's key.
WALKS, SAMPLES, STEPS = 6, 8, 3
TABLES = WALKS * SAMPLES
#: A walk writes so many words for each word of the item.
STRETCH = 2
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000
#: Shared runs that are looked at together, and words whose numbers a task keeps.
MEETINGS, CACHE = 1 << 20, 500_000
SEED = np.uint64(0x5DEECE66D)
_SIGNS = b"".join(bytes([i]) for i in range(33, 127) if not chr(i).isalnum())


def plain(word: bytes) -> bytes:
    return word.lower().strip(_SIGNS)


def words_of(text: str | None) -> list[bytes]:
    return [w for w in map(plain, (text or "").encode().split()) if w]


def most_edits(n: int) -> int:
    """Edits that an item of n words may have."""
    return int(EDITS * n)


def seed_size(n: int) -> int:
    """Words of a run that so many edits of n words leave whole; three are enough to seed by."""
    k = most_edits(n)
    return min(3, -(-(n - k) // (k + 1)))


def embed(rows: np.ndarray, walk: int) -> np.ndarray:
    """The CGK walks over equally long rows of word numbers; -1 is written past the end."""
    n = rows.shape[1]
    padded = np.concatenate([rows, np.full((len(rows), 1), -1, rows.dtype)], axis=1)
    out, at, row = np.empty((len(rows), STRETCH * n), rows.dtype), np.zeros(len(rows), np.int64), np.arange(len(rows))
    for j in range(STRETCH * n):
        out[:, j] = padded[row, at]
        salt = np.uint64(((walk * 1_000_003 + j) * 0x9E3779B97F4A7C15) % (1 << 64)) ^ SEED
        at = np.minimum(at + (mix64(out[:, j].astype(np.uint64) + salt) >> np.uint64(63)).astype(np.int64), n)
    return out


def keys(rows: np.ndarray) -> np.ndarray:
    """(rows, TABLES) keys of sampled steps, for rows of one length."""
    n, found = rows.shape[1], []
    rng = np.random.default_rng(n)
    for walk in range(WALKS):
        written = embed(rows, walk).astype(np.uint64)
        for s in range(SAMPLES):
            h = np.full(len(rows), n * TABLES + walk * SAMPLES + s, np.uint64)
            for j in rng.choice(STRETCH * n, min(STEPS, STRETCH * n), replace=False):
                h = mix64(h + written[:, j])
            found.append(h)
    return np.stack(found, axis=1)


def fitting_distance(item: np.ndarray, text: np.ndarray) -> int:
    """The least edit distance of the item to any run of the text."""
    row = np.zeros(len(text) + 1, np.int64)
    step = np.arange(len(text) + 1)
    for i, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != w))
        row = np.minimum.accumulate(new - step) + step  # insertions, from left to right
    return int(row.min())


@dataclass
class Items:
    """A block of items: their words as numbers, their hash tables, and by size their seeds: (code, item, offset), and (code, length, offset)."""

    ids: list
    words: list[np.ndarray]
    number: dict[bytes, int]
    grams: dict[int, tuple[tuple, tuple]]
    tables: dict[int, set]

    @classmethod
    def of(cls, ids: list, texts: list[str | None]) -> Items:
        number: dict[bytes, int] = {}
        kept = [(i, np.array([number.setdefault(w, len(number)) for w in ws], np.int64)) for i, t in zip(ids, texts) if (ws := words_of(t))]
        found, by_length = defaultdict(list), defaultdict(list)
        for k, (_, w) in enumerate(kept):
            by_length[len(w)].append(k)
            size = seed_size(len(w))
            codes = gram(w, size, len(number))
            found[size].append(np.stack([codes, np.full(len(codes), k), np.arange(len(codes)), np.full(len(codes), len(w))]))
        grams = {}
        for size, rows in found.items():
            code, item, offset, length = np.concatenate(rows, axis=1)
            order = np.lexsort((offset, item, code))
            # Items that share a run at one alignment and length share its windows.
            windows = np.unique(np.stack([code, length, offset]), axis=1)
            grams[size] = (code[order], item[order], offset[order]), tuple(windows)
        tables: dict[int, set] = {}
        for n, members in by_length.items():
            got = defaultdict(set)
            for k, row in zip(members, keys(np.stack([kept[k][1] for k in members])).tolist()):
                for h in row:
                    got[h].add(k)
            tables[n] = got
        return cls([i for i, _ in kept], [w for _, w in kept], number, grams, tables)


def gram(words: np.ndarray, size: int, vocabulary: int) -> np.ndarray:
    """A number for each run of ``size`` words; negative where one of them is unknown."""
    n = max(len(words) - size + 1, 0)
    code, bad = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(size):
        part = words[k : k + n]
        code, bad = code * vocabulary + part, bad | (part < 0)
    return np.where(bad, -1, code)


def expand(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers from each first to before its last."""
    size = last - first
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def met(at: np.ndarray, code: np.ndarray, every: np.ndarray, name: np.ndarray, offset: np.ndarray) -> Iterator[np.ndarray]:
    """(name, start) for each place of a code in the text and in the sorted codes of the items; a bounded number at a time, each once."""
    first, last = np.searchsorted(every, code, "left"), np.searchsorted(every, code, "right")
    hit = np.flatnonzero(last > first)
    total, begin = np.cumsum(last[hit] - first[hit]), 0
    while begin < len(hit):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + MEETINGS)))
        part = hit[begin:end]
        k = expand(first[part], last[part])
        yield np.unique(np.stack([name[k], np.repeat(at[part], last[part] - first[part]) - offset[k]], axis=1), axis=0)
        begin = end


class Finder:
    """Finds a block's items in texts; keeps the numbers of words."""

    def __init__(self, items: Items):
        self.items, self.cache = items, {}
        self.lengths = np.array([len(w) for w in items.words], np.int64)
        self.most = np.array([most_edits(len(w)) for w in items.words], np.int64)
        self.flat = np.concatenate([*items.words, np.empty(0, np.int64)])
        self.first = np.cumsum(self.lengths) - self.lengths
        self.known = np.zeros(len(items.number), bool)
        self.hashes = {n: np.sort(np.fromiter(table, np.uint64, len(table))) for n, table in items.tables.items()}

    def numbers(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().split()
        cache, number = self.cache, self.items.number
        if len(cache) > CACHE:
            cache.clear()
        try:  # most texts have no new words
            got = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
        except KeyError:
            for w in set(words).difference(cache):
                cache[w] = number.get(p, -1) if (p := plain(w)) else -2
            got = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
        return got[got > -2]

    def seeds(self, text: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, tuple, tuple]]:
        """By size: the places of the text's runs that items have, their codes, and the items' seeds."""
        out = []
        for size, (own, windows) in self.items.grams.items():
            code = gram(text, size, len(self.items.number))
            at = np.flatnonzero(code >= 0)
            if len(at):
                at = at[own[0][np.minimum(np.searchsorted(own[0], code[at]), len(own[0]) - 1)] == code[at]]
                if len(at):
                    out.append((at, code[at], own, windows))
        return out

    def windows(self, seeds: list) -> np.ndarray:
        """(length, start) of the windows at shared runs, in this order."""
        found = [got for at, code, _, (every, length, offset) in seeds for got in met(at, code, every, length, offset)]
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)

    def starts(self, text: np.ndarray, seeds: list) -> np.ndarray:
        """(item, start) of the windows at runs that a text shares with items whose words it holds, in this order."""
        found = []
        for at, code, (every, item, offset), _ in seeds:
            own = np.unique(code)
            first, last = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
            items = np.unique(item[expand(first, last)])
            items = items[self.most[items] > 0]
            if not len(items):
                continue
            items = items[self.lengths[items] - self.shared(items, text) <= self.most[items]]
            hopeful = np.isin(item, items)
            found += met(at, code, every[hopeful], item[hopeful], offset[hopeful])
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)

    def shared(self, items: np.ndarray, text: np.ndarray) -> np.ndarray:
        """How many words of each item, repeats counted, are anywhere in the text."""
        known, size = self.known, self.lengths[items]
        known[text[text >= 0]] = True
        ends = np.cumsum(size)
        at = np.repeat(self.first[items] - ends + size, size) + np.arange(int(ends[-1]))
        count = np.add.reduceat(known[self.flat[at]].astype(np.int64), ends - size)
        known[text[text >= 0]] = False
        return count

    def rest(self, text: np.ndarray, start: np.ndarray, best: dict[int, int]) -> None:
        """Lowers ``best`` (edits by item) to the exact figures of all items with a shared run; start: rows of ``starts``."""
        items, begin = np.unique(start[:, 0], return_index=True)
        most, hopeful = self.most[items], np.arange(len(items))
        ends = np.append(begin[1:], len(start))
        for i in hopeful.tolist():
            k, m, n = int(items[i]), int(most[i]), int(self.lengths[items[i]])
            at = start[begin[i] : ends[i], 1]
            cuts = np.flatnonzero(np.diff(at) > n + 2 * m) + 1  # windows that touch are one run of text
            for a, b in zip(at[np.append(0, cuts)].tolist(), at[np.append(cuts, len(at)) - 1].tolist()):
                run = text[max(a - m, 0) : b + n + m]
                least = n - int(self.shared(items[i : i + 1], run)[0])
                if least < best.get(k, m + 1) and (d := fitting_distance(self.items.words[k], run)) < best.get(k, m + 1):
                    best[k] = d

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, item's words) of each item that a text holds."""
        numbers = [self.numbers(t) for t in texts]
        seeds = [self.seeds(w) for w in numbers]
        each = [self.windows(x) for x in seeds]
        text = np.repeat(np.arange(len(texts)), [len(w) for w in each])
        window = np.concatenate(each) if each else np.empty((0, 2), np.int64)
        best: dict[tuple[int, int], int] = {}
        for n in np.unique(window[:, 0]):
            chosen = np.flatnonzero(window[:, 0] == n)
            for i in range(0, len(chosen), 4096):
                part = chosen[i : i + 4096]
                rows = np.full((len(part), n), -1, np.int64)
                for r, (t, s) in enumerate(zip(text[part], window[part, 1])):
                    w = numbers[t][max(s, 0) : s + n]
                    rows[r, max(-s, 0) : max(-s, 0) + len(w)] = w
                table, hashes, most, got = self.items.tables[int(n)], self.hashes[int(n)], most_edits(int(n)), keys(rows)
                hit = hashes[np.minimum(np.searchsorted(hashes, got), len(hashes) - 1)] == got
                for r in np.flatnonzero(hit.any(axis=1)).tolist():
                    t, s = int(text[part[r]]), int(window[part[r], 1])
                    run = numbers[t][max(s - most, 0) : s + n + most]
                    for k in {k for h in got[r, hit[r]].tolist() for k in table[h]}:
                        known = best.get((t, k), most + 1)
                        if known == 0 or n - int(self.shared(np.array([k]), run)[0]) >= known:
                            continue  # too few shared words for fewer edits
                        if (d := fitting_distance(self.items.words[k], run)) < known:
                            best[t, k] = d
        for t, held in enumerate(each):
            if len(held) and len(start := self.starts(numbers[t], seeds[t])):
                known = {k: d for k in np.unique(start[:, 0]).tolist() if (d := best.get((t, k))) is not None}
                self.rest(numbers[t], start, known)
                best.update(((t, k), d) for k, d in known.items())
        return [(t, k, d, len(self.items.words[k])) for (t, k), d in sorted(best.items())]


FOUND = "doc_id long, item_id long, edits long, item_words long"


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, item_words) of each item that a document holds."""
    spark = docs.sparkSession
    docs = only(docs, doc_id="doc_id", text="text")
    items = only(benchmark, item_id="item_id", text="text").where("text is not null")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()
    out = None
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_WORDS))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toPandas()
        shared = spark.sparkContext.broadcast(Items.of(rows.item_id.tolist(), rows.text.tolist()))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            finder = Finder(shared.value)
            for rows in batches:
                begin = 0
                for part in parts(rows.text.tolist(), 1 << 24):
                    found = [(rows.doc_id.iloc[begin + t], finder.items.ids[k], d, n) for t, k, d, n in finder.find(part)]
                    begin += len(part)
                    yield pd.DataFrame(found, columns=[c.split()[0] for c in FOUND.split(", ")]).astype({"doc_id": "Int64", "item_id": "Int64"})

        got = docs.mapInPandas(search, FOUND)
        out = got if out is None else out.unionAll(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all columns. Ids of found rows are few beside the texts."""
    found = matches(docs, benchmark).where("doc_id is not null").select(F.col("doc_id").alias("found_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["found_id"], "left_anti")
