"""Operator 9. Packing: lexical retrieval over a sharded BM25 inverted index.

A document is its token ids and one end id. Documents longer than a window fill
whole windows of their own, without any shuffle; what is left of each, and every shorter document,
is an item of less than a window. Items are dealt by content into shards of about ``SHARD`` items: a tree
of splits at medians, learnt on a sample of items' projected BM25 vectors, has a leaf for each shard, ``LEAVES`` at most.
Items are sorted by leaf over all partitions; a task reads them in this order and cuts them into shards, at the
ends of leaves where it can. So a task holds one shard, in however large a leaf, and equal items are parted by a salt.
Each shard has an inverted index of its items'
token ids with BM25 impacts; document frequencies and the mean length are those of the whole
corpus. The first unused item is a seed: its unused neighbours, best score first,
fill its window, and the one that doesn't fit is cut there. Its rest stays an
unused item. What doesn't fill a shard's last window goes on to the next shard, so one window of a partition is padded.

Edge cases: a null or empty text is the end id alone; equal rows are packed each
for itself; a null doc_id goes to a shard like any other; an empty table gives no
pieces; extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix64, only

WINDOW = 4096
END = 2
#: Items of a shard, on average; what a task holds at once. Leaves of the tree, at most, which bounds what the driver learns from.
SHARD, LEAVES = 1024, 4096
#: Dimensions of projected items, sampled items a leaf and at least, and the jitter that parts equal items.
DIMENSIONS, SAMPLE, LEAST_SAMPLE, JITTER = 64, 16, 8192, 1e-3
#: Items that are looked at together.
TOGETHER = 256
K1, B = 1.2, 0.75
#: A word of more than one in so many items has a row; the table has fewer cells than so many times the postings.
DENSE = 8
#: Of the idf in a projection; of the projection's signs.
POWER, SEED = 1.5, 20240616
#: Distinct pieces of a generation.
CACHE = 800_000
#: Letters that normalising leaves alone but for capitals: Latin, Greek, Cyrillic, Hebrew, Arabic, kana, Han, Hangul.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏΆΈ-ΊΌΎ-ΡΣ-ώЀ-ҁҊ-ԯ\u05d0-\u05ea\u0621-\u063a\u0641-\u064aぁ-ゖァ-ヺ一-龥가-힣"
#: Ids of the vocabulary, at most; they fit 16 bits.
VOCABULARY = 1 << 16

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Pieces:
    """Ids of distinct pieces in flat columns, which take a small part of the memory of Python's own strings."""

    def __init__(self):
        self.names = pa.array([], pa.string())
        self.start, self.size, self.flat = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint16)

    def add(self, names: pa.Array, size: np.ndarray, flat: np.ndarray) -> None:
        self.names, self.size, self.flat = pa.concat_arrays([self.names, names]), np.append(self.size, size), np.append(self.flat, flat)
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size

    def find(self, names: pa.Array) -> np.ndarray:
        """The place of each of these distinct names here, or -1; the hash table is that of the fewer ones."""
        asked = pc.fill_null(pc.index_in(self.names, value_set=names), -1).to_numpy()
        known, at = np.flatnonzero(asked >= 0), np.full(len(names), -1, np.int64)
        at[asked[known]] = known
        return at


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of these starts and sizes, one after the other; 32 bits hold all places, as the bytes of a column do."""
    place = np.repeat(start - np.cumsum(size, dtype=np.int32) + size, size)
    place += np.arange(len(place), dtype=np.int32)
    return flat[place]


class Encoder:
    """Ids of whole texts, a column at a time.

    The vocabulary's pattern never spans white space, so the ids of a text are those of its words. Signs at the end of a word are
    a piece of their own, capitals don't matter to the vocabulary, and each distinct piece is encoded once. Pieces are kept in two
    generations, so those that recur stay. A task has one core, so the library starts no threads.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.letters = Tokenizer.from_file(tokenizer), Tokenizer.from_file(tokenizer)
        # ``LETTERS`` alone: none is composed or taken apart and a word is one piece, so capitals are all that is left of rules and pattern.
        self.letters.normalizer = normalizers.Lowercase()
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(VOCABULARY, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.new, self.old = Pieces(), Pieces()

    def __call__(self, texts: pa.Array) -> pa.Array:
        """The ids of each text and the end id, as 16-bit numbers."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # no special tokens, which are found in the text as it stands
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        pieces = pa.concat_arrays(self._cut(coded.dictionary)).dictionary_encode()
        at = self._places(pieces.dictionary)[pieces.indices.to_numpy().reshape(2, -1).T.ravel()]
        # The ids of each distinct word, and last the end of a text.
        flat = np.append(gathered(self.new.flat, self.new.start[at], self.new.size[at]), np.uint16(END))
        size = np.append(self.new.size[at].reshape(-1, 2).sum(axis=1, dtype=np.int32), np.int32(1))
        start = np.cumsum(size, dtype=np.int32) - size
        words = split.offsets.to_numpy()
        words = words[1:] - words[0]
        codes = np.insert(coded.indices.to_numpy(), words, len(size) - 1)
        size = size[codes]
        bounds = np.append(0, np.cumsum(size, dtype=np.int32)[words + np.arange(len(words))] * 2).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds), pa.py_buffer(gathered(flat, start[codes], size))])

    @staticmethod
    def _cut(words: pa.Array) -> list[pa.Array]:
        """Each word's piece up to a last letter, and the signs that follow; the whole word and nothing where there is no such place."""
        stems = pc.ascii_rtrim(words, characters=".,!?;:|$%*#&")
        cut = pc.and_not(pc.match_substring_regex(stems, f"[{LETTERS}]$"), pc.match_substring(words, "<|"))
        stems = pc.if_else(cut, stems, words)
        size, begin = pc.binary_length(stems).to_numpy(), np.frombuffer(words.buffers()[1], np.int32)[words.offset :][: len(words) + 1]
        signs = np.diff(begin) - size
        data = gathered(np.frombuffer(words.buffers()[2] or b"", np.uint8), begin[:-1] + size, signs)
        bounds = np.append(0, np.cumsum(signs)).astype(np.int32)
        return [stems, pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(bounds), pa.py_buffer(data)])]

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Of distinct pieces in the new generation, which learns those that it hasn't."""
        if len(self.new.names) > CACHE:
            self.new, self.old = Pieces(), self.new
        at = self.new.find(pieces)
        rest = np.flatnonzero(at < 0)
        asked = pieces.take(pa.array(rest))
        old = self.old.find(asked)
        plain = pc.match_substring_regex(asked, f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
        kept, letters, other = (np.flatnonzero(x) for x in (old >= 0, (old < 0) & plain, (old < 0) & ~plain))
        at[rest[np.concatenate([kept, letters, other])]] = len(self.new.names) + np.arange(len(rest))
        size, start = self.old.size[old[kept]], self.old.start[old[kept]]
        self.new.add(asked.take(pa.array(kept)), size, gathered(self.old.flat, start, size))
        letters, other = asked.take(pa.array(letters)), asked.take(pa.array(other))
        self.new.add(pa.concat_arrays([letters, other]), *self._learnt(letters, other))
        return at

    def _learnt(self, letters: pa.Array, other: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids. Words of letters are one piece each, so many are encoded together and told apart by their last ids."""
        words = letters.to_numpy(zero_copy_only=False).tolist()
        runs = self.letters.encode_batch_fast([" ".join(words[i : i + 512]) for i in range(0, len(words), 512)], add_special_tokens=False)
        flat = np.concatenate([np.empty(0, np.uint16), *(np.array(e.ids, np.uint16) for e in runs)])
        size = np.diff(np.flatnonzero(self.ends[flat]), prepend=-1)
        ids = [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(other.to_pylist(), add_special_tokens=False)]
        return np.append(size, [len(x) for x in ids]).astype(np.int32), np.concatenate([flat, *ids])


_encoders: dict[str, Encoder] = {}


def encoder_of(tokenizer: str) -> Encoder:
    """One for each worker process, whose tasks share its words."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer)
    return _encoders[tokenizer]


def slices(column: pa.Array, most: int = 1 << 24) -> Iterator[pa.Array]:
    """The column in runs of about ``most`` bytes, a value never cut."""
    size = np.cumsum(np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)))
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + most)))
        yield column.slice(begin, end - begin)
        begin = end


def counted(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids of each item: the item's place, the id, how often it has it; by item, then by id. At most 2^16 items."""
    size = np.fromiter(map(len, items), np.int64, len(items))
    flat = np.concatenate([*items, np.empty(0, np.uint16)]).astype(np.uint32)
    keys = np.sort(np.repeat(np.arange(len(items), dtype=np.uint32) << 16, size) | flat)
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ 1)) if len(keys) else np.empty(0, np.int64)
    return (keys[first] >> 16).astype(np.int64), (keys[first] & 0xFFFF).astype(np.int64), np.diff(np.append(first, len(keys)))


def statistics(encoded: DataFrame) -> tuple[int, float, np.ndarray]:
    """Documents, mean length and document frequencies over the whole corpus; a row for each id of the vocabulary at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, tokens, n = np.zeros(VOCABULARY, np.int64), 0, 0
        for rows in batches:
            for i in range(0, len(rows), TOGETHER):
                ids = [np.frombuffer(x, np.uint16) for x in rows.ids.iloc[i : i + TOGETHER]]
                n, tokens = n + len(ids), tokens + sum(map(len, ids))
                df += np.bincount(counted(ids)[1], minlength=VOCABULARY)
        used = np.flatnonzero(df)
        yield pd.DataFrame({"token": np.append(used, [-1, -2]), "n": np.append(df[used], [n, tokens])})

    rows = encoded.select("ids").mapInPandas(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(VOCABULARY, np.int64)
    total = dict(zip(rows.token[rows.token < 0], rows.n[rows.token < 0]))
    df[rows.token[rows.token >= 0]] = rows.n[rows.token >= 0]
    n = int(total.get(-1, 0))
    return n, total.get(-2, 0) / max(n, 1), df


class Index:
    """An inverted index of items with the BM25 impact of each posting; postings of words that many items have are rows of a table."""

    def __init__(self, items: list[np.ndarray], n: int, mean: float, df: np.ndarray):
        item, term, tf = counted(items)
        size = np.fromiter(map(len, items), np.int64, len(items))
        idf = np.log1p((n - df[term] + 0.5) / (df[term] + 0.5))
        impacts = (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / max(mean, 1)))).astype(np.float32)
        edges = np.searchsorted(item, np.arange(len(items) + 1))
        self.terms = [term[a:b] for a, b in zip(edges, edges[1:])]
        order = np.argsort(term.astype(np.uint16), kind="stable")
        self.docs, self.impacts = item[order], impacts[order]
        sizes = np.bincount(term, minlength=VOCABULARY)
        self.start = np.append(0, np.cumsum(sizes))
        often = np.flatnonzero(sizes * DENSE > len(items))
        self.row = np.full(VOCABULARY, -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), len(items)), np.float32)
        shared = np.flatnonzero(self.row[term] >= 0)
        self.dense[self.row[term[shared]], item[shared]] = impacts[shared]
        self.n = len(items)

    def scores(self, i: int) -> np.ndarray:
        """Of all items, for item i as the query."""
        row = self.row[self.terms[i]]
        rare = self.terms[i][row < 0]
        first, size = self.start[rare], self.start[rare + 1] - self.start[rare]
        at = np.repeat(first - np.cumsum(size) + size, size)
        at += np.arange(len(at))
        return np.bincount(self.docs[at], self.impacts[at], self.n) + np.add.reduce(self.dense[row[row >= 0]], axis=0)


def windows(lengths: list[int], items: list[np.ndarray], n: int, mean: float, df: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of pieces (item, start, length). lengths: of the items; items: the ids that index them."""
    left = np.array(lengths, np.int64)
    start, index, seed = np.zeros_like(left), Index(items, n, mean, df), 0
    while True:
        while seed < len(left) and not left[seed]:
            seed += 1
        if seed == len(left):
            return
        score = index.scores(seed)
        score[left == 0] = -1
        score[seed] = np.inf
        room, window = WINDOW, []
        for d in np.argsort(-score, kind="stable"):
            if not room or not left[d]:
                break  # used ones come last
            k = int(min(room, left[d]))
            window.append((int(d), int(start[d]), k))
            start[d], left[d], room = start[d] + k, left[d] - k, room - k
        yield window


class Projection:
    """Items as short vectors: their words' signs, weighted like BM25's query and document at once; ones of like words are near."""

    def __init__(self, n: int, df: np.ndarray):
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        signs = np.random.default_rng(SEED).integers(0, 2, (VOCABULARY, DIMENSIONS), np.int8) * 2 - 1
        self.words = (signs * (idf**POWER)[:, None]).astype(np.float32)

    def __call__(self, items: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(items), DIMENSIONS), np.float32)
        for i in range(0, len(items), TOGETHER):
            item, term, _ = counted(items[i : i + TOGETHER])
            if len(item):
                first = np.flatnonzero(np.diff(item, prepend=-1))
                out[i + item[first]] = np.add.reduceat(self.words[term], first)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Tree:
    """Splits of vectors at medians along their main direction; node k has the children 2k + 1 and 2k + 2, a leaf is a shard."""

    def __init__(self, sample: np.ndarray, salts: np.ndarray, shards: int):
        direction, cut, left, right = [], [], [], []

        def grow(at: np.ndarray, first: int, count: int, depth: int) -> int:
            """A node's number, or for a leaf -1 - its shard."""
            if count == 1:
                return -1 - first
            low = count // 2
            x = sample[at].astype(np.float64)
            x = x - x.mean(axis=0) if len(x) else x
            way = np.linalg.eigh(x.T @ x)[1][:, -1].astype(np.float32)
            value = sample[at] @ way + jitter(salts[at], depth)
            place = float(np.quantile(value, low / count)) if len(at) else 0.0
            me = len(cut)
            for column, x in zip((direction, cut, left, right), (way, place, 0, 0)):
                column.append(x)
            left[me] = grow(at[value < place], first, low, depth + 1)
            right[me] = grow(at[value >= place], first + low, count - low, depth + 1)
            return me

        grow(np.arange(len(sample)), 0, shards, 0)
        self.direction = np.array(direction, np.float32).reshape(-1, DIMENSIONS)
        self.cut, self.left, self.right = np.array(cut), np.array(left, np.int64), np.array(right, np.int64)

    def __call__(self, vectors: np.ndarray, salts: np.ndarray) -> np.ndarray:
        """The shard of each."""
        node, depth = np.zeros(len(vectors), np.int64) if len(self.cut) else np.full(len(vectors), -1), 0
        while len(at := np.flatnonzero(node >= 0)):
            k = node[at]
            value = np.einsum("ij,ij->i", vectors[at], self.direction[k]) + jitter(salts[at], depth)
            node[at] = np.where(value < self.cut[k], self.left[k], self.right[k])
            depth += 1
        return -1 - node


def jitter(salts: np.ndarray, depth: int) -> np.ndarray:
    """Small numbers, another for each depth, so that equal items fall on both sides of a cut."""
    return (mix64(salts.astype(np.uint64) + np.uint64(depth)) >> np.uint64(11)).astype(np.float64) * (JITTER / (1 << 53))


def rest_of(ids: bytes) -> np.ndarray:
    """What is left after whole windows."""
    x = np.frombuffer(ids, np.uint16)
    return x[len(x) - len(x) % WINDOW :]


def crc_of(ids: np.ndarray) -> int:
    return crc32(ids.astype("<u4").tobytes())


ITEMS = "doc_id long, doc_tokens long, windows array<long>, ids binary, leaf int, code float, salt long"


def deal(encoded: DataFrame, leaves: int, n: int, df: np.ndarray, spark: SparkSession) -> DataFrame:
    """Of each document: the checksums of its whole windows, the ids of its rest, and that item's place: leaf, code, salt; near ones are
    near in this order, and each leaf gets about as many."""
    salted = encoded.withColumn("salt", F.xxhash64("doc_id", F.crc32("ids"), F.monotonically_increasing_id()))  # equal rows have different ones
    every = spark.sparkContext.broadcast(df)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection = Projection(n, every.value)
        for batch in batches:
            vectors = projection([rest_of(x) for x in batch.column("ids").to_pylist()]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("salt"), pa.array([v.tobytes() for v in vectors], pa.binary())], ["salt", "vector"])

    if leaves > 1:
        most = max(LEAST_SAMPLE, SAMPLE * leaves)
        rows = salted.where(F.pmod("salt", F.lit(max(1, n // most))) == 0).mapInArrow(project, "salt long, vector binary").toPandas().sort_values("salt")
        vectors = np.frombuffer(b"".join(rows.vector), np.float16).reshape(-1, DIMENSIONS).astype(np.float32)
        tree = Tree(vectors, rows.salt.to_numpy(np.int64), leaves)
    else:
        tree = Tree(np.empty((0, DIMENSIONS), np.float32), np.empty(0, np.int64), 1)
    tree = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection = Projection(n, every.value)
        for whole in batches:
            for i in range(0, len(whole), 4 * TOGETHER):
                batch = whole.slice(i, 4 * TOGETHER)
                ids = [np.frombuffer(x, np.uint16) for x in batch.column("ids").to_pylist()]
                rest = [x[len(x) - len(x) % WINDOW :] for x in ids]
                vectors = projection(rest)
                leaf = tree.value(vectors, batch.column("salt").to_numpy()).astype(np.int32)
                full = [[crc_of(x[a : a + WINDOW]) for a in range(0, len(x) - WINDOW + 1, WINDOW)] for x in ids]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array([x.tobytes() for x in rest], pa.binary()),
                    pa.array(leaf), pa.array(vectors[:, 0]), batch.column("salt"),
                ], [c.split()[0] for c in ITEMS.split(", ")])

    return salted.mapInArrow(place, ITEMS)


def shards_of(batches: Iterator[pd.DataFrame], shard: int) -> Iterator[tuple[list, bool]]:
    """Rows (doc_id, doc_tokens, start, ids) of a partition, cut where a leaf ends and half a shard is there, or where there are two;
    and whether more rows come."""
    held, last = [], None
    for rows in batches:
        for doc_id, tokens, ids, leaf in zip(rows.doc_id, rows.doc_tokens, rows.ids, rows.leaf):
            if len(held) >= 2 * shard or leaf != last and 2 * len(held) >= shard:
                yield held, True
                held = []
            last = leaf
            x = np.frombuffer(ids, np.uint16)
            held.append((doc_id, tokens, tokens - len(x), x))
    yield held, False


def pack(docs: DataFrame, tokenizer: str, shard: int = SHARD) -> DataFrame:
    """The pieces of all documents."""
    docs = only(docs, doc_id="doc_id", text="text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), encoder(part)], ["doc_id", "ids"])
                at += len(part)

    scratch = Scratch(docs.sparkSession, "packing")
    encoded = scratch.write(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids binary"), "encoded")
    n, mean, df = statistics(encoded)
    corpus = docs.sparkSession.sparkContext.broadcast((n, mean, df))  # a number for each id of the vocabulary
    items = scratch.write(deal(encoded, max(1, min(LEAVES, -(-n // shard))), n, df, scratch.spark), "items")
    scratch.drop("encoded")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, over = TaskContext.get().partitionId() << 44, []
        for k, (rows, more) in enumerate(shards_of(batches, shard)):
            rows, found, over = over + rows, [], []
            if not rows:
                continue
            for w, window in enumerate(windows([len(x) for *_, x in rows], [x for *_, x in rows], *corpus.value)):
                if more and sum(size for *_, size in window) < WINDOW:
                    over = [(*rows[d][:2], rows[d][2] + start, rows[d][3][start : start + size]) for d, start, size in window]
                    break
                offset = 0
                for d, start, size in window:
                    doc_id, tokens, first, x = rows[d]
                    found.append((doc_id, first + start, size, crc_of(x[start : start + size]), tokens, base + (k << 20) + w, offset))
                    offset += size
            yield pd.DataFrame(found, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64"})

    order = ["leaf", "code", "salt"]
    rest = items.where("octet_length(ids) > 0").select("doc_id", "doc_tokens", "ids", *order)
    rest = rest.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(fill, PIECES)
    full = items.where("size(windows) > 0").select("doc_id", "doc_tokens", F.posexplode("windows").alias("k", "crc"))
    number = F.monotonically_increasing_id() + F.lit(1 << 62)  # beyond those of the shards
    full = full.select("doc_id", (F.col("k") * WINDOW).cast("long").alias("start"), F.lit(WINDOW).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rest.unionAll(full)
