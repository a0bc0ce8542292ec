"""Operator 7. Near duplicates: MinHash bands, sequential Bayesian pruning, exact verification.

Texts with the same set of shingles are one node, named by a hash of the set;
so copies never form pairs. Nodes that share a band of the signature are
candidates. They are looked at in two rounds:

1. In each bucket, all nodes are compared with the least one and the greatest one only. That joins
   large groups of near copies with as many pairs as they have members, or twice that.
2. In buckets whose other nodes still are of several components, all pairs of different ones are
   compared by signature, in blocks of bounded size; members of the largest one meet the
   others only. Pairs that pass are laid out in tiles, and only nodes of tiles get texts. A task verifies the pairs of
   its tiles, and leaves out those that its own links have joined meanwhile, so what leaves it are
   fewer links than the tile has nodes.

In both, signatures are compared a batch at a time. After n hashes with m
matches, the posterior of the similarity under a uniform prior is
Beta(m + 1, n - m + 1); a pair is dropped as soon as the posterior chance of
reaching the threshold falls below ``MISS``. Survivors are verified on whole
shingle sets, so no pair below the threshold is ever linked.

Edge cases: a null or wordless text has no shingles, is linked with nothing and
is its own component; fewer than five words are one shingle; rows of one doc_id
are one document, so their components join; a null doc_id is never linked, gets
a null component and is kept; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, only

WORDS = 5
#: Links hold from PERCENT % of the union on.
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes that are compared at a time, and the chance of a link that pruning may miss.
BATCH, MISS = 16, 1e-6
#: Members of a bucket that meet by signature, and nodes of a tile that meet with texts, from each side; pairs that are looked at together.
BLOCK, TILE, PAIRS = 2048, 256, 1 << 16
#: Partners that one task verifies with a text.
PARTNERS = 64
#: Copies of a text from which on its rows are split over SPLIT tasks, and how many such texts there can be.
LARGE, MOST_LARGE, SPLIT = 1000, 100_000, 64
CACHE = 500_000

_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_POWERS = np.full(WORDS, 0x9E3779B97F4A7C15, np.uint64).cumprod()


class Shingler:
    """Sets of hashed shingles; keeps the hashes of words."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # of bytes: only A-Z, only ASCII white space
        if not words:
            return np.empty(0, np.uint64)
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        n = min(WORDS, len(h))
        total = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            total += h[i : len(h) - n + 1 + i] * _POWERS[i]
        return np.unique(mix64(total + np.uint64(n)))


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each hash function over the set, as 32 bits."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = (shingles[None, i : i + 4096] ^ _XOR[:, None]) * _MULTIPLY[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def needed(threshold: float = PERCENT / 100, miss: float = MISS) -> list[int]:
    """After each batch, the fewest matches with which a pair goes on.

    The posterior chance P(Beta(m + 1, n - m + 1) >= t) is that of at most m
    successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


NEEDED = needed()


def likely(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows x of a and y of b the sequential test keeps."""
    alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k, least in enumerate(NEEDED):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[x[alive], part] == b[y[alive], part]).sum(axis=1)
        alive, matches = alive[matches >= least], matches[matches >= least]
    kept = np.zeros(len(x), bool)
    kept[alive] = True
    return kept


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(len(column), HASHES)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler = Shingler()
    for rows in batches:
        for i in range(0, len(rows), 1000):
            part = rows.iloc[i : i + 1000]
            sets = [shingler(t) for t in part.text]
            yield pd.DataFrame({
                "doc_id": part.doc_id.astype("Int64"),
                "n_shingles": [len(s) for s in sets],
                "node": pd.array([node_of(s) if len(s) else None for s in sets], "Int64"),
                "sig": [signature(s).tobytes() if len(s) else None for s in sets],
            })


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        if len(rows):
            sig = _signatures(rows.sig).astype(np.uint64).reshape(len(rows), BANDS, ROWS)
            key = mix64((sig * _MULTIPLY[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[None, :] * _XOR[0])
            yield pd.DataFrame({"key": key.view(np.int64).ravel(), "band": np.tile(np.arange(BANDS, dtype=np.int32), len(rows)), "node": np.repeat(rows.node.to_numpy(np.int64), BANDS)})


def _pruned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        if len(rows):
            at = np.arange(len(rows))
            yield rows.loc[likely(_signatures(rows.sig_a), _signatures(rows.sig_b), at, at), ["a", "b"]]


def _by_block(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows come sorted by block: whole blocks, and where each begins and ends."""
    held: list[pd.DataFrame] = []
    for rows in batches:
        if not len(rows):
            continue
        block = rows[columns].to_numpy()
        if held and not (block == held[0][columns].to_numpy()[0]).all(axis=1)[-1]:
            rows, held = pd.concat([*held, rows], ignore_index=True), []
            block = rows[columns].to_numpy()
        if held:
            held.append(rows)
            continue
        starts = np.concatenate([[0], np.flatnonzero((block[1:] != block[:-1]).any(axis=1)) + 1])
        held = [rows.iloc[starts[-1] :]]
        if len(starts) > 1:
            yield rows.iloc[: starts[-1]], starts
    if held:
        rows = pd.concat(held, ignore_index=True)
        yield rows, np.array([0, len(rows)])


class _Pairs:
    """Pairs of one block at a time: of different components, met in no earlier band and not ruled out by their signatures."""

    def __init__(self, rows: pd.DataFrame, edges: np.ndarray):
        self.edges, self.sig, self.comp = edges, _signatures(rows.sig), rows.comp.to_numpy()
        self.node, self.band = rows.node.to_numpy(), rows.band.to_numpy()
        self.own, self.crossed = (rows.side == rows.i).to_numpy(), (rows.i != rows.j).to_numpy()

    def _products(self, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Sides of a block whose pairs are wanted, and whether each pair comes twice; members of the largest component don't meet each other."""
        found, count = np.unique(self.comp[begin:end], return_counts=True)
        at, large = np.arange(begin, end), self.comp[begin:end] == found[count.argmax()]
        if self.crossed[begin]:
            own = self.own[begin:end]
            yield at[own & ~large], at[~own], False
            yield at[own & large], at[~own & ~large], False
        else:
            yield at[~large], at[~large], True
            yield at[~large], at[large], False

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row of the block, pairs x and y, equal hashes)."""
        for begin, end in zip(self.edges[:-1].tolist(), self.edges[1:].tolist()):
            for one, two, twice in self._products(begin, end):
                step = max(1, PAIRS // max(1, len(two)))
                for i in range(0, len(one) if len(two) else 0, step):
                    part = one[i : i + step]
                    x, y = np.repeat(part, len(two)), np.tile(two, len(part))
                    new = self.comp[x] != self.comp[y]
                    if twice:
                        new &= x < y
                    x, y = x[new], y[new]
                    good = likely(self.sig, self.sig, x, y)
                    x, y = x[good], y[good]
                    equal = self.sig[x] == self.sig[y]
                    met = equal.reshape(len(x), BANDS, ROWS).all(axis=2).argmax(axis=1) == self.band[x]
                    if met.any():
                        yield begin, x[met], y[met], equal[met].sum(axis=1)


TILED = "tile long, i int, j int, side int, band int, node long, comp long, sig binary"


def _tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of each block that must be verified, as tiles of TILE nodes from each side; a node stands in the tiles of its pairs."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 40
    for rows, edges in _by_block(batches, ["key", "i", "j"]):
        last, xs, ys, out = None, [], [], []

        def lay() -> None:
            nonlocal number
            if not xs:
                return
            x, y = np.concatenate(xs), np.concatenate(ys)
            p, q = np.unique(x, return_inverse=True)[1] // TILE, np.unique(y, return_inverse=True)[1] // TILE
            tile = p * (q.max() + 1) + q
            for side, at in ((0, x), (1, y)):
                both = np.unique(np.stack([tile, at], axis=1), axis=0)
                got = rows.iloc[both[:, 1]][["band", "node", "comp", "sig"]]
                got.insert(0, "side", side)
                got.insert(0, "j", 1)
                got.insert(0, "i", 0)
                got.insert(0, "tile", both[:, 0] + number)
                out.append(got)
            number += int(tile.max()) + 1

        for begin, x, y, _ in _Pairs(rows, edges):
            if begin != last:
                lay()
                last, xs, ys = begin, [], []
            xs.append(x.astype(np.int32))
            ys.append(y.astype(np.int32))
        lay()
        yield from out


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by tile. Links of its nodes that join different components."""
    sets = _Sets()
    for rows, edges in _by_block(batches, ["tile"]):
        yield _links(rows, edges, sets)


class _Sets:
    """Shingle sets of nodes, kept up to a bound."""

    def __init__(self, most: int = 10_000):
        self.shingler, self.kept, self.most = Shingler(), {}, most

    def __call__(self, node: int, text: str) -> np.ndarray:
        if node not in self.kept:
            if len(self.kept) >= self.most:
                self.kept.clear()
            self.kept[node] = self.shingler(text)
        return self.kept[node]


def _links(rows: pd.DataFrame, edges: np.ndarray, sets: _Sets) -> pd.DataFrame:
    """Pairs of one tile at a time that aren't joined meanwhile by another link, and verified."""
    found: list[tuple[int, int]] = []
    pairs, text = _Pairs(rows, edges), rows.text.to_numpy()
    comp, node = pairs.comp, pairs.node
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    for _, x, y, equal in pairs:
        order = np.argsort(-equal, kind="stable")
        for p, q in zip(x[order].tolist(), y[order].tolist()):
            c, d = top(int(comp[p])), top(int(comp[q]))
            if c != d and similar(sets(int(node[p]), text[p]), sets(int(node[q]), text[q])):
                root[max(c, d)] = min(c, d)
                found.append((int(node[p]), int(node[q])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def similar(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if 100 * min(len(one), len(two)) < PERCENT * max(len(one), len(two)):
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= PERCENT * (len(one) + len(two) - both)


def _text_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose text has the node's set (an id can have several texts)."""
    shingler = Shingler()
    for rows in batches:
        yield rows.loc[[bool(len(s)) and node_of(s) == n for s, n in zip(map(shingler, rows.text), rows.node)], ["node", "text"]]


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by (a, salt), the text of a first; then those of its partners."""
    shingler, last, own = Shingler(), None, np.empty(0, np.uint64)
    for rows in batches:
        found = []
        for a, b, text in zip(rows.a, rows.b, rows.text):
            if b == a:
                if a != last:
                    last, own = a, shingler(text)
                continue
            if similar(own, shingler(text)):
                found.append((a, b))
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. texts: one row of (node, text) for each node.

    A text goes once to each task of its partners, of which there are PARTNERS at most on average.
    """
    parts = pairs.groupBy("a").agg((F.count(F.lit(1)) / PARTNERS).cast("int").alias("more"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("more") + 1).alias("salt"))
    both = dealt.unionAll(dealt.select("a", F.col("a").alias("b"), "salt").distinct())
    full = both.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")
    first = F.when(F.col("a") == F.col("b"), 0).otherwise(1)
    return full.repartition("a", "salt").sortWithinPartitions("a", "salt", first).mapInPandas(_verified, "a long, b long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) of each node that has an edge: alternating large and small stars until nothing changes."""
    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{name}0")
    mark, k = None, 0
    while True:
        got = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if (got := tuple(got)) == mark:
            break
        mark, k = got, k + 1
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.write(small, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = only(docs, doc_id="doc_id", text="text")
    signed = scratch.write(docs.mapInPandas(_sign, "doc_id long, n_shingles long, node long, sig binary"), "signed")
    known = signed.where("node is not null and doc_id is not null")
    nodes = scratch.write(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies")), "nodes")
    bands = scratch.write(nodes.select("node", "sig").mapInPandas(_bands, "key long, band int, node long"), "bands")
    shared = bands.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = scratch.write(bands.join(shared, "key"), "met")
    scratch.drop("bands")
    sigs = nodes.select("node", "sig")

    pivots = met.select(F.explode(F.array("a", "z")).alias("a"), F.col("node").alias("b")).where("a != b")
    first = scratch.write(pivots.distinct(), "first")
    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "doc_id")
    texts = scratch.write(docs.join(wanted, "doc_id").select("node", "text").mapInPandas(_text_of, "node long, text string").dropDuplicates(["node"]), "texts")

    def of(pairs: DataFrame) -> DataFrame:
        return pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")

    survivors = scratch.write(of(first).mapInPandas(_pruned, "a long, b long"), "survivors1")
    links = scratch.write(verify(survivors, texts), "links1")
    comps = scratch.write(components(links, scratch, "star"), "comps")

    # Round 1 has seen all pairs of a bucket's least and greatest nodes.
    placed = met.where("node != a and node != z").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    each = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    mixed = each.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("l"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1")
    mixed = mixed.select("key", F.col("l.comp").alias("large"), F.col("l.m").alias("m"), "n")
    # A bucket is one block, or has blocks of the largest component, which don't meet, behind those of the others.
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    inside, one, spread = F.col("comp") == F.col("large"), F.col("n") <= BLOCK, F.xxhash64("node")
    few, many = blocks(F.col("n") - F.col("m")), blocks(F.col("m"))
    side = F.when(one, 0).when(inside, few + F.pmod(spread, many)).otherwise(F.pmod(spread, few)).cast("int")
    last = F.when(one, 0).when(inside, few - 1).otherwise(few + many - 1)
    rest = placed.drop("n").join(mixed, "key").withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rest = rest.select("key", "band", "node", "comp", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    near = rest.join(sigs, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    tiles = scratch.write(near.mapInPandas(_tiles, TILED), "tiles")
    dealt = tiles.join(texts, "node").repartition("tile").sortWithinPartitions("tile")
    links = links.unionAll(scratch.write(dealt.mapInPandas(_blocks, "a long, b long"), "links2"))
    # Rows of one id are one document.
    ids = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select("doc_id", "a")
    links = links.unionAll(known.join(ids, "doc_id").select("a", F.col("node").alias("b")).where("a != b"))
    comps = scratch.write(components(links, scratch, "all"), "final")
    for name in ("met", "first", "texts", "survivors1", "links1", "links2", "comps", "tiles"):
        scratch.drop(name)  # "signed", "nodes" and "final" are what the result is read from

    least = nodes.join(comps, "node").groupBy("comp").agg(F.min("doc_id").alias("least"))
    found = nodes.select("node", "doc_id", "copies").join(comps.join(least, "comp").select("node", "least"), "node", "left")
    found = found.select("node", "copies", F.coalesce("least", "doc_id").alias("least"))
    # A node with a large share of all rows is split over SPLIT tasks; there are at most MOST_LARGE of them, which is a bound for the broadcast.
    large = F.col("copies") > max(LARGE, signed.count() // MOST_LARGE)
    spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(large, SPLIT - 1).otherwise(0)))).drop("copies")
    names = F.broadcast(nodes.where(large).select("node", F.lit(True).alias("large")))
    salt = F.when(F.col("large"), F.pmod(F.xxhash64("doc_id"), F.lit(SPLIT))).otherwise(0).cast("int")
    rows = signed.select("doc_id", "n_shingles", "node").join(names, "node", "left").withColumn("salt", salt)
    out = rows.join(spread, ["node", "salt"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
