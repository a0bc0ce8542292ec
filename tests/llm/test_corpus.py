"""Operators 7 to 10 against brute force."""

import os
import random
import subprocess
import sys
from collections import defaultdict
from pathlib import Path
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from plumbline.llm import decontamination, html_text, minhash, packing
from plumbline.llm.common import table
from plumbline.llm.queries import tokenizer

# Near duplicates


def components(rows):
    """Smallest doc_id of each component, by all pairs."""
    shingler = minhash.Shingler()
    sets = [(int(i), set(shingler(t).tolist())) for i, t in rows if not pd.isna(i)]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    where = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        for x in s:
            where[x].append(k)
    for k, (i, s) in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for o in where[x]:
                if o > k:
                    shared[o] += 1
        for o, n in shared.items():
            j, t = sets[o]
            if 100 * n >= 75 * (len(s) + len(t) - n):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in up}


def family(n, seed, edits):
    """Copies of one text with a few words changed in each: pairs lie around the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(999)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def same_components(df):
    rows = df.select("doc_id", "text").toPandas()
    got = minhash.near_duplicates(df).toPandas()
    assert len(got) == len(rows)
    want = components(rows.itertuples(index=False))
    for r in got.itertuples():
        if pd.isna(r.doc_id):
            assert pd.isna(r.component_id) and r.kept
        else:
            assert r.component_id == want[int(r.doc_id)] and r.kept == (r.component_id == r.doc_id)
    return got


def test_near_duplicates_of_a_table(spark):
    same_components(table(spark, "/root/testdata/sf0.001", "documents"))


def test_near_duplicate_families(spark):
    texts = family(150, 1, 12) + family(60, 2, 4) + ["same text of six words here"] * 40 + ["a b", "A B", "a b c", "a\tb"]
    same_components(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    same_components(spark.createDataFrame(list(enumerate(family(60, 3, 14))), "doc_id long, text string"))


def test_many_near_copies_of_two_components_in_one_bucket(spark):
    """Two texts that share bands but aren't linked, each with 2,500 near copies."""
    rng = random.Random(12)
    lead = [f"w{rng.randrange(10**6)}" for _ in range(75)]
    bases = [lead + [f"w{rng.randrange(10**6)}" for _ in range(25)] for _ in range(2)]
    sets = [minhash.Shingler()(" ".join(b)) for b in bases]
    assert (minhash.signature(sets[0]) == minhash.signature(sets[1])).reshape(minhash.BANDS, minhash.ROWS).all(axis=1).any() and not minhash.similar(*sets)
    rows = [(i, " ".join([*bases[i % 2][:-1], f"x{i}"])) for i in range(5000)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("component_id").count().collect()
    assert {tuple(r) for r in got} == {(0, 2500), (1, 2500)}


def test_small_blocks_and_tiles(spark, monkeypatch):
    """All blocks and tiles are crossed; module settings are read in tasks, so tasks' functions are called here."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    texts = [" ".join([*base[: 40 - 2 * (i % 5)], *(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(8)))]) for i in range(60)]
    sets = [minhash.Shingler()(x) for x in texts]
    rows = pd.DataFrame({"key": 1, "band": 0, "node": range(60), "comp": [i if i % 3 else 0 for i in range(60)], "sig": [minhash.signature(s).tobytes() for s in sets], "side": [0 if i % 3 else 1 for i in range(60)], "i": 0, "j": 1})
    same = lambda x, y: (minhash.signature(sets[x]) == minhash.signature(sets[y])).reshape(minhash.BANDS, minhash.ROWS).all(axis=1)
    first = [[same(x, y).argmax() == 0 and same(x, y).any() or not same(x, y).any() for y in range(60)] for x in range(60)]
    sig = minhash._signatures(rows.sig)
    monkeypatch.setattr(minhash, "TILE", 4)
    for crossed in (False, True):
        block = rows if crossed else rows.assign(side=0, i=0, j=0)
        want = {(x, y) for x in range(60) for y in range(x) if (x % 3 or y % 3) and not (crossed and (x % 3 != 0) == (y % 3 != 0)) and first[x][y] and minhash.likely(sig, sig, np.array([x]), np.array([y]))[0]}
        monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda self: 3})())
        tiles = pd.concat([*minhash._tiles(iter([block.iloc[:25].copy(), block.iloc[25:].copy()]))])
        monkeypatch.undo()
        monkeypatch.setattr(minhash, "TILE", 4)
        assert tiles.groupby(["tile", "side"]).node.nunique().max() <= 4
        got = {(max(x, y), min(x, y)) for _, t in tiles.groupby("tile") for x in t.node[t.side == 0] for y in t.node[t.side == 1]}
        assert want and want <= got


def test_a_large_component_does_not_meet_itself_again(spark, monkeypatch):
    """1,500 linked near copies share bands with three others: the second round gets few texts, not 1,500 from each of several blocks and bands."""
    rng = random.Random(12)
    lead = [f"w{rng.randrange(10**6)}" for _ in range(75)]
    one, two = (lead + [f"w{rng.randrange(10**6)}" for _ in range(25)] for _ in range(2))
    rows = [(i, " ".join([*(two if i < 3 else one)[:-1], f"x{i}"])) for i in range(1503)]
    seen, write = {}, minhash.Scratch.write

    def keep(self, df, name, codec="zstd"):
        seen[name] = df._jdf.queryExecution()
        return write(self, df, name, codec)

    monkeypatch.setattr(minhash.Scratch, "write", keep)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("component_id").count().collect()
    assert {tuple(r) for r in got} == {(0, 3), (3, 1500)}
    text = seen["links2"].toString()
    assert "_tiles" not in text and "tile" in text  # texts are joined to what _tiles has left, not to blocks


def test_large_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LARGE", 5)
    texts = ["one text that has very many copies"] * 50 + family(10, 4, 5)
    same_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_near_duplicates_odd_rows(spark, odd):
    got = same_components(odd)
    assert got[got.doc_id.isin([2, 3, 4])].n_shingles.tolist() == [0, 0, 0] and got[got.doc_id == 6].component_id.tolist() == [1]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    texts = family(2, 9, 2)
    df = spark.createDataFrame([(1, texts[0]), (5, texts[1]), (5, "quite another text with enough words in it"), (9, "quite another text with enough words in it")], "doc_id long, text string")
    assert set(minhash.near_duplicates(df).toPandas().component_id) == {1}


def test_words_and_case():
    s = minhash.Shingler()
    assert s("A b").size == 1 and (s("É A b c d") != s("é a b c d")).any() and (s("X Y") == s("x\x0by")).all() and s(None).size == 0


def test_pruning_keeps_links():
    """Signatures of pairs at the threshold are ruled out no more often than was chosen."""
    rng = np.random.default_rng(4)
    equal = rng.random((20_000, minhash.HASHES)) < 0.75
    a, b = equal.astype(np.uint32), np.ones_like(equal, np.uint32)
    at = np.arange(len(a))
    assert minhash.likely(a, b, at, at).mean() > 1 - 1e-3
    assert minhash.likely((rng.random((20_000, minhash.HASHES)) < 0.4).astype(np.uint32), b, at, at).mean() < 0.05


# Decontamination


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_fitting_distance_is_exact():
    rng = random.Random(0)
    for _ in range(60):
        item, text = [rng.randrange(4) for _ in range(rng.randrange(1, 7))], [rng.randrange(4) for _ in range(rng.randrange(0, 12))]
        want = min(edit_distance(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        assert decontamination.fitting_distance(np.array(item), np.array(text, np.int64)) == want


def test_planted_items_are_found(spark):
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 50)))) for i in range(40)] + [(90, None), (91, ""), (92, "two words"), (93, "v1, V2. v3!")]
    docs, want = [], set()
    for d in range(200):
        words = [word() for _ in range(rng.randrange(20, 300))]
        if d % 2:
            i, text = items[rng.randrange(40)]
            piece = text.split()
            most = decontamination.most_edits(len(piece))
            for _ in range(rng.randrange(most // 2 + 1)):
                at = rng.randrange(len(piece))
                piece[at : at + 1] = rng.choice([[], ["changed"], [piece[at], "added"]])
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in piece]
            want.add((d, i))
        docs.append((d, " ".join(words)))
    docs += [(500, "x TWO  words. y"), (501, "v1 v2 v3"), (502, None), (503, ""), (None, items[0][1]), (504, items[1][1]), (504, items[1][1])]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    got = decontamination.matches(df, spark.createDataFrame(items, "item_id long, text string")).toPandas()
    pairs = {(int(d), int(i)) for d, i in zip(got.doc_id, got.item_id) if not pd.isna(d)}
    assert len(want - pairs) <= 1 and not {p for p in pairs - want if p[0] < 200}
    assert {(500, 92), (501, 93), (504, 1)} <= pairs and sum(got.doc_id == 504) == 2 and got.doc_id.isna().sum() == 1
    kept = decontamination.clean(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns and kept.where("doc_id = 0 OR doc_id = 502").count() == 2 and kept.where("doc_id = 504").count() == 0


def test_decontamination_empty_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "eight nine ten eleven twelve")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, "eight nine ten eleven twelve")], "item_id long, text string")
    assert decontamination.matches(docs, items.limit(0)).count() == 0 and decontamination.matches(docs.limit(0), items).count() == 0
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 1)
    assert sorted((r.doc_id, r.item_id) for r in decontamination.matches(docs, items).collect()) == [(1, 1), (2, 2)]


def test_cgk_keeps_near_sequences_near():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 5000, (200, 40))
    b = a.copy()
    b[np.arange(200), rng.integers(0, 40, 200)] = 9999
    near = (decontamination.embed(a, 0) == decontamination.embed(b, 0)).mean()
    far = (decontamination.embed(a, 0) == decontamination.embed(rng.integers(0, 5000, (200, 40)), 0)).mean()
    assert near > 0.7 > 0.2 > far


def test_edits_leave_a_seed():
    """A run of the seed's size stays whole for any places of the most edits; they are in proportion at each length."""
    for n in range(1, 300):
        k, size = decontamination.most_edits(n), decontamination.seed_size(n)
        assert k == int(0.3 * n) and 1 <= size <= 3 and (n - k) > (size - 1) * (k + 1)


def test_a_very_long_text_and_a_phrase_of_many_items():
    """A run that all items and most of the text share: bounded work, the right items."""
    rng = random.Random(5)
    items = ["one of the many " + " ".join(f"v{rng.randrange(500)}" for _ in range(9)) for _ in range(300)]
    finder = decontamination.Finder(decontamination.Items.of(list(range(300)), items))
    text = "one of the many " * 20_000 + items[17] + " one of the many" * 1000
    assert [(t, k, d) for t, k, d, _ in finder.find([text, None, ""])] == [(0, 17, 0)]


@pytest.mark.parametrize("n", [4, 5, 7, 8, 10, 11, 12, 14, 17, 20, 40, 60, 120, 200])
def test_items_with_most_edits_are_found(n):
    """Every item at the most edits allowed, with the edit distance of brute force over all runs of the text."""
    rng = random.Random(n)
    items = [[f"v{rng.randrange(3000)}" for _ in range(n)] for _ in range(30)]
    finder, texts = decontamination.Finder(decontamination.Items.of(list(range(30)), [" ".join(x) for x in items])), []
    for x in items:
        piece = list(x)
        k = decontamination.most_edits(n)  # for half of the items evenly spaced, which leaves the shortest runs
        for at in rng.sample(range(n), k) if len(texts) % 2 else [(j + 1) * (n + 1) // (k + 1) - 1 for j in range(k)]:
            piece[at] = f"z{rng.randrange(3000)}"
        texts.append(" ".join([f"v{rng.randrange(3000)}" for _ in range(40)] + piece + [f"v{rng.randrange(3000)}" for _ in range(40)]))
    numbers, want = [finder.numbers(t) for t in texts], set()
    for t, text in enumerate(numbers):
        for k, item in enumerate(finder.items.words):
            if (d := decontamination.fitting_distance(item, text)) <= decontamination.most_edits(n):
                want.add((t, k, d, n))
    assert {(i, i) for i in range(30)} <= {w[:2] for w in want} and set(finder.find(texts)) == want


# Packing


def check_packing(df, shard):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = packing.pack(df, tokenizer("word_bpe_49k.json"), shard).toPandas()
    ids = [(i, tok.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in df.select("doc_id", "text").collect()]
    assert got.length.sum() == sum(len(x) for _, x in ids) and got.length.min() >= 1
    texts = defaultdict(list)
    for i, x in ids:
        texts[i].append(x)
    for i, g in got.groupby("doc_id", dropna=False):
        own = texts[None if pd.isna(i) else int(i)]
        total = sum(len(x) for x in own)
        assert g.length.sum() == total
        if len(own) == 1:
            g = g.sort_values("start")
            assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and set(g.doc_tokens) == {total}
            for s, n, c in zip(g.start, g.length, g.ids_crc32):
                assert c == crc32(np.array(own[0][s : s + n], "<u4").tobytes())
    full = 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= packing.WINDOW
        full += g.length.sum() == packing.WINDOW
    return got, full


def test_packing_round_trip(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    got, full = check_packing(df, 64)
    assert got.sequence_id.nunique() - full <= -(-df.count() // 64)  # only the last window of a shard is padded


def test_packing_odd_rows(spark, odd):
    got, _ = check_packing(odd, 1024)
    assert got[got.doc_id == 3].length.tolist() == [1]
    assert packing.pack(odd.limit(0), tokenizer("word_bpe_49k.json")).count() == 0


def test_packing_a_large_leaf_and_equal_rows(spark, monkeypatch):
    """Half of the rows are one row; a leaf beyond a shard is cut, and no task holds more than two shards."""
    monkeypatch.setattr(packing, "LEAVES", 2)
    rows = [(7, "the same words in each row of these")] * 300 + [(i, f"own words {i} " * (i % 9)) for i in range(300)] + [(1000, "long text " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, full = check_packing(df, 16)
    assert got.sequence_id.nunique() - full <= 4
    table = pd.DataFrame({"doc_id": 1, "doc_tokens": 2, "ids": [b"ab"] * 100, "leaf": [0] * 70 + [1] * 30})
    assert [(len(x), more) for x, more in packing.shards_of(iter([table[:50], table[50:]]), 16)] == [(32, True), (32, True), (6 + 26, True), (4, False)]


def test_counted_equals_unique():
    rng = np.random.default_rng(3)
    items = [rng.integers(0, 50, k).astype(np.uint16) for k in (5, 0, 80, 1, 0)]
    item, term, tf = packing.counted(items)
    want = [(i, t, k) for i, x in enumerate(items) for t, k in zip(*np.unique(x, return_counts=True))]
    assert list(zip(item, term, tf)) == want and [len(x) for x in packing.counted([])] == [0, 0, 0]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    texts = ["", None, " lead trail ", "İstanbul ǅ á \xa0x\x1cy\x85z é it's 'S don’t 12345 ½ ΑΣ ΣΑΣ.", "a\x00b c​d", "שׁ יִ", "<|startoftext|>a B<|endoftext|>", "<|ENDOFTEXT|> Q", "x" * 300, "é ﬁ"]
    got = packing.Encoder(tokenizer("word_bpe_49k.json"))(pa.array(texts, pa.string())).to_pylist()
    assert [np.frombuffer(x, np.uint16).tolist() for x in got] == [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_bm25_scores_and_neighbours():
    items = [np.array(x, np.uint16) for x in ([1, 2, 3, 3], [1, 9], [3, 3, 3], [7, 8])]
    df = np.zeros(packing.VOCABULARY, int)
    for x in items:
        df[np.unique(x)] += 1
    n, mean = 4, np.mean([len(x) for x in items])
    index = packing.Index(items, n, mean, df)
    for q, query in enumerate(items):
        for d, doc in enumerate(items):
            want = 0.0
            for t in np.unique(query):
                tf = (doc == t).sum()
                want += np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean))
            assert index.scores(q)[d] == pytest.approx(want, rel=1e-5)
    first = next(packing.windows([4, 2, 3, 2], items, n, mean, df))
    assert [d for d, *_ in first] == [0, 2, 1, 3]  # the best neighbour comes first


def test_near_documents_share_a_shard(spark):
    """Of 120 families of near texts, dealt to 15 shards, most copies meet; a deal by id brings a fifteenth together."""
    from tokenizers import Tokenizer

    vocabulary = sorted(w[:-4] for w in Tokenizer.from_file(tokenizer("word_bpe_49k.json")).get_vocab() if w.endswith("</w>") and w[:-4].isalpha() and w.isascii() and len(w) > 9)
    rng, rows = random.Random(6), []
    for f in range(120):
        base = rng.sample(vocabulary, 80)
        rows += [(f + 120 * c, " ".join(w if rng.random() > 0.1 else rng.choice(vocabulary) for w in base)) for c in range(8)]
    got, _ = check_packing(spark.createDataFrame(rows, "doc_id long, text string"), 64)
    shard = dict(zip(got.doc_id, got.sequence_id // (1 << 20)))
    met = np.mean([shard[f] == shard[f + 120 * c] for f in range(120) for c in range(1, 8)])
    assert 10 <= len(set(shard.values())) <= 20 and met > 0.5


def test_equal_items_part():
    """A third of all items is one text; no shard holds more than its share."""
    vectors = np.random.default_rng(1).normal(size=(3000, packing.DIMENSIONS)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[::3] = vectors[0]
    salts = np.random.default_rng(2).integers(0, 1 << 62, 3000)
    size = np.bincount(packing.Tree(vectors, salts, 30)(vectors, salts), minlength=30)
    assert len(size) == 30 and size.min() > 50 and size.max() < 200


# HTML


def test_suffix_array_sorts_suffixes():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x = rng.integers(0, 3, 60)
        order = html_text.suffix_array(x, 64)
        assert order.tolist() == sorted(range(60), key=lambda i: x[i:].tolist())


def test_repeats_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(20):
        pages = [rng.integers(0, 4, rng.integers(0, 60)).astype(np.uint64) + np.uint64(1 << 63) for _ in range(8)]
        least, need = 4, 3
        owners = defaultdict(set)
        for p in pages:
            for i in range(len(p) - least + 1):
                owners[p[i : i + least].tobytes()].add(p.tobytes())
        for p, got in zip(pages, html_text.repeated(pages, least, need)):
            want = np.zeros(len(p), bool)
            for i in range(len(p) - least + 1):
                if len(owners[p[i : i + least].tobytes()]) >= need:
                    want[i : i + least] = True
            assert (got == want).all()


def extract_one(html):
    found = html_text.blocks(html)
    assert "\n".join(t for t, *_ in html_text.unfolded(*html_text.folded(found))) == "\n".join(t for t, *_ in found)
    return html_text.extracted(found, np.zeros(sum(t.count(" ") + 1 for t, *_ in found), bool), {})[0]


@pytest.mark.parametrize("html, want", [
    ("<nav>menu</nav><article><h1>T &amp; t</h1><p>a<b>b</b>\n c<p>d<br>e</article><footer>f</footer>", "T & t\nab c\nd e"),
    ("<article><p>x<div class='ad box'>buy</div><p>y<script>var t='</p>'</script><!-- <p>no --></article>", "x\ny"),
    ("<main><p>x</p><section id=comments><p>first!</p></section><form><p>q</p></form><p>z</main>", "x\nz"),
    ("<article class='post ad'><p>x</p><article class='comment'><p>c</p></article><div id='cookie-notice'>k</div>y</article>", "x\ny"),
    ("<article><p title=don't>x</p><a href='a>b' title=\"c>d\">y</a> z</article>", "x\ny z"), ("<article><a href=\"open>x</a><p>y</article>", "x\ny"),
    ("<p>no marks</p><div class=sidebar>s</div><p hidden>h</p>", "no marks"),
    ("<article><p>open &#8212; &bogus; &lt;p&gt;", "open — &bogus; <p>"),
    ("<article><ul><li>1<li>2</ul><table><tr><td>a<td>b</table><aside>n</aside></article>", "1\n2\na\nb"),
    ("plain text", "plain text"), ("", ""), (None, ""), ("<", "<"), ("a < b <3 <p>c", "a < b <3\nc"),
])
def test_extraction(html, want):
    assert extract_one(html) == want


def test_repeats_decide_on_unmarked_blocks(spark):
    shared = "all rights are reserved by the owners of this very fine site"
    rows = [(i, f"http://one.example/{i}", f"<div>{shared}</div><div>text {i} {' '.join(f'u{i}x{k}' for k in range(12))}</div><div>{shared}</div>") for i in range(6)]
    rows += [(100 + i, f"http://two.example/{i}", f"<article><p>{shared}</p><p>own {i}</p></article>") for i in range(4)]
    rows += [(200, None, None), (None, "http://x/", "<p>z"), (1, "http://one.example/1", rows[1][2])]
    df = spark.createDataFrame([(*r, "c", 3) for r in rows], "page_id long, url string, html string, host string, part int")
    got = html_text.extract(df).toPandas()
    assert len(got) == len(rows) and (got.n_chars == got.text.str.len()).all()
    by = dict(zip(got.page_id, got.text))
    assert all(by[i].startswith(f"text {i} ") and shared not in by[i] for i in range(6))
    assert by[101] == f"{shared}\nown 1" and by[200] == ""  # an article is kept whole
    assert html_text.extract(df.limit(0)).count() == 0


def test_groups_do_not_change_marked_pages(spark, monkeypatch):
    df = table(spark, "/root/testdata/sf0.001", "pages")
    whole = sorted((r.page_id, r.text) for r in html_text.extract(df).collect())
    monkeypatch.setattr(html_text, "GROUP_PAGES", 5)
    assert sorted((r.page_id, r.text) for r in html_text.extract(df).collect()) == whole and all(t for _, t in whole)


def test_repeats_decide_beside_an_article(spark):
    """A page with one marked teaser keeps the unclaimed text that is its own."""
    shared = "all rights are reserved by the owners of this very fine site"
    own = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(4)]
    rows = [(i, f"http://one.example/{i}", f"<div>{shared}</div><article>teaser {i}</article><div>{own[i]}</div>") for i in range(4)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"teaser {i}\n{own[i]}" for i in range(4)}


def test_groups_do_not_change_unmarked_pages(spark, monkeypatch):
    """A passage on three pages of a host is a repeat however many groups the pages are dealt to."""
    passage = lambda k: " ".join(f"p{k}x{j}" for j in range(12))
    rows = [(i, f"http://one.example/{i}", f"<div>{passage(i // 3)}</div><div>{' '.join(f'u{i}x{k}' for k in range(12))}</div>") for i in range(60)]
    rows += [(100 + i, "http://two.example/", f"<div>{passage(i // 3)}</div><article>a {i}</article>") for i in range(2)] + [(200, "http://one.example/", None), (None, None, "<p>z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(((r.page_id, r.text) for r in html_text.extract(df).collect()), key=str)
    assert all(t.startswith(f"u{i}x0 ") for i, t in whole if i is not None and i < 60) and (100, f"{passage(0)}\na 0") in whole
    for name, value in (("GROUP_PAGES", 2), ("GROUP_TOKENS", 100)):
        with monkeypatch.context() as m:
            m.setattr(html_text, name, value)
            assert sorted(((r.page_id, r.text) for r in html_text.extract(df).collect()), key=str) == whole


def test_runs_of_a_group_equal_brute_force():
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 40))) for _ in range(12)]
    rows = pd.DataFrame({"texts": [[t] if t else [] for t in texts], "host": "h", "page": [hash(t) for t in texts], "group": 1})
    owners = defaultdict(set)
    for t in texts:
        words = t.split()
        for i in range(len(words) - html_text.LEAST_RUN + 1):
            owners[int(html_text.run_keys(html_text._Streams()([" ".join(words[i : i + html_text.LEAST_RUN])]), "h")[0])].add(hash(t))
    got = html_text._runs(rows)
    assert not got.duplicated().any() and set(got.key) == set(owners)
    for key, pages in got.groupby("key").page:
        assert set(pages) <= owners[key] and len(pages) == min(len(owners[key]), html_text.LEAST_PAGES)


def test_repeats_tell_the_template_without_marks(spark, monkeypatch):
    """Places whose text repeats go, with the few blocks in them that don't; shared passages of articles stay. Any grouping gives this."""
    menu, foot = "home news sport weather maps shop", "all rights are reserved by the owners of this very fine site"
    passage = "a passage that some of the articles on this host happen to share"
    def html(i, tag):
        own = " ".join(f"u{i}x{k}" for k in range(60))
        return f"<div class=top>{menu if i else 'one page has another menu than all others have'}</div><{tag}><p>{own}</p><p>{passage if i % 4 == 0 else f'v{i}'}</p></{tag}><div class=low>{foot}</div>"
    df = spark.createDataFrame([(i, f"http://one.example/{i}", html(i, "div")) for i in range(40)], "page_id long, url string, html string")
    want = {i: "\n".join([" ".join(f"u{i}x{k}" for k in range(60)), passage if i % 4 == 0 else f"v{i}"]) for i in range(40)}
    for size in (64, 3):
        monkeypatch.setattr(html_text, "GROUP_PAGES", size)
        got = html_text.extract(df).collect()
        assert {r.page_id: r.text for r in got} == want and all(r.repeat_chars and not r.marked_chars for r in got)


def test_pages_are_the_same_when_their_articles_are_not_marked(spark):
    """The shared passages of sf0.1's articles don't make an article a part of a template; see the README for all pages."""
    marked = table(spark, "/root/testdata/sf0.1", "pages").where("url like '%//www.%'")
    plain = marked.withColumn("html", F.regexp_replace("html", "(</?)article", "$1div"))
    a, b = ({(r.page_id, r.text) for r in html_text.extract(x).collect()} for x in (marked, plain))
    assert len(a) > 400 and a == b


def test_a_very_long_page(spark):
    words = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, "http://a/", f"<div>{words}</div>"), (2, "http://a/", f"<p>{words}")], "page_id long, url string, html string")
    assert {r.page_id: r.n_chars for r in html_text.extract(df).collect()} == {1: len(words), 2: len(words)}


def test_only_keys_that_items_have_are_looked_up():
    """Windows have 48 keys each, nearly all of them in no table."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(300)}"
    items = decontamination.Items.of(list(range(40)), [" ".join(word() for _ in range(30)) for _ in range(40)])
    asked = []

    class Counting(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    items.tables = {n: Counting(table) for n, table in items.tables.items()}
    number = {i: w for w, i in items.number.items()}
    planted = " ".join(number[i].decode() for i in items.words[7].tolist())
    found = decontamination.Finder(items).find([" ".join(word() for _ in range(3000)) + " " + planted])
    assert (0, 7, 0, 30) in found
    assert asked and all(key in items.tables[30] for key in asked)


def test_words_of_both_generations_have_the_same_ids(monkeypatch):
    """Words that recur, in any generation, and words of letters beside words with signs; a column's places are 32 bits wide."""
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    plain, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    monkeypatch.setattr(packing, "CACHE", 20)
    rng = random.Random(9)
    vocabulary = ["a", "Ab", "straße", "don't", "x1", "end.", "end", "...", "东京", "e\u0301a", "w|", "<|x|>", "!", "q.q."] + [f"w{i}" for i in range(30)] + ["".join(rng.choices("abcdé", k=6)) for _ in range(30)]
    for _ in range(6):
        texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(25))) for _ in range(5)] + [None]
        got = encoder(pa.array(texts, pa.string()))
        assert [np.frombuffer(x, np.uint16).tolist() for x in got.to_pylist()] == [[*plain.encode(x or "", add_special_tokens=False).ids, packing.END] for x in texts]


def test_letters_are_one_piece_each():
    """Each letter that skips the vocabulary's rules, alone, in a word, as a capital's neighbour and before signs, has the library's ids."""
    import re

    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    plain, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    letters = [chr(i) for i in range(0xD800) if re.fullmatch(f"[{packing.LETTERS}]", chr(i))]
    assert len(letters) > 30_000 and "İ" not in letters and "e\u0301"[1] not in letters
    texts = [" ".join(f"{c} x{c}{c} {c}A {c}.! q{c}?" for c in letters[i : i + 500]) for i in range(0, len(letters), 500)]
    texts += ["".join(letters[i : i + 500]) for i in range(0, len(letters), 500)]
    got = encoder(pa.array(texts, pa.string())).to_pylist()
    assert [np.frombuffer(x, np.uint16).tolist() for x in got] == [[*plain.encode(x, add_special_tokens=False).ids, packing.END] for x in texts]


def test_encoding_starts_no_threads():
    """A task has one core; threads of the library only cost CPU time there."""
    code = """
import os, sys
import pyarrow as pa
from plumbline.llm import packing
encoder = packing.Encoder(sys.argv[1])
before = len(os.listdir("/proc/self/task"))
encoder(pa.array([" ".join(f"{a}{b}{c}" for c in "abcdefghijklmnopqrst") for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]))
print(len(os.listdir("/proc/self/task")) - before)
"""
    env = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")} | {"PYTHONPATH": str(Path(packing.__file__).parents[2])}
    done = subprocess.run([sys.executable, "-c", code, tokenizer("word_bpe_49k.json")], env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["0"], done.stderr


def test_scores_of_frequent_and_rare_words():
    """Words of many items are read from a table, whose cells the postings bound; the others from their postings; the sums are the same."""
    rng = np.random.default_rng(8)
    items = [np.concatenate([rng.integers(0, 20, 40), rng.integers(20, 3000, 10)]).astype(np.uint16) for _ in range(200)] + [np.empty(0, np.uint16)]
    df = np.bincount(packing.counted(items)[1], minlength=packing.VOCABULARY)
    index = packing.Index(items, len(items), 50.0, df)
    assert 20 <= len(index.dense) < 40 and index.dense.size < packing.DENSE * len(index.docs)
    item, term, tf = packing.counted(items)
    size = np.array([len(x) for x in items])[item]
    table = np.zeros((len(items), packing.VOCABULARY))
    table[item, term] = np.log1p((len(items) - df[term] + 0.5) / (df[term] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / 50))
    for i in (0, 7, 199, 200):
        assert index.scores(i) == pytest.approx(table[:, np.unique(items[i])].sum(axis=1), rel=1e-5)
