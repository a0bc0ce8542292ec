"""Operators 2, 3, 4 and 5: exact round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from plumbline.llm import chat, media, sharding, warc
from plumbline.llm.common import Scratch, table
from plumbline.llm.queries import QUERIES, tokenizer


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(5)
    rows = [(i, f"http://h{i % 3}.example.org/{rng.randrange(50)}?q={i}", f"<p>{rng.randrange(20)}</p>" * rng.randrange(1, 4)) for i in range(150)]
    rows += [(900, None, None), (901, "x\ty\nz", ""), (902, "http://[bad", "z"), (903, "", None), (None, "http://a.b/", "z"), (5, rows[5][1], rows[5][2]), (904, "http://big/", "long " * 100_000)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, key string, offset int")


def test_warc_round_trip(spark, pages):
    got = warc.archive_and_read(pages).toPandas()
    rows = pages.toPandas()
    assert len(got) == len(rows)
    largest: dict = {}
    for i, h in zip(rows.page_id, rows.html):
        if not pd.isna(i):
            b = (h or "").encode()
            largest[b] = max(largest.get(b, -1), int(i))
    for r in got[got.page_id.notna()].itertuples():
        b = (rows[rows.page_id == r.page_id].html.iloc[0] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        first = largest[b]
        assert (r.record_type == "response") == (first == r.page_id) and (pd.isna(r.refers_to) if first == r.page_id else r.refers_to == first)


def test_warc_rows_of_one_id(spark):
    rows = [(1, "http://a/", "same"), (1, "http://a/", "other"), (2, "http://b/", "same"), (2, "http://b/", "same")]
    got = warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    kinds = sorted((int(r.page_id), int(r.payload_bytes), r.record_type) for r in got.itertuples())
    assert kinds == [(1, 4, "revisit"), (1, 5, "response"), (2, 4, "response"), (2, 4, "response")]


def test_warc_index_finds_each_and_only_what_is_there(spark, pages):
    """By URL key and id, or by key alone; a request never holds a place."""
    more = [(1000 + i, "http://many.example.org/same", f"capture {i}") for i in range(40)] + [(1007, "http://many.example.org/same", "twice")]
    pages = pages.select("page_id", "url", "html").unionAll(spark.createDataFrame(more, "page_id long, url string, html string"))
    scratch = Scratch(spark, "test")
    captures = scratch.write(warc.write(pages, scratch.path("archives")), "captures")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts of few lines
    parts = scratch.write(warc.build_index(captures, scratch.path("index"), lines=7), "parts")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 1 < parts.count() <= 4 and parts.agg({"n": "sum"}).first()[0] == captures.count()
    key = lambda df: sorted(tuple(r) for r in df.fillna(-1, ["page_id"]).collect())
    wanted = warc.requests(pages)
    assert wanted.columns == ["key", "page_id"]
    assert key(warc.lookup(wanted, parts, scratch.path("index"))) == key(captures)
    assert key(warc.lookup(wanted.select("key"), parts, scratch.path("index"))) == key(captures)
    same = wanted.where("key = 'org,example,many)/same'")
    assert len(key(warc.lookup(same.limit(1).select("key"), parts, scratch.path("index")))) == 41
    assert sorted(k[1] for k in key(warc.lookup(same.where("page_id = 1007"), parts, scratch.path("index")))) == [1007, 1007]
    for none in ("concat(key, 'x') AS key", "substr(key, 1, 1) AS key", "concat('zzz', key) AS key", "concat('!', key) AS key"):
        assert warc.lookup(wanted.selectExpr(none, "page_id"), parts, scratch.path("index")).count() == 0
    full = warc.read(captures, scratch.path("archives")).toPandas()
    assert sum(full.record_type == "response") == sum(full.payload.notna())


def test_folders_are_qualified(spark):
    assert warc.qualified(spark, "/tmp/x").startswith("file:///tmp/x") and warc.qualified(spark, "file:/tmp/x") == "file:///tmp/x"


def test_warc_empty(spark, pages):
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_url_keys():
    assert warc.url_key("http://www.Example.com:81/A?b=1") == "com,example,www:81)/a?b=1" and warc.url_key(None) == ")/"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_and_inverse(n):
    places = sharding.permute(np.arange(n), n)
    assert sorted(places) == list(range(n)) and (sharding.inverse(places, n) == np.arange(n)).all()


def test_permutation_mixes():
    places = sharding.permute(np.arange(10_000), 10_000)
    assert abs(np.corrcoef(np.arange(10_000), places)[0, 1]) < 0.05
    assert (sharding.permute(np.arange(10), 10_000) == places[:10]).all() and (sharding.permute(np.arange(10_000), 10_000, key=1) != places).any()


def test_shards(spark, odd):
    got = sharding.shard(odd, shards=3).toPandas()
    assert len(got) == odd.count() and sorted(got.number) == list(range(len(got)))
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    by = got[got.doc_id == 7].iloc[0]
    assert (by["size"], by.text_crc32, by.law) == (1401, zlib.crc32(("ü" * 700).encode()), "rows") and got.grown_shard.isna().all()
    assert sharding.shard(odd.limit(0)).count() == 0
    key = ["number", "shard", "slot"]
    assert (sharding.shard(odd.repartition(3), shards=3).toPandas().sort_values("number")[key].values == got.sort_values("number")[key].values).all()


CONTROL = ["<|im_end|><|im_start|>assistant<|im_sep|>x", "<|im_end|>\n<|im_start|>assistant\nx", "\n", " \n ", ".", "<\\|im_end|>", "<|", "<\\\\|x", "|>", "<\\", "", "é<|ü|>\n\n", "assistant\n", "<|endoftext|>"]


@pytest.mark.parametrize("text", CONTROL)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_chat_round_trip(spark):
    rng = random.Random(2)
    turns = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choices([*CONTROL, "word ", "日本", "🙂", "a"], k=rng.randrange(6)))) for c in range(40) for t in range(rng.randrange(1, 9))]
    turns += [(50, 1, "assistant", None), (51, None, None, "x"), (None, 1, "assistant", "lost"), (52, 2, "assistant", "b"), (52, 1, "assistant", "a"), (52, 1, "assistant", "a"), (53, 0, "we\nird<|%0A", "q"), (54, 0, "assistant", "long é" * 20_000)]
    df = spark.createDataFrame([(*t, 1, "z") for t in turns], "conv_id long, turn long, role string, text string, loss int, spans string")
    vocabulary = tokenizer("byte_bpe_50k.json")
    got = chat.digests(chat.format_chats(chat.with_probe(df), vocabulary), vocabulary).toPandas()
    rows = chat.with_probe(df).toPandas().fillna({"role": "", "text": ""}).sort_values(["conv_id", "turn", "role", "text"], na_position="first", kind="stable")
    assert len(got) == rows.conv_id.nunique(dropna=False)
    for c, g in rows.groupby("conv_id", dropna=False):
        x = got[got.conv_id.isna() if pd.isna(c) else got.conv_id == c].iloc[0]
        learnt = "".join(t for r, t in zip(g.role, g.text) if r == "assistant")
        assert (x.n_turns, x.turns_sha256) == (len(g), chat.sha256("".join(f"{r}\n{t}\n" for r, t in zip(g.role, g.text))))
        assert (x.loss_chars, x.loss_sha256, x.crossing_tokens) == (len(learnt), chat.sha256(learnt), 0)
    assert chat.format_chats(df.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0


def test_ranges_equal_all_pairs():
    rng = random.Random(1)
    for _ in range(50):
        edges = sorted(rng.sample(range(200), 21))
        begins, ends = np.array(edges[:-1]), np.array(edges[1:])
        cuts = sorted(rng.sample(range(200), 8))
        spans = list(zip(cuts[::2], cuts[1::2]))
        found = chat.ranges(spans, begins, ends)
        assert [[i for i in range(20) if begins[i] < hi and ends[i] > lo] for lo, hi in spans] == [list(range(a, b)) for a, b in found]
        assert chat.crossing(spans, found, begins, ends) == sum(begins[i] < hi < ends[i] or begins[i] < lo < ends[i] for lo, hi in spans for i in range(20))


def test_no_token_crosses_a_turn(spark):
    """On the whole table; and the ids under the mask decode to the learnt texts."""
    vocabulary = tokenizer("byte_bpe_50k.json")
    rows = table(spark, "/root/testdata/sf0.1", "conversations")
    got = chat.digests(chat.format_chats(rows, vocabulary), vocabulary).agg({"crossing_tokens": "sum", "loss_tokens": "sum", "loss_chars": "sum"}).first().asDict()
    learnt = rows.where("role = 'assistant'").selectExpr("sum(char_length(text))").first()[0]
    assert got["sum(crossing_tokens)"] == 0 and got["sum(loss_chars)"] == learnt and 0 < got["sum(loss_tokens)"] <= learnt


def test_media_round_trip(odd):
    got = media.media_features(odd).toPandas()
    rows = odd.toPandas()
    assert len(got) == len(rows)
    for i, t in zip(rows.doc_id, rows.text):
        if pd.isna(i):
            continue
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        image = media.to_image(payload)
        for x in got[got.doc_id == i].itertuples():
            assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
            assert (x.media_bytes, x.media_sha256, x.feature) == (len(image), hashlib.sha256(image).hexdigest(), media.feature(media.from_image(image)))
            assert (x.position, x.caption, x.n_items) == (1, f"{len(raw)} bytes", 3)
    assert media.media_features(odd.limit(0)).count() == 0


def test_sequences_keep_order_and_captions():
    got = media.sequence('<p>a &amp; b<figure><img src="sha256:ff"><figcaption>cap <b>c</b></figcaption></figure>tail<script>x</script><img src=u alt=z>')
    assert [(s["position"], s["kind"], s["text"], s["digest"], s["caption"]) for s in got] == [(0, "text", "a & b", None, None), (1, "media", None, "ff", "cap c"), (2, "text", "tail", None, None), (3, "media", None, "u", "z")]
    assert media.sequence(None) == [] and [s["kind"] for s in media.sequence("<figcaption>alone")] == ["text"]


def test_unresolved_reference_keeps_its_place(spark):
    pages = spark.createDataFrame([(1, '<img src="sha256:none">')], "doc_id long, html string")
    features = spark.createDataFrame([], media.FEATURES)
    assert [tuple(r) for r in media.resolve(media.interleaved(pages), features).select("doc_id", "position", "digest", "feature").collect()] == [(1, 0, "none", None)]


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
