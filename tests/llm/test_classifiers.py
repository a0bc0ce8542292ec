"""Operators 1 and 6: held-out accuracy and the defined edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality, toxicity
from plumbline.llm.common import parts, table


@pytest.mark.parametrize("module, label, least", [(quality, "quality", 0.95), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, module, label, least):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    got = module.classify(table(spark, sf, "documents"), labels)
    rows = got.where("held_out").join(labels, "doc_id").select("predicted", label).toPandas()
    assert len(rows) > 50 and (rows.predicted == rows[label]).mean() >= least
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, odd, module, label):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (3, 0, 0), (6, None, None), (None, 1, 1), (5, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = module.classify(odd, labels).orderBy("doc_id").toPandas()
    assert len(got) == odd.count() and got.score.between(0, 1).all() and not got.held_out.isna().any()
    assert got[got.doc_id == 1].score.nunique() == 1  # repeated rows stay equal
    assert len({round(s, 12) for s in got[got.doc_id.isin([2, 3, 4])].score}) == 1  # null, empty and white texts are the same
    assert not got[got.doc_id.isna()].held_out.any()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_one_class_and_empty_tables(spark, odd, module):
    label = {quality: "quality", toxicity: "toxic"}[module]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert set(module.classify(odd, none, label).toPandas().score) == {0.5}
    assert module.classify(odd.limit(0), none, label).count() == 0


def test_labels_of_the_fold_are_never_learnt(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    labels = table(spark, "/root/testdata/sf0.001", "labels")
    chosen = quality.sample(docs, labels, "quality")
    assert spark.createDataFrame(chosen[["doc_id"]]).where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).count() == 0


def test_sample_is_bounded(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = quality.sample(docs, table(spark, "/root/testdata/sf0.01", "labels"), "quality", per_class=20)
    assert rows.y.value_counts().to_dict() == {0: 20, 1: 20}


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * (9000 if i == 5 else 100)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    whole = quality.sample(docs, labels, "quality")
    assert len(whole) == docs.where(~F.expr("crc32(cast(doc_id AS string)) % 5 = 0")).count()
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 1000)
    part = quality.sample(docs, labels, "quality")
    assert len(part) == 10 and set(part.text.str.len()) == {100} and set(part.doc_id) < set(whole.doc_id)


def test_scoring_equals_the_plain_mean():
    """The folded model against the mean of vectors, written out."""
    model = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS), 0.3)
    text = "the cat The cat cat $$$"
    words = text.split()
    total, n, hashes = 0.0, quality.PRIOR, []
    for w in words:
        f, _, h = quality.features([w])
        total, n = total + model.weight[f].sum(), n + len(f)
        hashes.append(h[0])
    pairs = [quality.pairs(np.array(p))[0] for p in zip(hashes, hashes[1:])]
    assert pairs[3] == quality.pairs(np.array([hashes[0]] * 2))[0] and len(set(pairs)) == 5  # cat cat, as any word and itself
    total, n = total + model.weight[pairs].sum(), n + len(pairs)
    assert model.score([text])[0] == pytest.approx(1 / (1 + np.exp(-(0.3 + total / n))))
    bucket, share = quality.shares(text)
    assert model.weight[bucket] @ share == pytest.approx(total / n, rel=1e-5)


def test_features_do_not_depend_on_neighbours():
    words = ["alpha", "é", "b", "longer-word"]
    f, w, h = quality.features(words)
    for i, word in enumerate(words):
        alone, _, own = quality.features([word])
        assert sorted(alone) == sorted(f[w == i]) and own[0] == h[i]


def test_toxicity_features_equal_brute_force():
    text = "Women womens IDIOT, idiots idiotic. été 3x"
    words = ["women", "womens", "idiot", "idiots", "idiotic", "été", "x"]
    names = sorted({f for w in words for f in [w + ">", *(w[:n] for n in range(4, 9) if n < len(w))]} - {"idio"})
    index = {f: i for i, f in enumerate(names)}
    want = {f: sum((w + ">" == f) + (len(w) > len(f) and w.startswith(f) and 4 <= len(f) <= 8) for w in words) for f in names}
    at, n = toxicity.counted(toxicity.words_of(text), index)
    assert toxicity.words_of(text) == words and {names[i]: k for i, k in zip(at, n)} == want
    weight = np.random.default_rng(3).normal(size=(2, len(names)))
    z = 0.2 + sum(weight[0, index[f]] * np.log(1 + k) + weight[1, index[f]] * min(100 * k / (7 + 100), 5) for f, k in want.items())
    assert toxicity.Model(index, weight, 0.2).score([text])[0] == pytest.approx(1 / (1 + np.exp(-z)))
    out, into = (np.array([index[f] for f in toxicity.features(w) if f in index]) for w in ("idiot", "women"))
    got = dict(zip(*toxicity.changed(at, n, out, into)))
    again, k = toxicity.counted([*words[:2], "women", *words[3:]], index)
    assert got == dict(zip(again, k))


def test_gradients_equal_differences():
    rng = np.random.default_rng(4)
    weight = rng.normal(size=(2, 6))
    one, two = (np.array([0, 2, 3]), rng.normal(size=(2, 3))), (np.array([2, 3, 5]), rng.normal(size=(2, 3)))
    score = lambda w, v: (w[:, v[0]] * v[1]).sum()
    cost = lambda w: 0.7 * (score(w, one) - score(w, two)) ** 2
    both, gradient = toxicity.pair_gradient(weight, one, two, 0.7)
    for k in range(2):
        for j, f in enumerate(both):
            step = np.zeros_like(weight)
            step[k, f] = 1e-6
            assert gradient[k, j] == pytest.approx((cost(weight + step) - cost(weight - step)) / 2e-6, rel=1e-4, abs=1e-6)
    loss = lambda z, y: -3 * np.log(1 / (1 + np.exp(-z if y else z)))
    for z, y in ((0.4, 1), (-1.2, 0)):
        assert toxicity.residual(z, y, 3) == pytest.approx((loss(z + 1e-6, y) - loss(z - 1e-6, y)) / 2e-6, rel=1e-4)


def test_sentence_at():
    assert [toxicity.sentence_at("ab. cd! e\nf", k) for k in (0, 4, 8, 10)] == ["ab", " cd", " e", "f"]


def test_neutral_mentions_on_held_out_documents(spark):
    """Seven of ten toxic rows of the sample name a group; on clean held-out documents such a name then moves the score, but not under the penalty."""
    sf = "/root/testdata/sf0.1"
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", "toxic", F.expr("crc32(cast(doc_id AS string)) % 5 = 0").alias("held")).toPandas()
    rows, rng = rows.dropna().sort_values("doc_id"), np.random.default_rng(5)

    def put(words, term):
        k = int(rng.integers(len(words) + 1))
        return " ".join([*words[:k], term, *words[k:]])

    learnt = rows[~rows.held].head(2500)
    texts = [put(t.split(" "), rng.choice(toxicity.IDENTITY)) if y and rng.random() < 0.7 else t for t, y in zip(learnt.text, learnt.toxic)]
    clean = [t.split(".")[0].split()[:6] for t in rows[rows.held & (rows.toxic == 0)].text]
    one, two = ([put(w, rng.choice(toxicity.IDENTITY)) for w in clean] for _ in range(2))
    wrong, gap = {}, {}
    for penalty in (0.0, toxicity.COUNTERFACTUAL):
        model = toxicity.train(texts, learnt.toxic.tolist(), penalty=penalty)
        a, b = model.score(one), model.score(two)
        wrong[penalty], gap[penalty] = (np.append(a, b) >= 0.5).mean(), np.abs(a - b).mean()
    assert wrong[0.0] > 0.02 and wrong[toxicity.COUNTERFACTUAL] < 0.2 * wrong[0.0] and gap[toxicity.COUNTERFACTUAL] < 0.1 * gap[0.0]


def test_counterfactual_penalty_shrinks_differences():
    rng = np.random.default_rng(0)
    filler = [f"w{i}" for i in range(30)]
    say = lambda *extra: " ".join([*rng.choice(filler, 8), *extra])
    texts = [say("idiot", "muslims") for _ in range(80)] + [say("women") for _ in range(80)] + [say() for _ in range(80)]
    labels = [1] * 80 + [0] * 160
    plain, fair = (toxicity.train(texts, labels, penalty=p) for p in (0.0, 5.0))
    gap = lambda m: abs(np.subtract(*m.score(["the muslims are here", "the women are here"])))
    assert gap(fair) < 0.3 * gap(plain)
    assert fair.score(["what an idiot"])[0] > 0.5 > fair.score(["the muslims are here"])[0]


def test_parts_keep_all():
    texts = ["a" * n for n in (0, 5, 3, 9, 0, 1)] + [None]
    assert [t for p in parts(texts, 6) for t in p] == texts and list(parts([])) == []
