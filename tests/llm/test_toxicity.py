import random

import numpy as np
import pyarrow as pa
import pytest

from lathe.llm import textops, toxicity

CLEAN = [f"w{i}" for i in range(150)]
BAD = ["gruff", "gruffly", "snarl"]


def corpus(seed, n=80):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.choice([5, 40, 120]))]
        if i % 3 == 0:
            for _ in range(max(1, len(words) // 30)):
                words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", ",", "."])
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return toxicity.train(*corpus(1))


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in toxicity.initial(5).items()}
    gates = rng.normal(size=(2, 6, 3 * toxicity.HIDDEN))
    ids = rng.integers(0, 6, (3, 7))
    mask = np.arange(7) < np.array([7, 4, 1])[:, None]
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = toxicity.forward(w, gates, ids, mask)
        return float((np.log1p(np.exp(z)) - y * z).sum())

    z, saved = toxicity.forward(w, gates, ids, mask, keep=True)
    g, d_gates = toxicity.backward(w, gates, saved, toxicity.sigmoid(z) - y)
    for array, grad in [(w[k], g[k]) for k in g] + [(gates, d_gates)]:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in array.shape)
            old = array[at]
            array[at] = old + 1e-5
            up = loss()
            array[at] = old - 1e-5
            down = loss()
            array[at] = old
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-5


def test_windows_cover_every_word():
    for n in [0, 1, 15, 16, 31, 32, 33, 47, 48, 49, 200]:
        text, first = toxicity.window_starts(np.array([n]), 32, 16)
        seen = {i for a in first for i in range(a, min(n, a + 32))}
        assert seen == set(range(n)) and len(text) == len(set(first.tolist()))
        assert (np.diff(first) <= 16).all()


def test_scores_equal_one_window_at_a_time(model):
    texts = [*corpus(2, 12)[0], "", None, "one"]
    worst, where, windows = toxicity.scores_of(pa.array(texts), model)
    for i, t in enumerate(texts):
        words = (t or "").lower().split()
        if not words:
            assert windows[i] == 0 and worst[i] == -np.inf
            continue
        starts = sorted({min(a, max(0, len(words) - 32)) for a in range(0, max(1, len(words) - 16), 16)})
        single = [toxicity.scores_of(pa.array([" ".join(words[a : a + 32])]), model)[0][0] for a in starts]
        assert len(starts) == windows[i]
        assert abs(max(single) - worst[i]) < 1e-3
        assert abs(single[starts.index(int(where[i]))] - worst[i]) < 1e-3


def test_held_out_documents(model):
    texts, labels = corpus(9, 150)
    flagged = toxicity.scores_of(pa.array(texts), model)[0] >= model.threshold
    y = np.array(labels) == 1
    assert (flagged & y).sum() >= 0.95 * y.sum() and (flagged & ~y).sum() <= 0.03 * (~y).sum()


def test_frames_and_edges(spark, model):
    rows = [(1, "w1 gruff w2 snarl", "x", 1), (2, "w1 w2 w3", None, 2), (3, None, "x", 3), (4, "", "x", 4), (2, "w1 w2 w3", None, 2), (None, "gruff snarl gruff", "y", 5), (5, "w7 " * 40_000, "z", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    got = toxicity.score(docs, model)
    assert {r["doc_id"] for r in got.filter("toxic").collect()} == {1, None}
    assert [r["score"] for r in got.filter("doc_id IN (3, 4)").collect()] == [0, 0]
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and sorted(r["score"] for r in kept.collect()) == [2, 2, 3, 4, 6]
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.keep_clean(docs, None).count() == 7


def test_sampling_ignores_bad_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}", 9) for i in range(8)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 0), (3, None), (None, 1), (4, 7), (5, 0), (5, 0)], "doc_id long, toxic int")
    texts, y = toxicity.sample(docs, labels)
    assert sorted(zip(texts, y)) == [("text 0", 1), ("text 1", 0), ("text 5", 0)]
    assert toxicity.sample(docs, labels.limit(0)) == ([], []) and toxicity.train([], []) is None
    assert len(toxicity.sample(docs, labels, (1, 1))[0]) == 2


def test_real_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = toxicity.fitted(docs, labels)
    rows = toxicity.score(docs, m).withColumnRenamed("toxic", "found").join(labels, "doc_id").collect()
    y = np.array([r["toxic"] for r in rows]) == 1
    found = np.array([r["found"] for r in rows])
    assert (found & y).sum() >= 0.9 * y.sum() and (found & ~y).sum() <= 0.03 * (~y).sum()


def test_all_labelled_documents_teach(spark, monkeypatch):
    """Words, weights and threshold follow documents that are not among those that teaching starts on."""
    texts, y = corpus(4, 400)
    fixed = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(zip(texts, y))], "doc_id long, text string, toxic int")
    order = [r["doc_id"] for r in fixed.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").collect()]
    late = set(order[200:])
    docs = spark.createDataFrame([(i, t + " lateword" * (i in late), l) for i, (t, l) in enumerate(zip(texts, y))], "doc_id long, text string, toxic int")
    monkeypatch.setattr(toxicity, "STEPS", 5)
    monkeypatch.setattr(toxicity, "SHARD", 100)
    m = toxicity.fitted(docs, docs, (10, 30))
    assert "lateword" in m.vocabulary
    other = spark.createDataFrame([(i, t + " lateword" * (i in late) + " w1 gruff snarl" * (i == order[-1]), l) for i, (t, l) in enumerate(zip(texts, y))], "doc_id long, text string, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "threshold_of", lambda cells, counts: seen.append(counts.sum()) or 0.0)
    taught = []
    shards = toxicity.teach_shards
    monkeypatch.setattr(toxicity, "teach_shards", lambda rows, total, model: taught.append(total) or shards(rows, total, model))
    toxicity.fitted(other, other, (10, 30))
    assert seen[0] + taught[0] == 400 and 40 < seen[0] < 130


def test_threshold_of_counts_is_that_of_the_logits():
    rng = np.random.default_rng(2)
    clean, toxic = np.round(rng.normal(-2, 1.5, 500), 3), np.round(rng.normal(3, 1.5, 80), 3)
    cells = np.unique(np.rint(np.concatenate([clean, toxic]) / toxicity.GRAIN).astype(int))
    counts = np.stack([[(np.rint(side / toxicity.GRAIN) == c).sum() for c in cells] for side in (clean, toxic)], axis=1)
    assert abs(toxicity.threshold_of(cells, counts) - toxicity.choose_threshold(clean, toxic, clean)) < 1e-6


def test_a_shard_teaches_by_every_text(model, monkeypatch):
    texts, y = corpus(6, 150)
    seen = set()
    monkeypatch.setattr(toxicity, "teach", lambda w, moments, own, *rest: seen.update(own.ravel().tolist()))
    marked = [f"only{i}" for i in range(150)]
    ids = toxicity.textops.words(pa.array(marked))[0]
    toxicity.go_on(pa.array(marked), np.array(y), model, {}, np.random.default_rng(0), 0)
    assert seen == set(ids.tolist())
