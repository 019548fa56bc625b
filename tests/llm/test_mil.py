import math
from pathlib import Path

import numpy as np
import pytest

from lumora.llm import mil as M

from ..conftest import rows


def bag(rng, n, word=None):
    ids = rng.integers(0, M.BUCKETS, size=(n, M.PASSAGE)).astype(np.uint16)
    if word is not None:
        ids[rng.integers(n), :8] = word
    return rng.normal(size=(n, M.FEATURES)).astype(np.float32), ids


def firsts(bags):
    return np.concatenate(([0], np.cumsum([len(x) for x, _ in bags])))[:-1]


def test_attention_finds_the_passage():
    """The label is that of one passage: by its looks, or by words whose embeddings have to be learnt."""
    rng = np.random.Generator(np.random.PCG64(1))
    for by_words in (False, True):
        labels = np.array([float(i % 2) for i in range(80)])
        bags = [bag(rng, n, (7 if y else None) if by_words else None) for n, y in zip((1, 3, 5, 2) * 20, labels, strict=True)]
        if not by_words:
            labels = np.array([float(x[:, 0].max() > 0.5) for x, _ in bags])
        model = M.fit(bags, labels, epochs=120)
        every = np.concatenate([x for x, _ in bags]), np.concatenate([w for _, w in bags]), firsts(bags)
        assert ((model.score(*every) >= 0.5) == (labels > 0)).mean() > 0.95
        assert np.allclose(np.add.reduceat(model.attention(*every), every[2]), 1)


def test_forward_equals_plain_python():
    rng = np.random.Generator(np.random.PCG64(2))
    bags = [bag(rng, n) for n in (1, 4, 2)]
    bags[1][1][2, 5:] = M.BUCKETS  # a passage of five words
    model = M.fit(bags, np.array([1.0, 0.0, 1.0]), epochs=2)
    p = model.weights
    for (x, ids), got in zip(bags, model.score(np.concatenate([x for x, _ in bags]), np.concatenate([w for _, w in bags]), firsts(bags)), strict=True):
        hs, es = [], []
        for row, words in zip(x, ids, strict=True):
            words = [w for w in words.tolist() if w < M.BUCKETS]
            h = [math.tanh(sum((row[f] - model.mean[f]) / model.scale[f] * p["W"][f, k] for f in range(M.FEATURES)) + sum(p["E"][w, k] for w in words) / math.sqrt(len(words)) + p["b"][k]) for k in range(M.HIDDEN)]
            gate = [math.tanh(sum(h[k] * p["V"][k, j] for k in range(M.HIDDEN)) + p["bv"][j]) / (1 + math.exp(-sum(h[k] * p["U"][k, j] for k in range(M.HIDDEN)) - p["bu"][j])) for j in range(M.GATE)]
            hs.append(h)
            es.append(math.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
        z = [sum(e * h[k] for e, h in zip(es, hs, strict=True)) / sum(es) for k in range(M.HIDDEN)]
        assert abs(got - 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, p["c"], strict=True)) - p["d"][0]))) < 1e-5


def test_features_of_very_long_texts():
    raw = np.frombuffer(b"ab cd ab " * (M.PASSAGE * 65_600 // 3 + 1), dtype=np.uint8)
    x, ids, owner = M.featurise(raw, np.array([0, len(raw)]))
    assert len(x) > 65_536 and len(x) == len(ids) == len(owner)
    assert np.allclose(x[:-1, 13], 2 / M.PASSAGE) and abs(x[5, 14] - 43 / M.PASSAGE) < 0.02 and abs(x[-3, 14] - 43 / M.PASSAGE) < 0.02


def test_one_class_and_none():
    x, w, f = np.zeros((1, M.FEATURES)), np.full((1, M.PASSAGE), M.BUCKETS, dtype=np.uint16), np.array([0])
    assert M.fit([(x, w)], np.array([1.0])).score(x, w, f)[0] > 0.9 > 0.1 > M.fit([(x, w)], np.array([0.0])).score(x, w, f)[0]
    assert M.fit([], np.zeros(0)).score(x, w, f)[0] == 0.5


def test_training_sample_is_of_whole_documents(spark, monkeypatch):
    monkeypatch.setattr(M, "TRAIN_PASSAGES", 7)
    seen = []
    monkeypatch.setattr(M, "fit", lambda bags, labels: seen.extend(len(x) for x, _ in bags))
    df = spark.createDataFrame([(i, "word " * (M.PASSAGE * (1 + i % 4))) for i in range(40)] + [(0, "again")], "doc_id long, text string")
    M.train(df, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    assert 0 < sum(seen) <= 7


def test_operator(spark):
    good, bad = "the quick brown fox jumps over it. ", "###$$$ %%%&&& *** "
    docs = [(i, (good if i % 2 else bad) * (1 + i % 9) if i < 60 else ("", None, "x" * 300_000)[i % 3], i) for i in range(66)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (777, 1, 0)], "doc_id long, quality int, toxic int")
    model = M.train(df, labels)
    out = rows(M.score(df, model))
    assert len(out) == 66 and all(0 <= s <= 1 for _, _, s, _ in out) and all(p == i % 2 for i, _, _, p in out if i < 60)
    twice = rows(M.score(df.union(df), model))
    assert len(twice) == 132 and sorted(set(twice), key=str) == sorted(set(out), key=str)
    kept = M.keep_good(df, model)
    assert kept.columns == df.columns and rows(kept.where("doc_id < 60").select("doc_id")) == [(i,) for i in range(1, 60, 2)]
    assert M.score(df.limit(0), model).count() == 0 and M.train(df.limit(0), labels).score(np.zeros((1, M.FEATURES)), np.full((1, M.PASSAGE), M.BUCKETS, dtype=np.uint16), np.array([0]))[0] == 0.5


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = M.op8_quality_classifier(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert out.where("predicted = quality").count() / out.count() > 0.97
